"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
Shared tables are written inside the query that needs them first, so their
cost is counted once; each query is run in full through a no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from filmfold.operators import model, recommend  # noqa: E402
from filmfold.plans import artifacts, queries  # noqa: E402
from filmfold.session import build_session  # noqa: E402

HEADLINE = [
    "popular_movies", "movie_stats", "top_rated_min_support", "rating_distribution_pct", "matrix_sparsity",
    "null_audit", "duplicate_count", "scan_csv_ratings", "user_history", "title_display", "title_variants",
    "title_match", "poster_resolve", "poster_upsert", "score_pairs", "topk_per_user", "export_films",
    "export_user_picks", "serve_precomputed", "genre_mix", "route_requests", "hash_split", "rmse_global_mean",
    "als_train", "als_predict", "recommend_all", "recommend_users", "bayesian_average", "request_candidates",
    "anchor_ladder", "foldin_rows", "gram_matrix", "foldin_solve", "genre_fit", "mood_rank", "mood_recommend",
]


def one_user_cold(spark, sf_dir):
    """A single known user asks; the model is loaded first."""
    return one_user(spark, sf_dir, artifacts.trained_model(spark, sf_dir))


def one_user(spark, sf_dir, trained):
    """A single known user asks the loaded model, history removed, titles attached."""
    return recommend.recommend_user(
        trained.userFactors, trained.itemFactors, artifacts.ratings_table(spark, sf_dir),
        queries.V.movies(spark, sf_dir), 1,
    )


def one_user_clustered(spark, sf_dir, trained, user_id=1):
    """The same question to tables clustered by user; they are written with the model, not with the answer."""
    vectors = artifacts.vectors_by_user(spark, sf_dir, "model", lambda: trained.userFactors)
    return recommend.answer_user(
        vectors, trained.itemFactors, artifacts.ratings_by_user(spark, sf_dir),
        artifacts.titles_by_film(spark, sf_dir), user_id,
    )


def one_user_stored(spark, sf_dir):
    """The same question answered from the written picks."""
    return artifacts.model_top(spark, sf_dir).filter("userId = 1")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    # start-up is not a query
    queries.QUERIES["rating_histogram"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    runs = {name: queries.QUERIES[name] for name in HEADLINE}
    loaded = []

    def scan(spark, sf_dir):
        return one_user(spark, sf_dir, loaded[0])

    def warm(spark, sf_dir):
        return one_user_clustered(spark, sf_dir, loaded[0])

    runs |= {"one_user_cold": one_user_cold, "one_user_scan": scan, "one_user": warm, "one_user_stored": one_user_stored}
    seconds = {}
    for name, run in runs.items():
        if run is scan:
            loaded.append(artifacts.trained_model(spark, sf_dir))
        if run is warm:  # the tables are written, and another user has asked before
            one_user_clustered(spark, sf_dir, loaded[0], user_id=2).collect()
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    _, test = model.hash_split(artifacts.ratings_table(spark, sf_dir))
    error = model.rmse(model.predict(artifacts.trained_model(spark, sf_dir), model.als_input(test))).first()
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf"), "cpus": cpus,
        "als_test_rmse": round(error["rmse"], 4),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
