"""Splitting, training, tuning and evaluating the latent-factor model."""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from filmfold import fixed
from filmfold.operators import als as blocked
from filmfold.session import ensure_checkpoint_dir, materialise

SEED = 42
BLOCK_ROWS = 48_000_000  # ratings of one block, held by one task
FEW_BLOCKS = 4  # blocks that any large input has
COPIES = 150_000_000  # blocks times ratings, up to which there are as many blocks as cores
CHECKPOINT = 2  # iterations whose shuffle files lie on disk together
PARALLEL_FITS = 3  # settings tried side by side
MLLIB_ROWS = 16_000_000  # ratings up to which MLlib fits; beyond, it takes either few cores or much shuffling


def als_input(ratings: DataFrame) -> DataFrame:
    return ratings.select("userId", "movieId", "rating")


def split_bucket(user: Column, movie: Column) -> Column:
    """0..9 from a hash of the pair: the same for any partitioning or rerun."""
    digest = F.md5(F.concat_ws(":", user.cast("string"), movie.cast("string")))
    return (F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint") % 10).cast("int")


def hash_split(ratings: DataFrame, train_tenths: int = 8) -> tuple[DataFrame, DataFrame]:
    """80/20 split that survives repartitioning and recomputation, by filter only."""
    bucket = split_bucket(F.col("userId"), F.col("movieId"))
    return ratings.filter(bucket < train_tenths), ratings.filter(bucket >= train_tenths)


def random_split(ratings: DataFrame, train_share: float = 0.8, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Seeded random split. Give it a written table: the parts are cut per
    partition, so both must see the same partitions."""
    train, test = ratings.randomSplit([train_share, 1 - train_share], seed=seed)
    return train, test


def block_count(train_set: DataFrame) -> int:
    """Factor blocks to train with: as many as the ratings need, and as there are cores while the ratings are few.

    Every iteration sends each vector to nearly every block of the other side,
    so what is shuffled grows with vectors times blocks.
    """
    cores, n = train_set.sparkSession.sparkContext.defaultParallelism, train_set.count()
    spread = min(cores, max(FEW_BLOCKS, COPIES // max(1, n)))
    return max(spread, -(-n // BLOCK_ROWS))


def estimator(
    spark: SparkSession,
    rank: int = fixed.RANK,
    reg_param: float = fixed.REG_PARAM,
    max_iter: int = fixed.MAX_ITER,
    blocks: int = 10,
) -> ALS:
    """Explicit, non-negative ALS; unseen users and films are dropped from predictions."""
    ensure_checkpoint_dir(spark)
    return ALS(
        rank=rank, regParam=reg_param, maxIter=max_iter,
        userCol="userId", itemCol="movieId", ratingCol="rating",
        coldStartStrategy="drop", nonnegative=True, seed=SEED,
        numUserBlocks=blocks, numItemBlocks=blocks, checkpointInterval=CHECKPOINT,
    )


def _model(als: ALS, rank: int, factors: tuple[DataFrame, DataFrame]) -> ALSModel:
    """A model of given vectors with the columns and settings of the estimator."""
    users, items = factors
    made = users.sparkSession.sparkContext._jvm.org.apache.spark.ml.recommendation.ALSModel(als.uid, rank, users._jdf, items._jdf)
    return als._copyValues(ALSModel(made))


def train(train_set: DataFrame, **params) -> ALSModel:
    """Explicit, non-negative ALS: by MLlib for few ratings or a given number of blocks, else by ``operators.als``."""
    if "blocks" in params or train_set.count() <= MLLIB_ROWS:
        params.setdefault("blocks", block_count(train_set))
        return estimator(train_set.sparkSession, **params).fit(als_input(train_set))
    als = estimator(train_set.sparkSession, **params)
    sides = blocked.prepare(als_input(train_set))
    fitted = _model(als, als.getRank(), blocked.fit(*sides, als.getRank(), als.getRegParam(), als.getMaxIter(), SEED))
    blocked.release(*sides)
    return fitted


def predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Add ``prediction``; rows whose user or film is not in the model drop out."""
    return model.transform(pairs)


def rmse(predictions: DataFrame, label: str = "rating", prediction: str = "prediction") -> DataFrame:
    error = F.col(prediction).cast("double") - F.col(label)
    return predictions.agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse")
    )


def global_mean_rmse(train_set: DataFrame, test_set: DataFrame) -> DataFrame:
    """Error of always predicting the training mean."""
    mean = train_set.agg(F.avg("rating")).scalar()
    return rmse(test_set.withColumn("prediction", mean))


def tuned_models(train_set: DataFrame, configs=None, parallel: int = PARALLEL_FITS) -> list[tuple[tuple, ALSModel]]:
    """A model for every (rank, reg, iterations) setting, ``parallel`` of them fitted side by side.

    The settings are a list, not a cross product. The training set is written
    once and read by all fits. Of MLlib's fits each holds its own blocks, so
    ``parallel`` bounds their memory; the others read the same packed blocks
    and hold no more than their running tasks do.
    """
    configs = list(configs or fixed.TUNING_CONFIGS)
    spark = train_set.sparkSession
    written = materialise(als_input(train_set), "tuning-set")
    if written.count() > MLLIB_ROWS:
        sides = blocked.prepare(written)

        def fit(config: tuple) -> ALSModel:
            r, reg, n = config
            return _model(estimator(spark, r, reg, n), r, blocked.fit(*sides, r, reg, n, SEED))

        with ThreadPool(max(1, min(parallel, len(configs)))) as pool:
            models = pool.map(inheritable_thread_target(spark)(fit), configs, chunksize=1)
        blocked.release(*sides)
        return list(zip(configs, models))
    als = estimator(spark, blocks=block_count(written))
    maps = [{als.rank: r, als.regParam: reg, als.maxIter: n} for r, reg, n in configs]
    fits, models = als.fitMultiple(written, maps), [None] * len(maps)

    def fit_next(_: int) -> None:
        index, fitted = next(fits)
        models[index] = fitted

    with ThreadPool(max(1, min(parallel, len(maps)))) as pool:
        pool.map(inheritable_thread_target(spark)(fit_next), range(len(maps)), chunksize=1)
    return list(zip(configs, models))


def tune(models: list[tuple[tuple, ALSModel]], test_set: DataFrame) -> DataFrame:
    """Test error of every setting; the lowest is marked."""
    rows = [
        rmse(predict(model, test_set)).select(
            F.lit(r).alias("rank"), F.lit(reg).alias("reg_param"), F.lit(n).alias("max_iter"),
            F.col("n").alias("n_scored"), "rmse",
        )
        for (r, reg, n), model in models
    ]
    results = reduce(DataFrame.unionByName, rows)
    lowest = F.min("rmse").over(Window.partitionBy())  # one row per setting
    return results.withColumn("is_best", F.col("rmse") == lowest)


def save(model: ALSModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> ALSModel:
    return ALSModel.load(path)


def factor_summary(model: ALSModel) -> DataFrame:
    """Vectors per side, how many have the wrong length or a negative entry."""
    sides = [("user", model.userFactors), ("item", model.itemFactors)]
    return reduce(DataFrame.unionByName, [
        factors.agg(
            F.count(F.lit(1)).alias("n_factors"),
            F.count_if(F.size("features") != model.rank).alias("n_bad_length"),
            F.count_if(F.array_min("features") < 0).alias("n_negative"),
        ).withColumn("side", F.lit(side))
        for side, factors in sides
    ])
