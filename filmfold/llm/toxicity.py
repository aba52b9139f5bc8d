"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F, types as T

from filmfold.llm.common import hashes, mixed, signed, texts, words, written

#: From this score on a document is toxic.
THRESHOLD = 0.3
#: Bounds of the training sample: documents with a confirmed toxic label, and documents taken as unlabelled.
MOST_POSITIVE, MOST_UNLABELLED = 6000, 18_000
#: Word beginnings of these lengths are features, and whole words.
STEMS = (4, 5, 6, 7)
#: A feature is kept if it is in enough positives, and if the prior times its share there is PRECISION or more of its
#: share in the unlabelled text: an estimate of how many of the texts with it are toxic. Of those the MOST_FEATURES with
#: the highest share.
PRECISION, MOST_FEATURES = 0.6, 4000
#: Steps of training at most, how often the risk on the rows held back is looked at, one row in how many is held back.
STEPS, RATE, DECAY, LOOK, BACK = 1200, 0.2, 2e-5, 25, 5


def least_rows(n_positive: int) -> float:
    """Positives that must hold a feature: three, one in twenty, eight, then two in a thousand, as the sample grows."""
    return max(3, min(8, 0.05 * n_positive), 0.002 * n_positive)

WORDS = regex.compile(r"\p{L}+")


def features_of(word: str) -> list[str]:
    return [word[:n] for n in STEMS if len(word) > n] + [word + "$"]


def document_features(text: str | None) -> set[str]:
    found = set(WORDS.findall(text.lower())) if text else set()
    return {feature for word in found for feature in features_of(word)}


class Model(NamedTuple):
    """Weights of features that a document holds, and a constant."""

    weights: dict[str, float]
    bias: float


def copy_keys(text: str | None) -> tuple[int, int, int]:
    """The least hashes, in three orders, of the runs of three words: near copies have one in common, other texts none."""
    tokens = words(text)
    ids = hashes(tokens, len(tokens))
    runs = mixed(mixed(mixed(ids[:-2]) + ids[1:-1]) + ids[2:]) if len(ids) > 2 else ids.sum(keepdims=True, dtype=np.uint64)
    return tuple(int(signed(order.min(keepdims=True))[0]) for order in (runs, mixed(runs), mixed(mixed(runs))))


def held_out(docs: DataFrame) -> DataFrame:
    """Add ``held_out``: labels of these rows are for measuring only."""
    return docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))


def risk_gradient(scores: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Derivative by score of the non-negative estimate of the logistic risk.

    The unlabelled text is a mixture, so its loss as negatives, less the
    positives' part in it (prior times their loss as negatives), estimates the
    loss on true negatives. Where that falls below zero the model has begun to
    fit the toxic part of the unlabelled text, and the step goes back.
    """
    chance = 1 / (1 + np.exp(-scores))
    loss_as_negative = np.logaddexp(0, scores)
    n_positive, n_unlabelled = positive.sum(), (~positive).sum()
    negative = loss_as_negative[~positive].mean() - prior * loss_as_negative[positive].mean()
    as_positive = np.where(positive, prior * (chance - 1) / n_positive, 0)
    as_negative = np.where(positive, -prior * chance / n_positive, chance / n_unlabelled)
    return as_positive + as_negative if negative >= 0 else -as_negative


def risk(scores: np.ndarray, positive: np.ndarray, prior: float) -> float:
    """The non-negative estimate itself."""
    as_negative = np.logaddexp(0, scores)
    negative = as_negative[~positive].mean() - prior * as_negative[positive].mean()
    return prior * np.logaddexp(0, -scores[positive]).mean() + max(0.0, negative)


def constant_for(scores: np.ndarray, prior: float) -> float:
    """What to add to the scores of unlabelled text so that their mean chance is the prior."""
    low, high = -60.0, 60.0
    for _ in range(80):
        middle = (low + high) / 2
        if (1 / (1 + np.exp(-np.clip(scores + middle, -50, 50)))).mean() < prior:
            low = middle
        else:
            high = middle
    return (low + high) / 2


def fit(rows: list[np.ndarray], positive: np.ndarray, size: int, prior: float) -> tuple[np.ndarray, float]:
    """Weights and constant for rows of feature numbers, by Adam over the whole sample in each step.

    One row in BACK is held back where both kinds have some; the weights are
    those of the step with the least risk there. The constant follows the prior
    at every look and in the end, since steps that go back would lift it.
    """
    back = np.zeros(len(rows), bool)
    for kind in (positive, ~positive):
        back[np.flatnonzero(kind)[BACK - 1::BACK]] = True
    if not (back & positive).any() or not (back & ~positive).any():
        back[:] = False
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows).astype(np.int64) if rows else np.empty(0, np.int64)
    used = ~back[row]
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    best, least = theta.copy(), np.inf
    for step in range(1, STEPS + 1):
        scores = np.bincount(row, theta[column], len(rows)) + theta[-1]
        slope = np.zeros(len(rows))
        slope[~back] = risk_gradient(np.clip(scores[~back], -50, 50), positive[~back], prior)
        gradient = np.append(np.bincount(column[used], slope[row[used]], size), slope.sum()) + DECAY * np.append(theta[:-1], 0)
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        theta -= RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        if step % LOOK == 0:
            scores = np.bincount(row, theta[column], len(rows))
            theta[-1] = constant_for(scores[~positive], prior)
            looked = back if back.any() else ~back
            found = risk(np.clip(scores[looked] + theta[-1], -50, 50), positive[looked], prior)
            if found < least:
                best, least = theta.copy(), found
    return best[:-1], float(best[-1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on toxic labels and unlabelled text, both outside the held-out rows.

    The labels give the positives and, as their share of all labelled rows, the
    class prior; rows labelled clean are never used as negatives. Samples are
    bounded (the ids drawn are broadcast, the bound is theirs) and drawn by a
    hash of the id, the same on every run; how frequent each feature is in them is counted in parallel, and only the chosen
    features of the sampled rows reach the driver.

    Null ids, texts and labels are left out. Without a positive label the model
    knows no feature and gives every text the same low score.
    """
    known = held_out(labels.select("doc_id", "toxic")).filter("not held_out and doc_id is not null and toxic is not null")
    counted = known.agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("rows")).first()
    prior = min(0.5, max(0.001, (counted["toxic"] or 0) / max(1, counted["rows"])))
    turn = F.xxhash64("doc_id", F.lit("sample"))
    names = known.filter("toxic = 1").select("doc_id").distinct().orderBy(turn).limit(MOST_POSITIVE)
    usable = held_out(docs.select("doc_id", "text")).filter("not held_out and text is not null and doc_id is not null")
    total = docs.count()
    # A third more than wanted, since the share is met on average only; the limit takes the first by hash.
    share = min(1.0, 2 * MOST_UNLABELLED / max(1, total))
    below = int(-(2 ** 63) + share * (2 ** 64 - 1)) if share < 1 else 2 ** 63 - 1
    drawn = usable.filter(turn <= F.lit(below)).select("doc_id").orderBy(turn, "doc_id").limit(MOST_UNLABELLED)
    chosen = written(names.withColumn("positive", F.lit(1)).union(drawn.withColumn("positive", F.lit(0))), "sample-ids")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.array([copy_keys(t) for t in texts(batch["text"])], np.int64).reshape(-1, 3)
            for i in range(3):
                batch = batch.append_column(f"copy{i}", pa.array(keys[:, i]))
            yield batch

    # Copies of one toxic text would make each of its words look toxic, so of copies the first in turn is used.
    sample = usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "positive", turn.alias("turn"), "text")
    sample = sample.mapInArrow(keyed, "positive int, turn long, text string, copy0 long, copy1 long, copy2 long")
    for i in range(3):
        alike = Window.partitionBy("positive", f"copy{i}").orderBy("turn", F.xxhash64("text"))
        sample = sample.withColumn("nth", F.row_number().over(alike)).filter("nth = 1")
    sample = written(sample.select("positive", "turn", "text"), "sample")
    n_positive, n_unlabelled = (sample.filter(f"positive = {p}").count() for p in (1, 0))
    if not n_positive or not n_unlabelled:
        return Model({}, float(np.log(prior / (1 - prior))))

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for positive, text in zip(batch["positive"].to_pylist(), texts(batch["text"])):
                found = list(document_features(text))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found, pa.string()), pa.array([positive] * len(found), pa.int32())],
                    names=["feature", "positive"])

    counts = sample.mapInArrow(explode, "feature string, positive int").groupBy("feature").agg(
        F.sum("positive").alias("p"), F.sum(1 - F.col("positive")).alias("u"))
    precision = prior * (F.col("p") / n_positive) / ((F.col("u") + 0.5) / n_unlabelled)
    best = counts.filter((F.col("p") >= least_rows(n_positive)) & (precision >= PRECISION)).orderBy(F.desc("p"), "feature").limit(MOST_FEATURES)
    number = {r["feature"]: i for i, r in enumerate(best.select("feature").collect())}

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(number[f] for f in document_features(t) & number.keys()) for t in texts(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["positive"], batch["turn"], pa.array(found, pa.list_(pa.int32()))], names=["positive", "turn", "features"])

    rows = sample.mapInArrow(select, "positive int, turn long, features array<int>").toArrow()
    rows = rows.sort_by([("turn", "ascending"), ("positive", "ascending")])
    arrays = [np.array(x, np.int64) for x in rows["features"].to_pylist()]
    weights, bias = fit(arrays, rows["positive"].to_numpy().astype(bool), len(number), prior)
    return Model({f: float(weights[i]) for f, i in number.items()}, bias)


class _Hits(dict):
    """The model's features in each word met before; most have none."""

    def __init__(self, weights: dict[str, float], most: int = 400_000):
        super().__init__()
        self.weights, self.most = weights, most

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > self.most:
            self.clear()
        found = self[word] = tuple(f for f in features_of(word) if f in self.weights)
        return found


def score_text(text: str | None, model: Model, hits: _Hits) -> float:
    found = set(WORDS.findall(text.lower())) if text else ()
    features = {f for some in filter(None, map(hits.__getitem__, found)) for f in some}
    total = model.bias + sum(map(model.weights.__getitem__, sorted(features)))
    return float(1 / (1 + np.exp(-np.clip(total, -50, 50))))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs, ``score`` (0 to 1) and ``predicted`` (1 from THRESHOLD on), read from ``text`` alone.

    Null and empty texts get the score of a text without any known feature.
    Columns of the same names are replaced. Repeated rows get the same score.
    No shuffle; the model is bounded by its features.
    """
    docs = docs.drop("score", "predicted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = _Hits(model.weights)
        for batch in batches:
            scores = np.array([score_text(t, model, hits) for t in texts(batch["text"])], float)
            yield batch.append_column("score", pa.array(scores, pa.float64())).append_column(
                "predicted", pa.array((scores >= THRESHOLD).astype(np.int32)))

    schema = T.StructType([*docs.schema, T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
