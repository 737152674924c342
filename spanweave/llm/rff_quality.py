"""Quality classifier: random Fourier features of document statistics, ridge by partition-summed normal equations,
isotonic calibration.

The Gaussian kernel exp(-g |x - y|^2) is the expectation of z(x).z(y) with z(x) = sqrt(2/D) cos(Wx + b), W normal with
variance 2g, b uniform. Ridge regression on z needs only sums of z z' and z y, which partitions add up by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S
from spanweave.llm.doc_stats import FEATURES, labelled, statistics, with_statistics

#: Labelled rows a fit reads at most; the fit's cost and what reaches the driver do not grow beyond it.
MAX_LABELLED = 30_000
DIMENSIONS, RIDGE, SEED, PARTS = 192, 1e-3, 7, 8
CALIBRATION_FOLD = 3


@dataclass(frozen=True)
class QualityModel:
    """weights None: no labels of both classes, so each score is `prior`."""

    prior: float
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w: np.ndarray | None = None
    b: np.ndarray | None = None
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    levels: np.ndarray | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _lift(x, self.mean, self.scale, self.w, self.b) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0.0, 1.0)


def _lift(x: np.ndarray, mean: np.ndarray, scale: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.clip((x - mean) / scale, -6, 6) @ w + b
    return np.hstack([np.sqrt(2 / len(b)) * np.cos(z), np.ones((len(x), 1))])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots and non-decreasing levels; equal x are one point; levels shrink a little to the mean."""
    at, inverse, count = np.unique(x, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, weights=y)
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for t, c, v in zip(total.tolist(), count.tolist(), at.tolist()):
        blocks.append([t, c, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    prior = float(y.mean())
    return np.array([v for k in blocks for v in k[2:]]), np.array([(k[0] + prior) / (k[1] + 1) for k in blocks for _ in "12"])


def _sums(rows: DataFrame, lift: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Of z z' and z y over all rows: each partition sends one packed sum."""
    size = len(lift[3]) + 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
            z = _lift(x, *lift)
            gram += z.T @ z
            right += z.T @ batch.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([right.tobytes()])], ["g", "r"])

    got = rows.repartition(PARTS).select("features", "y").mapInArrow(add, "g binary, r binary").collect()  # PARTS rows
    return sum(np.frombuffer(x.g).reshape(size, size) for x in got), sum(np.frombuffer(x.r) for x in got)


def fit(stats: DataFrame, labels: DataFrame, *, target: str = "quality", key: str = "doc_id", most: int = MAX_LABELLED) -> QualityModel:
    """Fits on at most `most` labelled rows outside the held-out fold; fold 3 of crc32 calibrates, the others regress."""
    with S.scratch(stats.sparkSession):
        return _fit(stats, labels, target, key, most)


def _fit(stats: DataFrame, labels: DataFrame, target: str, key: str, most: int) -> QualityModel:
    rows = S.written(labelled(stats, S.label_sample(labels, target, most, key), key=key))
    about = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), *(f(F.get("features", F.lit(i))).alias(f"{k}{i}") for i in range(len(FEATURES)) for k, f in (("a", F.avg), ("s", F.stddev_pop)))).first()
    if not about.n or about.m in (0.0, 1.0):
        return QualityModel(prior=float(about.m) if about.n else 0.5)
    mean = np.array([about[f"a{i}"] for i in range(len(FEATURES))])
    scale = np.array([about[f"s{i}"] or 1.0 for i in range(len(FEATURES))])
    chance = np.random.default_rng(SEED)
    gamma = 1 / (4 * len(FEATURES))
    lift = (mean, scale, chance.normal(0, np.sqrt(2 * gamma), (len(FEATURES), DIMENSIONS)), chance.uniform(0, 2 * np.pi, DIMENSIONS))
    gram, right = _sums(rows.where(F.col("fold") != CALIBRATION_FOLD), lift)
    n = max(gram[-1, -1], 1.0)
    weights = np.linalg.solve(gram + RIDGE * n / DIMENSIONS * np.eye(len(gram)), right)
    held = rows.where(F.col("fold") == CALIBRATION_FOLD).select("features", "y").collect()  # bounded by `most`
    model = QualityModel(float(about.m), *lift, weights)
    if not held:
        return QualityModel(float(about.m), *lift, weights, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    knots, levels = isotonic(model.raw(np.array([x.features for x in held], float)), np.array([x.y for x in held]))
    return QualityModel(float(about.m), *lift, weights, knots, levels)


def score(stats: DataFrame, model: QualityModel, *, key: str = "doc_id", threshold: float = 0.7) -> DataFrame:
    """key, held_out, score, predicted (1 if score >= threshold) of each row of with_statistics()."""
    kind = stats.schema[key].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], [key, "held_out", "score"])

    scored = stats.select(key, S.held_out(key).alias("held_out"), "features").mapInArrow(apply, f"`{key}` {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", target: str = "quality", threshold: float = 0.7) -> DataFrame:
    """Scores every row's whole text: key, held_out, score, predicted.

    Equal texts get equal scores; a null or empty text is scored as a text without words. Without labels of both classes
    every score is the share of label 1 (0.5 without labels). The statistics are written once and read by fit and score.
    """
    stats = S.written(with_statistics(docs, key=key, text=text))
    return score(stats, fit(stats, labels, target=target, key=key), key=key, threshold=threshold)


def keep(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", target: str = "quality", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns kept, whose score is at least threshold.

    The fit takes statistics of the labelled sample only; the filter takes them from each text as it passes, so that no
    text is shuffled and each is looked at once. A null or empty text is scored as one without words; repeated rows and
    null keys are judged by their text; an empty table gives no rows. Columns may have any names.
    """
    sample = S.label_sample(labels, target, MAX_LABELLED, key).select(F.col(key).alias("_wanted"))
    labelled_docs = docs.select(key, text).join(F.broadcast(sample), F.col(key) == F.col("_wanted")).select(key, text)  # MAX_LABELLED bounds the sample
    model = fit(with_statistics(labelled_docs, key=key, text=text), labels, target=target, key=key)
    rows = docs.select(S.text_bytes(text).alias("_b"), *(F.col(c).alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            x = np.array([statistics(b)[1] for b in S.byte_values(batch.column(0))], float).reshape(-1, len(FEATURES))
            good = batch.filter(pa.array(model.score(x) >= threshold))
            yield pa.RecordBatch.from_arrays(good.columns[1:], good.schema.names[1:])

    return rows.mapInArrow(judge, schema).toDF(*docs.columns)
