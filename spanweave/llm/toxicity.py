"""Toxic passages by maximum-scoring segments.

Each word gets a score: the log-odds of its unit between toxic and other labelled documents under an informative
Dirichlet prior (a word's prior counts follow its beginning's). A unit is the word or, for a word not counted often
enough, its longest counted beginning, so that inflected and compounded insults are met too. Words without a positive
unit cost a constant. A linear-time scan lists all maximal segments of a document's scores, that is all disjoint
passages. Their scores follow extreme-value statistics: E = K n exp(-lambda S) passages of score S are expected in n
harmless words. A logistic curve over those calibrated values gives the probability of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S

#: Bounds of what a fit reads and of the model that executors get, at every input size.
MAX_LABELLED, MAX_UNITS = 20_000, 200_000
BEGINNINGS = (9, 7, 6, 5, 4)
PRIOR, LEAST_PRIOR, LEAST_COUNT, LEAST_Z, LEAST_LOG_ODDS, COST, SIGNIFICANT = 10.0, 0.5, 4, 2.5, 0.5, -0.25, 0.05
CALIBRATION_FOLD, RIDGE = 3, 0.05
#: Upper to lower case A-Z; ASCII points and symbols part words. Other bytes stay.
_TABLE = bytes(x + 32 if 65 <= x <= 90 else x if x > 127 or chr(x).isalnum() else 32 for x in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def units(word: bytes) -> list[bytes]:
    """The word, then its beginnings, longest first. A beginning ends with *, which no word holds."""
    return [word, *(word[:k] + b"*" for k in BEGINNINGS if len(word) >= k)]


class _Scores(dict):
    """Word -> score, filled as words come; emptied when full, which changes no score."""

    most = 400_000

    def __init__(self, table: dict[bytes, float]):
        super().__init__()
        self.table = table

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = next((self.table[u] for u in units(word) if u in self.table), COST)
        return got


@dataclass(frozen=True)
class ToxicityModel:
    table: dict[bytes, float] = field(default_factory=dict)
    scale: float = 1.0  # lambda
    log_k: float = 0.0
    weights: np.ndarray = field(default_factory=lambda: np.zeros(6))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), in order: Ruzzo and Tompa's scan, linear in the positive scores."""
    ends = np.cumsum(scores)
    begin: list[int] = []
    stop: list[int] = []
    low: list[float] = []
    high: list[float] = []
    back: list[int] = []  # the nearest earlier candidate with a smaller left sum
    at = np.flatnonzero(scores > 0)
    for i, r, s in zip(at.tolist(), ends[at].tolist(), scores[at].tolist()):
        start, left = i, r - s
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = back[j]
            if j < 0 or high[j] >= r:
                break
            start, left = begin[j], low[j]
            for x in (begin, stop, low, high, back):
                del x[j:]
        for x, v in zip((begin, stop, low, high, back), (start, i + 1, left, r, j)):
            x.append(v)
    return [(a, b, h - l) for a, b, l, h in zip(begin, stop, low, high)]


def _found(words: list[bytes], scores: _Scores) -> list[tuple[int, int, float]]:
    return segments(np.fromiter(map(scores.__getitem__, words), float, len(words))) if words else []


def _features(n: int, found: list[float], model: ToxicityModel) -> tuple[list[float], np.ndarray]:
    """Features of a document of n words from the scores of its segments, and which of these are significant."""
    sums = np.array(found, float)
    expected = model.log_k + np.log(max(n, 1)) - model.scale * sums  # log E
    good = expected < np.log(SIGNIFICANT)
    top = sums.max() if len(sums) else 0.0
    p = -np.expm1(-np.exp(min(float(expected.min()), 50.0))) if len(sums) else 1.0
    surprise = -np.log(max(p, 1e-30))
    return [min(surprise, 40.0) / 10, np.log1p(sums[good].sum()), np.log1p(good.sum()), float(top > 0), np.log1p(n) / 5, 1.0], good


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (y - p) - RIDGE * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _scale(values: np.ndarray, counts: np.ndarray) -> float:
    """lambda > 0 with mean exp(lambda s) = 1 over harmless words (the mean of s is negative)."""
    p = counts / counts.sum()
    low, high = 0.0, 1.0
    if values.max() <= 0 or p @ values >= 0:
        return 1.0
    while p @ np.exp(high * values) < 1 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if p @ np.exp(middle * values) < 1 else (low, middle)
    return max(high, 1e-3)


def _log_odds(counts: dict[bytes, tuple[int, int]]) -> dict[bytes, float]:
    """Unit -> score. The prior's PRIOR pseudo-documents fall to the two sides as the unit's shorter beginning does,
    or, where that isn't counted, as all units do; so a rare word keeps its beginning's log-odds and a common one has its
    own. Each side gets LEAST_PRIOR at least, so beginnings that count the same documents don't add up their evidence.

    Log-odds count as evidence of label 1 if they are LEAST_Z deviations of the observed counts above 0; those at or below
    0 count as they are, but cost COST at least. A unit between is left out, and its beginnings speak for it.
    """
    n0, n1 = (sum(c[i] for u, c in counts.items() if not u.endswith(b"*")) for i in (0, 1))
    base = np.log(n1 / n0)
    delta: dict[bytes, float] = {}
    table = {}
    for u in sorted(counts, key=lambda u: (not u.endswith(b"*"), len(u))):
        word = u.removesuffix(b"*")
        parent = next((delta[x] for x in units(word)[1:] if x != u and x in delta), 0.0)
        share = 1 / (1 + np.exp(-(base + parent)))
        c0, c1 = counts[u]
        y0, y1 = c0 + max(PRIOR * (1 - share), LEAST_PRIOR), c1 + max(PRIOR * share, LEAST_PRIOR)
        delta[u] = float(np.log(y1 / y0) - base)
        if delta[u] >= max(LEAST_Z * np.sqrt(1 / (c0 + 0.5) + 1 / (c1 + 0.5)), LEAST_LOG_ODDS):
            table[u] = delta[u]
        elif delta[u] < LEAST_LOG_ODDS:
            table[u] = min(delta[u], COST)
    return table


def _unit_counts(texts: DataFrame) -> DataFrame:
    """unit, c0, c1: the documents labelled 0 and 1 that have it, summed up per task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[Counter, Counter] = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(sides[0].keys() | sides[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *(pa.array([s[k] for k in keys], pa.int64()) for s in sides)], ["unit", "c0", "c1"])
            for s in sides:
                s.clear()
            return out

        for batch in batches:
            for text, y in zip(S.byte_values(batch.column(0)), batch.column(1).to_pylist()):
                sides[int(y > 0)].update({u for word in set(tokens(text)) for u in units(word)})
                if sum(map(len, sides)) > 300_000:
                    yield flush()
        yield flush()

    return texts.select("b", "y").mapInArrow(count, "unit binary, c0 long, c1 long").groupBy("unit").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def fit(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", target: str = "toxic", most: int = MAX_LABELLED) -> ToxicityModel:
    """Learns from at most `most` labelled documents outside the held-out fold: fold 3 calibrates, the others give the log-odds.

    Without labels of both classes there is no table and each score is 0.5.
    """
    with S.scratch(docs.sparkSession):
        return _fit(docs, labels, key, text, target, most)


def _fit(docs: DataFrame, labels: DataFrame, key: str, text: str, target: str, most: int) -> ToxicityModel:
    sample = S.label_sample(labels, target, most, key)
    rows = docs.select(key, S.text_bytes(text).alias("b")).join(F.broadcast(sample), key)  # `most` rows bound the broadcast
    texts = S.written(rows.groupBy(key, "y", "fold").agg(F.min("b").alias("b")).select("b", "y", "fold"))  # an id that repeats counts once
    counted = _unit_counts(texts.where(F.col("fold") != CALIBRATION_FOLD)).where(F.col("c0") + F.col("c1") >= LEAST_COUNT)
    got = counted.orderBy(F.desc(F.col("c0") + F.col("c1")), "unit").limit(MAX_UNITS).toPandas()
    if not len(got) or not got.c1.sum() or not got.c0.sum():
        return ToxicityModel()
    table = _log_odds({bytes(u): (a, b) for u, a, b in zip(got.unit, got.c0.tolist(), got.c1.tolist())})
    is_word = np.array([not u.endswith(b"*") for u in got.unit])
    y0 = got.c0.to_numpy(float)
    scores = _Scores(table)
    values = np.array([scores[bytes(u)] for u in got.unit[is_word]])
    model = ToxicityModel(table, _scale(values, np.maximum(y0[is_word], 1e-9)))
    raw = _scan(texts.where(F.col("fold") == CALIBRATION_FOLD), model)
    if not raw:
        return model
    calm = [(n, max(found, default=0.0)) for y, n, found in raw if y == 0 and n > 0]
    n, top = (np.array(x, float) for x in zip(*calm)) if calm else (np.ones(1), np.zeros(1))
    log_k = -float(np.log(np.mean(np.exp(-(model.scale * top - np.log(n)).clip(-50, 50))))) if calm else 0.0
    model = ToxicityModel(table, model.scale, log_k)
    x = np.array([_features(n, found, model)[0] for _, n, found in raw])
    return ToxicityModel(table, model.scale, log_k, _fit_logistic(x, np.array([y for y, _, _ in raw], float)))


def _scan(texts: DataFrame, model: ToxicityModel) -> list[tuple[float, int, list[float]]]:
    """Label, words and segment scores of the sampled documents, on the driver: bounded by the sample."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value.table)
        for batch in batches:
            words = [tokens(b) for b in S.byte_values(batch.column(0))]
            found = [[x[2] for x in _found(w, scores)] for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(map(len, words)), pa.int64()), pa.array(found, pa.list_(pa.float64()))], ["y", "n", "found"])

    return [tuple(r) for r in texts.select("b", "y").mapInArrow(look, "y double, n long, found array<double>").collect()]


def score(docs: DataFrame, model: ToxicityModel, *, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """key, held_out, score, predicted, passages array<struct<start, end, score>> (token positions) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_UNITS bounds it
    rows = docs.select(F.col(key), S.held_out(key).alias("held_out"), S.text_bytes(text).alias("_b"))
    kind = rows.schema[key].dataType.simpleString()
    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(shared.value.table)
        for batch in S.slices(batches):
            words = [tokens(b) for b in S.byte_values(batch.column(2))]
            found = [_found(w, scores) for w in words]
            got = [_features(len(w), [x[2] for x in f], shared.value) for w, f in zip(words, found)]
            x = np.array([g[0] for g in got]).reshape(-1, len(shared.value.weights))
            p = 1 / (1 + np.exp(-np.clip(x @ shared.value.weights, -30, 30)))
            passages = pa.array([[{"start": a, "end": b, "score": s} for (a, b, s), good in zip(f, g[1]) if good] for f, g in zip(found, got)], passage)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), passages], [key, "held_out", "score", "passages"])

    scored = rows.mapInArrow(apply, f"`{key}` {kind}, held_out boolean, score double, passages array<struct<start:int,end:int,score:double>>")
    return scored.select(key, "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "passages")


def detect(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", target: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """fit(), then score() of every row's whole text.

    A null text is empty; a text without words has no passage and gets the curve's value there. Equal texts get equal
    scores; repeated rows and null keys stay; no rows give none. A text of any length is scanned whole, in time linear
    in its words; its words are the most that a worker holds besides the texts of 256 rows. Other columns are left out.
    """
    return score(docs, fit(docs, labels, key=key, text=text, target=target), key=key, text=text, threshold=threshold)
