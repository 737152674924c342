"""Quality rules: gradient-boosted trees over document statistics, kept as flat numpy node arrays.

Trees grow level by level on binned features with second-order logistic gains. Chosen features are monotonic: a split
whose children would break the direction is refused, and both sides then stay on their side of the children's middle.
Scoring walks all trees for a whole batch at once through the node arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S
from spanweave.llm.doc_stats import BASE, FEATURES, labelled, with_statistics

MAX_LABELLED = 20_000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST = 60, 4, 48, 0.15, 2.0, 10.0
#: More of these never raises a score.
FALLING = ("symbol_rate", "symbol_word_rate", "dup_line_rate", "repeat_word_rate")
MIN_WORDS, MAX_REPEATED, KEEP_FROM = 20, 30, 0.5


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees; feature -1 marks a leaf. A row goes left if its value <= threshold."""

    prior: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
            at = np.where(f < 0, at, down)
        return 1 / (1 + np.exp(-(self.prior + self.value[at].sum(1))))


def _leaf(g: float, h: float, low: float, high: float) -> float:
    return float(np.clip(-g / (h + SHRINK), low, high))


def _gain(g: np.ndarray, h: np.ndarray, v: np.ndarray) -> np.ndarray:
    return -(g * v + 0.5 * (h + SHRINK) * v * v)


def grow(x: np.ndarray, y: np.ndarray, sign: np.ndarray, trees: int = TREES) -> Forest:
    """sign: -1 or 1 for features whose effect must not rise or fall, 0 for free ones."""
    n, m = x.shape
    share = float(np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    prior = float(np.log(share / (1 - share)))
    nodes: list[list[float]] = []
    roots: list[int] = []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) if n else np.array([]) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1) if n else np.zeros((0, m), int)
    total = np.full(n, prior)
    for _ in range(trees if n and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0, 0, 0, 0])
        level = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for depth in range(DEPTH + 1):
            below = []
            for node, rows, low, high in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                nodes[node][4] = RATE * _leaf(gs, hs, low, high)
                best = (1e-6, -1, 0, 0.0, 0.0)
                whole = float(_gain(gs, hs, _leaf(gs, hs, low, high)))
                for j in range(m if depth < DEPTH else 0):
                    k = len(edges[j])
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], k + 1))[:k]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], k + 1))[:k]
                    vl, vr = np.clip(-gl / (hl + SHRINK), low, high), np.clip(-(gs - gl) / (hs - hl + SHRINK), low, high)
                    good = (hl >= LEAST / 10) & (hs - hl >= LEAST / 10) & (sign[j] * (vr - vl) >= 0)
                    won = np.where(good, _gain(gl, hl, vl) + _gain(gs - gl, hs - hl, vr) - whole, -np.inf)
                    if k and won.max() > best[0]:
                        i = int(won.argmax())
                        best = (float(won[i]), j, i, float(vl[i]), float(vr[i]))
                _, j, i, vl, vr = best
                if j < 0:
                    total[rows] += nodes[node][4]
                    continue
                middle, there = (vl + vr) / 2, binned[rows, j] <= i
                sides = [(low, high), (low, high)]
                if sign[j] > 0:
                    sides = [(low, min(high, middle)), (max(low, middle), high)]
                elif sign[j] < 0:
                    sides = [(max(low, middle), high), (low, min(high, middle))]
                nodes[node][:4] = [j, edges[j][i], len(nodes), len(nodes) + 1]
                for part, bound in zip((there, ~there), sides):
                    below.append((len(nodes), rows[part], *bound))
                    nodes.append([-1, 0, 0, 0, 0])
            level = below
    flat = np.array(nodes, float).reshape(-1, 5)
    return Forest(prior, np.array(roots, int), flat[:, 0].astype(int), flat[:, 1], flat[:, 2].astype(int), flat[:, 3].astype(int), flat[:, 4])


def fit(stats: DataFrame, labels: DataFrame, *, target: str = "quality", key: str = "doc_id", most: int = MAX_LABELLED) -> Forest:
    """On at most `most` labelled rows that are not held out; without labels of both classes each row gets their share."""
    rows = labelled(stats, S.label_sample(labels, target, most, key), key=key).select("_o", "features", "y").collect()  # bounded by `most`
    rows.sort(key=lambda r: (r._o, r.features))
    x = np.array([r.features for r in rows], float).reshape(-1, len(FEATURES))
    return grow(x, np.array([r.y for r in rows], float), np.array([-1 if f in FALLING else 0 for f in FEATURES]))


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", target: str = "quality", keep_from: float = KEEP_FROM) -> DataFrame:
    """key, the BASE counts, base_failed, kept and score of every row.

    base_failed: under 20 words, or over 30 % of the words in repeated 8-word windows. kept: not base_failed and the
    forest's score >= keep_from. A null text has no words; repeated rows are judged alike; no labels mean score 0.5.
    """
    stats = S.written(with_statistics(docs, key=key, text=text))
    forest = fit(stats, labels, target=target, key=key)
    kind = stats.schema[key].dataType.simpleString()
    columns = [key, *BASE]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(len(columns)).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(forest.score(x))], [*columns, "score"])

    scored = stats.select(*columns, "features").mapInArrow(apply, f"`{key}` {kind}, {', '.join(f'{x} long' for x in BASE)}, score double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    return scored.select(*columns, failed.alias("base_failed"), (~failed & (F.col("score") >= keep_from)).alias("kept"), "score")
