"""Statistics of whole documents, one pass over the text in Arrow batches; what ops 7 and 8 score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S

#: Counts that the quality rules report as they are.
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What models see, in this order; all are 0 for a text without words.
FEATURES = (
    "log_words", "word_length", "symbol_rate", "dup_line_rate", "repeat_word_rate", "upper_rate", "digit_rate", "point_rate",
    "mark_rate", "distinct_rate", "line_length", "byte_entropy", "long_word_rate", "short_word_rate", "other_rate", "symbol_word_rate",
)
WINDOW = 8
_SYMBOLS = b"#*$%&|<>"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _classes() -> np.ndarray:
    """256 x 9: code points, white space, symbols, upper case, digits, points, marks, non-ASCII lead bytes, letters."""
    table, b = np.zeros((256, 9)), np.arange(256)
    table[:, 0] = (b < 128) | (b >= 192)
    for column, members in ((1, S.SPACES.encode()), (2, _SYMBOLS), (5, b".,;:"), (6, b"!?")):
        table[list(members), column] = 1
    table[:, 3], table[:, 4], table[:, 7] = (b >= 65) & (b <= 90), (b >= 48) & (b <= 57), b >= 192
    table[:, 8] = (b >= 65) & (b <= 90) | (b >= 97) & (b <= 122) | (b >= 192)
    return table


_CLASS = _classes()


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words stand in windows of `window` words that the text has twice or more, the first included."""
    n = len(words)
    if n <= window:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    h = (h[:-1] * _A) ^ (h[1:] + _B)
    h = (h[:-2] * _B) ^ (h[2:] + _C)
    h = (h[:-4] * _C) ^ (h[4:] + _A)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(len(h), bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    first: dict[tuple, int] = {}
    again = np.zeros(n + 1, np.int64)
    for i in np.flatnonzero(maybe).tolist():  # equal hashes are only a hint: the words decide
        at = first.setdefault(tuple(words[i : i + window]), i)
        if at != i:
            for k in (at, i):
                again[k] += 1
                again[k + window] -= 1
    return int((np.cumsum(again[:n]) > 0).sum())


def statistics(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """BASE and FEATURES of one text."""
    words = text.split()
    n = len(words)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points, spaces, symbols, upper, digits, stops, marks, other, letters = (counts @ _CLASS).tolist()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    dup, repeated = len(lines) - len(set(lines)), repeat_words(words)
    chars = int(points - spaces)
    base = (n, chars, int(symbols), dup, repeated)
    if not n:
        return base, [0.0] * len(FEATURES)
    share = counts[counts > 0] / max(len(text), 1)
    lengths = np.fromiter(map(len, words), np.int64, n)
    has = sum(1 for w in words if w[-1] in _SYMBOLS or w[0] in _SYMBOLS) / n
    return base, [
        np.log1p(n), chars / n, symbols / chars, dup / len(lines), repeated / n, upper / max(letters, 1), digits / chars, stops / n,
        marks / n, len(set(words)) / n, np.log1p(n / len(lines)), float(-(share * np.log(share)).sum()), float((lengths > 12).mean()), float((lengths < 3).mean()), other / chars, has,
    ]


def with_statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, BASE (long) and `features` array<double> for each row, in one scan without a shuffle.

    A null text counts as empty; null and repeated keys stay as they are; other columns are left out.
    """
    rows = docs.select(F.col(key).alias("_k"), S.text_bytes(text).alias("_b"))
    kind = rows.schema["_k"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [statistics(x) for x in S.byte_values(batch.column(1))]
            base = np.array([x[0] for x in got], np.int64).reshape(-1, len(BASE))
            features = pa.array([x[1] for x in got], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(base[:, i]) for i in range(len(BASE))), features], [key, *BASE, "features"])

    return rows.mapInArrow(scan, f"`{key}` {kind}, {', '.join(f'{x} long' for x in BASE)}, features array<double>")


def labelled(stats: DataFrame, sample: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """features, y, fold of the sampled labelled ids, each once: rows that repeat an id count as the one of the smallest
    features. So the sample's size bounds this, and it is broadcast."""
    found = stats.select(key, "features").join(F.broadcast(sample), key)
    return found.groupBy(key, "y", "fold").agg(F.min("features").alias("features")).select("features", "y", "fold", F.xxhash64(key).alias("_o"))
