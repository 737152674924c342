"""SimHash near-dedup by bit-sliced comparison.

Fingerprints that differ in at most 2 of 64 bits agree in at least 6 of their 8 bytes, so they meet under one of the 28
choices of 6 bytes. Under one such key at most 2^16 fingerprints can ever stand, as only 16 bits are free, whatever the
corpus holds. A block of fingerprints sorted by key is stored vertically: plane b has bit b of all of them, as one long
integer. A shift by d sets each fingerprint against the d-th behind it; carry-save counters over the planes' differences
update all these distances at once, and the block is abandoned as soon as all of them exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S
from spanweave.llm.components import components

SEED, SHINGLE, RADIUS = 42, 3, 2
_BYTES, _EQUAL = 8, 6
#: Fingerprints compared at once; a run under one key (2^16 at most) is never split.
BLOCK = 8192
_BIT = ((np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1).astype(np.int64)
_OFFSET = (np.arange(8, dtype=np.int64) * 256)[None, :]


def _masks() -> list[int]:
    """The signed 64-bit masks of all choices of _EQUAL bytes."""
    out = []
    for free in combinations(range(_BYTES), _BYTES - _EQUAL):
        mask = sum(0xFF << 8 * i for i in range(_BYTES) if i not in free)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def fingerprint(text: bytes, digest) -> int:
    """Signed 64-bit SimHash of the lower-cased text's word shingles; digest(bytes, seed) is XXH64."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= SHINGLE:
        hashes = [digest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1).tolist()
        starts = [0, *(e + 1 for e in ends[: n - SHINGLE])]
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])]
    octets = np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8)
    counts = np.bincount((octets + _OFFSET).ravel(), minlength=2048).reshape(8, 256) @ _BIT
    return int.from_bytes(np.packbits((2 * counts > len(hashes)).ravel()).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (signed long) of every row's whole text; a null text or one without words has fp 0."""
    rows = docs.select(F.col(key).alias("_k"), S.text_bytes(text).alias("_b"))
    kind = rows.schema["_k"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            fps = [fingerprint(b, xxh64_intdigest) for b in S.byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], [key, "fp"])

    return rows.mapInArrow(scan, f"`{key}` {kind}, fp long")


def planes(values: np.ndarray) -> list[int]:
    """Bit planes of unsigned 64-bit values, as integers whose bit i belongs to value i."""
    bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return [int.from_bytes(row.tobytes(), "little") for row in np.packbits(bits.T, axis=1, bitorder="little")]


def within(bits: list[int], d: int, wanted: np.ndarray, radius: int) -> np.ndarray:
    """The i among `wanted` (one flag per i) whose values i and i + d differ in at most `radius` bits.

    Carry-save counters hold all distances so far, digit by digit; a distance above the radius is out, and when all are
    the rest of the planes is not looked at.
    """
    alive = int.from_bytes(np.packbits(wanted, bitorder="little").tobytes(), "little")
    digits = radius.bit_length()
    counts = [0] * digits
    for at, plane in enumerate(bits, 1):
        carry = plane ^ (plane >> d)
        for j in range(digits):
            counts[j], carry = counts[j] ^ carry, counts[j] & carry
        alive &= ~carry  # beyond what the counters hold
        if at > radius and (at & 3 == 0 or at == len(bits)):
            more, equal = 0, -1
            for j in range(digits - 1, -1, -1):
                if radius >> j & 1:
                    equal &= counts[j]
                else:
                    more, equal = more | equal & counts[j], equal & ~counts[j]
            alive &= ~more
            if not alive:
                return np.zeros(0, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(alive.to_bytes((len(wanted) + 7) // 8, "little"), np.uint8), bitorder="little"))


def sliced_links(values: np.ndarray, runs: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs of equal run whose values differ in at most `radius` bits; runs are consecutive."""
    bits = planes(values)
    longest = int(np.bincount(np.unique(runs, return_inverse=True)[1]).max()) if len(values) else 0
    return [(i, i + d) for d in range(1, longest) for i in within(bits, d, runs[d:] == runs[:-d], radius).tolist()]


def _stars(values: np.ndarray, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one block as (value, smallest value reached in the block): a component of m values gives m - 1 links."""
    links = sliced_links(values.view(np.uint64), runs)
    parent = list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    top = np.array([root(i) for i in range(len(values))], np.int64) if links else np.arange(len(values))
    other = top != np.arange(len(values))
    return values[other], values[top[other]]


def _blocks(order: np.ndarray, start: np.ndarray, length: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Whole runs, those of like length together, as (row indices, run numbers) of about BLOCK rows."""
    rows, runs, held = [], [], 0
    for r in order.tolist():
        rows.append(np.arange(start[r], start[r] + length[r]))
        runs.append(np.full(length[r], r))
        held += int(length[r])
        if held >= BLOCK:
            yield np.concatenate(rows), np.concatenate(runs)
            rows, runs, held = [], [], 0
    if rows:
        yield np.concatenate(rows), np.concatenate(runs)


def links(distinct: DataFrame) -> DataFrame:
    """Links (u, v) that join all of distinct (fp) at radius 2: a spanning set in each block, so no component is lost."""
    keyed = distinct.select("fp", F.posexplode(F.array(*(F.lit(m) for m in _masks()))).alias("c", "m")).select("c", F.col("fp").bitwiseAND(F.col("m")).alias("k"), "fp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))

        def work(c: np.ndarray, k: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (k[1:] != k[:-1])])) if len(c) else np.zeros(0, np.int64)
            length = np.diff(np.append(edge, len(c)))
            several = np.flatnonzero(length > 1)
            order = several[np.argsort(length[several], kind="stable")]
            found = [_stars(fp[rows], runs) for rows, runs in _blocks(order, edge, length)]
            u, v = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        for batch in batches:
            kept = tuple(np.concatenate([a, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, a in enumerate(kept))
            last = np.flatnonzero((kept[0] != kept[0][-1]) | (kept[1] != kept[1][-1])) if len(kept[0]) else []
            if len(last):  # the last run may go on in the next batch
                cut = int(last[-1]) + 1
                yield work(*(a[:cut] for a in kept))
                kept = tuple(a[cut:] for a in kept)
        yield work(*kept)

    return keyed.repartition("c", "k").sortWithinPartitions("c", "k").mapInArrow(compare, "u long, v long")


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fingerprint (16 hex digits), component_id for every row.

    component_id is the smallest key reachable over links of fingerprints at most 2 bits apart, equal ones included.
    Texts without words (null, empty, white space) share fingerprint 0 and so one component. Repeated rows get equal
    results; null keys are carried but never a component's id unless it has no other. No rows give no rows. A
    fingerprint or component that many rows share is joined in SALTS parts.
    """
    with S.scratch(docs.sparkSession) as tables:
        table = tables.keep(S.written(fingerprints(docs, key=key, text=text)))
        firsts = S.written(table.groupBy("fp").agg(F.min(key).alias("_first")))
        roots = components(links(firsts.select("fp")))
        grouped = S.written(firsts.join(roots, firsts["fp"] == roots["node"], "left").select(firsts["fp"], "_first", F.coalesce("root", firsts["fp"]).alias("_root")))
        least = grouped.groupBy("_root").agg(F.min("_first").alias("component_id"))
        named = tables.keep(S.written(S.joined(grouped, least, "_root").select("fp", "component_id")))
    return S.joined(table, named, "fp").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
