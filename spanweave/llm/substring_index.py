"""Substring dedup by a log-structured fingerprint index.

Documents are dealt to runs of RUN_BYTES of text. A run is a sorted, immutable list of window fingerprints, each once
with the smallest document that starts it, cut into parts by its leading bits. Runs are merged by part, FAN of them at
most: FAN runs give one run of the next level, cut FAN times finer, until FAN or fewer are left, and those, with the
stored runs of earlier batches, meet in the last merge. So a run or merge of any level gives FAN blobs of like size, and
their number grows with the number of runs. What a merge finds goes back down the levels: to each run the fingerprints
that it needs. A passage that a third of all documents hold is one entry per run, then one per FAN runs, and so on.

Two such rounds are made. The first merges anchors only, the smallest 8-word fingerprint within each 13-word window:
equal windows have equal anchors, and a run has far fewer anchors than windows. The second merges the windows whose
anchor is shared, verified by a second, independent 32-bit hash of their words. The last pass removes what is covered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.llm import _support as S
from spanweave.llm.words import BASES, chunks, mix, over, word_hashes, word_spans

WINDOW, GRAM = 13, 8
#: Text bytes of a run, text bytes hashed at once.
RUN_BYTES, CHUNK = 6 << 20, 1 << 20
#: Runs that are merged at once, and parts that a run is cut into, as a power of two.
FAN_BITS = 8
#: Entries of a stored blob at most: a stored run's parts are cut so fine that none is larger.
BLOB = 1 << 20
HISTORY = -1
ANCHORS, WINDOWS = 0, 1
_U = np.uint64


def _smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each `width` consecutive values."""
    part, size = x, 1
    while size * 2 <= width:
        part, size = np.minimum(part[:-size], part[size:]), size * 2
    return np.minimum(part[: len(x) - width + 1], part[width - size :]) if size < width else part


class Windows:
    """The words and windows of some texts, in order. of: a window's text; at: its first word; words: words of each text."""

    def __init__(self, texts: list[bytes], anchors: bool = True, checks: bool = True):
        self.words = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, ...]] = []
        for a, b in chunks(texts, CHUNK):
            parts.append(self._hash(texts[a:b], a, anchors, checks))
        empty = np.zeros(0, np.uint64)
        self.of, self.at, self.anchor, self.h, self.check = (np.concatenate([p[i] for p in parts]) if parts else empty for i in range(5))

    def _hash(self, texts: list[bytes], first: int, anchors: bool, checks: bool) -> tuple[np.ndarray, ...]:
        joined, start, stop, count = word_spans(texts)  # no word crosses texts
        self.words[first : first + len(texts)] = count
        n = len(start) - WINDOW + 1
        if n <= 0:
            return (np.zeros(0, np.int64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in range(3)))
        of = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(start)) - np.repeat(np.cumsum(count) - count, count)
        whole = of[:n] == of[WINDOW - 1 :]
        # Minima crowd at the low end; mixed again they fall evenly into the buckets.
        hashes = word_hashes(joined, start, stop, 1 + checks)
        anchor = mix(_smallest(over(hashes[0], GRAM, BASES[1]), WINDOW - GRAM + 1)[whole]) if anchors else np.zeros(0, np.uint64)
        h = over(hashes[0], WINDOW, BASES[0])[whole]
        check = over(hashes[1], WINDOW, BASES[1])[whole] >> _U(32) if checks else np.zeros(0, np.uint64)
        return of[:n][whole] + first, nth[:n][whole], anchor, h, check


def _narrow(values: np.ndarray) -> bytes:
    """Unsigned values with as many bytes each as the largest needs; the first byte tells how many."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : blob[0]] = np.frombuffer(blob, np.uint8, n * blob[0], 1).reshape(n, blob[0])
    return out.view("<u8").reshape(-1)


def _pack(h: np.ndarray, *more: np.ndarray) -> list:
    """n and blobs of a sorted h (as differences) and what goes along with it."""
    return [len(h), _narrow(np.diff(h, prepend=_U(0))), *(_narrow(m) for m in more)]


def _unpack(n: int, h: bytes, *more: bytes | None) -> list[np.ndarray]:
    return [np.cumsum(_wide(h, n)), *(_wide(m, n) if m is not None else np.zeros(0, np.uint64) for m in more)]


#: A part of a run (or, of a higher level, of a unit of runs): n fingerprints h, for windows also their check hash and
#: smallest document (shifted to be unsigned).
_UP = "unit int, part long, n int, h binary, c binary, d binary"
#: What a unit is told of one of its parts: fingerprints h, with their checks where one fingerprint has several.
_DOWN = "unit int, part long, n int, h binary, c binary"
_SHIFT = _U(1 << 63)


def _unsigned(ids: np.ndarray) -> np.ndarray:
    return ids.astype(np.int64).view(np.uint64) ^ _SHIFT


def _cut(unit: int, level: int, h: np.ndarray, c: np.ndarray | None = None, d: np.ndarray | None = None) -> list[list]:
    """A sorted run's parts: those of equal first (level + 1) * FAN_BITS bits."""
    part = (h >> _U(64 - (level + 1) * FAN_BITS)).astype(np.int64)
    at = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(h)).tolist()
    out = []
    for i, j in zip(at, at[1:]):
        more = (c[i:j], d[i:j]) if c is not None else ()
        out.append([unit, int(part[i]), *_pack(h[i:j], *more), *[None] * (2 - len(more))])
    return out


def _table(rows: list, schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(c, kinds[k]) for (name, k), c in zip(fields, cols)})


def _first_of(h: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (h, c) with their smallest d."""
    order = np.lexsort((d, c, h))
    h, c, d = h[order], c[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    return h[new], c[new], d[new]


def _lists(group: pa.Table) -> list[list[np.ndarray]]:
    return [_unpack(*x) for x in zip(*(group.column(k).to_pylist() for k in ("n", "h", "c", "d")))]


def _merged(lists: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None]:
    """One sorted run of several: anchors once, windows once with their smallest document."""
    h = np.concatenate([x[0] for x in lists])
    if not len(lists[0][1]):
        return np.unique(h), None, None
    return _first_of(h, *(np.concatenate([x[i] for x in lists]) for i in (1, 2)))


def _next_level(group: pa.Table, level: int) -> pa.Table:
    """The units of `level` that make one of the next, merged and cut finer."""
    return _table(_cut(group.column("unit")[0].as_py() >> FAN_BITS, level + 1, *_merged(_lists(group))), _UP)


def _raised(level: int, with_kind: bool = False) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        made = _next_level(group, level)
        return made.append_column("kind", pa.array([group.column("kind")[0].as_py()] * made.num_rows, pa.int32())) if with_kind else made

    return run


def _tell(units: list[int], parts: list[int], lists: list[list[np.ndarray]], above: list[np.ndarray]) -> pa.Table:
    """To each unit of a merge what it needs: anchors that another one has too, windows that another one starts in a
    smaller document; and, of what the merge itself was told from above (sorted h and checks), all that the unit has."""
    h, c, d = (np.concatenate([x[i] for x in lists]) for i in range(3))
    of = np.repeat(np.arange(len(lists)), [len(x[0]) for x in lists])
    windows = bool(len(c))
    order = np.lexsort((d, c, h)) if windows else np.argsort(h, kind="stable")
    h, of = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if windows:
        c, d = c[order], d[order]
        new[1:] |= c[1:] != c[:-1]
        group = np.cumsum(new) - 1
        need = d > d[np.flatnonzero(new)[group]]
    else:
        need = np.append(~new[1:], False) | ~new  # the same as the next or the one before
    need |= _among(h, c if windows else None, *above)
    clash = windows and bool((new[1:] & (h[1:] == h[:-1])).any())
    sent = np.flatnonzero(need)
    sent = sent[np.argsort(of[sent], kind="stable")]
    at = np.searchsorted(of[sent], np.arange(len(lists) + 1)).tolist()
    out = []
    for k, (i, j) in enumerate(zip(at, at[1:])):
        if i < j and units[k] != HISTORY:
            mine = sent[i:j]
            out.append([units[k], parts[k], *_pack(h[mine], *([c[mine]] if clash else [])), *([] if clash else [None])])
    return _table(out, _DOWN)


def _among(h: np.ndarray, c: np.ndarray | None, told: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which (h, c) are among the told: by h alone, but for those told with a check (checks above 0; 0 is any)."""
    if not len(told):
        return np.zeros(len(h), bool)
    at, found = np.searchsorted(told, h), np.zeros(len(h), bool)
    while True:  # once, but for equal fingerprints with several checks
        i = np.minimum(at, len(told) - 1)
        same = (at < len(told)) & (told[i] == h)
        if not same.any():
            return found
        found |= same & ((checks[i] == 0) | (c is None) | (checks[i] == (c + _U(1) if c is not None else 0)))
        at = at + 1


def _told(right: pa.Table | None) -> list[np.ndarray]:
    """All rows that came down, sorted by h: fingerprints, and their checks plus one (0 where none is told)."""
    lists = [_unpack(*x) for x in zip(*(right.column(k).to_pylist() for k in ("n", "h", "c")))] if right is not None else []
    if not lists:
        return [np.zeros(0, np.uint64)] * 2
    h = np.concatenate([x[0] for x in lists])
    c = np.concatenate([x[1] + _U(1) if len(x[1]) else np.zeros(len(x[0]), np.uint64) for x in lists])
    order = np.argsort(h, kind="stable")
    return [h[order], c[order]]


def _last_merge(group: pa.Table) -> pa.Table:
    return _tell(group.column("unit").to_pylist(), group.column("part").to_pylist(), _lists(group), _told(None))


def _pass_down(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows:
        return _table([], _DOWN)
    return _tell(left.column("unit").to_pylist(), left.column("part").to_pylist(), _lists(left), _told(right))


def _levels(runs: int) -> int:
    """Merges before the last one."""
    return max(0, -(-max(runs - 1, 1).bit_length() // FAN_BITS) - 1)


def _exchange(up: DataFrame, runs: int, parts: int, history: DataFrame | None) -> DataFrame:
    """unit, h, c: what each run is told after all runs and the history were merged."""
    levels, steps = _levels(runs), []
    for level in range(levels):
        up = S.written(up)
        steps.append(up)
        owner = F.shiftright("unit", FAN_BITS)
        up = up.repartition(parts, "part", owner).groupBy("part", owner.alias("owner")).applyInArrow(_raised(level), _UP)
    if history is not None:
        up = up.unionByName(_as_fine_as(history, levels))
    down = up.repartition(parts, "part").groupBy("part").applyInArrow(_last_merge, _DOWN)
    for step in reversed(steps):
        left = step.withColumn("owner", F.shiftright("unit", FAN_BITS)).repartition(parts, "part", "owner").groupBy("part", "owner")
        right = down.withColumnsRenamed({"unit": "owner"}).withColumn("part", F.shiftright("part", FAN_BITS)).repartition(parts, "part", "owner").groupBy("part", "owner")
        down = left.cogroup(right).applyInArrow(_pass_down, _DOWN)
    return down


def _as_fine_as(stored: DataFrame, level: int) -> DataFrame:
    """Stored parts (of any level) cut or widened to those of a level."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _lists(pa.Table.from_batches([batch])):
                cut = _cut(HISTORY, level, *row) if len(row[1]) else _cut(HISTORY, level, row[0])
                yield _table(cut, _UP).to_batches()[0]

    return stored.select(*(f.split(" ")[0] for f in _UP.split(", "))).mapInArrow(split, _UP)


def _rows(left: pa.Table) -> tuple[list[bytes], np.ndarray]:
    return left.column("_b").to_pylist(), left.column("_d").to_numpy().astype(np.int64)


def _anchor_run(left: pa.Table) -> pa.Table:
    texts, _ = _rows(left)
    made = _table(_cut(left.column("run")[0].as_py(), 0, np.unique(Windows(texts, checks=False).anchor)), _UP)
    S.trim()
    return made


def _window_run(left: pa.Table, right: pa.Table | None) -> pa.Table:
    """The run's windows whose anchor is shared; all windows for right None."""
    if not left.num_rows:
        return _table([], _UP)
    texts, ids = _rows(left)
    w = Windows(texts)
    some = np.isin(w.anchor, _told(right)[0]) if right is not None else slice(None)
    made = _table(_cut(left.column("run")[0].as_py(), 0, *_first_of(w.h[some], w.check[some], _unsigned(ids)[w.of[some].astype(np.int64)])), _UP)
    del w, texts
    S.trim()
    return made


def _covered(left: pa.Table, right: pa.Table) -> tuple[list[bytes], Windows, list[np.ndarray | None]]:
    """For each text, which of its words are covered (None: none are)."""
    texts, ids = _rows(left)
    w = Windows(texts, anchors=False)
    d = _unsigned(ids)[w.of.astype(np.int64)]
    order = np.lexsort((d, w.check, w.h))
    h, c, mine = w.h[order], w.check[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
    first = mine[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(h) else mine
    gone = order[(first < mine) | _among(h, c, *_told(right))]  # told: a smaller document than any of the run's starts it
    out: list[np.ndarray | None] = [None] * len(texts)
    if len(gone):
        base = np.cumsum(w.words) - w.words
        step = np.zeros(int(w.words.sum()) + 1, np.int64)
        start = base[w.of[gone].astype(np.int64)] + w.at[gone].astype(np.int64)
        np.add.at(step, start, 1)
        np.add.at(step, start + WINDOW, -1)
        cover = np.cumsum(step[:-1]) > 0
        for i in np.unique(w.of[gone]).tolist():
            out[i] = cover[base[i] : base[i] + w.words[i]]
    return texts, w, out


def _result(left: pa.Table, right: pa.Table, with_text: bool) -> pa.Table:
    texts, w, covers = _covered(left, right) if left.num_rows else ([], None, [])
    removed, sha, kept = [], [], []
    for text, cover in zip(texts, covers):
        words = text.split()
        if cover is not None:
            words = list(compress(words, (~cover).tolist()))
        plain = b" ".join(words)
        removed.append(0 if cover is None else int(cover.sum()))
        sha.append(hashlib.sha256(plain).hexdigest())
        kept.append(None if cover is None or not with_text else plain.decode())
    S.trim()
    out = {
        "_k": left.column("_k"), "n_words": pa.array(w.words if w else [], pa.int64()), "n_removed": pa.array(removed, pa.int64()),
        "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(kept, pa.string()),
    }
    return pa.table(out | ({"_rest": left.column("_rest")} if "_rest" in left.column_names else {}))


def _carried(docs: DataFrame, rest: list[str]) -> list[Column]:
    """Columns that go along, as one struct of nullable fields."""
    kind = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in rest])
    return [F.struct(*(F.col(f"`{c}`") for c in rest)).cast(kind).alias("_rest")] if rest else []


def _dealt(docs: DataFrame, key: str, text: str, rest: list[str], parts: int, runs: int) -> DataFrame:
    """Documents by run, each row by itself, so that rows of one key are dealt out too."""
    cols = [F.col(key).alias("_k"), F.col(key).cast("long").alias("_d"), S.text_bytes(text).alias("_b")]
    rows = docs.select(*cols, *_carried(docs, rest))
    return rows.withColumn("run", F.pmod(F.xxhash64("_k", "_b"), F.lit(runs)).cast("int")).repartition(parts, "run")


def _sizes(docs: DataFrame, text: str) -> tuple[int, int]:
    """Partitions and runs: runs of RUN_BYTES of text, and no partition of more than some of them."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    runs = max(1, -(-size // RUN_BYTES))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs // 4)), runs


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", history: DataFrame | None = None, with_text: bool = False, rest: list[str] | None = None) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 for every row; kept_text (null where nothing is removed) and `rest` on request.

    A word goes if a 13-word window over it also starts in a document with a smaller (integer) key, in docs or in the
    stored runs `history`; windows are judged on the input. Null texts have no words. Rows with a null key keep all
    words and cover none. Rows that repeat a key don't cover each other. kept_sha256 is of the kept words joined by one
    space.
    """
    rest = rest or []
    own = docs.where(F.col(key).isNotNull())
    parts, runs = _sizes(own, text)
    dealt = _dealt(own, key, text, rest, parts, runs)
    kept = lambda kind: None if history is None else history.where(F.col("kind") == kind)

    shared = _exchange(dealt.groupBy("run").applyInArrow(_anchor_run, _UP), runs, parts, kept(ANCHORS))
    local = dealt.groupBy("run").cogroup(shared.groupBy("unit")).applyInArrow(_window_run, _UP)
    earlier = _exchange(local, runs, parts, kept(WINDOWS))
    kind = own.schema[key].dataType.simpleString()
    carried = f", _rest {dealt.schema['_rest'].dataType.simpleString()}" if rest else ""
    schema = f"_k {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string{carried}"
    found = dealt.groupBy("run").cogroup(earlier.groupBy("unit")).applyInArrow(lambda a, b: _result(a, b, with_text), schema)
    plain = F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != ""), " ")
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")).cast("long")
    without = docs.where(F.col(key).isNull()).select(
        F.col(key).alias("_k"), words.alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.sha2(plain, 256).alias("kept_sha256"),
        F.lit(None).cast("string").alias("kept_text"), *_carried(docs, rest),
    )
    every = found.unionByName(without)
    return every.select(F.col("_k").alias(key), "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text, *(F.col(f"_rest.{c}") for c in rest))


def strip(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without their repeated passages, all columns kept: a touched text becomes its kept words joined by one space.

    A document that loses all its words goes; one that had none stays. n_chars, if there, follows the new text.
    """
    rest = [c for c in docs.columns if c != key]
    cut = deduplicate(docs, key=key, text=text, with_text=True, rest=rest).where("n_removed = 0 or n_removed < n_words")
    out = cut.withColumn(text, F.coalesce("kept_text", text))
    if "n_chars" in rest:
        out = out.withColumn("n_chars", F.when(F.col("kept_text").isNotNull(), F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(docs.columns)


class SubstringIndex:
    """Windows of all batches so far, as immutable runs in one folder that all executors see.

    Each batch's ids must be larger than those before it, as only an earlier document's passage is kept. After FAN
    batches, or whenever told, the runs are compacted into one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folders(self) -> list[str]:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        store = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not store.exists(place):
            return []
        return sorted(f.getPath().toString() for f in store.listStatus(place) if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS")))

    def runs(self) -> DataFrame | None:
        """All whole runs: a batch that failed half-way left no mark of success and is not read."""
        folders = self._folders()
        return self.spark.read.parquet(*folders) if folders else None

    def add(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", name: str) -> None:
        """Writes the batch's anchors and windows as one run, and compacts when there are FAN of them."""
        own = docs.where(F.col(key).isNotNull())
        parts, runs = _sizes(own, text)
        dealt = _dealt(own, key, text, [], parts, runs).groupBy("run")
        anchors = dealt.applyInArrow(_anchor_run, _UP).withColumn("kind", F.lit(ANCHORS))
        windows = dealt.applyInArrow(lambda g: _window_run(g, None), _UP).withColumn("kind", F.lit(WINDOWS))
        self._write(anchors.unionByName(windows), name, runs, parts)
        if len(self._folders()) >= 1 << FAN_BITS:
            self.compact(name=f"{name}-compacted")

    def _write(self, rows: DataFrame, name: str, runs: int, parts: int) -> None:
        """Merges level by level, as _exchange() does, then by part; each part is stored as blobs of BLOB entries at most."""
        for level in range(_levels(runs)):
            owner = F.shiftright("unit", FAN_BITS)

            rows = rows.repartition(parts, "kind", "part", owner).groupBy("kind", "part", owner.alias("owner")).applyInArrow(_raised(level, True), f"{_UP}, kind int")
        merged = rows.drop("unit").repartition(parts, "kind", "part").groupBy("kind", "part").applyInArrow(_compacted, f"kind int, {_UP}")
        merged.sortWithinPartitions("kind", "part").write.parquet(f"{self.path}/{name}")

    def compact(self, *, name: str) -> None:
        """Merges all runs into one, then removes them."""
        old = self._folders()
        if old:
            stored = self.spark.read.parquet(*old)
            finest = stored.agg(F.max("part")).first()[0] or 0
            level = max(0, -(-int(finest).bit_length() // FAN_BITS) - 1)
            kinds = [_as_fine_as(stored.where(F.col("kind") == k), level).withColumn("kind", F.lit(k)) for k in (ANCHORS, WINDOWS)]
            parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._write(kinds[0].unionByName(kinds[1]), name, 1, parts)
            for folder in old:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def deduplicate(self, docs: DataFrame, *, key: str = "doc_id", text: str = "text", **more) -> DataFrame:
        return deduplicate(docs, key=key, text=text, history=self.runs(), **more)


def _compacted(group: pa.Table) -> pa.Table:
    """One run of a part: the merge of all its runs."""
    kind, part = group.column("kind")[0].as_py(), group.column("part")[0].as_py()
    h, c, d = _merged(_lists(group))
    rows = []
    for i in range(0, len(h), BLOB):
        more = (c[i : i + BLOB], d[i : i + BLOB]) if c is not None else ()
        rows.append([kind, HISTORY, part, *_pack(h[i : i + BLOB], *more), *[None] * (2 - len(more))])
    return _table(rows, f"kind int, {_UP}")
