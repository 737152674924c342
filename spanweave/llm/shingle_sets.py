"""SimHash near-dedup at a set similarity: one document of each group that shares most of its word shingles.

At a similarity of 0.8 two SimHashes differ in about 10 of 64 bits, and no choice of equal bytes is both sure to hold for
such pairs and rare for others, as it is for simhash.py's 2 bits. So fingerprints are dealt into blocks by BANDS keys of
ROWS min-hashes each, of which a pair at 0.8 misses all with probability (1 - 0.8^5)^20 = 0.0004, and one of higher
similarity less often. Within the blocks they are compared bit-sliced, and pairs beyond a radius that a pair at 0.8 keeps
to in all but 1 of 5,000 cases are abandoned; of what is left fingerprints of 1024 bits are compared, then whole sets.

First each document is compared with its block's smallest member; then, within a block, all pairs that these links have
left in different components. So every pair within the radius is either checked or joined already, a group of near
copies that are alike costs as many checks as it has members, and no block gives more links than members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.llm import _support as S
from spanweave.llm.components import components
from spanweave.llm.simhash import planes, within
from spanweave.llm.words import BASES, chunks, mix, over, word_hashes, word_spans

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, SEED = 20, 5, 42
#: Bits of the fingerprints that pairs are compared by before their sets are.
WIDE = 1024
#: Deviations of the expected number of differing bits that the radius allows for.
SPREAD = 3.6
#: Text bytes hashed at once.
CHUNK = 1 << 20
_ODD = np.random.default_rng(SEED).integers(0, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BIT = (np.arange(256)[:, None] >> np.arange(7, -1, -1)) & 1


def radius(similarity: float, bits: int = 64) -> int:
    """Bits in which SimHashes of sets of that similarity differ at most: the mean and SPREAD deviations."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return min(bits - 1, int(np.ceil(bits * p + SPREAD * np.sqrt(bits * p * (1 - p)))))


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its word shingles in lower case A-Z; of all its words, if they are fewer."""
    out: list[np.ndarray] = []
    for a, b in chunks(texts, CHUNK):
        joined, start, stop, count = word_spans([t.lower() for t in texts[a:b]])
        h = word_hashes(joined, start, stop, 1)[0]
        every = over(h, shingle, BASES[1]) if len(h) >= shingle else h[:0]
        for at, n in zip((np.cumsum(count) - count).tolist(), count.tolist()):
            if n >= shingle:
                out.append(np.unique(every[at : at + n - shingle + 1]))
            else:
                out.append(over(h[at : at + n], n, BASES[0]) if n else h[:0])
    return out


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """SimHash of each set (0 if it is empty) and its band keys (0 if it is empty), both as signed 64-bit values."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    fps, keys = np.zeros(len(sets), np.int64), np.zeros((len(sets), BANDS), np.int64)
    if len(full):
        values = np.concatenate([sets[i] for i in full.tolist()])
        of = np.repeat(np.arange(len(full)), size[full])
        fps[full] = np.packbits(_majority(values, of, size[full]), axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel()
        short, start = (values >> np.uint64(32)).astype(np.uint32), np.cumsum(size[full]) - size[full]
        for band in range(BANDS):
            key = np.full(len(full), band + 1, np.uint64)
            for odd in _ODD[band * ROWS : (band + 1) * ROWS]:
                x = short * odd
                x ^= x >> np.uint32(16)
                x *= np.uint32(0x9E3779B1)
                key = mix(key * BASES[0] + np.minimum.reduceat(x, start))
            keys[full, band] = key.view(np.int64)
    return fps, keys


def _majority(values: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each set (values of set `of`, set sizes) the 64 bits that most of its values have, as flags."""
    octets = values.astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = [np.bincount(of * 256 + octets[:, i], minlength=256 * len(size)).reshape(-1, 256) @ _BIT for i in range(8)]
    return 2 * np.concatenate(bits, 1) > size[:, None]


def wide_simhashes(sets: list[np.ndarray]) -> np.ndarray:
    """SimHash of WIDE bits of each set as bytes, one row each; zero of an empty one."""
    size = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(size)
    out = np.zeros((len(sets), WIDE // 8), np.uint8)
    if len(full):
        values, of = np.concatenate([sets[i] for i in full.tolist()]), np.repeat(np.arange(len(full)), size[full])
        for i in range(WIDE // 64):
            out[full, 8 * i : 8 * i + 8] = np.packbits(_majority(mix(values + np.uint64(i + 1) * BASES[1]), of, size[full]), axis=1)
    return out


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if both else 0.0


def _sid(members: np.ndarray) -> int:
    """A name for a set: a signed hash of it, 0 for the empty one."""
    from xxhash import xxh64_intdigest

    got = xxh64_intdigest(members.tobytes(), SEED) if len(members) else 0
    return got - (1 << 64) if got >> 63 else got


#: What names a row: its key and two hashes of its text. Rows that agree in them are repeats of each other.
_ROW = ("_key", "_h", "_g")


def _rows(docs: DataFrame, key: str, text: str, *rest: Column) -> DataFrame:
    plain = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(key).alias("_key"), F.xxhash64(plain).alias("_h"), F.hash(plain, F.lit(1)).alias("_g"), *rest)


def _described(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Of each row with a key: _ROW, sid (the set's name), n (its size), fp (its SimHash), ks (band keys)."""
    rows = _rows(docs.where(F.col(key).isNotNull()), key, text, S.text_bytes(text).alias("_b"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            sets = shingle_sets(S.byte_values(batch.column(3)))
            fps, keys = sketches(sets)
            ks = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
            new = [pa.array([_sid(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), ks]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *new], [*_ROW, "sid", "n", "fp", "ks"])

    return rows.mapInArrow(scan, f"_key {rows.schema['_key'].dataType.simpleString()}, _h long, _g int, sid long, n long, fp long, ks array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Whole runs of equal first column: all columns of some runs, and where each run starts (its end is the last)."""
    held: list[pa.RecordBatch] = []

    def whole(held: list[pa.RecordBatch]) -> list[np.ndarray]:
        return [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in range(held[0].num_columns)]

    def cut(columns: list[np.ndarray]) -> np.ndarray:
        k = columns[0]
        return np.append(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), len(k))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if batch.column(0)[-1].as_py() == held[0].column(0)[0].as_py():
            continue
        columns = whole(held)
        edges = cut(columns)
        last = int(edges[-2])
        tail = batch.num_rows - (int(edges[-1]) - last)  # the last run may go on; it starts in this batch or at its start
        yield [c[:last] for c in columns], edges[:-1]
        held = [batch.slice(max(tail, 0))]
    if held:
        columns = whole(held)
        yield columns, cut(columns)


def _alike(a, b, similarity: float):
    """Whether sets of these sizes can reach the similarity."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b)


def _blocks(firsts: DataFrame) -> DataFrame:
    """k, sid, n, fp, the block's smallest member (head: sid, n, fp) and size (_n), for members of blocks of two or more."""
    keyed = firsts.where("n > 0").select(F.explode("ks").alias("k"), "sid", "n", "fp")
    heads = S.written(keyed.groupBy("k").agg(F.min(F.struct("sid", "n", "fp")).alias("head"), F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    return S.joined(keyed, heads, "k", counts=heads)


def _links(sid: np.ndarray, n: np.ndarray, fp: np.ndarray, root: np.ndarray, s: np.ndarray, w: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links between the components of one block, one for each two of them that meet: m members give m - 1 at most.

    Pairs of one component, also of one that was joined just now, are passed over; the others are compared bit-sliced,
    then by wide fingerprints, then by their sets.
    """
    most, wide_most, m, out = radius(similarity), radius(similarity, WIDE), len(sid), []
    bits, wide = planes(fp.view(np.uint64)), np.frombuffer(b"".join(w), np.uint64).reshape(m, -1)
    sets = [np.frombuffer(x, np.uint64) for x in s]
    _, own = np.unique(root, return_inverse=True)
    for d in range(1, m):
        differ = own[d:] != own[:-d]
        if not differ.any():
            continue
        i = within(bits, d, differ & _alike(n[d:], n[:-d], similarity), most)
        i = i[np.bitwise_count(wide[i] ^ wide[i + d]).sum(1, dtype=np.int64) <= wide_most] if len(i) else i
        for x in i.tolist():
            if own[x] != own[x + d] and jaccard(sets[x], sets[x + d]) >= similarity:
                out.append((int(sid[x]), int(sid[x + d])))
                own[own == own[x + d]] = own[x]
    return out


def _across(blocks: DataFrame, roots: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """u, v: links within blocks between the components that the links to their heads have left.

    Only blocks of three or more that hold others than their head's component are gathered, with their members' sets; so
    a group of copies, however large, is not.
    """

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, *columns), edges in _runs(batches):
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                found = _links(*(c[a:b] for c in columns), similarity)
                if found:
                    u, v = zip(*found)
                    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    named = roots.select(F.col("node").alias("sid"), "root")
    placed = S.joined(blocks.where("_n > 2"), named, "sid", "left").select("k", "sid", "n", "fp", F.col("head.sid").alias("top"), F.coalesce("root", "sid").alias("root"))
    placed = S.written(S.joined(placed, named.select(F.col("sid").alias("top"), F.col("root").alias("_top")), "top", "left").withColumn("_top", F.coalesce("_top", "top")))
    mixed = S.written(placed.where("root <> _top").select("k").distinct())
    rest = S.written(S.joined(placed, mixed, "k").select("k", "sid", "n", "fp", "root"))
    some = S.with_hits(sets, S.bitmap(rest, "sid"), "sid").where("_hit").drop("_hit")
    whole = S.joined(rest, some, "sid").select("k", "sid", "n", "fp", "root", "s", "w")
    return whole.repartition("k").sortWithinPartitions("k", "sid").mapInArrow(links, "u long, v long").distinct()


def _sets(docs: DataFrame, firsts: DataFrame, blocks: DataFrame, key: str, text: str) -> DataFrame:
    """sid, s (the set's bytes), w (its wide SimHash) of all sets in blocks, one row each, from the sets' first rows.

    Texts are read again where a bitmap lets them pass; none is shuffled.
    """
    need = S.written(blocks.select("sid").distinct())
    rows = S.with_hits(_rows(docs.where(F.col(key).isNotNull()), key, text, S.text_bytes(text).alias("_b")), S.bitmap(firsts.join(need, "sid").select("first.*"), *_ROW), *_ROW).where("_hit").select("_b")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            sets = shingle_sets(S.byte_values(batch.column(0)))
            wide = [w.tobytes() for w in wide_simhashes(sets)]
            yield pa.RecordBatch.from_arrays([pa.array([_sid(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(wide, pa.binary())], ["sid", "s", "w"])

    return rows.mapInArrow(scan, "sid long, s binary, w binary").join(need, "sid", "left_semi").dropDuplicates(["sid"])


def _checked(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets are similar enough."""
    ends = pairs.select(F.col("u").alias("sid")).unionByName(pairs.select(F.col("v").alias("sid"))).distinct()
    some = S.with_hits(sets.select("sid", "s"), S.bitmap(ends, "sid"), "sid").where("_hit").drop("_hit")
    one = S.joined(pairs, some.select(F.col("sid").alias("u"), F.col("s").alias("a")), "u")
    both = S.joined(one, some.select(F.col("sid").alias("v"), F.col("s").alias("b")), "v", counts=pairs.groupBy("v").agg(F.count(F.lit(1)).alias("_n"))).select("u", "v", "a", "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in S.slices(batches):
            near = [jaccard(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= similarity for a, b in zip(S.byte_values(batch.column(2)), S.byte_values(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(check, "u long, v long")


def _grouped(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """The described rows, and for each set that isn't alone (sid) the row that stands for its component (won)."""
    table = S.written(_described(docs, key, text))
    firsts = S.written(table.groupBy("sid").agg(F.min(F.struct(*_ROW)).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("ks").alias("ks"), F.count(F.lit(1)).alias("c")))
    blocks = S.written(_blocks(firsts))
    sets = S.written(_sets(docs, firsts, blocks, key, text))
    alike = (F.least("n", "head.n") >= F.lit(similarity) * F.greatest("n", "head.n")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("head.fp"))) <= radius(similarity))
    heads = S.written(blocks.where((F.col("sid") != F.col("head.sid")) & alike).select(F.col("sid").alias("u"), F.col("head.sid").alias("v")).distinct())
    near = S.written(_checked(heads, sets, similarity))
    more = S.written(_across(blocks, components(near), sets, similarity))
    roots = components(near.unionByName(more))
    grouped = S.written(firsts.join(roots, firsts["sid"] == roots["node"], "left").where("c > 1 or root is not null").select("sid", "first", F.coalesce("root", "sid").alias("_root")))
    least = grouped.groupBy("_root").agg(F.min("first").alias("won"))
    return table, S.written(S.joined(grouped, least, "_root").select("sid", "won"))


def near_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """key, component_id for every row with a key.

    component_id is the smallest key reachable over documents whose sets of 5-word shingles have Jaccard similarity
    `similarity` (0.8 or more) at least. Texts without words are one component.
    """
    with S.scratch(docs.sparkSession) as tables:
        table, groups = _grouped(docs, key, text, similarity)
        found = tables.keep(S.written(S.joined(table.select("sid", "_key"), groups, "sid", "left").select(F.col("_key").alias(key), F.coalesce("won._key", "_key").alias("component_id"))))
    return found


def dedup(docs: DataFrame, *, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each near-duplicate group, that of the smallest key; all columns stay, whatever their names.

    A row goes only for a row that stays in its own group. Rows that repeat key and text count once (any of them stays,
    if other columns differ); rows of one key with different texts are judged each by itself. Rows with a null key stay.
    Texts without words (null, empty, white space) are one group. No rows give no rows.

    docs is read three times. Only rows that a bitmap of those to go lets pass are shuffled with their texts.
    """
    with S.scratch(docs.sparkSession) as tables:
        table, groups = _grouped(docs, key, text, similarity)
        losers = tables.keep(S.written(S.joined(table.select("sid", *_ROW), groups, "sid").where(F.struct(*_ROW) != F.col("won")).select(*_ROW)))
        repeated = table.groupBy(*_ROW).count().where("count > 1").select(*_ROW)
        pieces = tables.keep(S.written(S.bitmap(losers.unionByName(repeated), *_ROW)))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    rows = S.with_hits(_rows(docs, key, text, *(F.col(c).alias(n) for n, c in zip(names, docs.columns))), pieces, *_ROW)
    doubted = F.col("_hit") & F.col("_key").isNotNull()
    stays = rows.where(~doubted).select(*names)
    left = rows.where(doubted).dropDuplicates(list(_ROW)).join(losers, list(_ROW), "left_anti").select(*names)
    return stays.unionByName(left).toDF(*docs.columns)
