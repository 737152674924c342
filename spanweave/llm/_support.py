"""What the corpus operators share: bounded label samples and Arrow helpers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.storage import scratch, shared_folder, written  # noqa: F401  the operators' way to shared tables

#: Keys that joined() deals over SALTS parts, the most frequent ones, and the rows that such a key has at least.
HOT_KEYS, HOT_ROWS, SALTS = 500, 2000, 64
#: Bits of a bitmap of hashed keys, which is broadcast: 8 MiB at every input size.
BITMAP_BITS, _BUCKET_BITS = 1 << 26, 1 << 15
#: Words are maximal runs of other characters than these six; bytes.split() cuts at the same ones.
SPACES = " \t\n\x0b\x0c\r"


def text_bytes(column: str = "text") -> Column:
    """A text column as UTF-8; null is the empty text."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels no model may learn: crc32 of the id as text, modulo 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def label_sample(labels: DataFrame, target: str, most: int, key: str = "doc_id") -> DataFrame:
    """At most `most` labelled ids (key, y double, fold int) that may be learned from, the first by hash of their id.

    Null ids and labels are left out; an id that is labelled twice counts once, with its larger label. `most` bounds
    what is broadcast and what a driver-side fit reads, at every input size.
    """
    return (
        labels.where(F.col(key).isNotNull() & F.col(target).isNotNull() & ~held_out(key))
        .groupBy(key)
        .agg(F.max(F.col(target).cast("double")).alias("y"))
        .select(key, "y", (F.crc32(F.col(key).cast("string")) % 4).cast("int").alias("fold"))
        .orderBy(F.xxhash64(key), key)
        .limit(most)
    )


def joined(many: DataFrame, one: DataFrame, on: str, how: str = "inner", *, counts: DataFrame | None = None) -> DataFrame:
    """many.join(one, on, how), in which the HOT_KEYS most frequent keys of more than HOT_ROWS rows are dealt over SALTS parts each.

    `one` has at most one row a key. Only those keys, HOT_KEYS at most, go to the driver. A key beyond them holds less
    than 1 in HOT_KEYS of all rows. `counts` has the keys of many and their rows (_n), if the caller knows them. A row's
    part follows from its values, so a task that is run again deals it out alike.
    """
    counted = many.groupBy(on).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts
    hot = [x[0] for x in counted.where((F.col("_n") > HOT_ROWS) & F.col(on).isNotNull()).orderBy(F.desc("_n"), on).limit(HOT_KEYS).select(on).collect()]
    if not hot:
        return many.join(one, on, how)
    is_hot = F.col(on).isin(hot)
    part = F.pmod(F.xxhash64(*(f.name for f in many.schema if f.dataType.typeName() not in ("binary", "array", "map"))), F.lit(SALTS)).cast("int")
    dealt = many.withColumn("_salt", F.when(is_hot, part).otherwise(0))
    copies = one.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [on, "_salt"], how).drop("_salt")


def bitmap(keys: DataFrame, *columns: str) -> DataFrame:
    """_bucket, _bits: the hashed keys as a bitmap of BITMAP_BITS, in pieces."""
    at = keys.select((F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS)) + 1).alias("_at"))
    return at.groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bits"))


def with_hits(rows: DataFrame, pieces: DataFrame, *columns: str) -> DataFrame:
    """rows with _hit: false if the row's key is surely not in a bitmap(), true if it may be.

    So that only rows that may matter are shuffled. The more keys the bitmap holds, the more other rows it lets pass.
    """
    at = F.pmod(F.xxhash64(*columns), F.lit(BITMAP_BITS))
    place = F.pmod(at, F.lit(_BUCKET_BITS)).cast("int")
    bucket = (F.floor(at / F.lit(_BUCKET_BITS)) + 1).cast("long")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8))) == 1, F.lit(False))
    told = rows.withColumn("_bucket", bucket).join(F.broadcast(pieces), "_bucket", "left")  # BITMAP_BITS bound the pieces
    return told.withColumn("_hit", hit).drop("_bucket", "_bits")


def byte_values(array: pa.Array) -> list[bytes]:
    """The values of a binary Arrow column."""
    return array.to_pylist()


def trim() -> None:
    """Gives a worker's freed memory back to the machine: workers outlive their tasks, and the next may need it more."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that a worker holds few texts as Python objects at a time."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)
    trim()
