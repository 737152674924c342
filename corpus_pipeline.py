"""The corpus pipeline: raw documents to packed training sequences.

Each stage reads all that the one before kept and, but for the last, returns the columns of documents, further ones too,
whatever their names. A null text counts as empty; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import _support, mixing, packing, rff_quality, shingle_sets, substring_index
from spanweave.session import ship


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Equal texts are judged alike; without labels of both classes each
    document has the share of good ones as its score."""
    return rff_quality.keep(docs, _labels(ship(spark), sf_dir))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays, that of the smallest id; so do rows
    without an id. Repeated rows count once, and texts without words are one group."""
    ship(spark)
    return shingle_sets.dedup(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go from the texts; documents that lose all their words go. Rows without an id
    keep their texts, and so do those without words; rows of one id don't take from each other."""
    ship(spark)
    return substring_index.strip(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages reach their target weights, in tokens as packing counts them, by repeating documents; none is dropped, and
    none is there more than 16 times: a target missed for that is warned of."""
    return mixing.resample(docs, _labels(ship(spark), sf_dir))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of binary lengths, each a sequence. Each row is packed by itself; an empty text is its end token."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mix),
    ("packing", pack),
]

#: Models and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = _support.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
