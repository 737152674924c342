"""Stored datasets: saved as Parquet with a JSON sidecar, and offloaded in row chunks that are read by a pruned filter."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave import dimensions
from spanweave import schema as fields
from spanweave.dataset import Dataset, SourceInfo
from spanweave.dimensions import Dimension
from spanweave.operators.columns import with_row_id
from spanweave.schema import IndexField, IndexIdentity, Schema


def read_table(spark: SparkSession, path: str, index: str | list[str] | None = None, *, format: str = "parquet", **options) -> Dataset:
    """A stored table as a dataset of value fields; `index` names its row identity."""
    df = spark.read.format(format).options(**options).load(path)
    names = [index] if isinstance(index, str) else list(index or [])
    head = [IndexField(names[0])] if len(names) == 1 else [fields.CompositeIndexField("key", levels=tuple(names))] if names else []
    rest = [fields.ValueField(c) for c in df.columns if c not in names]
    return Dataset(df, Schema((*head, *rest)), sources=(SourceInfo(path, format),))


class CreationOperator:
    """Base of readers that make datasets: make_source() opens what is read, build() makes the dataset of it, and the
    dataset gets generate_source_info() as its provenance. Sources are registered with the manager, if one is given."""

    source_type = "custom"

    def make_source(self, **params: Any) -> Any:
        return None

    def generate_source_info(self, **params: Any) -> SourceInfo:
        told = ",".join(f"{k}={v}" for k, v in sorted(params.items()) if isinstance(v, (str, int, float, bool)))
        return SourceInfo(f"{self.source_type}://{told}", self.source_type)

    def build(self, spark: SparkSession, source: Any, **params: Any) -> Dataset:
        raise NotImplementedError

    def __call__(self, spark: SparkSession, *, source_manager: Any = None, **params: Any) -> Dataset:
        source = self.make_source(**params)
        if source is not None and source_manager is not None:
            source_manager.register(source)
        made = self.build(spark, source, **params)
        return made if made.sources else dataclasses.replace(made, sources=(self.generate_source_info(**params),))


def foreach_chunk(stream: DataFrame, write: Callable[[DataFrame, int], None]):
    """A streaming writer that hands each micro-batch to write(frame, batch number): rows() and offload() of a stream."""
    return stream.writeStream.foreachBatch(write)


def _told(value: Any) -> Any:
    """A field, or what it holds, as JSON."""
    if isinstance(value, fields.Field):
        return {"$field": type(value).__name__} | {f.name: _told(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, IndexIdentity):
        return {"$identity": value.id}
    if isinstance(value, Dimension):
        return {"$dimension": type(value).__name__} | {f.name: _told(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, T.DataType):
        return {"$spark": value.json()}
    if isinstance(value, type):
        return {"$type": value.__name__}
    if isinstance(value, (tuple, list)):
        return {"$tuple": [_told(v) for v in value]} if isinstance(value, tuple) else [_told(v) for v in value]
    if isinstance(value, dict):
        return {"$dict": [[_told(k), _told(v)] for k, v in value.items()]}
    return value


def _read(told: Any) -> Any:
    if isinstance(told, list):
        return [_read(v) for v in told]
    if not isinstance(told, dict):
        return told
    if "$identity" in told:
        return IndexIdentity(told["$identity"])
    if "$spark" in told:
        return T.DataType.fromJson(json.loads(told["$spark"]))
    if "$type" in told:
        return {t.__name__: t for t in (int, float, str, bool, object)}[told["$type"]]
    if "$tuple" in told:
        return tuple(_read(v) for v in told["$tuple"])
    if "$dict" in told:
        return {_read(k): _read(v) for k, v in told["$dict"]}
    kind, where = (told["$field"], fields) if "$field" in told else (told["$dimension"], dimensions)
    return getattr(where, kind)(**{k: _read(v) for k, v in told.items() if not k.startswith("$")})


def save(ds: Dataset, path: str, *, mode: str = "error") -> None:
    """Rows as Parquet, the whole schema (types, dimensions, members, identities), provenance and the row identity beside
    them. Pending columns are not stored: consume them first."""
    ds.df.write.mode(mode).parquet(f"{path}/rows")
    told = {"fields": [_told(f) for f in ds.schema.fields], "sources": [[s.source_uri, s.source_type, s.source_id] for s in ds.sources], "metadata": _told({k: v for k, v in ds.metadata.items() if k not in ("pairing", "terms")})}  # those hold frames
    ds.df.sparkSession.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite" if mode == "append" else mode).text(f"{path}/about")


def load(spark: SparkSession, path: str) -> Dataset:
    told = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
    sources = tuple(SourceInfo(u, t, source_id=i) for u, t, i in told["sources"])
    return Dataset(spark.read.parquet(f"{path}/rows"), Schema(tuple(_read(f) for f in told["fields"])), sources=sources, metadata=_read(told["metadata"]))


@dataclass(frozen=True)
class Chunks:
    """An offloaded dataset: base rows (chunk, start, stop), and the stored rows they point to."""

    base: Dataset
    path: str
    schema: Schema
    into: str = "fiber"

    def _rows(self) -> DataFrame:
        return self.base.df.sparkSession.read.parquet(self.path)

    def extract(self, chunk: int) -> Dataset:
        """One chunk: its partition of the stored table is all that is read."""
        return Dataset(self._rows().where(F.col("_chunk") == chunk).drop("_pos", "_chunk"), self.schema)

    def flatten(self) -> Dataset:
        return Dataset(self._rows().drop("_pos", "_chunk"), self.schema)


def offload(ds: Dataset, *, path: str, chunk_size: int | None = None, order: list[str] | None = None, into: str = "fiber") -> Chunks:
    """Stores the rows in chunks of chunk_size by their order (the index, unless told) and returns row ranges into them.

    An empty dataset gives one (0, 0) chunk.
    """
    done = ds.consumed()
    numbered = with_row_id(done.df, "_pos", order or list(done.index_names))
    size = chunk_size or 2**62
    numbered.withColumn("_chunk", F.floor(F.col("_pos") / F.lit(size)).cast("long")).write.partitionBy("_chunk").parquet(path)
    spark = ds.df.sparkSession
    rows = spark.read.schema(numbered.schema.add("_chunk", "long")).parquet(path)
    base = rows.groupBy(F.col("_chunk").alias("chunk")).agg(F.min("_pos").alias("start"), (F.max("_pos") + 1).alias("stop"))
    if rows.isEmpty():
        base = spark.createDataFrame([(0, 0, 0)], "chunk long, start long, stop long")
    return Chunks(Dataset(base, Schema((IndexField("chunk"), fields.ValueField("start"), fields.ValueField("stop"))), sources=ds.sources), path, done.schema, into)
