"""Sources of whole datasets: row ranges of stored datasets, and accessors that point to them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.dataset import Dataset
from spanweave.dimensions import IndexDimension
from spanweave.operators.columns import with_row_id
from spanweave.sources.arrays import SourceDescriptor
from spanweave.storage import shared_folder

#: The dimension that row ranges are told in.
ROW = IndexDimension("row")
#: Rows of a stored file; a range reads the files that hold it.
FILE_ROWS = 1 << 20


class DatasetSource:
    """Ranges of rows [start, stop), in a fixed order."""

    @property
    def descriptor(self) -> SourceDescriptor:
        raise NotImplementedError

    def length(self) -> int:
        """The number of rows, without reading them."""
        raise NotImplementedError

    def read(self, start: int | None = None, stop: int | None = None) -> Dataset:
        raise NotImplementedError


@dataclass(frozen=True)
class StoredDatasetSource(DatasetSource):
    """A dataset written with a position for each row, in files of FILE_ROWS rows by position: a range is a pruned filter."""

    spark: SparkSession
    path: str

    @staticmethod
    def write(ds: Dataset, path: str, *, order: list[str] | None = None, file_rows: int = FILE_ROWS) -> StoredDatasetSource:
        from spanweave.sources.tables import save

        done = ds.consumed()
        numbered = with_row_id(done.df, "_pos", order or list(done.index_names))
        save(done.with_(done.df.limit(0)), f"{path}/schema")
        numbered.withColumn("_file", F.floor(F.col("_pos") / F.lit(file_rows)).cast("long")).write.partitionBy("_file").parquet(f"{path}/rows")
        n = numbered.count()
        told = json.dumps({"rows": n, "file_rows": file_rows, "columns": numbered.schema.json()})
        ds.df.sparkSession.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/count")
        return StoredDatasetSource(ds.df.sparkSession, path)

    @property
    def descriptor(self) -> SourceDescriptor:
        return SourceDescriptor("stored_dataset", self.path, {"path": self.path})

    def _about(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/count", wholetext=True).first()[0])

    def length(self) -> int:
        return self._about()["rows"]

    def read(self, start: int | None = None, stop: int | None = None) -> Dataset:
        from pyspark.sql import types as T

        from spanweave.sources.tables import load

        about = self._about()
        low, high = max(start or 0, 0), min(about["rows"] if stop is None else stop, about["rows"])
        kind = T.StructType.fromJson(json.loads(about["columns"]))
        rows = self.spark.read.schema(T.StructType([*kind.fields, T.StructField("_file", T.LongType())])).parquet(f"{self.path}/rows")
        found = rows.where((F.col("_file") >= low // about["file_rows"]) & (F.col("_file") <= max(high - 1, 0) // about["file_rows"]) & (F.col("_pos") >= low) & (F.col("_pos") < high))
        return load(self.spark, f"{self.path}/schema").with_(found.drop("_pos", "_file"))


@dataclass
class DatasetStore:
    """Datasets by name, in one folder (the shared one, unless told). put() on an existing name fails."""

    spark: SparkSession
    folder: str | None = None
    sources: dict[str, StoredDatasetSource] = field(default_factory=dict)

    def put(self, name: str, ds: Dataset) -> DatasetSource:
        if name in self.sources:
            raise ValueError(f"dataset {name!r} exists")
        folder = self.folder or shared_folder(self.spark)
        self.sources[name] = StoredDatasetSource.write(ds, f"{folder.rstrip('/')}/dataset-{name}")
        return self.sources[name]

    def get(self, name: str) -> DatasetSource:
        if name not in self.sources:
            raise KeyError(name)
        return self.sources[name]

    def accessors(self, name: str, chunk_size: int) -> DataFrame:
        """accessor struct<store_id, start, stop> of each chunk of rows."""
        n = self.get(name).length()
        spans = [(name, a, min(a + chunk_size, n)) for a in range(0, max(n, 1), chunk_size)]
        return self.spark.createDataFrame([(s,) for s in spans], "accessor struct<store_id: string, start: long, stop: long>")

    def resolve(self, accessor: dict) -> Dataset:
        """The rows that an accessor points to."""
        return self.get(accessor["store_id"]).read(accessor["start"], accessor["stop"])


def assert_dataset_source_contract(source: DatasetSource, make: Callable[[], DatasetSource] | None = None) -> None:
    """What every dataset source must hold to."""
    n, whole = source.length(), source.read()
    assert len(whole) == n, "length() and read() differ"
    labels = lambda ds: sorted(tuple(r) for r in ds.df.select(*ds.index_names).collect())
    middle = n // 2
    assert sorted(labels(source.read(0, middle)) + labels(source.read(middle, n))) == labels(whole), "two halves are not the whole"
    assert len(source.read(n, n + 10)) == 0 and len(source.read(0, 0)) == 0, "an empty range has rows"
    assert source.read(0, 1).schema.names() == whole.schema.names(), "a range has another schema"
    if make is not None:
        assert make().descriptor == source.descriptor, "the same source has two descriptors"
