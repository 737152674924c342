"""Tables in the shared folder that spark.checkpoint.dir names."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[Scratch | None] = ContextVar("scope", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of this machine only where a local session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spanweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


class Scratch:
    """Tables that go when their scope ends, but for those kept."""

    def __init__(self, outer: Scratch | None):
        self.outer, self.tables = outer, []

    def keep(self, table: DataFrame) -> DataFrame:
        """A written table that outlives this scope: it goes with the next outer one, or when the driver ends."""
        path = table._written
        self.tables.remove(path)
        _hand_over(self.outer, table.sparkSession, path)
        return table


def _hand_over(scope: Scratch | None, spark: SparkSession, path: str) -> None:
    if scope is not None:
        scope.tables.append(path)
    else:
        atexit.register(_remove, spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Within it, written() tables are temporary: what is made of them must be written and kept before it ends."""
    mine = Scratch(_scope.get())
    token = _scope.set(mine)
    try:
        yield mine
    finally:
        _scope.reset(token)
        for path in mine.tables:
            _remove(spark, path)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table there: cuts the lineage, survives lost executors; removed with its scope or the driver."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spanweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _hand_over(_scope.get(), spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass
