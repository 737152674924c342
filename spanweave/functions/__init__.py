"""Plain relational pass-throughs that datasets offer beyond their own operators; each keeps the schema."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanweave.dataset import Dataset


def order_by(ds: Dataset, *columns: str | Column) -> Dataset:
    return ds.with_(ds.df.orderBy(*columns))


def limit(ds: Dataset, n: int) -> Dataset:
    return ds.with_(ds.df.limit(n))


def distinct(ds: Dataset, *fields: str) -> Dataset:
    return ds.with_(ds.df.dropDuplicates(list(fields) or None))


def sample(ds: Dataset, fraction: float, seed: int = 0) -> Dataset:
    return ds.with_(ds.df.sample(fraction=fraction, seed=seed))


def intersect(a: Dataset, b: Dataset) -> Dataset:
    """Rows of a that b has too, repeats by the smaller count."""
    return a.with_(a.df.intersectAll(b.df.select(a.df.columns)))


def subtract(a: Dataset, b: Dataset) -> Dataset:
    """Rows of a less those of b, one for one."""
    return a.with_(a.df.exceptAll(b.df.select(a.df.columns)))


def semi(ds: Dataset, plan: Dataset, ref: str = "left_index") -> Dataset:
    """Rows that a plan points to."""
    return ds.with_(ds.df.join(plan.df.select(F.col(ref).alias("_ref")), F.col(ds.index_name) == F.col("_ref"), "left_semi"))


def anti(ds: Dataset, plan: Dataset, ref: str = "left_index") -> Dataset:
    """Rows that no pair of a plan points to."""
    return ds.with_(ds.df.join(plan.df.select(F.col(ref).alias("_ref")), F.col(ds.index_name) == F.col("_ref"), "left_anti"))


def latest(ds: Dataset, by: str, time: str) -> Dataset:
    """Each key's last row by time, ties to the larger label: a partial aggregate of structs, no window sort."""
    rest = [c for c in ds.df.columns if c not in (time, ds.index_name)]
    row = F.max(F.struct(time, ds.index_name, *rest))
    return ds.with_(ds.df.groupBy(F.col(by).alias("_by")).agg(row.alias("_r")).select("_r.*").select(*ds.df.columns))
