"""Grouping. A bundle of fibers is kept factored: its base rows and its members, nested only on demand."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.dataset import Dataset, strict, union_sources
from spanweave.schema import BundleField, CompositeIndexField, DataField, DimensionedSliceField, ForeignIndexField, IndexField, IndexIdentity, Schema, ValueField, spark_type


@dataclass(frozen=True)
class Fibers:
    """Groups of a dataset: base has one row per group, members hold the rows, `by` leads from these to those."""

    base: Dataset
    members: Dataset
    by: tuple[str, ...]
    into: str

    @property
    def schema(self) -> Schema:
        return self.base.schema.add(BundleField(self.into))

    def nested(self, order: Sequence[str] | None = None) -> DataFrame:
        """base with the column `into`, an array of member structs, sorted by the members' labels or by `order` columns.

        A fiber becomes one cell: use it where the largest group fits a task, else stay with members and reducers.
        """
        first = list(order or self.members.index_names)
        rest = [c for c in self.members.df.columns if c not in first]
        cell = F.sort_array(F.collect_list(F.struct(*(F.col(f"`{c}`") for c in [*first, *rest])))).alias(self.into)
        nested = self.members.df.select(*(F.col(f"`{b}`").alias(f"_g{i}") for i, b in enumerate(self.by)), "*").groupBy(*(f"_g{i}" for i in range(len(self.by)))).agg(cell)
        on = [self.base.df[k] == nested[f"_g{i}"] for i, k in enumerate(self.base.index_names)]
        out = self.base.df.join(nested, on, "left").select(*self.base.df.columns, self.into)
        kind = out.schema[self.into].dataType.simpleString()
        return out.withColumn(self.into, F.coalesce(self.into, F.array().cast(kind)))

    @property
    def table(self) -> DataFrame:
        return self.nested()

    def field(self, name: str) -> FiberHandle:
        """A handle on the fibers, or on a pending aggregate of them."""
        return FiberContext(self)[name]

    def __getitem__(self, label: Any) -> dict:
        from spanweave.dataset import exited

        labels = label if isinstance(label, tuple) else (label,)
        df = self.nested()
        for n, v in zip(self.base.index_names, labels):
            df = df.where(F.col(n) == F.lit(v))
        row = df.first()
        if row is None:
            raise KeyError(label)
        return exited(row)


class FiberContext:
    """Pending aggregates over one grouping: reducers given its fiber handle are recorded, and made in one aggregation."""

    def __init__(self, fibers: Fibers):
        self.fibers, self.pending = fibers, {}

    def __getitem__(self, name: str) -> FiberHandle:
        if name != self.fibers.into and name not in self.pending and not self.fibers.base.schema.has(name):
            raise ValueError(f"unknown field {name!r}")
        return FiberHandle(self, name)

    def defer(self, out: str, reducer: ReducingOperator) -> FiberHandle:
        if out in self.pending or out in self.fibers.base.index_names:
            raise ValueError(f"field {out!r} exists")
        self.pending[out] = reducer
        return FiberHandle(self, out)

    def collect(self) -> Dataset:
        return reduced(self.fibers, dict(self.pending))


@dataclass(frozen=True)
class FiberHandle:
    context: FiberContext
    name: str

    def collect(self) -> Dataset:
        """All pending aggregates; of the fibers themselves, their rows."""
        return flatten(self.context.fibers) if self.name == self.context.fibers.into else self.context.collect()


def map_fibers(fibers: Fibers | FiberHandle, fn: Any, out: str, *, dtype: Any = None) -> Dataset:
    """One value per group from its whole fiber, opaque to Spark.

    Without dtype fn builds a Column from the fiber as an array of member structs. With one it is Python, given a pandas
    frame of the members sorted by their labels (an empty one for a group without any). Either way a group is in one
    task at a time: it must fit there. Reducers have no such bound.
    """
    if isinstance(fibers, FiberHandle):
        fibers = fibers.context.fibers
    keys = list(fibers.base.index_names)
    if fibers.base.schema.has(out):
        raise ValueError(f"field {out!r} exists")
    if dtype is None:
        df = fibers.nested().withColumn(out, fn(F.col(f"`{fibers.into}`"))).select(*fibers.base.df.columns, out)
        return Dataset(df, fibers.base.schema.add(ValueField(out)), sources=fibers.base.sources, metadata=fibers.base.metadata)
    import pandas as pd
    from pyspark.sql import types as T

    members, by, order = fibers.members.df, list(fibers.by), list(fibers.members.index_names)
    columns = list(members.columns)
    kind = T.StructType([*(T.StructField(f"_g{i}", members.schema[b].dataType) for i, b in enumerate(by)), T.StructField(out, spark_type(dtype))])

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, fn(group.sort_values(order, ignore_index=True))]], columns=[f.name for f in kind])

    made = members.groupBy(*(f"`{b}`" for b in by)).applyInPandas(run, kind)
    df = fibers.base.df.join(made, [fibers.base.df[k] == made[f"_g{i}"] for i, k in enumerate(keys)], "left")
    if _total(fibers):
        empty = fn(pd.DataFrame({c: [] for c in columns}))
        df = df.withColumn(out, F.when(F.col("_g0").isNull(), F.lit(empty).cast(spark_type(dtype))).otherwise(F.col(out)))
    return Dataset(df.select(*fibers.base.df.columns, out), fibers.base.schema.add(ValueField(out, dtype=dtype)), sources=fibers.base.sources, metadata=fibers.base.metadata)


def partition(ds: Dataset, by: str | Sequence[str], domain: Dataset | None = None, *, into: str = "fiber", null_keys: str = "error") -> Fibers:
    """Fibers by one key, or by several (base index `key` of several levels).

    A foreign key's base takes the target's identity; with a domain all its rows are groups, empty ones too. Null keys
    fail (in strict validation, or when read), or are dropped.
    """
    keys = (by,) if isinstance(by, str) else tuple(by)
    if null_keys == "group":
        raise NotImplementedError("null_keys='group'")
    fields = [ds.schema.get(k) for k in keys]
    for f in fields:
        if isinstance(f, (IndexField, DataField, DimensionedSliceField, BundleField)) or f.columns != (f.name,):
            raise ValueError(f"{f.name!r} cannot be a key")
    if domain is not None and len(keys) > 1:
        raise ValueError("a composite key has no domain")
    members = ds
    some = F.lit(False)
    for k in keys:
        some = some | F.col(f"`{k}`").isNull()
    if null_keys == "drop":
        members = ds.with_(ds.df.where(~some))
    elif strict() and ds.df.where(some).limit(1).count():
        raise ValueError("null keys")
    else:
        members = ds.with_(ds.df.withColumns({k: F.coalesce(F.col(f"`{k}`"), F.raise_error(F.lit(f"null key {k}")).cast(ds.df.schema[k].dataType)) for k in keys}))
    foreign = isinstance(fields[0], ForeignIndexField) and len(keys) == 1
    if domain is not None:
        if not foreign:
            raise ValueError("a domain needs a foreign key; link() declares one")
        if fields[0].target != domain.identity:
            raise ValueError("the key points into another dataset than the domain")
        if strict():
            lost = members.df.join(domain.df.select(F.col(domain.index_name).alias("_t")), F.col(keys[0]) == F.col("_t"), "left_anti").limit(1).count()
            if lost:
                raise ValueError("keys outside the domain")
        base = Dataset(domain.df.select(F.col(domain.index_name).alias(keys[0])), Schema((IndexField(keys[0], identity=domain.identity),)), sources=union_sources(ds.sources, domain.sources))
    else:
        identity = fields[0].target if foreign and fields[0].target else IndexIdentity()
        index = IndexField(keys[0], identity=identity) if len(keys) == 1 else CompositeIndexField("key", levels=keys)
        base = Dataset(members.df.select(*keys).distinct(), Schema((index,)), sources=ds.sources, metadata={"levels": dict(zip(keys, fields))})
    return Fibers(base, members, keys, into)


def flatten(bundle: Fibers | Sequence[Dataset]) -> Dataset:
    """All members of all groups (those of keys outside a domain are gone), or the union of several datasets."""
    if isinstance(bundle, Fibers):
        m = bundle.members
        labels = bundle.base.df.select(*(F.col(k).alias(f"_b{i}") for i, k in enumerate(bundle.base.index_names)))
        on = [m.df[k] == labels[f"_b{i}"] for i, k in enumerate(bundle.by)]
        return m.with_(m.df.join(labels, on, "left_semi"))
    from spanweave.operators.composition import concat_rows

    cells = [d for d in bundle if d is not None]
    if not cells:
        raise ValueError("nothing to flatten")
    return concat_rows(*cells)


@dataclass(frozen=True)
class ReducingOperator:
    """One value per group. Subclasses give a native expression; empty is what a group without rows has."""

    column: str | None = None
    empty: Any = None
    dtype: Any = None

    @classmethod
    def on(cls, column: str | None = None) -> ReducingOperator:
        return cls(column=column)

    def expression(self) -> Column:
        raise NotImplementedError

    def __call__(self, fibers: Fibers | FiberHandle, *, out: str) -> Dataset | FiberHandle:
        """Of fibers: the aggregate. Of a handle on them: recorded as pending, with a handle on it."""
        return fibers.context.defer(out, self) if isinstance(fibers, FiberHandle) else reduced(fibers, {out: self})


class Sum(ReducingOperator):
    """As double; nulls are skipped, nothing to add is 0."""

    def expression(self) -> Column:
        return F.coalesce(F.sum(F.col(f"`{self.column}`").cast("double")), F.lit(0.0))


class Count(ReducingOperator):
    def expression(self) -> Column:
        return F.count(F.lit(1))


class Mean(ReducingOperator):
    def expression(self) -> Column:
        return F.avg(F.col(f"`{self.column}`").cast("double"))


class Min(ReducingOperator):
    def expression(self) -> Column:
        return F.min(f"`{self.column}`")


class Max(ReducingOperator):
    def expression(self) -> Column:
        return F.max(f"`{self.column}`")


class Distinct(ReducingOperator):
    """Exact number of distinct values, nulls left out."""

    def expression(self) -> Column:
        return F.countDistinct(f"`{self.column}`")


@dataclass(frozen=True)
class Custom(ReducingOperator):
    """A Python function of a pandas Series to one value, run per group on Arrow batches."""

    fn: Any = None
    kind: Any = float

    def expression(self) -> Column:
        import pandas as pd

        fn = self.fn

        def run(values: pd.Series) -> Any:
            return fn(values)

        run.__annotations__ = {"values": pd.Series, "return": float}
        return F.pandas_udf(run, spark_type(self.kind))(F.col(f"`{self.column}`"))


_EMPTY = {Sum: 0.0, Count: 0, Distinct: 0}


def reduced(fibers: Fibers, aggs: dict[str, ReducingOperator]) -> Dataset:
    """One row per base row: all reducers in one aggregation, partial before its shuffle; empty groups filled."""
    if set(aggs) & set(fibers.base.index_names):
        raise ValueError("an aggregate is named like the key")
    grouped = fibers.members.df.groupBy(*(f"`{b}`" for b in fibers.by)).agg(*(a.expression().alias(n) for n, a in aggs.items()))
    schema = fibers.base.schema.add(*(ValueField(n) for n in aggs))
    keys = list(fibers.base.index_names)
    if fibers.base.schema.index is not None and fibers.base.df.columns == keys and not _total(fibers):
        return Dataset(grouped, schema, sources=fibers.base.sources, metadata=fibers.base.metadata)
    renamed = grouped.withColumnsRenamed({b: f"_g{i}" for i, b in enumerate(fibers.by)})
    df = fibers.base.df.join(renamed, [fibers.base.df[k] == renamed[f"_g{i}"] for i, k in enumerate(keys)], "left").drop(*(f"_g{i}" for i in range(len(keys))))
    for n, a in aggs.items():
        if type(a) in _EMPTY:
            df = df.withColumn(n, F.coalesce(n, F.lit(_EMPTY[type(a)])))
    return Dataset(df, schema, sources=fibers.base.sources, metadata=fibers.base.metadata)


def _total(fibers: Fibers) -> bool:
    """Whether base may have groups without members."""
    return "levels" not in fibers.base.metadata


def reduce(ds: Dataset, by: str | Sequence[str], aggs: dict[str, ReducingOperator], domain: Dataset | None = None, *, null_keys: str = "error") -> Dataset:
    return reduced(partition(ds, by, domain, null_keys=null_keys), aggs)
