"""Row filters and column operators. None of them shuffles; checks that would are made in validation() only."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import replace
from functools import wraps
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.dataset import CallSpec, Coupling, Dataset, FieldHandle, SourceInfo, one_context, strict
from spanweave.schema import (
    CompositeField, CompositeIndexField, Field, ForeignIndexField, IndexColumnField, IndexField, IndexIdentity, Schema, ValueField, spark_type,
)


def make_from_dataframe(
    table: DataFrame | pd.DataFrame, schema: Schema, *, couplings: Sequence[Coupling] = (), source_info: SourceInfo | None = None, spark: SparkSession | None = None
) -> Dataset:
    """A dataset over a DataFrame, or over a pandas frame whose index becomes the index field's column."""
    if isinstance(table, pd.DataFrame):
        names = list(schema.index.columns) if schema.index else ["index"]
        spark = spark or SparkSession.active()
        flat = table.copy()
        flat.index.names = names
        flat = flat.reset_index().convert_dtypes(convert_integer=False)
        table = spark.createDataFrame(flat.astype(object).where(flat.notna(), None).values.tolist(), _struct(flat, schema)) if len(flat) else spark.createDataFrame([], _struct(flat, schema))
    schema.check(table.schema)
    out = Dataset(table, schema, tuple(couplings), (source_info or SourceInfo("memory://dataframe", "dataframe"),))
    return checked_unique(out)


def _struct(flat: pd.DataFrame, schema: Schema):
    from pyspark.sql import types as T

    kinds = {"int64": T.LongType(), "float64": T.DoubleType(), "boolean": T.BooleanType(), "bool": T.BooleanType(), "string": T.StringType()}
    declared = {f.name: spark_type(f.dtype) for f in schema.fields if not isinstance(f, CompositeIndexField)}
    return T.StructType([T.StructField(c, kinds.get(str(flat[c].dtype).lower()) or declared.get(c) or T.StringType()) for c in flat.columns])


def checked_unique(ds: Dataset) -> Dataset:
    if strict() and ds.index_names:
        twice = ds.df.groupBy(*ds.index_names).count().where("count > 1").limit(5).collect()
        if twice:
            raise ValueError(f"index labels are not unique: {[tuple(r)[:-1] for r in twice]}")
    return ds


def _names(ds: Dataset, fields: str | FieldHandle | Sequence) -> list[str]:
    given = [fields] if isinstance(fields, (str, FieldHandle)) else list(fields)  # a FieldSelection lists its handles
    out = [f.name if isinstance(f, FieldHandle) else f for f in given]
    for n in out:
        ds.coming(n)
    return out


def _resolve(ds: Dataset, value: Any) -> Column:
    if callable(value) and not isinstance(value, Column):
        value = value(ds)
    if isinstance(value, FieldHandle):
        return value.column
    return value if isinstance(value, Column) else F.lit(value)


def where(ds: Dataset, predicate: Column | str | Callable[[Dataset], Column]) -> Dataset:
    """Rows for which the predicate is true; null is not. It may test the index."""
    return ds.with_(ds.df.where(predicate if isinstance(predicate, str) else _resolve(ds, predicate)))


def _pruned(ds: Dataset, gone: set[str]) -> tuple[Coupling, ...]:
    kept = tuple(c for c in ds.couplings if c.output not in gone and not gone & set(c.inputs))
    if len(kept) < len(ds.couplings):
        warnings.warn(f"pending columns of dropped fields go too: {[c.output for c in ds.couplings if c not in kept]}", UserWarning, stacklevel=3)
    return kept


def drop(ds: Dataset, fields: str | Sequence[str]) -> Dataset:
    gone = _names(ds, fields)
    index = ds.schema.index
    more = {"index": index.columns, "index_field": index} if index and index.name in gone else {}
    columns = {c for n in gone for c in ds.schema.get(n).columns} - set(ds.index_names)
    return ds.with_(ds.df.drop(*columns), ds.schema.drop(*gone), couplings=_pruned(ds, set(gone)), metadata=ds.metadata | more)


def keep(ds: Dataset, fields: str | Sequence[str]) -> Dataset:
    """Only these fields, in the schema's order. Row identity stays in the table even if its field is not listed."""
    wanted = _names(ds, fields)
    return drop(ds, [n for n in ds.schema.names() if n not in wanted])


def rename(ds: Dataset, names: dict[str, str]) -> Dataset:
    schema = ds.schema.rename(names)
    return ds.with_(ds.df.withColumnsRenamed(names), schema, couplings=tuple(c.renamed(names) for c in ds.couplings))


def assign(ds: Dataset | Sequence[FieldHandle], values: Any = None, *, couplings: Sequence[Coupling] = (), **columns: Any) -> Dataset:
    """Adds or overwrites fields: values are Columns, literals, functions of the dataset, (Field, value), a Dataset or
    DataFrame of (index, column) or a pandas Series whose values are aligned by label, or a list of as many values as
    rows, in the order of the index.

    Given handles and a value for each, their context is moved on. couplings are recorded as pending.
    """
    if not isinstance(ds, Dataset):
        handles = [ds] if isinstance(ds, FieldHandle) else list(ds)
        context = one_context(handles)
        given = [values] if len(handles) == 1 and not isinstance(values, (list, tuple)) else list(values)
        if len(given) != len(handles):
            raise ValueError(f"{len(handles)} handles, {len(given)} values")
        context.dataset = assign(context.dataset, couplings=couplings, **{h.name: v for h, v in zip(handles, given)})
        return context.dataset
    df, schema = ds.df, ds.schema
    plain: dict[str, Column] = {}
    for name, value in columns.items():
        spec = None
        if isinstance(value, tuple) and isinstance(value[0], Field):
            spec, value = value
        if schema.has(name) and isinstance(schema.get(name), CompositeField) and not isinstance(value, Column):
            raise ValueError(f"{name!r} is composite")
        if isinstance(value, (list, np.ndarray)):
            value, df = _positional(ds, df, name, list(value), spec)
        if isinstance(value, pd.Series):
            value = _labelled(ds, value.rename(name))
        if isinstance(value, (DataFrame, Dataset)):
            other = value.df if isinstance(value, Dataset) else value
            own = [c for c in other.columns if c not in ds.index_names][-1]
            df = df.drop(name).join(other.select(*ds.index_names, F.col(f"`{own}`").alias(name)), list(ds.index_names), "left")
        else:
            made = _resolve(ds, value)
            plain[name] = made.cast(spark_type(spec.dtype)) if spec is not None and spec.dtype is not None else made
        old = schema.get(name) if schema.has(name) else None
        if spec is not None and old is not None and (type(spec) is not type(old) or spec.dtype != old.dtype):
            raise ValueError(f"{name!r} is already defined otherwise")
        schema = schema.put(replace(spec, name=name) if spec is not None else old or ValueField(name))
    df = df.withColumns(plain) if plain else df
    return ds.with_(df.drop(*(c for c in df.columns if c.startswith("_given_"))), schema, couplings=(*ds.couplings, *couplings))


def _labelled(ds: Dataset, values: pd.Series) -> DataFrame:
    """(index, value) of a Series, which comes from the driver."""
    kinds = [ds.df.schema[n].dataType for n in ds.index_names]
    made = ds.df.sparkSession.createDataFrame(values.rename_axis(list(ds.index_names)).reset_index())
    return made.select(*(F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(ds.index_names, kinds)), values.name)


def _positional(ds: Dataset, df: DataFrame, name: str, values: list, spec: Field | None) -> tuple[Column, DataFrame]:
    """Values given in the index's order; there must be one for each row."""
    kind = spark_type(spec.dtype).simpleString() if spec is not None and spec.dtype is not None else None
    spark = df.sparkSession
    plain = [v.item() if isinstance(v, np.generic) else v for v in values]
    schema = f"_pos long, _v {kind}" if kind else None
    given = spark.createDataFrame(list(enumerate(plain)), schema or ["_pos", "_v"])
    numbered = with_row_id(df, "_pos", list(ds.index_names))
    if strict() and numbered.count() != len(values):
        raise ValueError(f"{name!r}: {len(values)} values for another number of rows")
    there = numbered.join(given.withColumn("_there", F.lit(True)), "_pos", "left")
    value = F.when(F.col("_there").isNull(), F.raise_error(F.lit(f"{name}: too few values")).cast(given.schema["_v"].dataType)).otherwise(F.col("_v"))
    return F.col(f"_given_{name}"), there.withColumn(f"_given_{name}", value).drop("_pos", "_v", "_there")


def add_column(ds: Dataset | FieldHandle, new: Any, values: Any = None, *, couplings: Sequence[Coupling] = ()) -> Dataset:
    """A new typed field; of a handle whose field is declared only, its values (add_column(handle, values))."""
    if isinstance(ds, FieldHandle):
        return assign([ds], [new], couplings=couplings)
    if isinstance(values, pd.Series):
        values = values.tolist()  # by position
    if ds.schema.has(new.name):
        raise ValueError(f"duplicate field {new.name!r}")
    return assign(ds, couplings=couplings, **{new.name: (new, values)})


def new_field(ds: Dataset, new: Field) -> Dataset:
    """A declared field without values yet."""
    kind = spark_type(new.dtype)
    return ds.with_(ds.df.withColumn(new.name, F.lit(None).cast(kind) if kind is not None else F.lit(None)), ds.schema.add(new))


def map_fields(ds: Dataset, inputs: str | Sequence[str], fn: Callable, out: str, *, dtype: Any = None, lazy: bool = False, batch: bool = False) -> Dataset:
    """A fresh field fn(inputs). Without dtype fn builds a Column; with one it is Python, run on Arrow batches of values:
    row by row, or with batch on pandas Series, one call for thousands of rows.

    lazy records it as pending instead. Given the fibers of a grouping, fn sees whole groups (see groups.map_fibers()).
    """
    if not isinstance(ds, Dataset):
        from spanweave.operators.groups import map_fibers

        return map_fibers(ds, fn, out, dtype=dtype)
    names = _names(ds, inputs)
    if ds.schema.has(out):
        raise ValueError(f"field {out!r} exists")
    if any(isinstance(ds.coming(n), CompositeField) for n in names):
        raise ValueError("composite inputs are not supported")
    if any(c.output == out for c in ds.couplings):
        raise ValueError(f"field {out!r} is pending")
    if dtype is None:
        compute = lambda cols: fn(*(cols[n] for n in names))
    else:
        run = _batched(fn, len(names), spark_type(dtype)) if batch else F.udf(fn, spark_type(dtype), useArrow=True)
        compute = lambda cols: run(*(cols[n] for n in names))
    call = CallSpec.of("map_fields", inputs=tuple(names), fn=fn, out=out, dtype=dtype, lazy=True, batch=batch) if lazy else None
    pending = ds.with_(couplings=(*ds.couplings, Coupling(tuple(names), out, compute, ValueField(out, dtype=dtype), "map", call)))
    return pending if lazy else pending.consumed(out)


def _batched(fn: Callable, many: int, kind) -> Callable:
    def run(*series: pd.Series) -> pd.Series:
        return fn(*series)

    return F.pandas_udf(run, kind) if many else F.udf(fn, kind)


def consume(ds: Dataset, target: str | Coupling | None = None) -> Dataset:
    """Computes pending columns up to a target and discharges them."""
    return ds.consumed(target.output if isinstance(target, Coupling) else target)


def set_index(ds: Dataset, field: str, *, index_name: str | None = None, drop: bool = True) -> Dataset:
    """Promotes a column to row identity of a new namespace; the old identity becomes a column that remembers its own."""
    if not drop:
        raise NotImplementedError("drop=False")
    old, new = ds.schema.index, ds.schema.get(field)
    if isinstance(old, CompositeIndexField):
        raise ValueError("a composite index cannot be replaced")
    name = index_name or field
    demoted = [IndexColumnField(old.name, dtype=old.dtype, identity=old.identity, lineage=old.lineage)] if old else []
    rest = [f for f in ds.schema.fields if f.name != field and f is not old]
    schema = Schema((IndexField(name, lineage=new.lineage), *demoted, *rest))
    meta = {k: v for k, v in ds.metadata.items() if k not in ("index", "index_field")}
    return checked_unique(ds.with_(ds.df.withColumnRenamed(field, name), schema, couplings=tuple(c.renamed({field: name}) for c in ds.couplings), metadata=meta))


def reset_index(ds: Dataset, *, index_name: str = "index", dense: bool = True) -> Dataset:
    """The index becomes columns again; a fresh one counts rows in the old labels' order (dense) or is merely unique."""
    if index_name in ds.df.columns:
        raise ValueError(f"column {index_name!r} exists")
    old = ds.schema.index
    levels = ds.metadata.get("levels", {})
    back = [levels.get(c, ValueField(c)) for c in old.columns] if isinstance(old, CompositeIndexField) else [IndexColumnField(old.name, dtype=old.dtype, identity=old.identity)] if old else []
    df = with_row_id(ds.df, index_name, list(ds.index_names) if dense else None)
    return ds.with_(df, Schema((IndexField(index_name), *back, *ds.values)), couplings=(), metadata={})


def with_row_id(df: DataFrame, name: str, order: list[str] | None = None) -> DataFrame:
    """A long column: 0..N-1 in the given order, or without one unique but not dense (and without any shuffle), the same
    in every evaluation only while the rows come from a stored table through row-wise operators.

    Dense ids are made without a single-task window: rows are sorted into ranges, ranges are counted, and each range
    starts where those before it end. The sorted rows are written once, as a second sort might cut other ranges.
    """
    if order is None:
        return df.withColumn(name, F.monotonically_increasing_id())
    from spanweave.storage import written

    low = F.lit((1 << 33) - 1)
    raw = F.monotonically_increasing_id()
    kept = written(df.sort(*order).withColumn("_part", F.shiftright(raw, 33)).withColumn("_nth", raw.bitwiseAND(low)))
    start, starts = 0, []
    for r in sorted(kept.groupBy("_part").count().collect()):  # one number per range
        starts.append((r["_part"], start))
        start += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_nth")).drop("_part", "_nth", "_start")


def with_label(df: DataFrame, name: str, of: list[str]) -> DataFrame:
    """A text label made of columns that are unique together: the same in every evaluation, and free of any shuffle."""
    return df.withColumn(name, F.concat_ws("|", *(F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("||")), F.lit("|-")) for c in of)))


def link(ds: Dataset, target: Dataset, field: str, *, allow_dangling: bool = False) -> Dataset:
    """Declares a column to hold labels of target's rows."""
    old = ds.schema.get(field)
    if strict() and not allow_dangling:
        other = target.df.select(F.col(target.index_name).alias("_label"))
        lost = ds.df.select(F.col(field).alias("_own")).join(other, F.col("_own") == F.col("_label"), "left_anti").select("_own").distinct().limit(5).collect()
        if lost:
            raise ValueError(f"labels without a target row: {[r[0] for r in lost]}")
    return ds.with_(schema=ds.schema.put(ForeignIndexField(field, dtype=old.dtype, target=target.identity, lineage=old.lineage)))


_MODES = {"schema": ("preserve", "construct"), "identity": ("preserve", "inherit", "mint"), "couplings": ("derive", "inherit", "clear"), "sources": ("inherit", "clear")}


def pipe(ds: Dataset, fn: Callable[..., DataFrame], *args: Any, schema: Schema | None = None, transitions: dict[str, str] | None = None, **more: Any) -> Dataset:
    """fn(dataset) -> DataFrame. Without a schema the result keeps the dataset's (labels must be among its rows'); with
    one it is a new dataset with its own identity and no pending columns.

    transitions overrides that by aspect: schema preserve or construct; identity preserve, inherit (the dataset's, for
    labels among its rows') or mint; couplings derive (those whose inputs are left), inherit or clear; sources inherit
    or clear.
    """
    told = transitions or {}
    for aspect, mode in told.items():
        if aspect not in _MODES:
            raise ValueError(f"unknown aspect {aspect!r}")
        if mode not in _MODES[aspect]:
            raise NotImplementedError(f"{aspect}={mode!r}")
    if (told.get("schema") == "construct") != (schema is not None) and "schema" in told:
        raise ValueError("schema='construct' goes with a schema, 'preserve' without one")
    identity = told.get("identity", "mint" if schema is not None else "inherit")
    couplings = told.get("couplings", "clear" if schema is not None else "inherit")
    df = fn(ds, *args, **more)
    made = schema or ds.schema
    made.check(df.schema)
    if made.index is not None and not isinstance(made.index, CompositeIndexField):
        if identity == "mint":
            made = made.put(replace(made.index, identity=IndexIdentity())) if schema is None else made
        elif ds.schema.index is not None:
            made = made.put(replace(made.index, identity=ds.identity))
    if identity != "mint" and strict() and ds.index_names and made.index is not None:
        names = list(made.index.columns)
        if len(names) == len(ds.index_names):
            own = ds.df.select(*(F.col(o).alias(n) for o, n in zip(ds.index_names, names)))
            if df.select(*names).join(own, names, "left_anti").limit(1).count():
                raise ValueError("new row labels need a schema of their own")
    kept = () if couplings == "clear" else ds.couplings if couplings == "inherit" else tuple(c for c in ds.couplings if all(made.has(i) for i in c.inputs))
    sources = () if told.get("sources") == "clear" else ds.sources
    return checked_unique(Dataset(df, made, kept, sources, {} if schema is not None else ds.metadata))


def table_transform(*, schema: Schema | None = None, transitions: dict[str, str] | None = None) -> Callable:
    """Decorator: a named pipe()."""

    def named(fn: Callable[..., DataFrame]) -> Callable[..., Dataset]:
        @wraps(fn)
        def run(ds: Dataset, *args: Any, **more: Any) -> Dataset:
            return pipe(ds, fn, *args, schema=schema, transitions=transitions, **more)

        run.pipe_fn = fn
        return run

    return named
