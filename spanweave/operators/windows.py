"""Windows over dimensions, slices, and lazily read data."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanweave.dataset import CallSpec, Coupling, Dataset
from spanweave.dimensions import AxisWindow, CategoricalDimension, Dimension
from spanweave.operators.columns import with_label, with_row_id
from spanweave.schema import DataField, DimensionField, DimensionedSliceField, ForeignIndexField, IndexField, Schema


def window_expansion_plan(
    ds: Dataset, *, windows: Mapping[str, AxisWindow], field: str | None = None, bindings: Mapping[str, tuple[str, str]] | None = None,
    source_index_field: str = "source_index", slice_field: str = "slice", plan_index_name: str = "plan_id", dense: bool = True,
) -> Dataset:
    """A plan of windows over each row's extent: a slice field (null ones give none) or pairs of bound scalar fields.

    Several dimensions give their product, the first named slowest; other dimensions of a slice stay as they are. The
    tiling is an expression per row, so it needs no shuffle unless ids are dense.
    """
    if ds.metadata.get("plan"):
        warnings.warn("windows over a plan: explode it first for windows of rows", UserWarning, stacklevel=2)
    if (field is None) == (bindings is None):
        raise ValueError("give field or bindings")
    if field is not None:
        source = ds.schema.get(field)
        whole = F.col(f"`{field}`")
        members = [d.name for d in source.dimensions]
        extent = {d: whole[d] for d in members}
        df = ds.df.where(whole.isNotNull())
        dims = source.dimensions
    else:
        members = list(bindings)
        need = lambda c: F.when(F.col(f"`{c}`").isNull(), F.raise_error(F.lit(f"null bound {c}")).cast(ds.df.schema[c].dataType)).otherwise(F.col(f"`{c}`"))
        extent = {d: F.struct(need(a).alias("start"), need(b).alias("stop")) for d, (a, b) in bindings.items()}
        df = ds.df
        dims = tuple(_dimension_of(ds, d, *pair) for d, pair in bindings.items())
    for d in windows:
        if d not in members:
            raise ValueError(f"no dimension {d!r} in the extent")
    out = df.select(F.col(f"`{ds.index_name}`").alias(source_index_field), *(extent[d].alias(f"_e_{d}") for d in members))
    for d, w in windows.items():
        e = F.col(f"_e_{d}")
        out = out.withColumn(f"_w_{d}", F.explode(w.windows(e["start"], e["stop"])))
    parts = F.struct(*(F.col(f"_w_{d}" if d in windows else f"_e_{d}").alias(d) for d in members))
    tiled = out.select(source_index_field, parts.alias(slice_field))
    order = [source_index_field, *(f"{slice_field}.{d}.start" for d in windows)]
    plan = (with_row_id if dense else with_label)(tiled, plan_index_name, order).select(plan_index_name, source_index_field, slice_field)
    schema = Schema((IndexField(plan_index_name), ForeignIndexField(source_index_field, target=ds.identity), DimensionedSliceField(slice_field, dimensions=tuple(dims))))
    return Dataset(plan, schema, sources=ds.sources, metadata={"plan": True})


def _dimension_of(ds: Dataset, name: str, start: str, stop: str) -> Dimension:
    found = {f.dimension for f in (ds.schema.get(start), ds.schema.get(stop)) if isinstance(f, DimensionField)}
    if len(found) > 1:
        raise ValueError(f"{start!r} and {stop!r} are of different dimensions")
    return next(iter(found)) if found else Dimension(name)


def compose_slice(ds: Dataset, slice_field: str, bindings: Mapping[str, tuple[str, str]] | list[tuple[str, str]], *, lazy: bool = False) -> Dataset:
    """A slice column from bound scalar fields; any null bound makes the whole slice null. On an existing slice field the
    dimensions are added to or replaced."""
    if not isinstance(bindings, Mapping):
        bindings = {_dimension_of(ds, "", a, b).name: (a, b) for a, b in bindings}
    new = {d: _dimension_of(ds, d, a, b) for d, (a, b) in bindings.items()}
    old = ds.schema.get(slice_field) if ds.schema.has(slice_field) else None
    kept = [d for d in (old.dimensions if old else ()) if d.name not in new]
    inputs = tuple(dict.fromkeys(c for pair in bindings.values() for c in pair)) + ((slice_field,) if kept else ())

    def compute(cols: dict[str, Column]) -> Column:
        members = [cols[slice_field][d.name].alias(d.name) for d in kept]
        members += [F.struct(cols[a].alias("start"), cols[b].alias("stop")).alias(d) for d, (a, b) in bindings.items()]
        there = cols[slice_field].isNotNull() if kept else F.lit(True)
        for pair in bindings.values():
            for c in pair:
                there = there & cols[c].isNotNull()
        return F.when(there, F.struct(*members))

    field = DimensionedSliceField(slice_field, dimensions=(*kept, *new.values()))
    pending = ds.with_(schema=ds.schema.put(field) if old else ds.schema, couplings=(*ds.couplings, Coupling(inputs, slice_field, compute, field, "compose_slice", CallSpec.of("compose_slice", slice_field=slice_field, bindings=tuple(sorted(bindings.items())), lazy=True))))
    return pending if lazy else pending.consumed(slice_field)


def slice_data(ds: Dataset, slice_field: str, data_field: str, *, lazy: bool = False) -> Dataset:
    """Puts each row's slice on its accessor in place of the one before, without any read; a null slice changes nothing.

    Data that is held inline (an array, a text or bytes) becomes an accessor struct<data, slice>.
    """
    field = ds.schema.get(data_field)
    inline = not (isinstance(ds.df.schema[data_field].dataType, T.StructType) and "slice" in ds.df.schema[data_field].dataType.names)

    def compute(cols: dict[str, Column]) -> Column:
        cell, cut = cols[data_field], cols[slice_field]
        if inline:
            return F.struct(cell.alias("data"), cut.alias("slice"))
        return F.when(cut.isNull(), cell).otherwise(cell.withField("slice", cut))

    dims = ds.coming(slice_field).dimensions
    out = ds.with_(couplings=(*ds.couplings, Coupling((slice_field, data_field), data_field, compute, replace(field, dimensions=field.dimensions or dims) if isinstance(field, DataField) else DataField(data_field, dimensions=dims, lineage=field.lineage), "slice_data", CallSpec.of("slice_data", slice_field=slice_field, data_field=data_field, lazy=True))))
    return out if lazy else out.consumed(data_field)


def materialize(ds: Dataset, fields: str | list[str], *, reader=None) -> Dataset:
    """Records the reading of accessor cells; it runs when consumed, or on row access.

    Inline arrays, texts and bytes are cut by native expressions: nested arrays along all dimensions, outermost first.
    Other cells need a reader: a function of an accessor column to a Column (see sources.reader()).
    """
    out = ds
    for name in [fields] if isinstance(fields, str) else fields:
        field = ds.schema.get(name)
        pending = [c for c in out.couplings if c.output == name]
        if not pending:
            _cut_check(ds, name, reader)
        dims = (pending[-1].field if pending else field).dimensions

        def compute(cols: dict[str, Column], types: dict, name: str = name, dims: tuple = dims) -> Column:
            return reader(cols[name]) if reader is not None else cut_inline(cols[name], dims, types[name]["data"].dataType)

        made = DataField(name, dimensions=dims, lineage=field.lineage)
        call = CallSpec.of("materialize", fields=name, reader=reader)
        out = out.with_(couplings=(*out.couplings, Coupling((name,), name, compute, made, "materialize", call, typed=True)))
    return out


def _cut_check(ds: Dataset, name: str, reader) -> None:
    kind = ds.df.schema[name].dataType
    if reader is None and not (isinstance(kind, T.StructType) and {"data", "slice"} <= set(kind.names)):
        raise ValueError(f"{name!r} holds no accessor that can be cut natively; give a reader")


def cut_inline(accessor: Column, dimensions: tuple[Dimension, ...], kind: T.DataType) -> Column:
    """accessor.data within accessor.slice: [start, stop) positions from 0; a null slice or member is the full extent."""
    depth, inner = 0, kind
    while isinstance(inner, T.ArrayType):
        depth, inner = depth + 1, inner.elementType
    axes = depth or 1
    if axes < len(dimensions):
        raise ValueError(f"data of {axes} axes has no place for the dimensions {[d.name for d in dimensions]}")
    return _cut(accessor["data"], accessor["slice"], dimensions, depth > 0)


def _span(cut: Column, dimension: Dimension) -> tuple[Column, Column, Column]:
    """The member, and the first position and the number of positions it takes."""
    span = cut[dimension.name]
    if isinstance(dimension, CategoricalDimension):
        at = dimension.position(span)
        start, stop = at, at + 1
    else:
        start, stop = dimension.to_index(span["start"], span["stop"])
    first = F.greatest(F.coalesce(start.cast("int"), F.lit(0)), F.lit(0))
    return span, first, F.greatest(F.coalesce(stop.cast("int"), F.lit(2**31 - 1)) - first, F.lit(0))


def _cut(data: Column, cut: Column, dimensions: tuple[Dimension, ...], nested: bool) -> Column:
    if not dimensions:
        return data
    span, first, many = _span(cut, dimensions[0])
    part = F.slice(data, first + 1, F.least(many, F.greatest(F.size(data) - first, F.lit(0)))) if nested else F.substr(data, first + 1, many)
    whole = F.when(span.isNull(), data).otherwise(part)
    return F.transform(whole, lambda x: _cut(x, cut, dimensions[1:], True)) if len(dimensions) > 1 else whole


def array_cut(dimension: Dimension):
    """A reader for inline arrays of one axis, whatever dimensions their field tells."""
    return lambda accessor: _cut(accessor["data"], accessor["slice"], (dimension,), True)
