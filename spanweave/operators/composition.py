"""Putting datasets side by side or below each other, and driver-side bundles of whole datasets."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import functions as F

from spanweave.dataset import Dataset, union_sources
from spanweave.operators.columns import checked_unique
from spanweave.operators.joins import ColumnCollision
from spanweave.schema import CompositeField, CompositeIndexField, DimensionField, Field, IndexColumnField, IndexField, IndexIdentity, Schema, ValueField


_policies: dict[type, Callable[[Field, Field], Field]] = {}


def register_field_policy(kind: type, compose: Callable[[Field, Field], Field]) -> None:
    """How two fields of a kind, or of those derived from it, become the field of rows from both; raise to refuse."""
    _policies[kind] = compose


def _composed(a: Field, b: Field) -> Field:
    """The field of rows from both."""
    for kind in type(a).__mro__:
        if kind in _policies:
            return _policies[kind](a, b)
    if type(a) is not type(b):
        raise ValueError(f"field {a.name!r} is {type(a).__name__} and {type(b).__name__}")
    if isinstance(a, (CompositeField, CompositeIndexField)):
        raise NotImplementedError("composite fields are not composed")
    if isinstance(a, DimensionField) and a.dimension != b.dimension:
        raise ValueError(f"field {a.name!r} has two dimensions")
    if isinstance(a, IndexField):
        return a if a.identity == b.identity else replace(a, identity=IndexIdentity())
    if a.dtype != b.dtype:
        if not isinstance(a, ValueField):
            raise ValueError(f"field {a.name!r} has two types")
        return replace(a, dtype=None)
    return a


def concat_rows(*datasets: Dataset) -> Dataset:
    """All rows, fields by name; a field that a dataset lacks is null there, differing value types are widened."""
    if len(datasets) < 2:
        raise ValueError("two datasets at least")
    first = datasets[0].couplings
    if any(len(d.couplings) != len(first) or not all(a.same(b) for a, b in zip(first, d.couplings)) for d in datasets[1:]):
        raise ValueError("pending columns differ; consume them first")
    schema, df = datasets[0].schema, datasets[0].df
    for d in datasets[1:]:
        for f in d.schema.fields:
            schema = schema.put(_composed(schema.get(f.name), f)) if schema.has(f.name) else schema.add(replace(f, nullable=True))
        df = df.unionByName(d.df, allowMissingColumns=True)
    return checked_unique(Dataset(df, schema, datasets[0].couplings, union_sources(*(d.sources for d in datasets))))


def _beside(a: Dataset, b: Dataset, collision: ColumnCollision) -> Dataset:
    if a.identity != b.identity and a.index_name == b.index_name:
        raise ValueError(f"index {a.index_name!r} stands for different rows; rename one")
    left, right = a.df, b.df.withColumnsRenamed({c: f"_r_{c}" for c in b.df.columns})
    df = left.join(right, left[a.index_name] == right[f"_r_{b.index_name}"], "full_outer")
    out, fields = [F.coalesce(left[a.index_name], right[f"_r_{b.index_name}"]).alias(a.index_name)], [a.schema.index]
    gone: set[str] = set()
    for f in a.values:
        if b.schema.has(f.name) and b.schema.get(f.name) is not b.schema.index:
            out.append(collision.combine(f.name, left[f.name], right[f"_r_{f.name}"]).alias(f.name))
            gone.add(f.name)
        else:
            out += [left[c] for c in f.columns]
        fields.append(f)
    if b.index_name != a.index_name:
        out.append(right[f"_r_{b.index_name}"].alias(b.index_name))
        fields.append(IndexColumnField(b.index_name, identity=b.identity))
    for f in b.values:
        if not a.schema.has(f.name):
            out += [right[f"_r_{c}"].alias(c) for c in f.columns]
            fields.append(replace(f, primary=False))
    return Dataset(df.select(*out), Schema(tuple(fields)), (*a.couplings, *(c for c in b.couplings if c.output not in gone)), union_sources(a.sources, b.sources))


def concat_columns(*datasets: Dataset, collision: ColumnCollision | None = None) -> Dataset:
    """Full outer alignment by row label; a further index of another name stays as a column."""
    if len(datasets) < 2:
        raise ValueError("two datasets at least")
    out = datasets[0]
    for d in datasets[1:]:
        out = _beside(out, d, collision or ColumnCollision())
    return out


def concat(*datasets: Dataset, axis: int = 0, **more: Any) -> Dataset:
    if axis not in (0, 1):
        raise ValueError("axis is 0 or 1")
    return concat_columns(*datasets, **more) if axis else concat_rows(*datasets, **more)


@dataclass(frozen=True)
class Bundle:
    """One record of whole datasets, and operators deferred over them."""

    cells: dict[str, Dataset]
    pending: dict[str, tuple[Callable[..., Dataset], tuple[str, ...], dict]] = field(default_factory=dict)

    def defer(self, out: str, op: Callable[..., Dataset], *inputs: str, **params: Any) -> Bundle:
        """The cell `out` will be op(*cells), when it is collected."""
        for i in inputs:
            if i not in self.cells and i not in self.pending:
                raise ValueError(f"no cell {i!r}")
        return replace(self, pending=self.pending | {out: (op, inputs, params)})

    def collect(self, name: str | None = None) -> Dataset:
        if name is None:
            name = extractable(self)
        if name in self.pending:
            op, inputs, params = self.pending[name]
            return op(*(self.collect(i) for i in inputs), **params)
        return self.cells[name]


def bundle(*datasets: Dataset, **named: Dataset) -> Bundle:
    return Bundle({f"cell_{i}": d for i, d in enumerate(datasets)} | named)


def extractable(b: Bundle) -> str:
    names = {**b.cells, **b.pending}
    if len(names) != 1:
        raise ValueError(f"name one of {tuple(names)}")
    return next(iter(names))


def extract(b: Bundle, field: str | None = None) -> Dataset:
    name = field or extractable(b)
    if name not in b.cells and name not in b.pending:
        raise ValueError(f"no cell {name!r}")
    return b.collect(name)
