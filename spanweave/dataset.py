"""Dataset: a DataFrame with typed fields, a row identity, pending columns and provenance. Immutable; nothing runs until an action."""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from spanweave.schema import CompositeIndexField, Field, Schema, ValueField

_strict: ContextVar[bool] = ContextVar("strict", default=False)


@contextmanager
def validation(strict: bool = True) -> Iterator[None]:
    """Within it, operators run counting queries that hold rows against their contracts (unique labels, known keys).

    Without it, they only check what needs no job; missing labels still fail inside the query that meets them.
    """
    token = _strict.set(strict)
    try:
        yield
    finally:
        _strict.reset(token)


def strict() -> bool:
    return _strict.get()


@dataclass(frozen=True)
class SourceInfo:
    """Where rows came from."""

    source_uri: str
    source_type: str = "memory"
    source_name: str = ""
    source_id: str = ""
    metadata: dict = field(default_factory=dict, compare=False)

    @property
    def key(self) -> str:
        return self.source_id or self.source_uri


def union_sources(*groups: tuple[SourceInfo, ...]) -> tuple[SourceInfo, ...]:
    """All sources, the last of each id."""
    found: dict[str, SourceInfo] = {}
    for group in groups:
        for s in group:
            found.pop(s.key, None)
            found[s.key] = s
    return tuple(found.values())


class UnpicklableCallWarning(UserWarning):
    """A recorded function cannot be stored for later."""


@dataclass(frozen=True)
class CallSpec:
    """The operator call that made a pending column: it can be stored, compared and made again.

    params are the call's arguments but for the dataset. Functions among them are kept pickled; one that cannot be
    pickled is kept as it is, with a warning, and compared by identity.
    """

    op: str
    params: tuple[tuple[str, Any], ...]

    @staticmethod
    def of(op: str, **params: Any) -> CallSpec:
        kept = []
        for k, v in sorted(params.items()):
            if callable(v) and not isinstance(v, type):
                try:
                    v = pickle.dumps(v)
                except Exception:  # noqa: BLE001
                    warnings.warn(f"{v!r} cannot be stored", UnpicklableCallWarning, stacklevel=3)
            kept.append((k, v))
        return CallSpec(op, tuple(kept))

    @property
    def storable(self) -> bool:
        return not any(callable(v) and not isinstance(v, type) for _, v in self.params)

    def replay(self, ds: Dataset) -> Dataset:
        """The call made again on a dataset."""
        import spanweave

        return getattr(spanweave, self.op)(ds, **{k: pickle.loads(v) if isinstance(v, bytes) else v for k, v in self.params})


@dataclass(frozen=True)
class Coupling:
    """A pending column: output computed from inputs by compute(dataset columns) -> Column when consumed.

    typed: compute takes the inputs' types as a second argument. kind and call tell what made it.
    """

    inputs: tuple[str, ...]
    output: str
    compute: Callable[..., Column]
    field: Field | None = None
    kind: str = "apply"
    call: CallSpec | None = None
    typed: bool = False

    def renamed(self, names: dict[str, str]) -> Coupling:
        back = {names.get(i, i): i for i in self.inputs}
        inner = self.compute
        told = lambda x: {old: x[new] for new, old in back.items()}
        return replace(self, inputs=tuple(back), output=names.get(self.output, self.output), compute=lambda *x: inner(*map(told, x)))

    def same(self, other: Coupling) -> bool:
        """Whether both compute the same: by one function object, or by equal calls."""
        if (self.inputs, self.output, self.field) != (other.inputs, other.output, other.field):
            return False
        return self.compute is other.compute or self.call is not None and self.call == other.call


def ordered(couplings: tuple[Coupling, ...]) -> list[Coupling]:
    """Topological order; couplings of one output stay in the order declared. A cycle raises."""
    left, out = list(couplings), []
    writes = [c.output for c in couplings]
    for at, c in enumerate(couplings):  # a write in place would change what an earlier reader was meant to see
        if c.output in c.inputs and any(c.output in o.inputs and o.output != c.output for o in couplings[:at]) and c.output not in writes[:at]:
            raise ValueError(f"{c.output!r} is read by an earlier pending column and then written in place")
    while left:
        for c in left:
            earlier = left[: left.index(c)]
            waits = [o for o in left if o is not c and o.output in c.inputs and (o.output != c.output or o in earlier)]
            if not waits and not any(o.output == c.output for o in earlier):
                out.append(c)
                left.remove(c)
                break
        else:
            raise ValueError(f"couplings form a cycle: {[c.output for c in left]}")
    return out


@dataclass(frozen=True)
class Dataset:
    df: DataFrame
    schema: Schema
    couplings: tuple[Coupling, ...] = ()
    sources: tuple[SourceInfo, ...] = ()
    metadata: dict = field(default_factory=dict)

    @property
    def table(self) -> DataFrame:
        return self.df

    @property
    def index_names(self) -> tuple[str, ...]:
        return self.schema.index.columns if self.schema.index else tuple(self.metadata.get("index", ()))

    @property
    def index_name(self) -> str:
        names = self.index_names
        if len(names) != 1:
            raise ValueError(f"one index column is needed, there are {names}")
        return names[0]

    @property
    def identity(self):
        index = self.schema.index or self.metadata.get("index_field")
        if index is None:
            raise ValueError("the dataset has no index field")
        return index.identity

    def coming(self, name: str) -> Field:
        """The field of a column that is there, or that a pending column will give."""
        made = [c for c in self.couplings if c.output == name]
        if made and (made[-1].field is not None or not self.schema.has(name)):
            return made[-1].field or ValueField(name)
        return self.schema.get(name)

    @property
    def values(self) -> list[Field]:
        """All fields but the index."""
        return [f for f in self.schema.fields if f is not self.schema.index]

    def __len__(self) -> int:
        return self.df.count()

    def with_(self, df: DataFrame | None = None, schema: Schema | None = None, **more: Any) -> Dataset:
        return replace(self, df=self.df if df is None else df, schema=schema or self.schema, **more)

    def consumed(self, upto: str | None = None) -> Dataset:
        """Pending columns computed: all, or those that `upto` needs and itself."""
        order = ordered(self.couplings)
        if upto is not None:
            if not any(c.output == upto for c in order) and not self.schema.has(upto):
                raise ValueError(f"unknown column {upto!r}")
            need = {upto}
            for c in reversed(order):
                if c.output in need:
                    need.update(c.inputs)
            order = [c for c in order if c.output in need]
        df, schema = self.df, self.schema
        for c in order:
            cols = {i: F.col(f"`{i}`") for i in c.inputs}
            df = df.withColumn(c.output, c.compute(cols, {i: df.schema[i].dataType for i in c.inputs}) if c.typed else c.compute(cols))
            schema = schema.put(c.field or (schema.get(c.output) if schema.has(c.output) else ValueField(c.output)))
        return self.with_(df, schema, couplings=tuple(c for c in self.couplings if c not in order))

    def __getitem__(self, key: Any) -> Any:
        """A field's column with the index, or one row as a dict, its pending columns computed."""
        if isinstance(key, str) and self.schema.has(key):
            return self.df.select(*self.index_names, *(c for c in self.schema.get(key).columns if c not in self.index_names))
        labels = key if isinstance(key, tuple) else (key,)
        found = self.consumed().df.where(F.lit(True) if not labels else _all(F.col(f"`{n}`") == F.lit(v) for n, v in zip(self.index_names, labels))).limit(1).collect()
        if not found and isinstance(key, int) and not isinstance(key, bool):
            try:
                row = self.rows()[key]
            except IndexError:
                raise KeyError(key) from None
            warnings.warn(f"{key} is no label; rows by position are rows()[{key}]", DeprecationWarning, stacklevel=2)
            return row
        if not found:
            raise KeyError(key)
        return exited(found[0], self.schema)

    def rows(self, fields: str | list[str] | None = None) -> RowSequence:
        """The rows as dicts, pending columns computed: to iterate, by position, or by batches of positions."""
        return RowSequence(self, [fields] if isinstance(fields, str) else fields)

    def field(self, name: str) -> FieldHandle:
        return FieldHandle(DatasetContext(self), self.schema.get(name).lineage)

    def fields(self, *names: str) -> FieldSelection:
        """Handles of several fields in one context."""
        return DatasetContext(self).fields(*names)

    def context(self) -> DatasetContext:
        return DatasetContext(self)

    def assign(self, **columns: Any) -> Dataset:
        from spanweave.operators.columns import assign

        return assign(self, **columns)


def _all(conditions: Iterator[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


_exits: dict[type, Callable[[Any], Any]] = {}
_field_exits: dict[type, Callable[[Field, Any], Any]] = {}


def register_exit(kind: type, convert: Callable[[Any], Any]) -> None:
    """How values of a Python type leave in row dicts."""
    _exits[kind] = convert


def register_field_exit(kind: type, convert: Callable[[Field, Any], Any]) -> None:
    """How values of a kind of field, or of those derived from it, leave in row dicts; it precedes register_exit()."""
    _field_exits[kind] = convert


def exited(value: Any, schema: Schema | None = None) -> Any:
    for kind in type(value).__mro__:
        if kind in _exits:
            return _exits[kind](value)
    if isinstance(value, Row):
        return {k: _left(schema, k, v) for k, v in value.asDict().items()}
    if isinstance(value, list):
        return [exited(v) for v in value]
    return value


def _left(schema: Schema | None, name: str, value: Any) -> Any:
    if schema is not None and schema.has(name):
        f = schema.get(name)
        for kind in type(f).__mro__:
            if kind in _field_exits:
                return _field_exits[kind](f, value)
    return exited(value)


class RowSequence:
    """Rows on the driver. Iterating streams one partition at a time. Positions follow the index's order: the first
    access by position numbers the rows once, in a stored table; each further one reads just the rows it names."""

    def __init__(self, dataset: Dataset, fields: list[str] | None = None):
        self.dataset = dataset
        done = dataset.consumed()
        self.schema = done.schema
        self.df = done.df if fields is None else done.df.select(*dataset.index_names, *(f for f in fields if f not in dataset.index_names))
        self._stored: DataFrame | None = None

    def __iter__(self) -> Iterator[dict]:
        return (exited(r, self.schema) for r in self.df.toLocalIterator(prefetchPartitions=True))

    def __len__(self) -> int:
        return self.df.count()

    def _numbered(self) -> DataFrame:
        if self._stored is None:
            from spanweave.operators.columns import with_row_id
            from spanweave.storage import written

            self._stored = written(with_row_id(self.df, "_pos", list(self.dataset.index_names)))
        return self._stored

    def __getitem__(self, at: int | slice) -> Any:
        if isinstance(at, slice):
            return self.__getitems__(list(range(*at.indices(len(self)))))
        return self.__getitems__([at])[0]

    def __getitems__(self, positions: list[int]) -> list[dict]:
        """The rows at some positions, repeats included, in one query."""
        n = len(self) if any(p < 0 for p in positions) else 0
        wanted = [p + n if p < 0 else p for p in positions]
        kept = self._numbered().where(F.col("_pos").isin(sorted(set(wanted))))
        found = {r["_pos"]: r for r in kept.collect()}
        lost = [p for p in wanted if p not in found]
        if lost:
            raise IndexError(f"no rows at {lost[:5]}")
        out = []
        for p in wanted:
            row = exited(found[p], self.schema)
            row.pop("_pos")
            out.append(row)
        return out


_active: ContextVar[DatasetContext | None] = ContextVar("active", default=None)


def active_context() -> DatasetContext | None:
    """The innermost context that a `with` holds."""
    return _active.get()


class DatasetContext:
    """A cursor over an immutable dataset: operators given its handles move it on.

    Within `with context:` unary operators may be called without a dataset; they take and move this one.
    """

    def __init__(self, dataset: Dataset):
        self.dataset = dataset
        self._tokens: list = []

    def __enter__(self) -> DatasetContext:
        self._tokens.append(_active.set(self))
        return self

    def __exit__(self, *_: Any) -> None:
        _active.reset(self._tokens.pop())

    def __getitem__(self, name: str) -> FieldHandle:
        return FieldHandle(self, self.dataset.schema.get(name).lineage)

    def __setitem__(self, name: str | Field, value: Any) -> None:
        if isinstance(name, Field):
            name, value = name.name, (name, value)
        self.dataset = self.dataset.assign(**{name: value})

    def fields(self, *names: str) -> FieldSelection:
        return FieldSelection(self, tuple(self[n] for n in names or self.dataset.schema.names()))

    def new_field(self, new: Field) -> FieldHandle:
        from spanweave.operators.columns import new_field

        self.dataset = new_field(self.dataset, new)
        return self[new.name]

    def adopt(self, dataset: Dataset) -> DatasetContext:
        """Moves the cursor to another dataset."""
        self.dataset = dataset
        return self

    def branch(self) -> DatasetContext:
        return DatasetContext(self.dataset)


@dataclass(frozen=True)
class FieldHandle:
    """One field of a context, found by its lineage, so it follows renames."""

    context: DatasetContext
    lineage: str

    @property
    def name(self) -> str:
        pending = [c.field for c in self.context.dataset.couplings if c.field is not None]
        found = {f.name for f in (*self.context.dataset.schema.fields, *pending) if f.lineage == self.lineage}
        if len(found) != 1:
            raise ValueError("the field is gone" if not found else "the field is ambiguous")
        return found.pop()

    @property
    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    @property
    def loc(self) -> _Labels:
        """Values by row label: handle.loc[label], handle.loc[[labels]]; assigning sets them in the context's dataset."""
        return _Labels(self)

    def collect(self) -> Dataset:
        """The context's dataset with the pending work of this field done."""
        return self.context.dataset.consumed(self.name)

    def items(self) -> Iterator[tuple[Any, Any]]:
        """(label, value) of each row, pending work done."""
        ds, name = self.collect(), self.name
        keys = ds.index_names
        for r in ds.df.select(*keys, name).toLocalIterator():
            yield r[0] if len(keys) == 1 else tuple(r[k] for k in keys), _left(ds.schema, name, r[name])

    def __iter__(self) -> Iterator[Any]:
        return (v for _, v in self.items())


@dataclass(frozen=True)
class _Labels:
    handle: FieldHandle

    def _rows(self, ds: Dataset, labels: Any) -> Column:
        key = F.col(f"`{ds.index_name}`")
        if isinstance(labels, Column):
            return labels
        if isinstance(labels, slice):  # of labels, both ends included
            return _all(c for c in ((key >= F.lit(labels.start)) if labels.start is not None else F.lit(True), (key <= F.lit(labels.stop)) if labels.stop is not None else F.lit(True)))
        return key.isin(list(labels)) if isinstance(labels, (list, tuple, set)) else key == F.lit(labels)

    def __getitem__(self, labels: Any) -> Any:
        ds, name = self.handle.collect(), self.handle.name
        got = {r[0]: _left(ds.schema, name, r[1]) for r in ds.df.where(self._rows(ds, labels)).select(ds.index_name, name).collect()}
        if isinstance(labels, (list, tuple)):
            return [got[x] for x in labels]
        if isinstance(labels, (Column, slice, set)):
            return got
        return got[labels]

    def __setitem__(self, labels: Any, value: Any) -> None:
        context, name = self.handle.context, self.handle.name
        old = F.col(f"`{name}`")
        context.dataset = context.dataset.assign(**{name: F.when(self._rows(context.dataset, labels), value if isinstance(value, Column) else F.lit(value)).otherwise(old)})


@dataclass(frozen=True)
class FieldSelection:
    """Handles of one context, as one operand."""

    context: DatasetContext
    handles: tuple[FieldHandle, ...]

    def __iter__(self) -> Iterator[FieldHandle]:
        return iter(self.handles)

    @property
    def names(self) -> tuple[str, ...]:
        return tuple(h.name for h in self.handles)

    def collect(self) -> Dataset:
        """The context's dataset with the pending work of these fields done, and just these fields."""
        from spanweave.operators.columns import keep

        ds = self.context.dataset
        for n in self.names:
            ds = ds.consumed(n)
        index = ds.schema.index
        return keep(ds, [*([index.name] if index and index.name not in self.names else []), *self.names])


def one_context(handles: list[FieldHandle]) -> DatasetContext:
    if len({id(h.context) for h in handles}) != 1:
        raise ValueError("the handles belong to different contexts")
    return handles[0].context
