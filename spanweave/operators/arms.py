"""The deferred arms of the operators: over cells of a bundle, over fields of a context, and within `with context:`.

An operator called on datasets runs as it is. Called on handles of a bundle it is recorded there, and what it gives is a
handle; collecting that calls the operators it needs. Called on handles of a dataset's fields it is recorded as a
pending column. Either way Spark sees one plan, the same as of the direct calls.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import wraps
from typing import Any

from spanweave.dataset import Dataset, FieldHandle, FieldSelection, active_context, one_context
from spanweave.operators.composition import Bundle

#: What operators do to each aspect of a dataset; a declaration names one word for each.
ASPECTS = {
    "schema": ("preserve", "extend", "narrow", "rewrite", "compose", "construct", "custom", "infer"),
    "table": ("preserve", "mutate", "construct"),
    "couplings": ("derive", "inherit", "homogeneous", "construct", "clear", "custom"),
    "sources": ("inherit", "derive", "compose", "construct", "clear", "custom"),
    "identity": ("preserve", "inherit", "mint", "coalesce", "derive", "custom"),
}


@dataclass(frozen=True)
class Transition:
    """An operator's declared effect, its effect on the number of rows, and whether rows are worked on independently."""

    schema: str = "preserve"
    table: str = "mutate"
    couplings: str = "derive"
    sources: str = "inherit"
    identity: str = "preserve"
    cardinality: str = "preserve"  # or filter, expand, unknown
    independent: bool = True

    def __post_init__(self) -> None:
        for aspect, words in ASPECTS.items():
            if getattr(self, aspect) not in words:
                raise ValueError(f"{aspect} is one of {words}")
        if self.cardinality not in ("preserve", "filter", "expand", "unknown"):
            raise ValueError(f"unknown cardinality {self.cardinality!r}")


#: Declared operators by name, those of extensions too.
OPERATORS: dict[str, Operator] = {}
_aspect_handlers: dict[tuple[str, str], Callable[[Dataset, Dataset], Dataset]] = {}


def register_aspect_handler(aspect: str, word: str, handler: Callable[[Dataset, Dataset], Dataset]) -> None:
    """handler(first operand, result) -> result for each declared operator whose Transition has that word: how an
    extension's "custom" is carried out."""
    if aspect not in ASPECTS:
        raise ValueError(f"unknown aspect {aspect!r}")
    _aspect_handlers[aspect, word] = handler


@dataclass(frozen=True)
class BundleHandle:
    """A cell of a bundle, there or pending."""

    context: BundleContext
    name: str

    def collect(self) -> Dataset:
        return self.context.bundle.collect(self.name)


class BundleContext:
    def __init__(self, bundle: Bundle):
        self.bundle = bundle

    def __getitem__(self, name: str) -> BundleHandle:
        if name not in self.bundle.cells and name not in self.bundle.pending:
            raise ValueError(f"no cell {name!r}")
        return BundleHandle(self, name)


def bundle_field(self: Bundle, name: str) -> BundleHandle:
    """A handle on a cell; operators given it are recorded."""
    return BundleContext(self)[name]


Bundle.field = bundle_field


class Operator:
    """A callable over datasets with its declaration. with_params() fixes parameters; calling it chooses the arm."""

    def __init__(self, fn: Callable, transition: Transition, params: dict[str, Any] | None = None, columns: Callable | None = None, unary: bool = True):
        wraps(fn)(self)
        self.fn, self.transition, self.params, self.columns, self.unary = fn, transition, params or {}, columns, unary

    def with_params(self, **params: Any) -> Operator:
        return Operator(self.fn, self.transition, self.params | params, self.columns, self.unary)

    def __call__(self, *args: Any, out: str | None = None, **more: Any) -> Any:
        more = self.params | more
        cells = [a for a in args if isinstance(a, BundleHandle)]
        if cells:
            context = one_context(cells)
            if len(cells) < len([a for a in args if isinstance(a, (Dataset, BundleHandle))]):
                raise ValueError("handles and datasets in one call")
            rest = args[len(cells) :]
            if any(isinstance(a, BundleHandle) for a in rest):
                raise ValueError("handles come before parameters")
            name = out or f"{self.__name__}_{len(context.bundle.pending)}"
            context.bundle = context.bundle.defer(name, lambda *ds, **kw: self.fn(*ds, *rest, **kw), *(c.name for c in cells), **more)
            return context[name]
        first = args[0] if args else None
        if self.columns is not None and (isinstance(first, (FieldHandle, FieldSelection)) or isinstance(first, (list, tuple)) and first and isinstance(first[0], FieldHandle)):
            return self.columns(*args, **({"out": out} if out is not None else {}), **more)
        if out is not None:
            more["out"] = out
        active = active_context()
        if self.unary and active is not None and not isinstance(first, Dataset) and not hasattr(first, "members"):
            active.dataset = self._done(active.dataset, self.fn(active.dataset, *args, **more))
            return active.dataset
        return self._done(first, self.fn(*args, **more))

    def _done(self, first: Any, result: Any) -> Any:
        if isinstance(result, Dataset) and isinstance(first, Dataset):
            for aspect in ASPECTS:
                handler = _aspect_handlers.get((aspect, getattr(self.transition, aspect)))
                if handler is not None:
                    result = handler(first, result)
        return result


def operator(transition: Transition | None = None, *, columns: Callable | None = None, unary: bool = True) -> Callable[[Callable], Operator]:
    """Declares a function of datasets as an operator, with both arms."""

    def declare(fn: Callable) -> Operator:
        made = Operator(fn, transition or Transition(), columns=columns, unary=unary)
        OPERATORS[fn.__name__] = made
        return made

    return declare


# --- the arms over fields: recorded as pending columns of the handles' context


def _handles(operand: Any) -> list[FieldHandle]:
    return [operand] if isinstance(operand, FieldHandle) else list(operand)


def _pending(context: Any, dataset: Dataset, name: str) -> FieldHandle:
    context.dataset = dataset
    made = next(c for c in reversed(dataset.couplings) if c.output == name)
    return FieldHandle(context, made.field.lineage)


def map_fields_later(fields: Any, fn: Callable, out: str, **more: Any) -> FieldHandle:
    from spanweave.operators.columns import map_fields

    handles = _handles(fields)
    context = one_context(handles)
    return _pending(context, map_fields(context.dataset, [h.name for h in handles], fn, out, **more | {"lazy": True}), out)


def slice_data_later(slice_field: FieldHandle, data_field: FieldHandle) -> FieldHandle:
    from spanweave.operators.windows import slice_data

    context = one_context([slice_field, data_field])
    return _pending(context, slice_data(context.dataset, slice_field.name, data_field.name, lazy=True), data_field.name)


def materialize_later(fields: Any, *, reader: Any = None) -> FieldHandle:
    from spanweave.operators.windows import materialize

    handles = _handles(fields)
    context = one_context(handles)
    return _pending(context, materialize(context.dataset, [h.name for h in handles], reader=reader), handles[-1].name)


def compose_slice_later(bounds: Any, slice_field: str) -> FieldHandle:
    """bounds: handles of start and stop fields, two for each dimension."""
    from spanweave.operators.windows import compose_slice

    handles = _handles(bounds)
    context = one_context(handles)
    names = [h.name for h in handles]
    return _pending(context, compose_slice(context.dataset, slice_field, list(zip(names[::2], names[1::2])), lazy=True), slice_field)
