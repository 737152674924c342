"""Array sources: where accessor cells are read from, on the executors, each source opened once per worker."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.dataset import Dataset, SourceInfo
from spanweave.dimensions import Dimension, IndexDimension, TemporalDimension
from spanweave.schema import DataField, DimensionField, IndexField, Schema


@dataclass(frozen=True)
class SourceDescriptor:
    """How to reopen a source anywhere."""

    source_type: str
    source_id: str
    config: dict = field(default_factory=dict, compare=False)


class ArrayDataSource:
    """Arrays by item id. Subclasses read whole arrays and, where they can, parts."""

    supports_partial_read = False
    #: Whether it lives in this process only, can be reopened from its descriptor, can go elsewhere, and may be shared.
    runtime, reopenable, portable, thread_safe, fork_safe = "python", True, True, False, False

    def __init__(self, dimensions: tuple[Dimension, ...], **config: Any):
        self.dimensions, self.config = tuple(dimensions), config

    @property
    def descriptor(self) -> SourceDescriptor:
        name = type(self).__name__
        told = repr((self.dimensions, sorted((k, v) for k, v in self.config.items() if not isinstance(v, np.ndarray | dict))))
        return SourceDescriptor(name, f"{name}:{hashlib.sha256(told.encode()).hexdigest()[:16]}", self.config)

    def open(self) -> None: ...

    def close(self) -> None: ...

    def shape(self, item: Any) -> tuple[int, ...]:
        return self.read_full(item).shape

    def read_full(self, item: Any) -> np.ndarray:
        raise NotImplementedError

    def read_partial(self, item: Any, index: tuple[slice, ...]) -> np.ndarray:
        raise NotImplementedError

    def resolve(self, cut: Mapping[str, Any] | None) -> tuple[slice, ...]:
        """Positions per axis: an absent dimension is its full extent, an unknown one fails."""
        known = {d.name for d in self.dimensions}
        for k in cut or {}:
            if k not in known:
                raise ValueError(f"unknown dimension {k!r}")
        out = []
        for d in self.dimensions:
            span = (cut or {}).get(d.name)
            if span is None:
                out.append(slice(None))
            elif isinstance(d, TemporalDimension):
                if d.sample_rate is None:
                    raise ValueError(f"dimension {d.name!r} has no sample rate")
                out.append(slice(int(span["start"] * d.sample_rate), int(span["stop"] * d.sample_rate)))
            else:
                out.append(slice(int(span["start"]), int(span["stop"])))
        return tuple(out)

    def describe(self) -> SourceDescriptor:
        return self.descriptor

    def extent_for(self, item: Any) -> dict[str, dict[str, float]]:
        """The full extent of an item, in natural units."""
        rate = lambda d: d.sample_rate or 1.0 if isinstance(d, TemporalDimension) else 1
        return {d.name: {"start": 0, "stop": n / rate(d)} for d, n in zip(self.dimensions, self.shape(item))}

    def inspect(self, item: Any) -> dict[str, Any]:
        """What is known of an item without reading its values."""
        return {"item": item, "shape": self.shape(item), "dimensions": tuple(d.name for d in self.dimensions), "partial": self.supports_partial_read}

    @staticmethod
    def slice_accessor(accessor: Mapping[str, Any], cut: Mapping[str, Any] | None) -> dict[str, Any]:
        """The accessor with another slice, which replaces the one before; no slice changes nothing."""
        return dict(accessor) if cut is None else {**accessor, "slice": dict(cut)}

    def materialize(self, accessor: Mapping[str, Any]) -> np.ndarray:
        return self.read(accessor["item"], {k: v for k, v in (accessor.get("slice") or {}).items() if v is not None})

    def read(self, item: Any, cut: Mapping[str, Any] | None = None) -> np.ndarray:
        index = self.resolve(cut)
        if cut and self.supports_partial_read:
            return self.read_partial(item, index)
        return self.read_full(item)[index]


class MemoryArraySource(ArrayDataSource):
    """Arrays given by value: small ones, as they travel with the job."""

    supports_partial_read = True

    def __init__(self, arrays: Mapping[Any, np.ndarray], dimensions: tuple[Dimension, ...]):
        super().__init__(dimensions, arrays=dict(arrays))

    def write(self, item: Any, array: np.ndarray) -> None:
        """A new item, or a new array in place of an item's."""
        self.config["arrays"][item] = array

    def append(self, item: Any, array: np.ndarray) -> None:
        if item in self.config["arrays"]:
            raise ValueError(f"item {item!r} exists")
        self.write(item, array)

    def read_full(self, item: Any) -> np.ndarray:
        return self.config["arrays"][item]

    def read_partial(self, item: Any, index: tuple[slice, ...]) -> np.ndarray:
        return self.read_full(item)[index]


class MockArraySource(ArrayDataSource):
    """Seeded random float32 arrays of one shape; an item's array depends on its id and the seed alone."""

    def __init__(self, dimensions: tuple[Dimension, ...], extents: Mapping[str, int], seed: int = 0):
        super().__init__(dimensions, extents=tuple(sorted(extents.items())), seed=seed)

    def shape(self, item: Any) -> tuple[int, ...]:
        sizes = dict(self.config["extents"])
        return tuple(int(sizes[d.name]) for d in self.dimensions)

    def read_full(self, item: Any) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(f"{self.config['seed']}/{item}".encode()).digest()[:8], "big")
        return np.random.default_rng(seed).random(self.shape(item), dtype=np.float32)


class SourceManager:
    """Sources by (type, id); registering one again gives the same number.

    A source is opened when it is first asked for, from its descriptor if only that is known, and closed by close_all().
    Leases are tokens: giving one back keeps the source open.
    """

    def __init__(self) -> None:
        self.sources: dict[tuple[str, str], tuple[int, ArrayDataSource | None, SourceDescriptor]] = {}
        self.types: dict[str, Callable[[SourceDescriptor], ArrayDataSource]] = {}
        self.opened: set[tuple[str, str]] = set()

    def register_source_type(self, name: str, reopen: Callable[[SourceDescriptor], ArrayDataSource]) -> None:
        """How a source of a type is made again from its descriptor."""
        self.types[name] = reopen

    def register_descriptor(self, descriptor: SourceDescriptor) -> int:
        key = (descriptor.source_type, descriptor.source_id)
        return self.sources.setdefault(key, (len(self.sources), None, descriptor))[0]

    def register(self, source: ArrayDataSource) -> int:
        d = source.descriptor
        number, known, _ = self.sources.get((d.source_type, d.source_id), (len(self.sources), None, d))
        self.sources[d.source_type, d.source_id] = (number, known or source, d)
        return number

    register_source = register

    def get(self, descriptor: SourceDescriptor | int) -> ArrayDataSource:
        """The source of a descriptor, or of the number that registering it gave; opened if it isn't."""
        key = next((k for k, v in self.sources.items() if v[0] == descriptor), None) if isinstance(descriptor, int) else (descriptor.source_type, descriptor.source_id)
        if key not in self.sources:
            raise KeyError(descriptor if isinstance(descriptor, int) else descriptor.source_type)
        number, source, told = self.sources[key]
        if source is None:
            if told.source_type not in self.types:
                raise KeyError(told.source_type)
            source = self.types[told.source_type](told)
            self.sources[key] = (number, source, told)
        if key not in self.opened:
            source.open()
            self.opened.add(key)
        return source

    def acquire(self, descriptor: SourceDescriptor | int) -> tuple[ArrayDataSource, object]:
        """The source and a lease on it."""
        return self.get(descriptor), object()

    def release(self, lease: object) -> None:
        """A lease is a token; the source stays open."""

    def close_all(self) -> None:
        for key in self.opened:
            self.sources[key][1].close()
        self.opened.clear()
        self.sources.clear()


_default = SourceManager()


def get_default_manager() -> SourceManager:
    """The process's manager; executors have one each, so a source is opened once per worker."""
    return _default


def reset_default_manager() -> None:
    _default.close_all()
    _default.types.clear()


def reader(source: ArrayDataSource) -> Callable[[Column], Column]:
    """For materialize(): accessor struct<item, slice> -> struct<shape array<int>, data binary> (float32), on Arrow batches."""

    def read(cells: pd.DataFrame) -> pd.DataFrame:
        from spanweave.sources.arrays import get_default_manager

        manager, out = get_default_manager(), []
        opened = manager.get(manager.register(source))
        for item, cut in zip(cells["item"], cells["slice"] if "slice" in cells else [None] * len(cells)):
            spans = {k: v for k, v in (cut.items() if hasattr(cut, "items") else cut.asDict(True).items() if cut is not None else ()) if v is not None}
            a = np.ascontiguousarray(opened.read(item, spans), dtype=np.float32)
            out.append((list(a.shape), a.tobytes()))
        return pd.DataFrame(out, columns=["shape", "data"])

    read.__annotations__ = {"cells": pd.DataFrame, "return": pd.DataFrame}
    return F.pandas_udf(read, "shape array<int>, data binary")


def to_array(cell: Any) -> np.ndarray:
    return np.frombuffer(cell["data"], np.float32).reshape(cell["shape"])


def make_mock_dataset(spark: SparkSession, item_ids: list, dimensions: tuple[Dimension, ...], extents: Mapping[str, int], *, data_field: str = "data", seed: int = 0) -> tuple[Dataset, MockArraySource]:
    """Items with accessors of random arrays, and their source."""
    source = MockArraySource(dimensions, extents, seed)
    members = ", ".join(f"{d.name}: struct<start: double, stop: double>" for d in dimensions)
    df = spark.createDataFrame([(i, (i, None)) for i in item_ids], f"item_id string, {data_field} struct<item: string, slice: struct<{members}>>")
    schema = Schema((IndexField("item_id"), DataField(data_field, dimensions=tuple(dimensions))))
    return Dataset(df, schema, sources=(SourceInfo(f"mock://{seed}", "mock", source_id=source.descriptor.source_id),)), source


def make_mock_dataset_from_dims(ds: Dataset, *, data_field: str = "data", seed: int = 0) -> tuple[Dataset, MockArraySource]:
    """ds with accessors of random arrays whose extents come from its rows: the DimensionFields of one dimension are its
    size, or its start and stop. A null bound makes the slice null, which is the full extent."""
    bounds: dict[Dimension, list[str]] = {}
    for f in ds.schema.fields:
        if isinstance(f, DimensionField):
            bounds.setdefault(f.dimension, []).append(f.name)
    if not bounds:
        raise ValueError("the dataset has no dimension fields")
    if any(len(names) > 2 for names in bounds.values()):
        raise ValueError("a dimension has one field (its size) or two (start and stop)")
    pair = lambda names: (F.lit(0.0), F.col(names[0])) if len(names) == 1 else (F.col(names[0]), F.col(names[1]))
    spans = {d: pair(names) for d, names in bounds.items()}
    there = F.lit(True)
    for a, b in spans.values():
        there = there & a.isNotNull() & b.isNotNull()
    most = ds.df.agg(*(F.max(b.cast("double")).alias(d.name) for d, (_, b) in spans.items())).first()
    sizes = {d.name: int((most[d.name] or 0) * (d.sample_rate or 1 if isinstance(d, TemporalDimension) else 1)) for d in spans}
    source = MockArraySource(tuple(spans), sizes, seed)
    cut = F.when(there, F.struct(*(F.struct(a.cast("double").alias("start"), b.cast("double").alias("stop")).alias(d.name) for d, (a, b) in spans.items())))
    cell = F.struct(F.col(f"`{ds.index_name}`").cast("string").alias("item"), cut.alias("slice"))
    out = ds.with_(ds.df.withColumn(data_field, cell), ds.schema.add(DataField(data_field, dimensions=tuple(spans))))
    return out, source


def assert_source_contract(source: ArrayDataSource, item: Any) -> None:
    """What every array source must hold to."""
    whole = source.read(item)
    assert whole.shape == source.shape(item)
    assert source.descriptor == source.descriptor
    first = source.dimensions[0]
    if isinstance(first, IndexDimension):
        half = max(1, whole.shape[0] // 2)
        assert np.array_equal(source.read(item, {first.name: {"start": 0, "stop": half}}), whole[:half])
    try:
        source.read(item, {"no such dimension": {"start": 0, "stop": 1}})
    except ValueError:
        return
    raise AssertionError("an unknown dimension must fail")
