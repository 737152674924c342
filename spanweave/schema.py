"""Fields, schemas and identities: what a dataset says about its columns, kept on the driver."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import types as T

_TYPES: dict[Any, T.DataType] = {
    int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), object: T.StringType(),
    "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "uint8": T.ShortType(), "uint16": T.IntegerType(),
    "uint32": T.LongType(), "uint64": T.DecimalType(20, 0), "float32": T.FloatType(), "float64": T.DoubleType(), "string": T.StringType(), "bool": T.BooleanType(),
}


def spark_type(dtype: Any) -> T.DataType | None:
    """The Spark type of a declared dtype; None declares nothing."""
    if dtype is None or isinstance(dtype, T.DataType):
        return dtype
    found = _TYPES.get(dtype) or _TYPES.get(str(dtype).lower())
    if found is None:
        raise TypeError(f"no Spark type for {dtype!r}")
    return found


@dataclass(frozen=True)
class IndexIdentity:
    """The namespace that row labels belong to; foreign labels name the one they point into."""

    id: str = field(default_factory=lambda: uuid.uuid4().hex)


@dataclass(frozen=True)
class Field:
    name: str
    dtype: Any = None
    nullable: bool = True
    primary: bool = False
    metadata: dict = field(default_factory=dict, compare=False)
    lineage: str = field(default_factory=lambda: uuid.uuid4().hex, compare=False)

    @property
    def columns(self) -> tuple[str, ...]:
        return (self.name,)

    def named(self, name: str) -> Field:
        return replace(self, name=name)


@dataclass(frozen=True)
class IndexField(Field):
    """Row identity: one ordinary column that holds unique labels."""

    identity: IndexIdentity = field(default_factory=IndexIdentity, compare=False)
    nullable: bool = False
    primary: bool = True


@dataclass(frozen=True)
class CompositeIndexField(IndexField):
    """Row identity by several columns, its levels."""

    levels: tuple[str, ...] = ()

    @property
    def columns(self) -> tuple[str, ...]:
        return self.levels


@dataclass(frozen=True)
class IndexColumnField(Field):
    """Labels that once were row identity."""

    identity: IndexIdentity | None = None


@dataclass(frozen=True)
class ForeignIndexField(Field):
    """Labels of another dataset's rows."""

    target: IndexIdentity | None = None


@dataclass(frozen=True)
class ValueField(Field):
    pass


@dataclass(frozen=True)
class DimensionField(Field):
    """A scalar read along a dimension."""

    dimension: Any = None

    @classmethod
    def from_dim(cls, name: str, dimension: Any, dtype: Any = float) -> DimensionField:
        return cls(name=name, dtype=dtype, dimension=dimension)


@dataclass(frozen=True)
class DimensionedSliceField(Field):
    """A struct with one nullable member per dimension: struct<start, stop> or a label. A null struct is no slice."""

    dimensions: tuple = ()


@dataclass(frozen=True)
class DataField(Field):
    """Lazy data: an accessor struct (item, slice), or the array, text or bytes themselves."""

    dimensions: tuple = ()


@dataclass(frozen=True)
class CompositeField(Field):
    """One struct column whose members are fields of their own."""

    members: tuple[Field, ...] = ()


@dataclass(frozen=True)
class BundleField(Field):
    """Cells that are datasets: the fibers of a grouping."""


@dataclass(frozen=True)
class Schema:
    fields: tuple[Field, ...]

    def __post_init__(self) -> None:
        seen: set[str] = set()
        for f in self.fields:
            for c in {f.name, *f.columns}:
                if c in seen:
                    raise ValueError(f"duplicate field or column {c!r}")
                seen.add(c)
        if sum(isinstance(f, IndexField) for f in self.fields) > 1:
            raise ValueError("at most one index field")

    def names(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.fields)

    def has(self, name: str) -> bool:
        return name in self.names()

    def get(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise ValueError(f"unknown field {name!r}; there are {self.names()}")

    @property
    def index(self) -> IndexField | None:
        return next((f for f in self.fields if isinstance(f, IndexField)), None)

    def add(self, *fields: Field) -> Schema:
        return Schema((*self.fields, *fields))

    def drop(self, *names: str) -> Schema:
        for n in names:
            self.get(n)
        return Schema(tuple(f for f in self.fields if f.name not in names))

    def put(self, new: Field, name: str | None = None) -> Schema:
        """new in place of the field `name` (its own name), or behind all."""
        name = name or new.name
        if not self.has(name):
            return self.add(new)
        return Schema(tuple(new if f.name == name else f for f in self.fields))

    def rename(self, names: dict[str, str]) -> Schema:
        for n in names:
            self.get(n)
        return Schema(tuple(f.named(names.get(f.name, f.name)) for f in self.fields))

    def check(self, struct: T.StructType) -> None:
        """Each field's columns exist with the declared type; further columns are tolerated."""
        have = {f.name: f.dataType for f in struct}
        for f in self.fields:
            if isinstance(f, BundleField):
                continue
            for c in f.columns:
                if c not in have:
                    raise ValueError(f"no column {c!r} for field {f.name!r}")
            want = spark_type(f.dtype) if not isinstance(f, CompositeIndexField) else None
            if want is not None and have[f.name] != want and not _widens(have[f.name], want):
                raise TypeError(f"column {f.name!r} is {have[f.name].simpleString()}, declared {want.simpleString()}")


_ORDER = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]


def _widens(a: T.DataType, b: T.DataType) -> bool:
    return a in _ORDER and b in _ORDER and _ORDER.index(a) <= _ORDER.index(b) or a == T.FloatType() and b == T.DoubleType()
