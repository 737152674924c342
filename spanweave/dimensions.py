"""Dimensions, slices as struct columns, and window layouts as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Dimension:
    name: str

    def spec(self, start: Any = None, stop: Any = None) -> dict[str, Any]:
        """[start, stop) as a value."""
        return {"start": start, "stop": stop}

    def comparable_with(self, other: Dimension) -> bool:
        return type(self) is type(other) and self.name == other.name

    def to_index(self, start: Column, stop: Column) -> tuple[Column, Column]:
        return start, stop


@dataclass(frozen=True)
class IndexDimension(Dimension):
    """Whole positions."""


@dataclass(frozen=True)
class TemporalDimension(Dimension):
    """Seconds; positions are seconds times the rate, cut toward zero."""

    sample_rate: float | None = None

    def to_index(self, start: Column, stop: Column) -> tuple[Column, Column]:
        if self.sample_rate is None:
            raise ValueError(f"dimension {self.name!r} has no sample rate")
        return tuple((c * F.lit(self.sample_rate)).cast("long") for c in (start, stop))


@dataclass(frozen=True)
class CategoricalDimension(Dimension):
    categories: tuple[Any, ...] = ()

    def spec(self, *labels: Any) -> Any:
        """One label, or a tuple of several."""
        return labels[0] if len(labels) == 1 else labels

    def position(self, label: Column) -> Column:
        """Where a label stands; an unknown one fails."""
        at = F.array_position(F.array(*(F.lit(c) for c in self.categories)), label)
        return F.when(at > 0, at - 1).otherwise(F.raise_error(F.concat(F.lit("unknown category "), label.cast("string"))))


def interval(start: Column | str, stop: Column | str) -> Column:
    """Half-open [start, stop)."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (start, stop))
    return F.struct(a.alias("start"), b.alias("stop"))


def overlaps(a: Column, b: Column, pad: float = 0) -> Column:
    """Half-open overlap of two interval structs, the left one padded on both sides."""
    stop, start = (a["stop"] + F.lit(pad), a["start"] - F.lit(pad)) if pad else (a["stop"], a["start"])
    return (b["start"] < stop) & (b["stop"] > start)


@dataclass(frozen=True)
class AxisWindow:
    """Windows [start + offset + k * stride, + size) along one axis, full ones only or with one clipped at the end."""

    size: float
    stride: float | None = None
    offset: float = 0
    include_partial: bool = False

    def __post_init__(self) -> None:
        if self.size <= 0 or self.step <= 0:
            raise ValueError("size and stride must be positive")

    @property
    def step(self) -> float:
        return self.size if self.stride is None else self.stride

    def windows(self, start: Column, stop: Column) -> Column:
        """array<struct<start, stop>> over the extent [start, stop); null where there is none."""
        first = start + F.lit(self.offset)
        full = F.greatest(F.floor((stop - first - F.lit(self.size)) / F.lit(self.step)) + 1, F.lit(0)).cast("long")
        count = full + F.when(first + full * F.lit(self.step) < stop, 1).otherwise(0) if self.include_partial else full
        span = lambda k: F.struct((first + k * F.lit(self.step)).alias("start"), F.least(first + k * F.lit(self.step) + F.lit(self.size), stop).alias("stop"))
        return F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), span))
