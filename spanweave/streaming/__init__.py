"""Operators on unbounded tables: the row-wise ones run unchanged on readStream; these need event time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanweave.dimensions import AxisWindow
from spanweave.operators.groups import ReducingOperator


def _timed(stream: DataFrame, time: str) -> tuple[DataFrame, bool]:
    """The stream with an event time that watermarks take, and whether it had no time zone before."""
    plain = stream.schema[time].dataType.typeName() == "timestamp_ntz"
    return (stream.withColumn(time, F.col(time).cast("timestamp")) if plain else stream), plain


def windowed(stream: DataFrame, time: str, window: AxisWindow, aggs: dict[str, ReducingOperator], *, by: list[str] | None = None, late: str = "0 seconds") -> DataFrame:
    """Reducers per event-time window (seconds; sliding if stride < size) and key; rows later than `late` are dropped by the watermark."""
    span = F.window(F.col(time), f"{window.size} seconds", f"{window.step} seconds", f"{window.offset} seconds")
    timed, plain = _timed(stream, time)
    kind = "timestamp_ntz" if plain else "timestamp"
    keyed = timed.withWatermark(time, late).groupBy(span.alias("window"), *(by or []))
    edges = [F.col(f"window.{k}").cast(kind).alias(n) for k, n in (("start", "start"), ("end", "stop"))]
    return keyed.agg(*(a.expression().alias(n) for n, a in aggs.items())).select(*edges, *(by or []), *aggs)


def interval_join(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, on: dict[str, str], pad: str, late: str) -> DataFrame:
    """Stream-stream pairs of equal keys whose times are within `pad` of each other; watermarks bound the state."""
    a, b = _timed(left, left_time)[0].withWatermark(left_time, late).alias("l"), _timed(right, right_time)[0].withWatermark(right_time, late).alias("r")
    condition: Column = F.col(f"r.{right_time}").between(F.col(f"l.{left_time}") - F.expr(f"INTERVAL {pad}"), F.col(f"l.{left_time}") + F.expr(f"INTERVAL {pad}"))
    for x, y in on.items():
        condition = condition & (F.col(f"l.{x}") == F.col(f"r.{y}"))
    return a.join(b, condition)


def first_seen(stream: DataFrame, keys: list[str], time: str, *, late: str) -> DataFrame:
    """Rows whose label has not come before within the watermark: row identity on a stream."""
    return _timed(stream, time)[0].withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
