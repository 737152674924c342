"""Queries that apply the dataset operators to the supplied tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import spanweave as sw
from spanweave import AxisWindow, ColumnCollision, Count, Custom, Dataset, DimensionJoin, Distinct, Max, Mean, Min, Sum
from spanweave.dimensions import IndexDimension, TemporalDimension
from spanweave.schema import DataField, IndexField, Schema, ValueField
from spanweave.storage import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_INDEX = {"orders": "o_orderkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id"}
TIME, CHARS, AXIS = TemporalDimension("time"), IndexDimension("chars"), IndexDimension("axis")


def table(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return sw.read_table(spark, f"{sf_dir}/{name}.parquet", _INDEX.get(name))


def query(sql: str | None) -> Callable:
    def add(fn: Callable[[Callable[[str], Dataset]], Dataset | DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(lambda name: table(spark, sf_dir, name))
            return out.consumed().df if isinstance(out, Dataset) else out

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _events_at(ds: Dataset, length: float = 600.0, later: float = 0.0) -> Dataset:
    """Events with their time as a slice [at, at + length) in seconds of January 2024, moved by `later`."""
    at = F.expr("CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) AS DOUBLE) / 1000000")
    dated = sw.assign(ds, at=(sw.DimensionField.from_dim("at", TIME), at + F.lit(later) if later else at))
    dated = sw.assign(dated, until=(sw.DimensionField.from_dim("until", TIME), F.col("at") + F.lit(length)))
    return sw.compose_slice(dated, "span", {"time": ("at", "until")})


_AT = "epoch_us(ts) / 1000000.0 - 1704067200.0"


# --- filters and columns


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderstatus = 'F'")
def where_filter(t):
    return sw.keep(sw.where(t("orders"), lambda d: (F.col("o_totalprice") > 200000) & (F.col("o_orderstatus") == "F")), ["o_orderkey", "o_custkey", "o_totalprice"])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS c_acctbal FROM customer WHERE CASE WHEN c_acctbal > 0 THEN c_acctbal END < 5000")
def where_null_mask(t):
    ds = sw.assign(sw.keep(t("customer"), ["c_custkey", "c_acctbal"]), c_acctbal=F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")))
    return sw.where(ds, "c_acctbal < 5000")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def keep_columns(t):
    return sw.keep(t("orders"), ["o_orderpriority", "o_orderstatus", "o_orderkey"])


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part")
def drop_columns(t):
    return sw.drop(t("part"), "p_retailprice")


@query("SELECT s_suppkey AS supplier, s_name AS name, s_nationkey, s_acctbal FROM supplier")
def rename_columns(t):
    return sw.rename(t("supplier"), {"s_suppkey": "supplier", "s_name": "name"})


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def assign_expression(t):
    ds = sw.assign(t("lineitem"), net=F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return sw.keep(ds, ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "net"])


@query("SELECT c_custkey, c_name, n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def assign_by_label(t):
    counts = sw.reduce(t("orders"), "o_custkey", {"n": Count.on()})
    return sw.keep(sw.assign(t("customer"), n=sw.rename(counts, {"o_custkey": "c_custkey"}).df), ["c_custkey", "c_name", "n"])


@query("SELECT p_partkey, p_size, CAST(p_size * 2 AS DOUBLE) AS twice FROM part")
def add_column_typed(t):
    return sw.keep(sw.add_column(t("part"), ValueField("twice", dtype=float), F.col("p_size") * 2), ["p_partkey", "p_size", "twice"])


@query("SELECT r_regionkey, r_name, CAST(NULL AS DOUBLE) AS weight FROM region")
def new_field_null(t):
    return sw.new_field(t("region"), ValueField("weight", dtype=float))


@query("SELECT doc_id, length(text)::BIGINT + length(lang)::BIGINT AS size FROM documents")
def map_fields_python(t):
    return sw.keep(sw.map_fields(t("documents"), ["text", "lang"], lambda a, b: len(a) + len(b), "size", dtype=int), ["doc_id", "size"])


@query("SELECT p_partkey, upper(p_brand) || '/' || p_type AS label FROM part")
def map_fields_native_lazy(t):
    ds = sw.map_fields(t("part"), ["p_brand", "p_type"], lambda a, b: F.concat(F.upper(a), F.lit("/"), b), "label", lazy=True)
    return sw.keep(sw.consume(ds, "label"), ["p_partkey", "label"])


@query("SELECT c_name, c_custkey AS customer_label, c_acctbal FROM customer")
def set_index_demotes(t):
    ds = sw.keep(t("customer"), ["c_custkey", "c_name", "c_acctbal"])
    return sw.rename(sw.set_index(ds, "c_name"), {"c_custkey": "customer_label"})


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS index, s_suppkey, s_name FROM supplier")
def reset_index_dense(t):
    return sw.reset_index(sw.keep(t("supplier"), ["s_suppkey", "s_name"]))


@query("SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1")
def pipe_sql(t):
    return sw.pipe(t("supplier"), lambda d: d.df.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")), schema=Schema((IndexField("s_nationkey"), ValueField("n"))))


# --- plans and joins

_PAIR = "SELECT row_number() OVER (ORDER BY left_index NULLS FIRST, right_index NULLS FIRST) - 1 AS {0}, left_index, right_index FROM ({1})"


def _halves(t):
    a = sw.keep(sw.where(t("customer"), "c_custkey % 3 <> 0"), ["c_custkey", "c_acctbal"])
    b = sw.keep(sw.where(t("customer"), "c_custkey % 3 <> 1"), ["c_custkey", "c_name"])
    return a, b


_HALF = "(SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) a {0} JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 1) b ON a.c_custkey = b.c_custkey"
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):

    def _run(t, how=_how):
        return sw.join(*_halves(t), how=how)

    _run.__name__ = f"join_index_{_how}"
    query(_PAIR.format("join_id", f"SELECT a.c_custkey AS left_index, b.c_custkey AS right_index FROM {_HALF.format(_sql)}"))(_run)


def _keyed(t):
    a = sw.rename(sw.keep(t("customer"), ["c_custkey", "c_nationkey"]), {"c_nationkey": "nation"})
    b = sw.rename(sw.keep(t("supplier"), ["s_suppkey", "s_nationkey"]), {"s_nationkey": "nation"})
    null = lambda d: sw.assign(d, nation=F.when(F.col("nation") % 5 != 0, F.col("nation")))
    return null(a), null(b)


_NULLED = "(SELECT c_custkey, CASE WHEN c_nationkey % 5 <> 0 THEN c_nationkey END AS k FROM customer) a {0} JOIN (SELECT s_suppkey, CASE WHEN s_nationkey % 5 <> 0 THEN s_nationkey END AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k"
for _how, _sql in (("inner", "INNER"), ("left", "LEFT"), ("right", "RIGHT"), ("outer", "FULL")):

    def _run(t, how=_how):
        return sw.join(*_keyed(t), on="nation", how=how)

    _run.__name__ = f"join_field_null_keys_{_how}"
    query(_PAIR.format("join_id", f"SELECT a.c_custkey AS left_index, b.s_suppkey AS right_index FROM {_NULLED.format(_sql)}"))(_run)


@query("SELECT o_orderkey AS left_index, c_custkey AS right_index, o_custkey, o_totalprice, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_inner(t):
    orders, customers = sw.keep(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"]), sw.keep(t("customer"), ["c_custkey", "c_name", "c_mktsegment"])
    keyed = sw.assign(customers, o_custkey=F.col("c_custkey"))
    plan = sw.join(orders, keyed, on="o_custkey", dense=False)
    return sw.drop(sw.merge(orders, keyed, plan, collision=ColumnCollision("keep")), "join_id").df.select("left_index", "right_index", "o_custkey", "o_totalprice", "c_name", "c_mktsegment")


@query(f"SELECT a.c_custkey AS left_index, b.c_custkey AS right_index, x.c_acctbal, y.c_name FROM {_HALF.format('FULL')} LEFT JOIN customer x ON x.c_custkey = a.c_custkey LEFT JOIN customer y ON y.c_custkey = b.c_custkey")
def merge_outer(t):
    a, b = _halves(t)
    return sw.merge(a, b, sw.join(a, b, how="outer", dense=False)).df.select("left_index", "right_index", "c_acctbal", "c_name")


def _collide(t):
    a = sw.assign(sw.keep(t("customer"), ["c_custkey"]), v=F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey") * 10))
    b = sw.assign(sw.keep(t("customer"), ["c_custkey"]), v=F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") * 100))
    return a, b


@query("SELECT c_custkey AS left_index, c_custkey AS right_index, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END AS v FROM customer")
def merge_collision_keep(t):
    a, b = _collide(t)
    return sw.merge(a, b, sw.join(a, b, dense=False), collision=ColumnCollision("keep")).df.drop("join_id")


@query("SELECT c_custkey AS left_index, c_custkey AS right_index, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 100 END, CASE WHEN c_custkey % 2 = 0 THEN c_custkey * 10 END) AS v FROM customer")
def merge_collision_update_missing(t):
    a, b = _collide(t)
    return sw.merge(a, b, sw.join(a, b, dense=False), collision=ColumnCollision("update_missing", side="right")).df.drop("join_id")


@query("SELECT d.doc_id AS plan_id, v.v AS text_copy, d.lang FROM (SELECT doc_id, lang FROM documents) d JOIN (VALUES (1), (2)) v(v) ON TRUE")
def explode_gather(t):
    docs = sw.keep(t("documents"), ["doc_id", "lang"])
    twice = docs.df.select(F.col("doc_id").alias("source_index"), F.explode(F.array(F.lit(1), F.lit(2))).alias("text_copy"))
    plan = sw.make_plan(docs, twice, dense=False)
    both = sw.explode(sw.assign(docs, text_copy=F.lit(0), doc=F.col("doc_id")), plan)
    return both.df.select(F.col("doc").alias("plan_id"), "text_copy", "lang")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.05)")
def anti_by_plan(t):
    lines = sw.reset_index(sw.where(t("lineitem"), "l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.05"), index_name="line", dense=False)
    sup = sw.keep(t("supplier"), ["s_suppkey"])
    right = sw.rename(sw.keep(lines, ["line", "l_suppkey"]), {"l_suppkey": "k"})
    return sw.anti(sw.keep(sup, ["s_suppkey"]), sw.join(sw.assign(sup, k=F.col("s_suppkey")), right, on="k", dense=False))


# --- intervals


def _pairs(plan: Dataset) -> DataFrame:
    return plan.df.select("left_index", "right_index")


def _signups(t):
    """All events, and all events five hours later."""
    return _events_at(t("events")), _events_at(t("events"), later=18000.0)


_SIDES = f"(SELECT event_id, user_id, {_AT} AS at FROM events) a, (SELECT event_id, user_id, {_AT} + 18000.0 AS at FROM events) b"
_OVER = "b.at < a.at + 600 + {0} AND b.at + 600 > a.at - {0}"


@query(f"SELECT a.event_id AS left_index, b.event_id AS right_index FROM {_SIDES} WHERE a.user_id = b.user_id AND {_OVER.format(0)}")
def dimension_join_scoped(t):
    return _pairs(sw.join(*_signups(t), strategy=DimensionJoin("span", "span", ["time"], on="user_id"), dense=False))


@query(f"SELECT a.event_id AS left_index, b.event_id AS right_index FROM {_SIDES} WHERE {_OVER.format(0)}")
def dimension_join_unscoped(t):
    return _pairs(sw.join(*_signups(t), strategy=DimensionJoin("span", "span", ["time"]), dense=False))


@query(f"SELECT a.event_id AS left_index, b.event_id AS right_index FROM {_SIDES.replace(', (SELECT', ' LEFT JOIN (SELECT')} ON a.user_id = b.user_id AND {_OVER.format(0)}")
def dimension_join_left(t):
    return _pairs(sw.join(*_signups(t), strategy=DimensionJoin("span", "span", ["time"], on="user_id", how="left"), dense=False))


@query(f"SELECT a.event_id AS left_index, b.event_id AS right_index FROM {_SIDES.replace(', (SELECT', ' FULL JOIN (SELECT')} ON a.user_id = b.user_id AND {_OVER.format(0)}")
def dimension_join_outer(t):
    return _pairs(sw.join(*_signups(t), strategy=DimensionJoin("span", "span", ["time"], on="user_id", how="outer"), dense=False))


@query("SELECT a.p_partkey AS left_index, b.p_partkey AS right_index FROM part a, part b WHERE a.p_size < b.p_size + 2 AND b.p_size < a.p_size + 2 AND a.p_partkey < b.p_partkey + 50 AND b.p_partkey < a.p_partkey + 50")
def dimension_join_2d(t):
    boxes = sw.assign(sw.keep(t("part"), ["p_partkey", "p_size"]), x0=F.col("p_size").cast("long"), x1=F.col("p_size").cast("long") + 2, y0=F.col("p_partkey"), y1=F.col("p_partkey") + 50)
    boxes = sw.compose_slice(boxes, "box", {"y": ("y0", "y1"), "x": ("x0", "x1")})
    return _pairs(sw.join(boxes, boxes, strategy=DimensionJoin("box", "box", ["y", "x"]), dense=False))


@query(f"SELECT a.event_id AS left_index, b.event_id AS right_index FROM {_SIDES} WHERE a.user_id = b.user_id AND {_OVER.format(3600)}")
def dimension_join_chain(t):
    a, b = _signups(t)
    first = sw.dimension_join(a, b, predicate=sw.equals(), left_on="user_id", right_on="user_id", dense=False)
    return _pairs(sw.dimension_join(a, b, first, predicate=sw.overlap(pad=3600), left_on="span", right_on="span", dimension="time", dense=False))


@query(f"SELECT a.event_id AS left_index, b.event_id AS right_index FROM {_SIDES} WHERE {_OVER.format(100)}")
def dimension_join_overlap_pad(t):
    return _pairs(sw.dimension_join(*_signups(t), predicate=sw.overlap(pad=100), left_on=("at", "until"), right_on=("at", "until"), dense=False))


@query(_PAIR.format("pair_id", f"SELECT a.event_id AS left_index, b.event_id AS right_index FROM {_SIDES} WHERE a.user_id = b.user_id AND {_OVER.format(3600)}"))
def match_on_overlap(t):
    return sw.match(*_signups(t), on=["user_id"], predicates={"time": sw.overlap(pad=3600)})


@query(f"SELECT a.event_id, count(b.event_id) AS n, coalesce(sum(b.value), 0.0) AS total FROM (SELECT event_id, user_id, {_AT} AS at FROM events) a LEFT JOIN (SELECT event_id, user_id, value, {_AT} + 18000.0 AS at FROM events) b ON a.user_id = b.user_id AND {_OVER.format(3600)} GROUP BY 1")
def implode_domain_reduce(t):
    a, b = _signups(t)
    plan = sw.match(a, b, on=["user_id"], predicates={"time": sw.overlap(pad=3600)}, dense=False)
    groups = sw.implode(b, plan, a)
    from spanweave.operators.groups import reduced

    return sw.rename(reduced(groups, {"n": Count.on(), "total": Sum.on("value")}), {"left_index": "event_id"}).df.select("event_id", "n", F.round("total", 6).alias("total"))


ORACLE_SQL["implode_domain_reduce"] = ORACLE_SQL["implode_domain_reduce"].replace("coalesce(sum(b.value), 0.0)", "round(coalesce(sum(b.value), 0.0), 6)")

# --- composition


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS nation FROM customer UNION ALL SELECT -s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def concat_rows_pad(t):
    a = sw.rename(sw.keep(t("customer"), ["c_custkey", "c_name", "c_acctbal"]), {"c_custkey": "id", "c_name": "name", "c_acctbal": "balance"})
    s = t("supplier")
    b = sw.rename(sw.keep(s.with_(s.df.withColumn("s_suppkey", -F.col("s_suppkey"))), ["s_suppkey", "s_name", "s_nationkey"]), {"s_suppkey": "id", "s_name": "name", "s_nationkey": "nation"})
    return sw.concat_rows(a, b)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 <> 1 THEN o_orderstatus END AS o_orderstatus FROM orders")
def concat_columns_align(t):
    o = t("orders")
    return sw.concat_columns(sw.where(sw.keep(o, ["o_orderkey", "o_totalprice"]), "o_orderkey % 3 <> 0"), sw.where(sw.keep(o, ["o_orderkey", "o_orderstatus"]), "o_orderkey % 3 <> 1"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000")
def bundle_deferred(t):
    b = sw.bundle(orders=t("orders")).defer("big", sw.where, "orders", predicate="o_totalprice > 1000").defer("slim", sw.keep, "big", fields=["o_orderkey", "o_totalprice"])
    return sw.extract(b, "slim")


# --- groups


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(avg(l_quantity), 4) AS mean_quantity, min(l_shipdate) AS first, max(l_shipdate) AS last FROM lineitem GROUP BY 1")
def reduce_all(t):
    ds = sw.assign(t("lineitem"), net=F.col("l_extendedprice") * (1 - F.col("l_discount")))
    out = sw.reduce(ds, "l_suppkey", {"revenue": Sum.on("net"), "n": Count.on(), "parts": Distinct.on("l_partkey"), "mean_quantity": Mean.on("l_quantity"), "first": Min.on("l_shipdate"), "last": Max.on("l_shipdate")})
    return sw.assign(out, revenue=F.round("revenue", 2), mean_quantity=F.round("mean_quantity", 4))


@query("SELECT s_suppkey AS l_suppkey, round(coalesce(sum(l_quantity), 0.0), 2) AS quantity, count(l_suppkey) AS n, count(DISTINCT l_partkey) AS parts FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48) ON l_suppkey = s_suppkey GROUP BY 1")
def reduce_domain(t):
    sup = t("supplier")
    lines = sw.link(sw.where(t("lineitem"), "l_returnflag = 'R' AND l_quantity > 48"), sup, "l_suppkey")
    return sw.assign(sw.reduce(lines, "l_suppkey", {"quantity": Sum.on("l_quantity"), "n": Count.on(), "parts": Distinct.on("l_partkey")}, sup), quantity=F.round("quantity", 2))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY 1, 2")
def reduce_composite(t):
    return sw.assign(sw.reduce(t("lineitem"), ["l_returnflag", "l_linestatus"], {"n": Count.on(), "quantity": Sum.on("l_quantity")}), quantity=F.round("quantity", 2))


@query("SELECT o_orderstatus, sum(n)::DOUBLE AS orders, count(*) AS cells FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def reduce_rollup(t):
    cells = sw.reduce(t("orders"), ["o_orderstatus", "o_orderpriority"], {"n": Count.on()})
    return sw.reduce(sw.reset_index(cells, dense=False), "o_orderstatus", {"orders": Sum.on("n"), "cells": Count.on()})


@query("SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'click' GROUP BY 1")
def partition_drop_nulls(t):
    ds = sw.assign(t("events"), user_id=F.when(F.col("event_type") != "click", F.col("user_id")))
    return sw.reduce(ds, "user_id", {"n": Count.on()}, null_keys="drop")


@query("SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1")
def partition_nested(t):
    groups = sw.partition(sw.keep(t("orders"), ["o_orderkey", "o_custkey"]), "o_custkey")
    return groups.nested().select("o_custkey", F.array_join(F.col("fiber.o_orderkey").cast("array<string>"), ",").alias("orders"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def flatten_roundtrip(t):
    return sw.flatten(sw.partition(sw.keep(t("orders"), ["o_orderkey", "o_custkey"]), "o_custkey"))


@query("SELECT user_id, arg_max(event_id, ts) AS event_id FROM events GROUP BY 1")
def last_touch(t):
    return sw.latest(sw.keep(t("events"), ["event_id", "ts", "user_id"]), "user_id", "ts").df.select("user_id", "event_id")


@query("SELECT s_suppkey, s_name, round(coalesce(r, 0) / nullif(n, 0), 6) AS share FROM supplier LEFT JOIN (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0 END) AS r, count(*) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey")
def ratio_after_domain_reduce(t):
    sup = t("supplier")
    lines = sw.link(sw.assign(t("lineitem"), back=F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)), sup, "l_suppkey")
    sums = sw.rename(sw.reduce(lines, "l_suppkey", {"r": Sum.on("back"), "n": Count.on()}, sup), {"l_suppkey": "s_suppkey"})
    both = sw.concat_columns(sw.keep(sup, ["s_suppkey", "s_name"]), sums)
    return sw.keep(sw.assign(both, share=F.round(F.col("r") / F.nullif(F.col("n"), F.lit(0)), 6)), ["s_suppkey", "s_name", "share"])


# --- windows and slices


def _chars(t) -> Dataset:
    ds = sw.assign(sw.keep(t("documents"), ["doc_id", "text", "n_chars"]), begin=(sw.DimensionField.from_dim("begin", CHARS, int), F.lit(0).cast("long")), end=(sw.DimensionField.from_dim("end", CHARS, int), F.col("n_chars")))
    return sw.compose_slice(ds, "extent", {"chars": ("begin", "end")})


def _tiles(partial: bool, offset: int = 0) -> str:
    full = f"greatest(floor((n_chars - {offset} - 512) / 256.0)::BIGINT + 1, 0)"
    count = f"{full} + CASE WHEN {offset} + {full} * 256 < n_chars THEN 1 ELSE 0 END" if partial else full
    return f"SELECT doc_id AS source_index, {offset} + k * 256 AS start, least({offset} + k * 256 + 512, n_chars) AS stop FROM (SELECT *, unnest(range({count})) AS k FROM documents)"


for _name, _partial, _offset in (("window_full", False, 0), ("window_partial", True, 0), ("window_offset", True, 100)):

    def _run(t, partial=_partial, offset=_offset):
        plan = sw.window_expansion_plan(_chars(t), windows={"chars": AxisWindow(512, 256, offset, partial)}, field="extent", dense=False)
        return plan.df.select("source_index", F.col("slice.chars.start").alias("start"), F.col("slice.chars.stop").alias("stop"))

    _run.__name__ = _name
    query(_tiles(_partial, _offset))(_run)


@query("SELECT row_number() OVER (ORDER BY p_partkey, x, y) - 1 AS plan_id, p_partkey AS source_index, x::BIGINT AS x0, y::BIGINT AS y0 FROM (SELECT p_partkey, unnest(range(0, (p_size // 5) * 5, 5)) AS x FROM part), (SELECT unnest(range(0, 40, 20)) AS y)")
def window_2d(t):
    ds = sw.assign(sw.keep(t("part"), ["p_partkey", "p_size"]), x0=F.lit(0), x1=F.col("p_size"), y0=F.lit(0), y1=F.lit(40))
    plan = sw.window_expansion_plan(ds, windows={"x": AxisWindow(5), "y": AxisWindow(20)}, bindings={"x": ("x0", "x1"), "y": ("y0", "y1")})
    return plan.df.select("plan_id", "source_index", F.col("slice.x.start").cast("long").alias("x0"), F.col("slice.y.start").cast("long").alias("y0"))


@query("SELECT doc_id, start, text FROM (SELECT doc_id, k * 512 AS start, substring(text, (k * 512 + 1)::BIGINT, 512) AS text FROM (SELECT *, unnest(range(greatest(floor((n_chars - 512) / 512.0)::BIGINT + 1, 0))) AS k FROM documents))")
def slice_text_windows(t):
    docs = sw.assign(_chars(t), doc=F.col("doc_id"))
    plan = sw.window_expansion_plan(docs, windows={"chars": AxisWindow(512)}, field="extent", slice_field="extent", dense=False)
    cut = sw.materialize(sw.slice_data(sw.explode(docs, plan), "extent", "text", lazy=True), "text")
    return sw.consume(cut).df.select(F.col("doc").alias("doc_id"), F.col("extent.chars.start").cast("long").alias("start"), "text")


@query("SELECT vec_id, len(embedding[1:8])::INTEGER AS n, embedding[1]::DOUBLE AS first, embedding[8]::DOUBLE AS last FROM embeddings")
def slice_embedding(t):
    ds = sw.assign(t("embeddings"), a=F.lit(0), b=F.lit(8))
    ds = sw.slice_data(sw.compose_slice(ds, "part", {"axis": ("a", "b")}), "part", "embedding")
    head = sw.consume(sw.materialize(ds, "embedding", reader=sw.array_cut(AXIS))).df
    at = lambda i: F.element_at("embedding", i).cast("double")
    return head.select("vec_id", F.size("embedding").alias("n"), at(1).alias("first"), at(-1).alias("last"))


@query(f"SELECT event_id, user_id, {_AT} AS start, {_AT} + 600 AS stop FROM events")
def compose_slice_fields(t):
    return _events_at(t("events")).df.select("event_id", "user_id", F.col("span.time.start").alias("start"), F.col("span.time.stop").alias("stop"))


@query(f"""WITH e AS (SELECT *, {_AT} AS moment FROM events), x AS (SELECT user_id, floor(min(moment) / 86400) * 86400 AS a, floor(max(moment) / 86400) * 86400 + 86400 AS b FROM e GROUP BY 1),
w AS (SELECT user_id, a + k * 86400 AS start FROM (SELECT *, unnest(range(((b - a) / 86400)::BIGINT)) AS k FROM x))
SELECT w.user_id, w.start, count(e.event_id) AS n, round(coalesce(sum(e.value), 0.0), 4) AS total FROM w LEFT JOIN e ON e.user_id = w.user_id AND e.moment < w.start + 86400 AND e.moment + 1 > w.start GROUP BY 1, 2""")
def daily_windows(t):
    """Flagship: each user's days, from the first event's to the last one's, with what happens in them, empty days too."""
    ev = _events_at(t("events"), 1.0)
    users = sw.reduce(ev, "user_id", {"lo": Min.on("at"), "hi": Max.on("at")})
    day = 86400.0
    users = sw.assign(users, lo=F.floor(F.col("lo") / day) * day, hi=F.floor(F.col("hi") / day) * day + day)
    days = sw.window_expansion_plan(sw.assign(users, user=F.col("user_id")), windows={"time": AxisWindow(day)}, bindings={"time": ("lo", "hi")})
    days = sw.rename(days, {"source_index": "user_id"})
    plan = sw.match(sw.assign(days, uid=F.col("user_id")), sw.assign(ev, uid=F.col("user_id")), on=["uid"], predicates={"time": sw.overlap()}, dense=False)
    from spanweave.operators.groups import reduced

    found = sw.rename(reduced(sw.implode(ev, plan, days), {"n": Count.on(), "total": Sum.on("value")}), {"left_index": "plan_id"})
    out = sw.concat_columns(days, found).df
    return out.select("user_id", F.col("slice.time.start").alias("start"), "n", F.round("total", 4).alias("total"))


@query("SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority) - 1 AS chunk_rank, count(*) AS n FROM orders GROUP BY 1")
def ordered_ids(t):
    counts = sw.reduce(t("orders"), "o_orderpriority", {"n": Count.on()})
    return sw.reset_index(counts, index_name="chunk_rank").df.select("o_orderpriority", "chunk_rank", "n")


@query("SELECT l_orderkey, c_custkey, n_name, l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 49 AND n_regionkey = 1")
def merge_chain(t):
    lines = sw.rename(sw.reset_index(sw.where(t("lineitem"), "l_quantity > 49"), index_name="line", dense=False), {"l_orderkey": "key"})
    lines = sw.keep(lines, ["line", "key", "l_quantity"])
    orders = sw.keep(sw.assign(t("orders"), key=F.col("o_orderkey"), customer=F.col("o_custkey")), ["o_orderkey", "key", "customer"])
    first = sw.drop(sw.merge(lines, orders, sw.join(lines, orders, on="key", dense=False), collision=ColumnCollision("keep")), ["left_index", "right_index"])
    people = sw.assign(t("customer"), customer=F.col("c_custkey"), nation=F.col("c_nationkey"))
    people = sw.keep(people, ["c_custkey", "customer", "nation"])
    second = sw.merge(first, people, sw.join(first, people, on="customer", dense=False), collision=ColumnCollision("keep"))
    second = sw.rename(sw.drop(second, ["left_index", "right_index"]), {"join_id": "row"})
    nations = sw.keep(sw.assign(sw.where(t("nation"), "n_regionkey = 1"), nation=F.col("n_nationkey")), ["n_nationkey", "nation", "n_name"])
    third = sw.merge(second, nations, sw.join(second, nations, on="nation", dense=False), collision=ColumnCollision("keep"))
    return third.df.select(F.col("key").alias("l_orderkey"), F.col("customer").alias("c_custkey"), "n_name", "l_quantity")


# --- storage, bundles and arms


def _place(t) -> str:
    return f"{shared_folder(t('region').df.sparkSession)}/query-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def save_and_load(t):
    ds, path = sw.keep(t("customer"), ["c_custkey", "c_name", "c_acctbal"]), _place(t)
    sw.save(ds, path)
    return sw.load(ds.df.sparkSession, path)


@query("SELECT o_orderkey, o_totalprice FROM orders")
def offload_flatten(t):
    return sw.offload(sw.keep(t("orders"), ["o_orderkey", "o_totalprice"]), path=_place(t), chunk_size=4000).flatten()


@query("SELECT k AS chunk, k * 4000 AS start, least(k * 4000 + 4000, (SELECT count(*) FROM orders)) AS stop FROM (SELECT unnest(range((SELECT (count(*) + 3999) // 4000 FROM orders))) AS k)")
def offload_chunks(t):
    return sw.offload(sw.keep(t("orders"), ["o_orderkey"]), path=_place(t), chunk_size=4000).base


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def make_dataset(t):
    schema = Schema((IndexField("n_nationkey"), ValueField("n_name", dtype=str), ValueField("n_regionkey")))
    return sw.make_from_dataframe(t("nation").df.select("n_nationkey", "n_name", "n_regionkey"), schema)


@query("SELECT s_nationkey, max(s_acctbal) AS most FROM supplier GROUP BY 1")
def named_transform(t):
    @sw.table_transform(schema=Schema((IndexField("s_nationkey"), ValueField("most"))))
    def richest(ds, column):
        return ds.df.groupBy("s_nationkey").agg(F.max(column).alias("most"))

    return richest(t("supplier"), "s_acctbal")


@query("SELECT s_nationkey, max(s_acctbal) - min(s_acctbal) AS spread FROM supplier GROUP BY 1")
def reduce_custom(t):
    return sw.reduce(t("supplier"), "s_nationkey", {"spread": Custom("s_acctbal", fn=lambda s: float(s.max() - s.min()))})


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.05)")
def semi_by_plan(t):
    lines = sw.reset_index(sw.where(t("lineitem"), "l_returnflag = 'R' AND l_quantity > 49 AND l_discount > 0.05"), index_name="line", dense=False)
    sup = sw.keep(t("supplier"), ["s_suppkey", "s_name"])
    right = sw.rename(sw.keep(lines, ["line", "l_suppkey"]), {"l_suppkey": "k"})
    return sw.semi(sup, sw.join(sw.assign(sup, k=F.col("s_suppkey")), right, on="k", dense=False))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def concat_dispatch(t):
    c = t("customer")
    return sw.concat(sw.keep(c, ["c_custkey", "c_name"]), sw.keep(c, ["c_custkey", "c_acctbal"]), axis=1)


@query("SELECT c_custkey, upper(c_name) AS loud FROM customer")
def concat_rows_pending(t):
    late = sw.map_fields(sw.keep(t("customer"), ["c_custkey", "c_name"]), "c_name", F.upper, "loud", lazy=True)
    return sw.keep(sw.consume(sw.concat_rows(sw.where(late, "c_name < 'Customer#000000500'"), sw.where(late, "c_name >= 'Customer#000000500'"))), ["c_custkey", "loud"])


@query("SELECT o_orderkey AS left_index, o_totalprice * 2 AS twice, upper(c_name) AS loud FROM orders JOIN customer ON o_custkey = c_custkey")
def merge_pending(t):
    orders = sw.rename(sw.keep(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"]), {"o_custkey": "who"})
    people = sw.assign(sw.keep(t("customer"), ["c_custkey", "c_name"]), who=F.col("c_custkey"))
    plan = sw.join(orders, people, on="who", dense=False)
    left, right = sw.map_fields(orders, "o_totalprice", lambda x: x * 2, "twice", lazy=True), sw.map_fields(people, "c_name", F.upper, "loud", lazy=True)
    return sw.consume(sw.merge(left, right, plan, collision=ColumnCollision("keep"))).df.select("left_index", "twice", "loud")


@query("SELECT o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000")
def bundle_of_handles(t):
    orders, people = sw.keep(t("orders"), ["o_orderkey", "o_custkey", "o_totalprice"]), sw.keep(t("customer"), ["c_custkey", "c_acctbal"])
    people = sw.rename(sw.assign(people, o_custkey=F.col("c_custkey")), {})
    from spanweave.operators.arms import BundleContext

    c = BundleContext(sw.bundle(l=orders, r=people))
    plan = sw.join(c["l"], c["r"], on="o_custkey", dense=False, out="plan")
    rich = sw.where(sw.merge(c["l"], c["r"], plan, collision=ColumnCollision("keep"), out="m"), predicate="c_acctbal > 5000", out="rich")
    return rich.collect().df.select(F.col("left_index").alias("o_orderkey"), "o_totalprice")


@query("SELECT vec_id, 2 AS tall, e[10]::DOUBLE AS first, e[19]::DOUBLE AS last FROM (SELECT vec_id, embedding AS e FROM embeddings)")
def materialize_2d(t):
    """An 8 x 8 matrix in each cell, cut in both axes without a reader."""
    ds = sw.keep(t("embeddings"), ["vec_id", "embedding"])
    grid = F.array(*(F.slice(F.col("embedding").cast("array<double>"), 8 * i + 1, 8) for i in range(8)))
    ds = sw.assign(ds, part=(DataField("part", dimensions=(IndexDimension("y"), IndexDimension("x"))), grid), a=F.lit(1), b=F.lit(3))
    ds = sw.compose_slice(ds, "box", {"y": ("a", "b"), "x": ("a", "b")})
    cut = sw.consume(sw.materialize(sw.slice_data(ds, "box", "part"), "part")).df
    return cut.select("vec_id", F.size("part").alias("tall"), F.col("part")[0][0].alias("first"), F.element_at(F.element_at("part", -1), -1).alias("last"))


# --- pipelines, end to end


@query("SELECT d.doc_id AS clip, l.quality, substring(d.text, (coalesce(l.quality, 0) * 10 + 1)::BIGINT, 20) AS text FROM labels l JOIN documents d ON d.doc_id = l.doc_id")
def labelled_clips(t):
    """Labels joined with the files they are of; each label's segment of its file is bound and read."""
    files = sw.assign(sw.keep(t("documents"), ["doc_id", "text"]), name=F.col("doc_id"))
    labels = sw.assign(sw.keep(sw.rename(t("labels"), {"doc_id": "label"}), ["label", "quality"]), name=F.col("label"))
    both = sw.merge(labels, files, sw.join(labels, files, on="name", dense=False), collision=ColumnCollision("keep"))
    clips = sw.set_index(sw.drop(both, ["left_index", "right_index"]), "name", index_name="clip")
    begin = F.coalesce("quality", F.lit(0)) * 10
    clips = sw.assign(clips, begin=(sw.DimensionField.from_dim("begin", CHARS, None), begin), end=(sw.DimensionField.from_dim("end", CHARS, None), begin + 20))
    cut = sw.materialize(sw.slice_data(sw.compose_slice(clips, "segment", [("begin", "end")]), "segment", "text"), "text")
    return sw.consume(cut).df.select("clip", "quality", "text")


@query("""WITH tiles AS (SELECT p_partkey, p_brand, x, y FROM (SELECT p_partkey, p_brand, unnest(range(0, (p_size // 5) * 5, 5)) AS x FROM part), (SELECT unnest(range(0, 40, 20)) AS y))
SELECT p_partkey AS image, x::BIGINT AS x0, y::BIGINT AS y0, p_brand FROM tiles
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_linenumber < x + 5 AND l_linenumber + 3 > x AND l_quantity / 2 < y + 20 AND l_quantity / 2 + 5 > y)""")
def labelled_tiles(t):
    """Tiles of images that overlap a labelled box, with the image's fields."""
    images = sw.assign(sw.keep(t("part"), ["p_partkey", "p_size", "p_brand"]), x0=F.lit(0).cast("double"), x1=F.col("p_size").cast("double"), y0=F.lit(0.0), y1=F.lit(40.0))
    tiles = sw.window_expansion_plan(images, windows={"x": AxisWindow(5), "y": AxisWindow(20)}, bindings={"x": ("x0", "x1"), "y": ("y0", "y1")}, dense=False)
    tiles = sw.assign(tiles, image=F.col("source_index"))
    boxes = sw.assign(sw.reset_index(sw.keep(t("lineitem"), ["l_partkey", "l_linenumber", "l_quantity"]), index_name="box_id", dense=False), image=F.col("l_partkey"))
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity") / 2
    boxes = sw.compose_slice(sw.assign(boxes, x0=n, x1=n + 3, y0=q, y1=q + 5), "box", {"x": ("x0", "x1"), "y": ("y0", "y1")})
    hit = sw.semi(tiles, sw.join(tiles, boxes, strategy=DimensionJoin("slice", "box", ["x", "y"], on="image"), dense=False))
    out = sw.explode(images, hit, carry=["slice", "image"])
    return out.df.select("image", F.col("slice.x.start").cast("long").alias("x0"), F.col("slice.y.start").cast("long").alias("y0"), "p_brand")


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {_AT} AS moment FROM events), d AS (SELECT user_id, floor(min(moment) / 86400) * 86400 AS a, floor(max(moment) / 86400) * 86400 + 86400 AS b FROM e GROUP BY 1),
w AS (SELECT user_id, a + k * 86400 AS start FROM (SELECT *, unnest(range(((b - a) / 86400)::BIGINT)) AS k FROM d))
SELECT w.user_id, w.start, string_agg(e.event_type, '>' ORDER BY e.event_id) AS said FROM w JOIN e ON e.user_id = w.user_id AND e.moment < w.start + 86400 + 600 AND e.moment + 600 > w.start - 600 GROUP BY 1, 2""")
def fused_windows(t):
    """Windows over each user's time, matched with what others tell of it (equal user, padded overlap), told in order."""
    ev = _events_at(t("events"))
    users = sw.reduce(ev, "user_id", {"lo": Min.on("at"), "hi": Max.on("at")})
    day = 86400.0
    users = sw.assign(users, lo=F.floor(F.col("lo") / day) * day, hi=F.floor(F.col("hi") / day) * day + day)
    clips = sw.window_expansion_plan(users, windows={"time": AxisWindow(day)}, bindings={"time": ("lo", "hi")})
    clips = sw.assign(clips, uid=F.col("source_index"))
    plan = sw.match(clips, sw.assign(ev, uid=F.col("user_id")), on=["uid"], predicates={"time": sw.overlap(pad=600)}, dense=False)
    groups = sw.implode(sw.assign(ev, eid=F.col("event_id")), plan)
    in_order = lambda f: F.array_join(F.transform(F.array_sort(F.transform(f, lambda x: F.struct(x["eid"], x["event_type"]))), lambda x: x["event_type"]), ">")
    said = sw.rename(sw.map_fields(groups, ["matched"], in_order, "said"), {"left_index": "plan_id"})
    both = sw.merge(clips, said, sw.join(clips, said, dense=False))
    return both.df.select(F.col("source_index").alias("user_id"), F.col("slice.time.start").alias("start"), "said")


@query(f"""WITH e AS (SELECT event_id, user_id, event_type, {_AT} AS at FROM events)
SELECT p.event_id AS conversion, arg_max(c.event_id, c.at) AS touch FROM e p JOIN e c ON c.user_id = p.user_id AND c.event_type = 'click' AND c.at < p.at AND c.at + 1e-6 > p.at - 86400 WHERE p.event_type = 'purchase' GROUP BY 1""")
def attribution(t):
    """Purchases with the last click of the same user within a day before: two equality hops, a lookback, the last touch."""
    ev = _events_at(t("events"), 1e-6)
    clicks = sw.where(ev, "event_type = 'click'")
    bought = sw.compose_slice(sw.assign(sw.where(ev, "event_type = 'purchase'"), since=F.col("at") - 86400.0), "span", {"time": ("since", "at")})
    same = sw.dimension_join(bought, clicks, predicate=sw.equals(), left_on="user_id", right_on="user_id", dense=False)
    near = sw.dimension_join(bought, clicks, same, predicate=sw.overlap(), left_on="span", right_on="span", dimension="time", dense=False)
    pairs = sw.merge(sw.keep(bought, ["event_id"]), sw.keep(clicks, ["event_id", "at"]), near)
    return sw.latest(pairs, "left_index", "at").df.select(F.col("left_index").alias("conversion"), F.col("right_index").alias("touch"))


@query("SELECT c_custkey, c_name, string_agg(o_orderstatus, '' ORDER BY o_orderdate, o_orderkey) AS path FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def journeys(t):
    """Each customer's orders in their order, customers without any too."""
    people = t("customer")
    steps = sw.link(sw.assign(sw.keep(t("orders"), ["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus"]), key=F.col("o_orderkey")), people, "o_custkey")
    in_order = lambda f: F.array_join(F.transform(F.array_sort(F.transform(f, lambda x: F.struct(x["o_orderdate"], x["key"], x["o_orderstatus"]))), lambda x: x["o_orderstatus"]), "")
    paths = sw.rename(sw.map_fields(sw.partition(steps, "o_custkey", people), ["fiber"], lambda f: F.when(F.size(f) > 0, in_order(f)), "path"), {"o_custkey": "c_custkey"})
    return sw.concat_columns(sw.keep(people, ["c_custkey", "c_name"]), paths)


@query("SELECT o_custkey, round(max(n) / sum(n), 6) AS top_share FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def top_share(t):
    """Counts per customer and priority, regrouped by customer: the share of the commonest."""
    cells = sw.reset_index(sw.reduce(t("orders"), ["o_custkey", "o_orderpriority"], {"n": Count.on()}), dense=False)
    total = lambda f: F.aggregate(f["n"], F.lit(0).cast("long"), lambda a, x: a + x)
    return sw.map_fields(sw.partition(cells, "o_custkey"), ["fiber"], lambda f: F.round(F.array_max(f["n"]) / total(f), 6), "top_share")


# --- exits, handles, sources, streams


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 7")
def row_by_label(t):
    ds = sw.keep(t("customer"), ["c_custkey", "c_name", "c_nationkey"])
    return ds.df.sparkSession.createDataFrame([ds[7]], ds.df.schema)


@query("SELECT c_custkey, c_name FROM customer")
def column_view(t):
    return t("customer")["c_name"]


@query("SELECT n_nationkey, n_name, lower(n_name) AS quiet FROM nation WHERE n_nationkey IN (0, 2, 4, 24)")
def rows_by_position(t):
    ds = sw.map_fields(sw.keep(t("nation"), ["n_nationkey", "n_name"]), "n_name", F.lower, "quiet", lazy=True)
    return ds.df.sparkSession.createDataFrame([*ds.rows().__getitems__([0, 4, 2]), ds.rows()[-1]], "n_nationkey int, n_name string, quiet string")


@query("SELECT r_regionkey, r_name FROM region")
def rows_streamed(t):
    ds = sw.keep(t("region"), ["r_regionkey", "r_name"])
    return ds.df.sparkSession.createDataFrame(list(ds.rows()), ds.df.schema)


@query("SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 2) THEN 'changed' ELSE n_name END AS n_name, length(CASE WHEN n_nationkey IN (1, 2) THEN 'changed' ELSE n_name END)::INTEGER AS size FROM nation")
def handles(t):
    context = sw.keep(t("nation"), ["n_nationkey", "n_name"]).context()
    context["n_name"].loc[[1, 2]] = "changed"
    size = sw.map_fields(context["n_name"], F.length, "size")
    return size.collect()


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def within_context(t):
    with t("supplier").context() as context:
        sw.where("s_acctbal > 0")
        sw.keep(["s_suppkey", "s_acctbal"])
    return context.dataset


@query("SELECT s_nationkey, sum(s_acctbal)::DOUBLE AS total, count(*) AS n FROM supplier GROUP BY 1")
def reducers_on_handles(t):
    fibers = sw.partition(t("supplier"), "s_nationkey").field("fiber")
    Sum.on("s_acctbal")(fibers, out="total")
    out = Count.on()(fibers, out="n").collect()
    return sw.assign(out, total=F.round("total", 4))


ORACLE_SQL["reducers_on_handles"] = ORACLE_SQL["reducers_on_handles"].replace("sum(s_acctbal)::DOUBLE", "round(sum(s_acctbal)::DOUBLE, 4)")


@query("SELECT r_regionkey, 3 AS n, (9 * r_regionkey)::DOUBLE AS total FROM region")
def read_arrays(t):
    """Arrays by item, read in part on the executors: 2, 3 and 4 times the region's number."""
    from spanweave.sources import arrays

    regions = sw.assign(sw.keep(t("region"), ["r_regionkey"]), a=F.lit(2), b=F.lit(5))
    source = arrays.MemoryArraySource({str(k): np.arange(100, dtype=np.float32) * k for k in range(5)}, (AXIS,))
    cell = F.struct(F.col("r_regionkey").cast("string").alias("item"), F.lit(None).cast("struct<axis: struct<start: int, stop: int>>").alias("slice"))
    ds = sw.compose_slice(sw.assign(regions, data=(DataField("data", dimensions=(AXIS,)), cell)), "part", {"axis": ("a", "b")})
    read = sw.consume(sw.materialize(sw.slice_data(ds, "part", "data"), "data", reader=arrays.reader(source)))
    total = F.udf(lambda c: float(arrays.to_array(c).sum()), "double", useArrow=False)
    return read.df.select("r_regionkey", F.col("data.shape")[0].alias("n"), total("data").alias("total"))


@query("SELECT n_nationkey, n_nationkey AS n FROM nation")
def mock_from_dimensions(t):
    """Random arrays whose lengths are told by the rows."""
    from spanweave.sources import arrays

    ds = sw.assign(sw.keep(t("nation"), ["n_nationkey"]), size=(sw.DimensionField.from_dim("size", AXIS, None), F.col("n_nationkey").cast("double")))
    made, source = arrays.make_mock_dataset_from_dims(ds)
    return sw.consume(sw.materialize(made, "data", reader=arrays.reader(source))).df.select("n_nationkey", F.col("data.shape")[0].alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 500 OFFSET 250")
def dataset_range(t):
    """A range of rows of a stored dataset."""
    from spanweave.sources.datasets import DatasetStore

    ds = sw.keep(t("orders"), ["o_orderkey", "o_totalprice"])
    return DatasetStore(ds.df.sparkSession, _place(t)).put("orders", ds).read(250, 750)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey IN (3, 5, 9)")
def plan_from_series(t):
    import pandas as pd

    ds = sw.assign(sw.keep(t("customer"), ["c_custkey", "c_acctbal"]), who=F.col("c_custkey"))
    return sw.explode(ds, sw.make_plan.from_series(ds, pd.Series([9, 3, 5]))).df.select(F.col("who").alias("c_custkey"), "c_acctbal")


def _streamed(t, name: str, made, mode: str) -> DataFrame:
    """What a query over the stream of a table's files wrote when all of them were read."""
    ds, place = t(name), _place(t)
    spark = ds.df.sparkSession
    stream = spark.readStream.schema(ds.df.schema).parquet(f"{ds.sources[0].source_uri[:-1]}?")  # a pattern may also name a single file
    out = made(stream)
    write = lambda df, n: df.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/rows")
    out.writeStream.outputMode(mode).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).foreachBatch(write).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/rows")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(t):
    from spanweave import streaming

    hours = lambda s: streaming.windowed(s, "ts", AxisWindow(3600), {"n": Count.on()}, by=["event_type"])
    return _streamed(t, "events", hours, "complete").select("start", "event_type", "n")


@query("SELECT event_id, upper(event_type) AS loud FROM events WHERE event_type <> 'view'")
def stream_stateless(t):
    def rows(s):
        ds = sw.where(Dataset(s, Schema((IndexField("event_id"), ValueField("event_type")))), "event_type <> 'view'")
        return sw.map_fields(ds, "event_type", F.upper, "loud").df.select("event_id", "loud")

    return _streamed(t, "events", rows, "append")


@query("SELECT DISTINCT user_id FROM events")
def stream_first_seen(t):
    from spanweave import streaming

    return _streamed(t, "events", lambda s: streaming.first_seen(s, ["user_id"], "ts", late="400 days").select("user_id"), "append")
