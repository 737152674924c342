"""Operators on small hand-written tables, with exact results and the errors that must come."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

import spanweave as sw
from spanweave import AxisWindow, ColumnCollision, Count, DimensionJoin, Distinct, IndexField, Max, Mean, Min, Schema, Sum, ValueField
from spanweave.dimensions import CategoricalDimension, IndexDimension, TemporalDimension
from spanweave.schema import DimensionedSliceField, DimensionField


def ds(spark, rows, types, index="id", fields=None):
    df = spark.createDataFrame(rows, types)
    rest = [ValueField(c) for c in df.columns if c != index]
    return sw.make_from_dataframe(df, Schema((IndexField(index), *(fields or rest))))


def got(x, *cols):
    df = x.df if isinstance(x, sw.Dataset) else x
    return sorted((tuple(r) for r in df.select(*cols or df.columns).collect()), key=repr)


@pytest.fixture
def halves(spark):
    return ds(spark, [("a", 1), ("b", 2), ("c", 3)], "id string, score long"), ds(spark, [("b", 10), ("c", 20), ("d", 30)], "id string, label long")


def test_index_joins(halves):
    l, r = halves
    assert got(sw.join(l, r)) == [(0, "b", "b"), (1, "c", "c")]
    assert got(sw.join(l, r, how="left"), "left_index", "right_index") == [("a", None), ("b", "b"), ("c", "c")]
    assert got(sw.join(l, r, how="right"), "left_index", "right_index") == [("b", "b"), ("c", "c"), (None, "d")]
    assert len(got(sw.join(l, r, how="outer"))) == 4
    assert sw.join(l, r).schema.names() == ("join_id", "left_index", "right_index")
    with pytest.raises(ValueError):
        sw.join(l, r, how="cross")
    with pytest.raises(ValueError):
        sw.join(l, r, on="score", strategy=sw.IndexJoin())


def test_field_joins_match_null_keys(spark):
    l = ds(spark, [("l1", 1), ("l2", 2), ("l3", 2), ("l4", None)], "id string, group long")
    r = ds(spark, [("r1", 2), ("r2", 2), ("r3", None)], "id string, group long")
    assert got(sw.join(l, r, on="group"), "left_index", "right_index") == [("l2", "r1"), ("l2", "r2"), ("l3", "r1"), ("l3", "r2"), ("l4", "r3")]
    with pytest.raises(ValueError):
        sw.join(l, r, on="id")


def keyed_sides(spark):
    l = [(i, None if i % 3 == 0 else i % 7) for i in range(60, 0, -1)]
    r = [(f"r{i:02}", None if i % 4 == 0 else i % 9) for i in range(40)]
    return l, r, ds(spark, l, "id long, k long"), ds(spark, r, "id string, k long")


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
@pytest.mark.parametrize("twice", [False, True])
def test_field_joins_number_pairs_in_label_order(spark, how, twice, monkeypatch):
    from spanweave.operators import joins

    monkeypatch.setattr(joins, "PIECE", 3)
    l, r, a, b = keyed_sides(spark)
    if twice:  # pairs of a label that repeats interleave
        l = l + [(7, 2), (7, None)]
        a = a.with_(spark.createDataFrame(l, "id long, k long"))
    pairs = [(x, y) for x, k in l for y, m in r if k == m]
    pairs += [(x, None) for x, k in l if k not in [m for _, m in r]] if how in ("left", "outer") else []
    pairs += [(None, y) for y, m in r if m not in [k for _, k in l]] if how in ("right", "outer") else []
    pairs.sort(key=lambda p: tuple((v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in p))
    found = sorted(tuple(x) for x in sw.join(a, b, on="k", how=how).df.collect())
    assert found == [(i, *p) for i, p in enumerate(pairs)]


def test_field_joins_sort_no_pairs(spark, monkeypatch):
    """The pairs of a hot key were sorted and written to be numbered."""
    from spanweave.operators import joins

    _, _, a, b = keyed_sides(spark)
    sorted_ = []
    monkeypatch.setattr(joins, "with_row_id", lambda df, *more: sorted_.append(df))
    assert sw.join(a, b, on="k").df.count() > 100 and not sorted_


@pytest.mark.parametrize("how", ["left", "outer", "right"])
def test_field_joins_take_pairs_from_arrays(spark, how):
    """Each pair was a row of a join, and one task sent all right rows to their squares."""
    l, r, a, b = keyed_sides(spark)
    plan = plan_of(sw.join(a, b, on="k", how=how).df)
    assert "posexplode" in plan and plan.count("REPARTITION_BY_NUM") == 3
    none = [x.with_(x.df.where("false")) for x in (a, b)]
    assert sw.join(*none, on="k", how=how).df.count() == 0
    assert sw.join(a, none[1], on="k", how=how).df.count() == (0 if how == "right" else len(l))


@pytest.mark.parametrize("how", ["outer", "right"])
def test_field_joins_number_no_lone_rows_where_there_are_none(spark, monkeypatch, how):
    """Lone right rows were sorted, counted and numbered, in jobs of their own, where each key is on both sides."""
    from spanweave.operators import joins

    numbered = []
    monkeypatch.setattr(joins, "with_row_id", lambda df, *more: numbered.append(df))
    a, b = ds(spark, [(1, "x"), (2, "y"), (3, None)], "id long, k string"), ds(spark, [(7, "y"), (8, None), (9, "x"), (10, "x")], "id long, k string")
    plan = sw.join(a, b, on="k", how=how)
    assert got(plan, "join_id", "left_index", "right_index") == [(0, 1, 9), (1, 1, 10), (2, 2, 7), (3, 3, 8)]
    assert not numbered and "Union" not in plan_of(plan.df)


def boxes(spark, rows):
    y, x = IndexDimension("y"), IndexDimension("x")
    df = spark.createDataFrame(rows, "id string, image string, box struct<y: struct<start: long, stop: long>, x: struct<start: long, stop: long>>")
    return sw.make_from_dataframe(df, Schema((IndexField("id"), ValueField("image"), DimensionedSliceField("box", dimensions=(y, x)))))


def test_dimension_joins(spark):
    l = boxes(spark, [("l1", "a", ((0, 10), (0, 10))), ("l2", "b", ((10, 20), (0, 10)))])
    r = boxes(spark, [("r1", "b", ((5, 15), (2, 4))), ("r2", "b", ((20, 25), (0, 5)))])
    assert got(sw.join(l, r, strategy=DimensionJoin("box", "box", ["y", "x"])), "left_index", "right_index") == [("l1", "r1"), ("l2", "r1")]
    assert got(sw.join(l, r, strategy=DimensionJoin("box", "box", ["y", "x"], on="image")), "left_index", "right_index") == [("l2", "r1")]
    assert got(sw.join(l, r, strategy=DimensionJoin("box", "box", ["y"], on="image", how="left")), "left_index", "right_index") == [("l1", None), ("l2", "r1")]
    assert got(sw.join(l, r, strategy=DimensionJoin("box", "box", ["y"], how="outer")), "left_index", "right_index") == [("l1", "r1"), ("l2", "r1"), (None, "r2")]
    with pytest.raises(ValueError):
        sw.join(l, boxes(spark, [("r", "b", None)]), strategy=DimensionJoin("box", "box", ["y"]))


def spans(spark, rows):
    t = TemporalDimension("t")
    base = ds(spark, rows, "id string, clip string, a double, b double", fields=[ValueField("clip"), DimensionField("a", dimension=t), DimensionField("b", dimension=t)])
    return sw.compose_slice(base, "span", {"t": ("a", "b")})


W = [("w0", "a", 0.0, 2.0), ("w1", "a", 1.0, 3.0), ("w2", "b", 0.0, 2.0)]
SEG = [("s0", "a", 0.5, 1.2), ("s1", "a", 2.5, 2.8), ("s2", "b", 0.1, 0.4)]


def test_match_and_chain(spark):
    w, s = spans(spark, W), spans(spark, SEG)
    both = [("w0", "s0"), ("w1", "s0"), ("w1", "s1"), ("w2", "s2")]
    assert len(got(sw.match(w, s, on=["clip"]))) == 5
    assert len(got(sw.match(w, s, predicates={"t": sw.overlap()}))) == 6
    assert got(sw.match(w, s, on=["clip"], predicates={"t": sw.overlap()}), "left_index", "right_index") == both
    first = sw.dimension_join(w, s, predicate=sw.equals(), left_on="clip", right_on="clip")
    assert got(sw.dimension_join(w, s, first, predicate=sw.overlap(), left_on="span", right_on=("a", "b"), dimension="t"), "left_index", "right_index") == both
    with pytest.raises(ValueError):
        sw.match(w, s)
    with pytest.raises(ValueError):
        sw.dimension_join(s, w, first, predicate=sw.overlap(), left_on="span", right_on="span", dimension="t")


def test_chain_over_a_whole_plan_is_one_join(spark, tmp_path):
    """The pairs of the first predicate were joined with both sides again, all of them."""
    w, s = spans(spark, W), spans(spark, SEG)
    first = sw.dimension_join(w, s, predicate=sw.equals(), left_on="clip", right_on="clip", dense=False)
    chain = lambda among: sw.dimension_join(w, s, among, predicate=sw.overlap(), left_on="span", right_on="span", dimension="t", dense=False)
    assert got(chain(first), "left_index", "right_index") == [("w0", "s0"), ("w1", "s0"), ("w1", "s1"), ("w2", "s2")]
    assert plan_of(chain(first).df).count("Join ") == 1
    fewer = first.with_(first.df.where("left_index <> 'w1'"))
    assert got(chain(fewer), "left_index", "right_index") == [("w0", "s0"), ("w2", "s2")]
    late = sw.dimension_join(w, s, chain(first), predicate=sw.equals(), left_on="a", right_on="b", dense=False)
    assert got(late, "left_index", "right_index") == []
    sw.save(first, str(tmp_path / "plan"))
    assert len(got(sw.load(spark, str(tmp_path / "plan")))) == 5


def test_overlap_pad(spark):
    w, s = spans(spark, [("w", "a", 0.0, 2.0)]), spans(spark, [("s", "a", 2.1, 2.4)])
    for pad, n in ((0, 0), (0.25, 1)):
        assert len(got(sw.match(w, s, predicates={"t": sw.overlap(pad)}))) == n


@pytest.mark.parametrize("pad", [0, 0.25, 7])
def test_range_join_is_the_theta_join(spark, pad):
    import random

    r = random.Random(3)
    make = lambda n, p: [(f"{p}{i}", "a", s := r.uniform(-50, 50), s + r.choice([0.1, 1, 5, 60])) for i in range(n)]
    a, b = make(80, "l"), make(70, "r")
    found = got(sw.match(spans(spark, a), spans(spark, b), predicates={"t": sw.overlap(pad)}), "left_index", "right_index")
    assert found == sorted(((x[0], y[0]) for x in a for y in b if y[2] < x[3] + pad and y[3] > x[2] - pad), key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["dimension_join_2d", "dimension_join_unscoped", "labelled_tiles", "dimension_join_scoped", "dimension_join_outer", "dimension_join_left", "dimension_join_overlap_pad"])
def test_range_join_broadcasts_no_side(spark, name):
    """Spark takes a side for as large as its rows before they are dealt to cells, so it broadcast the dealt ones."""
    from spanweave.queries import QUERIES

    with sw.validation(False):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin [_" not in plan


@pytest.mark.parametrize("how", ["inner", "outer"])
@pytest.mark.parametrize("piece", [1, 3, 256])
def test_unscoped_range_join_takes_pairs_from_arrays(spark, monkeypatch, how, piece):
    """Each candidate pair was a row of the join, so that the whole of the pairs went through it one by one."""
    import random

    from spanweave.plans import predicates

    monkeypatch.setattr(predicates, "PIECE", piece)
    r = random.Random(5)
    make = lambda n, p: [(f"{p}{i}", "a", s := r.choice([0.0, 3.5, r.uniform(-20, 20)]), s + r.choice([0.1, 1, 5, 60])) for i in range(n)]
    a, b = make(50, "l"), [*make(60, "r"), ("far", "a", 900.0, 901.0)]
    plan = sw.join(spans(spark, a), spans(spark, b), strategy=DimensionJoin("span", "span", ["t"], how=how), dense=False)
    assert "posexplode" in plan_of(plan.df)
    pairs = [(x[0], y[0]) for x in a for y in b if y[2] < x[3] and y[3] > x[2]]
    lone = [(x[0], None) for x in a if x[0] not in {p for p, _ in pairs}] + [(None, y[0]) for y in b if y[0] not in {q for _, q in pairs}]
    assert got(plan, "left_index", "right_index") == sorted(pairs + (lone if how == "outer" else []), key=repr)


@pytest.mark.parametrize("pad", [0, 0.5])
def test_unscoped_range_join_compares_only_in_arrays_met_in_part(spark, monkeypatch, pad):
    """Each element of an array was compared, also where the array's ends tell that a left row overlaps all of it."""
    from spanweave.plans import predicates

    monkeypatch.setattr(predicates, "PIECE", 3)
    a = [(f"l{i}", "a", float(i), i + n) for i in range(12) for n in (1.0, 40.0)][::-1]
    b = [(f"r{i}", "a", i / 2, i / 2 + 0.5) for i in range(40)] + [("r_long", "a", -30.0, 30.0)]
    a = [(f"{x[0]}_{i}", *x[1:]) for i, x in enumerate(a)]
    plan = sw.match(spans(spark, a), spans(spark, b), predicates={"t": sw.overlap(pad)}, dense=False)
    assert "_sure" in plan_of(plan.df)
    assert got(plan, "left_index", "right_index") == sorted((x[0], y[0]) for x in a for y in b if y[2] < x[3] + pad and y[3] > x[2] - pad)


@pytest.mark.parametrize("name", ["dimension_join_unscoped", "dimension_join_left"])
def test_range_join_filters_on_no_level(spark, name):
    """A filter on the level, which is never null, had Spark compute the interval some thirty times a row."""
    from spanweave.queries import QUERIES

    with sw.validation(False):
        plan = plan_of(QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "LOG(" in plan and not [line for line in plan.splitlines() if "Filter" in line and "LOG(" in line]


def test_rows_without_an_interval_meet_nothing(spark):
    gone = spans(spark, W[:2] + [("w9", "a", None, None)])
    with sw.validation(False):
        plan = sw.join(gone, spans(spark, SEG), strategy=DimensionJoin("span", "span", ["t"], how="left"), dense=False)
        assert [x for x in got(plan, "left_index", "right_index") if x[0] == "w9"] == [("w9", None)]


def test_unscoped_range_join_keeps_its_tasks(spark):
    """Spark made the tasks fewer by the sides' bytes, which tell nothing of the pairs."""
    from spanweave.queries import QUERIES

    with sw.validation(False):
        plan = plan_of(QUERIES["dimension_join_overlap_pad"](spark, "/root/testdata/sf0.001"))
    assert plan.count("REPARTITION_BY_NUM") == 2


@pytest.mark.parametrize("name", ["dimension_join_outer", "dimension_join_left"])
def test_lone_rows_of_range_joins_shuffle_no_pairs(spark, name):
    """All pairs were shuffled and sorted by each label whose lone rows were wanted."""
    from spanweave.queries import QUERIES

    with sw.validation(False):
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        plan = plan_of(df)
        df.collect()
    assert "Window" not in plan and "LeftAnti" in plan and "partial_count" in plan
    assert df._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= (4 if name == "dimension_join_outer" else 2)  # the sides in their cells


def test_explode_broadcasts_no_source(spark):
    """Spark judged a source by its packed file, and sent millions of its rows through the driver."""
    from spanweave.queries import QUERIES

    with sw.validation(False):
        plan = plan_of(QUERIES["labelled_tiles"](spark, "/root/testdata/sf0.001"))
    assert "_si" in plan and "BroadcastHashJoin" not in plan


def test_merge(spark, halves):
    l, r = halves
    out = sw.merge(l, r, sw.join(l, r, how="outer"))
    assert got(out, "left_index", "right_index", "score", "label") == [("a", None, 1, None), ("b", "b", 2, 10), ("c", "c", 3, 20), (None, "d", None, 30)]
    with pytest.raises(ValueError):
        sw.merge(r, l, sw.join(l, r))
    plan = sw.join(l, r)
    lost = plan.with_(plan.df.withColumn("left_index", F.lit("zz")))
    with pytest.raises(Exception, match="no row"):
        sw.merge(l, r, lost).df.collect()


def test_merge_collisions(spark):
    l, r = ds(spark, [("a", 10), ("b", None)], "id string, v long"), ds(spark, [("a", 99), ("b", 20)], "id string, v long")
    plan = sw.join(l, r)
    with pytest.raises(ValueError):
        sw.merge(l, r, plan)
    with pytest.raises(ValueError):
        sw.merge(l, r, plan, collision=ColumnCollision("rename"))
    assert got(sw.merge(l, r, plan, collision=ColumnCollision("update_missing")), "v") == [(10,), (20,)]
    assert got(sw.merge(l, r, plan, collision=ColumnCollision("keep", "right")), "v") == [(20,), (99,)]
    with pytest.raises(Exception, match="differs"):
        sw.merge(l, r, plan, collision=ColumnCollision("coalesce", on_conflict="raise")).df.collect()


def test_concat_rows(spark):
    a, b = ds(spark, [("a", 1)], "id string, score long"), ds(spark, [("b", 2.5)], "id string, score double")
    assert got(sw.concat_rows(a, b), "score") == [(1.0,), (2.5,)]
    c = ds(spark, [("c", "x")], "id string, label string")
    assert got(sw.concat(a, c), "id", "score", "label") == [("a", 1, None), ("c", None, "x")]
    with pytest.raises(ValueError):
        sw.concat_rows(a, a)


def test_concat_columns(spark):
    base = ds(spark, [("i", 1, 2), ("j", 3, 4)], "id string, a long, b long")
    assert got(sw.concat_columns(sw.keep(base, ["id", "a"]), sw.keep(base, ["id", "b"]))) == [("i", 1, 2), ("j", 3, 4)]
    other = ds(spark, [("i", 5), ("k", 6)], "id string, z long")
    with pytest.raises(ValueError):
        sw.concat_columns(base, other)
    assert got(sw.concat_columns(base, sw.rename(other, {"id": "right_id"}))) == [("i", 1, 2, "i", 5), ("j", 3, 4, None, None), ("k", None, None, "k", 6)]


def test_explode(spark):
    src = ds(spark, [("a", 1, "left"), ("b", 2, "right")], "id string, value long, label string")
    plan = sw.make_plan(src, spark.createDataFrame([("a", 10), ("a", 20), ("b", 30)], "source_index string, value long"))
    assert got(sw.explode(src, plan), "value", "label") == [(10, "left"), (20, "left"), (30, "right")]
    with pytest.raises(ValueError):
        sw.make_plan(src, ["a", "zz"])
    with pytest.raises(ValueError):
        sw.explode(src, plan, overlay_fields=[])
    bad = plan.with_(plan.df.withColumn("source_index", F.lit(None).cast("string")))
    with pytest.raises(Exception, match="no row"):
        sw.explode(src, bad).df.collect()


def test_windows(spark):
    src = ds(spark, [("a", 0, 40, 0, 30), ("b", 10, 50, 0, 10)], "id string, x0 long, x1 long, y0 long, y1 long")
    plan = sw.window_expansion_plan(src, windows={"x": AxisWindow(20), "y": AxisWindow(10)}, bindings={"x": ("x0", "x1"), "y": ("y0", "y1")})
    rows = plan.df.orderBy("plan_id").collect()
    cut = [(r.source_index, r.slice.x.start, r.slice.x.stop, r.slice.y.start, r.slice.y.stop) for r in rows]
    assert len(cut) == 8 and [r.plan_id for r in rows] == list(range(8))
    assert cut[0] == ("a", 0, 20, 0, 10) and cut[1] == ("a", 0, 20, 10, 20) and cut[-1] == ("b", 30, 50, 0, 10)


def test_partial_windows(spark):
    t = IndexDimension("t")
    df = spark.createDataFrame([("a", ((0, 5),)), ("b", None), ("c", ((10, 14),))], "id string, extent struct<t: struct<start: long, stop: long>>")
    src = sw.make_from_dataframe(df, Schema((IndexField("id"), DimensionedSliceField("extent", dimensions=(t,)))))
    plan = sw.window_expansion_plan(src, windows={"t": AxisWindow(2, include_partial=True)}, field="extent")
    assert got(plan, "source_index", "slice.t.start", "slice.t.stop") == [("a", 0, 2), ("a", 2, 4), ("a", 4, 5), ("c", 10, 12), ("c", 12, 14)]
    six = spark.createDataFrame([(0, 10)], "a long, b long").select(F.explode(AxisWindow(6, 2, include_partial=True).windows(F.col("a"), F.col("b"))).alias("w")).select("w.*")
    assert got(six) == [(0, 6), (2, 8), (4, 10), (6, 10)]
    with pytest.raises(ValueError):
        AxisWindow(0)


@pytest.fixture
def clips(spark):
    clips = ds(spark, [("a", 1.0), ("b", 2.0), ("c", 3.0), ("d", 4.0)], "clip_id string, duration double", "clip_id")
    segs = ds(spark, [("s0", "b", "x"), ("s1", "a", "y"), ("s2", "b", "z"), ("s3", "c", "w")], "seg_id string, clip string, text string", "seg_id")
    return clips, segs


def test_partition(clips):
    clips, segs = clips
    groups = sw.partition(segs, "clip")
    nested = {r.clip: [m.seg_id for m in r.fiber] for r in groups.nested().collect()}
    assert nested == {"a": ["s1"], "b": ["s0", "s2"], "c": ["s3"]}
    with pytest.raises(ValueError):
        sw.partition(segs, "clip", clips)
    total = sw.partition(sw.link(segs, clips, "clip"), "clip", clips)
    assert total["d"]["fiber"] == [] and [m["seg_id"] for m in total["b"]["fiber"]] == ["s0", "s2"]
    assert got(sw.flatten(total), "seg_id") == [("s0",), ("s1",), ("s2",), ("s3",)]
    with pytest.raises(ValueError):
        sw.link(sw.assign(segs, clip=F.lit("nowhere")), clips, "clip")
    with pytest.raises(NotImplementedError):
        sw.partition(segs, "clip", null_keys="group")
    with pytest.raises(ValueError):
        sw.partition(segs, "seg_id")


def test_reduce(spark, clips):
    members = ds(spark, [("r0", "a", 1.0, "x"), ("r1", "a", 2.0, "x"), ("r2", "b", 5.0, "y")], "id string, k string, v double, u string")
    aggs = {"t": Sum.on("v"), "n": Count.on(), "u": Distinct.on("u"), "m": Mean.on("v"), "lo": Min.on("v"), "hi": Max.on("v")}
    assert got(sw.reduce(members, "k", aggs)) == [("a", 3.0, 2, 1, 1.5, 1.0, 2.0), ("b", 5.0, 1, 1, 5.0, 5.0, 5.0)]
    keys = ds(spark, [("a",), ("b",), ("c",)], "key string", "key")
    total = sw.reduce(sw.link(members, keys, "k"), "k", aggs, keys)
    assert got(total)[-1] == ("c", 0.0, 0, 0, None, None, None)
    nulls = ds(spark, [("r0", "a", None)], "id string, k string, v double")
    assert got(sw.reduce(nulls, "k", {"t": Sum.on("v"), "m": Mean.on("v")})) == [("a", 0.0, None)]
    from spanweave import Custom

    spread = sw.reduce(members, "k", {"s": Custom(column="v", fn=lambda v: float(v.max() - v.min()))})
    assert got(spread) == [("a", 1.0), ("b", 0.0)]


def test_composite_keys(spark):
    rows = [("i0", "cr0", "s1", 1.0), ("i1", "cr0", "s2", 2.0), ("i2", "cr1", "s1", 3.0), ("i3", "cr1", "s1", 4.0), ("i4", "cr1", "s2", 5.0)]
    imp = ds(spark, rows, "id string, creative string, segment string, conv double")
    cells = sw.reduce(imp, ["creative", "segment"], {"conv": Sum.on("conv"), "n": Count.on()})
    assert len(got(cells)) == 4 and ("cr1", "s1", 7.0, 2) in got(cells)
    back = sw.reset_index(cells)
    assert got(sw.reduce(back, "creative", {"conv": Sum.on("conv")})) == [("cr0", 3.0), ("cr1", 12.0)]
    assert len(got(sw.reduce(sw.assign(imp, segment=F.when(F.col("segment") != "s2", F.col("segment"))), ["creative", "segment"], {"n": Count.on()}, null_keys="drop"))) == 2


def test_implode(spark):
    w = spans(spark, [*W, ("w3", "a", 10.0, 12.0)])
    s = spans(spark, [("s0", "a", 0.5, 2.5), ("s1", "b", 0.1, 0.4)])
    plan = sw.match(w, s, on=["clip"], predicates={"t": sw.overlap()})
    groups = sw.implode(s, plan, w)
    found = {r.left_index: len(r.matched) for r in groups.nested().collect()}
    assert found == {"w0": 1, "w1": 1, "w2": 1, "w3": 0}


def test_columns(spark):
    base = ds(spark, [("a", 1, None), ("b", 2, 5)], "id string, x long, y long")
    assert got(sw.where(base, "y > 1"), "id") == [("b",)]
    assert sw.keep(base, ["y", "x"]).df.columns == ["id", "x", "y"]
    with pytest.raises(ValueError):
        sw.keep(base, ["nope"])
    assert got(sw.rename(base, {"id": "key", "x": "z"}), "key", "z") == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        sw.rename(base, {"x": "y"})
    with pytest.raises(ValueError):
        sw.add_column(base, ValueField("x"), 1)
    typed = sw.assign(base, w=(ValueField("w", dtype=float), F.col("x") * 2))
    assert got(typed, "w") == [(2.0,), (4.0,)]
    assert got(sw.assign(base, z=sw.keep(typed, ["id", "w"])), "z") == [(2.0,), (4.0,)]
    promoted = sw.set_index(base, "x")
    assert promoted.index_names == ("x",) and promoted.schema.has("id")
    with pytest.raises(ValueError):
        sw.set_index(sw.assign(base, c=F.lit(1)), "c")
    assert got(sw.reset_index(base), "index", "id") == [(0, "a"), (1, "b")]
    assert base["b"] == {"id": "b", "x": 2, "y": 5}
    with pytest.raises(KeyError):
        base["zz"]


def test_pending_columns(spark):
    base = ds(spark, [("a", 1), ("b", 2)], "id string, x long")
    late = sw.map_fields(sw.map_fields(base, "x", lambda x: x + 1, "y", lazy=True), "x", lambda v: v * 10, "z", dtype=int, lazy=True)
    assert "y" not in late.df.columns and late["a"] == {"id": "a", "x": 1, "y": 2, "z": 10}
    one = sw.consume(late, "y")
    assert "y" in one.df.columns and [c.output for c in one.couplings] == ["z"]
    with pytest.warns(UserWarning):
        assert not sw.drop(late, "x").couplings
    assert [r["z"] for r in sorted(late.rows(), key=lambda r: r["id"])] == [10, 20]
    with pytest.raises(ValueError):
        sw.map_fields(base, "x", lambda x: x, "x")


def test_pipe(spark):
    base = ds(spark, [("a", 1), ("b", 2)], "id string, x long")
    assert got(sw.pipe(base, lambda d: d.df.where("x > 1"))) == [("b", 2)]
    with pytest.raises(ValueError):
        sw.pipe(base, lambda d: d.df.withColumn("id", F.concat("id", F.lit("!"))))

    @sw.table_transform(schema=Schema((IndexField("x"),)))
    def only_x(d):
        return d.df.select("x")

    assert got(only_x(base)) == [(1,), (2,)]


def test_handles_follow_renames(spark):
    base = ds(spark, [("a", 1)], "id string, x long")
    ctx = base.context()
    handle = ctx["x"]
    ctx.dataset = sw.rename(ctx.dataset, {"x": "renamed"})
    assert handle.name == "renamed"
    ctx["more"] = F.col("renamed") + 1
    assert ctx.dataset["a"] == {"id": "a", "renamed": 1, "more": 2}
    ctx.dataset = sw.drop(ctx.dataset, "renamed")
    with pytest.raises(ValueError):
        handle.name


def test_bundles(spark, halves):
    l, r = halves
    lazy = sw.bundle(left=l, right=r).defer("plan", sw.join, "left", "right").defer("both", sw.merge, "left", "right", "plan")
    assert got(sw.extract(lazy, "both")) == got(sw.merge(l, r, sw.join(l, r)))
    with pytest.raises(ValueError):
        sw.extract(lazy)
    assert len(got(sw.flatten(list(sw.bundle(l, sw.rename(sw.where(r, "id = 'd'"), {"label": "score"})).cells.values())))) == 4


def test_ntsc_and_categories(spark):
    one = spark.range(1)
    a, b = TemporalDimension("t", 30000 / 1001).to_index(F.lit(0.0), F.lit(2.0))
    assert got(one.select(a.alias("a"), b.alias("b"))) == [(0, 59)]
    c = CategoricalDimension("c", ("x", "y"))
    assert got(one.select(c.position(F.lit("y")).alias("p"))) == [(1,)]
    with pytest.raises(Exception, match="unknown category"):
        one.select(c.position(F.lit("z"))).collect()


def test_array_sources(spark):
    import numpy as np

    from spanweave.sources.arrays import MemoryArraySource, assert_source_contract, make_mock_dataset, reader, to_array

    dims = (IndexDimension("y"), IndexDimension("x"))
    source = MemoryArraySource({"i": np.arange(20).reshape(4, 5)}, dims)
    assert_source_contract(source, "i")
    assert source.read("i", {"y": {"start": 1, "stop": 3}, "x": {"start": 2, "stop": 5}}).tolist() == [[7, 8, 9], [12, 13, 14]]
    items, mock = make_mock_dataset(spark, ["p", "q"], dims, {"y": 4, "x": 6})
    cut = sw.compose_slice(sw.assign(items, a=F.lit(1.0), b=F.lit(3.0)), "part", {"y": ("a", "b")})
    cut = sw.slice_data(cut.with_(cut.df.withColumn("part", F.struct(F.col("part.y").alias("y"), F.lit(None).cast("struct<start:double,stop:double>").alias("x")))), "part", "data")
    cell = sw.consume(sw.materialize(cut, "data", reader=reader(mock))).df.orderBy("item_id").first().data
    assert np.array_equal(to_array(cell), mock.read_full("p")[1:3])


def test_offload_and_save(spark, tmp_path):
    events = ds(spark, [(f"r{i}", i) for i in range(6)], "id string, x long")
    chunks = sw.offload(events, path=str(tmp_path / "chunks"), chunk_size=2)
    assert got(chunks.base, "chunk", "start", "stop") == [(0, 0, 2), (1, 2, 4), (2, 4, 6)]
    assert got(chunks.extract(1), "id") == [("r2",), ("r3",)]
    assert got(chunks.flatten(), "id", "x") == got(events)
    empty = sw.offload(sw.where(events, "x > 99"), path=str(tmp_path / "none"), chunk_size=2)
    assert got(empty.base) == [(0, 0, 0)]
    sw.save(events, str(tmp_path / "saved"))
    back = sw.load(spark, str(tmp_path / "saved"))
    assert back.identity == events.identity and got(back) == got(events)


def test_streaming(spark, tmp_path):
    from spanweave.streaming import windowed

    spark.createDataFrame([(i, f"2024-01-01 00:00:{i:02d}") for i in range(20)], "x long, t string").selectExpr("x", "cast(t as timestamp) as t").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x long, t timestamp").parquet(str(tmp_path / "in"))
    out = windowed(stream, "t", AxisWindow(10), {"n": Count.on(), "s": Sum.on("x")})
    q = out.writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert got(spark.table("windowed"), "n", "s") == [(10, 145.0), (10, 45.0)]


def test_pandas_frames(spark):
    pdf = pd.DataFrame({"score": [1, 2]}, index=pd.Index(["a", "b"]))
    out = sw.make_from_dataframe(pdf, Schema((IndexField("item"), ValueField("score", dtype=int))), spark=spark)
    assert got(out) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        sw.make_from_dataframe(pd.DataFrame({"score": [1, 2]}, index=["a", "a"]), Schema((IndexField("item"), ValueField("score"))), spark=spark)
    with pytest.raises(TypeError):
        sw.make_from_dataframe(pdf, Schema((IndexField("item"), ValueField("score", dtype=str))), spark=spark)
