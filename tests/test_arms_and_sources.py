"""Pending columns over composition, handles, row sequences, sources, storage, predicates; with and without validation."""

import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tests.test_datasets import ds, got

import spanweave as sw
from spanweave import AxisWindow, CategoricalDimension, Count, Custom, Max, Sum
from spanweave.dimensions import IndexDimension, TemporalDimension
from spanweave.plans.predicates import MatchPredicate, range_join
from spanweave.schema import DataField, DimensionedSliceField, DimensionField, Field, ForeignIndexField, IndexField, Schema, ValueField
from spanweave.sources import arrays
from spanweave.sources.datasets import DatasetStore, assert_dataset_source_contract
from spanweave.sources.tables import CreationOperator


def double(x):
    return x * 2


def add_one(x):
    return x + 1


@pytest.fixture(params=[True, False], ids=["validated", "unvalidated"])
def mode(request):
    with sw.validation(request.param):
        yield request.param


@pytest.fixture
def base(spark):
    return ds(spark, [("a", 1, "x"), ("b", 2, "y"), ("c", None, "x")], "id string, v long, k string")


def test_concat_rows_compares_pending_columns(spark, base):
    later = lambda d, fn: sw.map_fields(d, "v", fn, "w", lazy=True)
    a, b = sw.where(base, "id = 'a'"), sw.where(base, "id <> 'a'")
    both = sw.concat_rows(later(a, add_one), later(b, add_one))
    assert sorted(got(sw.consume(both), "id", "w"), key=str) == [("a", 2), ("b", 3), ("c", None)]
    with pytest.raises(ValueError, match="differ"):
        sw.concat_rows(later(a, add_one), later(b, double))
    with pytest.raises(ValueError, match="differ"):
        sw.concat_rows(later(a, add_one), b)


def test_merge_carries_pending_columns(spark, base):
    r = ds(spark, [("a", 5), ("b", 6)], "id string, u long")
    plan = sw.join(base, r)
    left, right = sw.map_fields(base, "v", add_one, "w", lazy=True), sw.map_fields(r, "u", double, "z", lazy=True)
    assert got(sw.consume(sw.merge(left, right, plan)), "left_index", "w", "z") == [("a", 2, 10), ("b", 3, 12)]
    with pytest.raises(ValueError, match="both sides"):
        sw.merge(left, sw.map_fields(r, "u", double, "w", lazy=True), plan)
    kept = sw.merge(left, sw.map_fields(r, "u", double, "w", lazy=True), plan, collision=sw.ColumnCollision("keep", side="right"))
    assert got(sw.consume(kept), "left_index", "w") == [("a", 10), ("b", 12)]
    with pytest.warns(UserWarning, match="without their inputs"):
        sw.merge(sw.map_fields(base, "id", F.upper, "w", lazy=True), r, plan)


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_merge_of_an_unfiltered_plan_is_the_join_itself(spark, how):
    l = ds(spark, [("a", 1, 5), ("b", None, 6), ("c", 3, 7)], "id string, k long, v long")
    r = ds(spark, [("x", 1, 8), ("y", None, 9), ("z", 4, 10)], "id string, k long, u long")
    plan = sw.join(l, r, on="k", how=how, dense=False)
    kept = sw.ColumnCollision("coalesce")
    fused, plain = sw.merge(l, r, plan, collision=kept), sw.merge(l, r, sw.where(plan, F.lit(True)), collision=kept)
    columns = ("join_id", "left_index", "right_index", "k", "v", "u")
    assert sorted(got(fused, *columns), key=str) == sorted(got(plain, *columns), key=str) and fused.schema.names() == plain.schema.names()
    joins = lambda d: d.df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(fused) == 1 and joins(plain) == 3
    index = sw.join(l, sw.rename(r, {"k": "q"}), how=how, dense=False)
    assert len(sw.merge(l, sw.rename(r, {"k": "q"}), index)) == len(index)


def test_pending_columns_written_in_place_after_a_reader(spark, base):
    one = sw.map_fields(base, "v", add_one, "w", lazy=True)
    from spanweave import Coupling

    with pytest.raises(ValueError, match="written in place"):
        one.with_(couplings=(*one.couplings, Coupling(("v",), "v", lambda c: c["v"] * 2))).consumed()


def test_calls_are_recorded_and_replayed(spark, base):
    late = sw.map_fields(base, "v", add_one, "w", lazy=True)
    call = late.couplings[0].call
    assert call.storable and late.couplings[0].kind == "map"
    assert got(sw.consume(call.replay(base)), "id", "w") == got(sw.consume(late), "id", "w")
    with pytest.warns(sw.UnpicklableCallWarning):
        assert not sw.map_fields(base, "v", lambda x: x, "w", lazy=True).couplings[0].call.storable


def test_save_keeps_the_whole_schema(spark, tmp_path):
    time, label = TemporalDimension("t", sample_rate=29.97), CategoricalDimension("c", ("a", "b"))
    target = ds(spark, [("a",)], "id string")
    made = ds(spark, [("r", 0.0, 2.0, "a", 3)], "id string, lo double, hi double, ref string, n int", fields=[
        DimensionField("lo", float, dimension=time), DimensionField("hi", float, dimension=time), ForeignIndexField("ref", target=target.identity), ValueField("n", "int32", nullable=False, metadata={"unit": "m"}),
    ])
    made = sw.compose_slice(made, "span", {"t": ("lo", "hi")})
    made = made.with_(made.df, made.schema.put(DataField("n", dimensions=(label,), metadata={"unit": "m"})))
    sw.save(made, str(tmp_path / "x"))
    back = sw.load(spark, str(tmp_path / "x"))
    assert back.schema == made.schema and back.identity == made.identity and back.schema.get("ref").target == target.identity
    assert back.schema.get("n").metadata == {"unit": "m"} and back.schema.get("n").dimensions == (label,) and [f.lineage for f in back.schema.fields] == [f.lineage for f in made.schema.fields]
    plan = sw.window_expansion_plan(back, windows={"t": AxisWindow(1)}, field="span")
    assert [r["slice"]["t"]["start"] for r in plan.rows()] == [0.0, 1.0]


def test_materialize_cuts_all_axes(spark):
    y, x = IndexDimension("y"), IndexDimension("x")
    rows = [("a", [[1, 2, 3], [4, 5, 6], [7, 8, 9]], 0, 2, 1, 3), ("b", [[1, 2], [3, 4]], 0, 1, 0, 1), ("c", [[1, 2], [3, 4]], None, None, 0, 1), ("d", [[1], [2]], 5, 9, 0, 9)]
    d = ds(spark, rows, "id string, data array<array<int>>, y0 int, y1 int, x0 int, x1 int", fields=[DataField("data", dimensions=(y, x)), *(ValueField(f"{k}{i}") for k in "yx" for i in (0, 1))])
    d = sw.compose_slice(d, "box", {"y": ("y0", "y1"), "x": ("x0", "x1")})
    cut = sw.consume(sw.materialize(sw.slice_data(d, "box", "data"), "data"))
    assert dict(got(cut, "id", "data")) == {"a": [[2, 3], [5, 6]], "b": [[1]], "c": [[1, 2], [3, 4]], "d": []}
    late = sw.consume(sw.materialize(sw.slice_data(d, "box", "data", lazy=True), "data"))
    assert dict(got(late, "id", "data"))["b"] == [[1]]
    text = sw.compose_slice(ds(spark, [("a", "abcdef", 1, 3)], "id string, data string, x0 int, x1 int"), "s", {"x": ("x0", "x1")})
    with pytest.raises(ValueError, match="no place"):
        sw.materialize(sw.slice_data(sw.compose_slice(text, "s", {"y": ("x0", "x1")}), "s", "data"), "data").consumed()


def test_range_join_plans_an_equi_join_with_an_outlier(spark):
    """One interval of a year among seconds: no cartesian product, and the rows of both sides are not multiplied by it."""
    day = 86400
    rows = [(i, float(10 * i), float(10 * i + 5)) for i in range(400)] + [(9999, 0.0, 365.0 * day)]
    side = spark.createDataFrame(rows, "i int, a double, b double")
    left = side.select("i", F.struct(F.col("a").alias("start"), F.col("b").alias("stop")).alias("x"))
    right = side.select(F.col("i").alias("j"), F.struct((F.col("a") + 3).alias("start"), (F.col("b") + 3).alias("stop")).alias("y"))
    joined = range_join(left, right, "x", "y", sw.overlap().condition(F.col("x"), F.col("y")))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    expected = {(i, j) for i, a, b in rows for j, c, d in rows if c + 3 < b and d + 3 > a}
    found = [(r.i, r.j) for r in joined.select("i", "j").collect()]
    assert len(found) == len(set(found)) and set(found) == expected


def test_range_join_of_points_and_magnitudes(spark):
    r = np.random.default_rng(5)
    rows = [(i, float(s), float(s + w)) for i, (s, w) in enumerate(zip(r.choice([0, 1e9, 1.7e15], 90) + r.integers(-50, 50, 90), r.choice([0.0, 1e-3, 1, 30, 1e6], 90)))]
    left, right = (spark.createDataFrame(rows, f"{k} int, a double, b double").select(k, F.struct(F.col("a").alias("start"), F.col("b").alias("stop")).alias(c)) for k, c in (("i", "x"), ("j", "y")))
    for pad in (0, 2):
        found = [(q.i, q.j) for q in range_join(left, right, "x", "y", sw.overlap(pad).condition(F.col("x"), F.col("y")), pad).select("i", "j").collect()]
        expected = {(i, j) for i, a, b in rows for j, c, d in rows if c < b + pad and d > a - pad}
        assert len(found) == len(set(found)) and set(found) == expected


class SameParity(MatchPredicate):
    def matches(self, left, right):
        return left is not None and right is not None and left % 2 == right % 2


def test_predicate_contract_and_opt_in(spark):
    values = [1, 2, None, 3]
    frame = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(values) for j, b in enumerate(values)], "i int, j int, left long, right long")
    sw.assert_predicate_contract(sw.equals(), values, values, frame)
    sw.assert_predicate_contract(SameParity(), values, values, frame)
    spans = [(0, 2), (1, 3), (5, 6), None]
    nested = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(spans) for j, b in enumerate(spans)], "i int, j int, left struct<start: long, stop: long>, right struct<start: long, stop: long>")
    for pad in (0, 3):
        sw.assert_predicate_contract(sw.overlap(pad), spans, spans, nested)
    a = ds(spark, [("a", 1), ("b", 2)], "id string, v long")
    b = ds(spark, [("c", 3), ("d", 4)], "id string, v long")
    with pytest.raises(ValueError, match="cross=True"):
        sw.dimension_join(a, b, predicate=SameParity(), left_on="v", right_on="v")
    assert got(sw.dimension_join(a, b, predicate=SameParity(), left_on="v", right_on="v", cross=True), "left_index", "right_index") == [("a", "c"), ("b", "d")]


@pytest.mark.parametrize("how", ["left", "right", "outer"])
def test_outer_interval_joins(spark, how):
    rows = lambda *x: sw.compose_slice(ds(spark, list(x), "id string, a double, b double"), "s", {"t": ("a", "b")})
    l, r = rows(("a", 0.0, 2.0), ("b", 50.0, 60.0), ("c", 1.0, 9.0)), rows(("x", 1.0, 3.0), ("y", 100.0, 101.0), ("z", 8.0, 8.5))
    inner = [("a", "x"), ("c", "x"), ("c", "z")]
    lone = ([("b", None)] if how != "right" else []) + ([(None, "y")] if how != "left" else [])
    plan = sw.join(l, r, strategy=sw.DimensionJoin("s", "s", ["t"], how=how))
    assert sorted(got(plan, "left_index", "right_index"), key=str) == sorted(inner + lone, key=str)


def test_row_sequences(base):
    rows = base.rows()
    assert len(rows) == 3 and rows[0] == {"id": "a", "v": 1, "k": "x"} and rows[-1]["id"] == "c"
    assert [r["id"] for r in rows.__getitems__([2, 0, 2])] == ["c", "a", "c"] and [r["id"] for r in rows[1:]] == ["b", "c"]
    assert sorted(r["id"] for r in rows) == ["a", "b", "c"] and base.rows("v")[1] == {"id": "b", "v": 2}
    with pytest.raises(IndexError):
        rows[3]
    assert sw.map_fields(base, "v", add_one, "w", lazy=True).rows()[0]["w"] == 2


def test_handles_as_operands(base):
    context = base.context()
    w = sw.map_fields(context["v"], add_one, "w")
    z = sw.map_fields([w], double, "z")
    assert [c.output for c in context.dataset.couplings] == ["w", "z"]
    assert sorted(z.items(), key=str) == [("a", 4), ("b", 6), ("c", None)] and z.loc["b"] == 6 and z.loc[["b", "a"]] == [6, 4]
    assert got(z.collect(), "id", "w", "z")[0] == ("a", 2, 4)
    context["v"].loc["a"] = 100
    assert dict(context["v"].items())["a"] == 100 and w.loc["a"] == 101
    context["v"].loc[["b", "c"]] = 7
    assert sorted(context["v"]) == [7, 7, 100]
    assert base.fields("v").collect().schema.names() == ("id", "v")
    other = base.context()
    with pytest.raises(ValueError, match="different contexts"):
        sw.map_fields([w, other["v"]], double, "q")
    assert context.branch().dataset is context.dataset and other.adopt(context.dataset).dataset is context.dataset
    sw.add_column(context["k"], F.lit("new"))
    assert set(context["k"]) == {"new"}


def test_within_a_context(base):
    with base.context() as context:
        sw.where("v = 2")
        sw.rename({"v": "value"})
        assert sw.active_context() is context
    assert sw.active_context() is None and got(context.dataset, "id", "value") == [("b", 2)]


def test_bundle_arm_gives_what_the_eager_one_gives(spark, base):
    r = ds(spark, [("a", 5), ("b", 6)], "id string, u long")
    eager = sw.drop(sw.where(sw.merge(base, r, sw.join(base, r)), "u > 5"), "k")
    cells = sw.bundle(l=base, r=r, plan=sw.join(base, r))
    from spanweave.operators.arms import BundleContext

    context = BundleContext(cells)
    m = sw.merge(context["l"], context["r"], context["plan"], out="m")
    late = sw.drop(sw.where(m, predicate="u > 5", out="big"), fields="k", out="slim")
    assert set(context.bundle.pending) == {"m", "big", "slim"}
    assert sorted(got(late.collect(), *eager.df.columns)) == sorted(got(eager, *eager.df.columns))
    with pytest.raises(ValueError, match="handles and datasets"):
        sw.merge(context["l"], r, cells.cells["plan"])


def test_slices_and_materialize_by_handles(spark):
    d = ds(spark, [("a", "abcdef", 1, 3)], "id string, text string, lo long, hi long", fields=[ValueField("text"), DimensionField("lo", dimension=IndexDimension("c")), DimensionField("hi", dimension=IndexDimension("c"))])
    context = d.context()
    cut = sw.compose_slice([context["lo"], context["hi"]], "s")
    out = sw.materialize(sw.slice_data(cut, context["text"]))
    assert [c.kind for c in context.dataset.couplings] == ["compose_slice", "slice_data", "materialize"]
    assert out.loc["a"] == "bc"


def test_fibers_are_mapped_and_reduced_by_handle(spark, base):
    groups = sw.partition(base, "k")
    native = sw.map_fields(groups, ["fiber"], lambda f: F.array_join(f["id"], "+"), "ids")
    assert got(native, "k", "ids") == [("x", "a+c"), ("y", "b")]
    counted = sw.map_fields(groups, ["fiber"], lambda pdf: len(pdf) + int(pdf.v.fillna(0).sum()), "score", dtype=int)
    assert got(counted, "k", "score") == [("x", 3), ("y", 3)]
    handle = groups.field("fiber")
    total, most = Sum.on("v")(handle, out="total"), Max.on("v")(handle, out="most")
    assert got(total.collect(), "k", "total", "most") == [("x", 1.0, 1), ("y", 2.0, 2)] and most.name == "most"
    domain = ds(spark, [("x",), ("q",)], "id string")
    linked = sw.link(sw.where(base, "k = 'x'"), domain, "k")
    assert got(sw.map_fields(sw.partition(linked, "k", domain), ["fiber"], len, "n", dtype=int), "k", "n") == [("q", 0), ("x", 2)]
    assert got(sw.reduce(base, "k", {"m": Custom("v", fn=lambda s: float(s.sum()))}), "k", "m") == [("x", 1.0), ("y", 2.0)]


def test_pipe_transitions(base):
    schema = Schema((IndexField("id"), ValueField("v")))
    slim = lambda d: d.df.select("id", "v")
    assert sw.pipe(base, slim, schema=schema).identity != base.identity
    assert sw.pipe(base, slim, schema=schema, transitions={"identity": "inherit"}).identity == base.identity
    assert sw.pipe(base, lambda d: d.df, transitions={"identity": "mint"}).identity != base.identity
    late = sw.map_fields(base, "v", add_one, "w", lazy=True)
    assert not sw.pipe(late, lambda d: d.df, transitions={"couplings": "clear"}).couplings and sw.pipe(late, slim, schema=schema, transitions={"couplings": "derive"}).couplings
    assert not sw.pipe(base, lambda d: d.df, transitions={"sources": "clear"}).sources
    for bad, error in (({"schema": "infer"}, NotImplementedError), ({"color": "red"}, ValueError), ({"schema": "construct"}, ValueError)):
        with pytest.raises(error):
            sw.pipe(base, lambda d: d.df, transitions=bad)


def test_assign_by_position_and_label(base):
    assert got(sw.assign(base, n=[10, 20, 30]), "id", "n") == [("a", 10), ("b", 20), ("c", 30)]
    assert got(sw.assign(base, n=pd.Series([1.5, 2.5], index=["c", "a"])), "id", "n") == [("a", 2.5), ("b", None), ("c", 1.5)]
    context = base.context()
    sw.assign([context["v"], context["k"]], [F.col("v") * 2, F.lit("z")])
    assert got(context.dataset, "id", "v", "k") == [("a", 2, "z"), ("b", 4, "z"), ("c", None, "z")]
    assert got(sw.map_fields(base, "v", lambda s: s + 1, "w", dtype=float, batch=True), "id", "w")[:2] == [("a", 2.0), ("b", 3.0)]


def test_plans_from_frames_and_series(base):
    plan = sw.make_plan.from_series(base, pd.Series(["b", "a"], index=[7, 9]))
    assert sorted(got(plan, "plan_id", "source_index")) == [(7, "b"), (9, "a")]
    framed = sw.make_plan.from_dataframe(base, pd.DataFrame({"source_index": ["c"], "score": [0.5]}))
    assert got(sw.explode(base, framed, carry=["score"]), "v", "k", "score") == [(None, "x", 0.5)]


def test_mock_data_from_dimension_fields(spark):
    t = TemporalDimension("t", sample_rate=10)
    d = ds(spark, [("a", 0.0, 2.0), ("b", 1.0, 1.5), ("c", None, 3.0)], "id string, lo double, hi double", fields=[DimensionField("lo", dimension=t), DimensionField("hi", dimension=t)])
    made, source = arrays.make_mock_dataset_from_dims(d)
    cells = {r["id"]: r["data"] for r in sw.consume(sw.materialize(made, "data", reader=arrays.reader(source))).rows()}
    assert [len(arrays.to_array(cells[k])) for k in "abc"] == [20, 5, 30]


class Numbers(arrays.ArrayDataSource):
    opened = 0

    def open(self):
        type(self).opened += 1

    def read_full(self, item):
        return np.arange(int(item), dtype=np.float32)


def test_source_manager_and_contract():
    manager, source = arrays.SourceManager(), Numbers((IndexDimension("x"),), tag="n")
    number = manager.register_descriptor(source.descriptor)
    with pytest.raises(KeyError):
        manager.get(number)
    manager.register_source_type("Numbers", lambda d: Numbers((IndexDimension("x"),), **d.config))
    Numbers.opened = 0
    (first, lease), again = manager.acquire(number), manager.get(source.descriptor)
    manager.release(lease)
    assert first is again and Numbers.opened == 1 and manager.register(source) == number
    manager.close_all()
    arrays.assert_source_contract(source, 6)
    assert source.inspect(6)["shape"] == (6,) and source.extent_for(6) == {"x": {"start": 0, "stop": 6.0}}
    cell = source.slice_accessor({"item": 6, "slice": {"x": None}}, {"x": {"start": 1, "stop": 3}})
    assert source.materialize(cell).tolist() == [1, 2] and source.slice_accessor(cell, None) == cell
    memory = arrays.MemoryArraySource({}, (IndexDimension("x"),))
    memory.append("a", np.zeros(3))
    with pytest.raises(ValueError):
        memory.append("a", np.zeros(3))


def test_dataset_sources(spark, tmp_path):
    d = ds(spark, [(f"r{i:03}", i) for i in range(25)], "id string, v long")
    store = DatasetStore(spark, str(tmp_path))
    source = store.put("d", d)
    assert_dataset_source_contract(source, lambda: store.get("d"))
    assert [r["v"] for r in source.read(10, 12).rows()[:]] == [10, 11] and source.read().identity == d.identity
    with pytest.raises(ValueError):
        store.put("d", d)
    cells = [r.accessor.asDict() for r in store.accessors("d", 10).collect()]
    assert [(c["start"], c["stop"]) for c in cells] == [(0, 10), (10, 20), (20, 25)] and len(store.resolve(cells[2])) == 5
    empty = store.put("none", sw.where(d, "v < 0"))
    assert empty.length() == 0 and len(empty.read()) == 0


class Ranged(CreationOperator):
    source_type = "ranged"

    def build(self, spark, source, *, n):
        return sw.Dataset(spark.range(n), Schema((IndexField("id"),)))


class Euro(ValueField):
    pass


def test_registries_and_names(spark, base):
    made = Ranged()(spark, n=3)
    assert len(made) == 3 and made.sources[0].source_uri == "ranged://n=3"
    sw.register_field_exit(Euro, lambda f, v: f"{v} EUR")
    priced = base.with_(schema=base.schema.put(Euro("v")))
    assert priced["a"]["v"] == "1 EUR" and base["a"]["v"] == 1
    sw.register_field_policy(Euro, lambda a, b: (_ for _ in ()).throw(ValueError("no sums of money")))
    with pytest.raises(ValueError, match="money"):
        sw.concat_rows(sw.where(priced, "id = 'a'"), sw.where(priced, "id = 'b'"))
    with pytest.warns(DeprecationWarning):
        assert sw.bind_slice is sw.slice_data
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert sw.OPERATORS["where"].transition.cardinality == "filter"
    with pytest.raises(ValueError):
        sw.Transition(schema="melt")

    @sw.operator(sw.Transition(identity="custom"))
    def stamped(d, *, tag="x"):
        return sw.assign(d, tag=F.lit(tag))

    seen = []
    sw.register_aspect_handler("identity", "custom", lambda first, result: seen.append(first) or result)
    assert set(r["tag"] for r in stamped.with_params(tag="y")(base).rows()) == {"y"} and seen == [base]


def test_modes(spark, mode):
    """What validation adds: contracts that need a job of their own. Results are the same either way."""
    l = ds(spark, [("a", 1), ("b", 2)], "id string, k long")
    twice = ds(spark, [("a", 1), ("b", 1)], "id string, k long")
    if mode:
        with pytest.raises(ValueError, match="not unique"):
            sw.set_index(twice, "k")
        with pytest.raises(ValueError, match="without a target"):
            sw.link(sw.assign(l, ref=F.lit("zz")), l, "ref")
    else:
        assert len(sw.set_index(twice, "k")) == 2
        dangling = sw.link(sw.assign(l, ref=F.lit("zz")), l, "ref")
        plan = sw.make_plan(l, dangling.df.select(F.col("ref").alias("source_index")), dense=False)
        with pytest.raises(Exception, match="no row"):
            sw.explode(l, plan).df.collect()
    r = ds(spark, [("a", 5), ("c", 6)], "id string, u long")
    assert sorted(got(sw.merge(l, r, sw.join(l, r, how="outer")), "left_index", "right_index", "k", "u"), key=str) == [("a", "a", 1, 5), ("b", None, 2, None), (None, "c", None, 6)]
    assert got(sw.reduce(l, "k", {"n": Count.on()}), "k", "n") == [(1, 1), (2, 1)]
    spans = sw.compose_slice(ds(spark, [("a", 0, 4)], "id string, lo int, hi int"), "s", {"t": ("lo", "hi")})
    assert len(sw.window_expansion_plan(spans, windows={"t": AxisWindow(2)}, field="s")) == 2
    assert len(sw.concat_rows(l, sw.rename(ds(spark, [("q", 5)], "id string, k long"), {}))) == 3


def test_small_print(spark, base):
    with pytest.warns(DeprecationWarning, match="no label"):
        assert ds(spark, [(10, "x"), (20, "y")], "id long, k string")[1]["id"] == 20
    with pytest.raises(KeyError):
        base["nobody"]
    with pytest.raises(NotImplementedError):
        sw.set_index(base, "k", drop=False)
    with pytest.raises(ValueError, match="null labels"):
        sw.make_plan(base, ["a", None])
    context = base.context()
    assert got(sw.make_plan(context["id"], ["b"], metadata={"why": "test"}), "source_index") == [("b",)]
    with pytest.raises(ValueError, match="no index field"):
        sw.make_plan(context["k"], ["b"])
    plan = sw.make_plan(base, ["b", "a"])
    with pytest.warns(UserWarning, match="left out"):
        sw.explode(base, sw.map_fields(plan, "plan_id", add_one, "w", lazy=True))
    assert TemporalDimension("t").spec(0, 1) == {"start": 0, "stop": 1} and CategoricalDimension("c").spec("a") == "a"
    x_rows = sw.where(base, "k = 'x'")
    assert got(sw.intersect(base, x_rows), "id") == [("a",), ("c",)] and got(sw.subtract(base, x_rows), "id") == [("b",)]
    assert sw.ColumnCollisionStrategy is sw.ColumnCollision


def test_stream_joins_and_first_seen(spark, tmp_path):
    from spanweave import streaming

    one = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00"), (1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 00:10:00")], "id int, k string, t string").selectExpr("id", "k", "to_timestamp(t) t")
    for name in ("l", "r"):
        one.write.parquet(str(tmp_path / name))
    read = lambda name: spark.readStream.schema(one.schema).parquet(str(tmp_path / name))

    def run(stream, name):
        q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    seen = run(streaming.first_seen(read("l"), ["id"], "t", late="1 hour"), "seen")
    assert sorted(r.id for r in seen.collect()) == [1, 2]
    pairs = run(streaming.interval_join(read("l").withColumnsRenamed({"id": "i"}), read("r"), left_time="t", right_time="t", on={"k": "k"}, pad="1 minute", late="1 hour").selectExpr("i", "id"), "pairs")
    assert sorted((r.i, r.id) for r in pairs.collect()) == [(1, 1)] * 4 + [(2, 2)]
    rows = sw.where(sw.Dataset(read("l"), Schema((IndexField("id"), ValueField("k"), ValueField("t")))), "k = 'b'")
    assert [r.id for r in run(sw.assign(rows, x=F.lit(1)).df, "stateless").collect()] == [2]
    from spanweave.sources.tables import foreach_chunk

    counted = []
    foreach_chunk(read("l"), lambda df, n: counted.append(df.count())).trigger(availableNow=True).start().awaitTermination()
    assert sum(counted) == 3
