"""Joins as plans: join() and match() give datasets of label pairs, merge(), explode() and implode() apply them."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce as fold

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.dataset import Coupling, Dataset, FieldHandle, ordered, strict, union_sources
from spanweave.operators.columns import with_label, with_row_id
from spanweave.plans.predicates import MatchPredicate, equals, overlap, range_join
from spanweave.schema import DimensionedSliceField, Field, ForeignIndexField, IndexField, Schema, ValueField
from spanweave.storage import written

LEFT, RIGHT = "left_index", "right_index"
_HOW = {"inner": "inner", "left": "left", "right": "right", "outer": "full_outer"}


@dataclass(frozen=True)
class IndexJoin:
    how: str = "inner"


@dataclass(frozen=True)
class FieldEqualityJoin:
    on: str | Sequence[str] = ()
    how: str = "inner"


@dataclass(frozen=True)
class DimensionJoin:
    """Pairs whose slices overlap in all dimensions, within equal `on` values."""

    left_field: str
    right_field: str
    dimensions: Sequence[str]
    on: str | Sequence[str] = ()
    how: str = "inner"
    predicates: Mapping[str, MatchPredicate] = field(default_factory=dict)


def _plan(df: DataFrame, l: Dataset, r: Dataset, name: str, dense: bool) -> Dataset:
    pairs = df.select(LEFT, RIGHT)
    return _described(with_row_id(pairs, name, [LEFT, RIGHT]) if dense else with_label(pairs, name, [LEFT, RIGHT]), l, r, name)


def _described(df: DataFrame, l: Dataset, r: Dataset, name: str) -> Dataset:
    out = df.select(name, LEFT, RIGHT)
    schema = Schema((IndexField(name), ForeignIndexField(LEFT, target=l.identity), ForeignIndexField(RIGHT, target=r.identity)))
    return Dataset(out, schema, sources=union_sources(l.sources, r.sources), metadata={"plan": True})


@dataclass(frozen=True)
class Pairing:
    """What an equality plan was made of: merge() of the same frames and the unfiltered plan is then the join itself."""

    left: DataFrame
    right: DataFrame
    plan: DataFrame
    on: tuple[tuple[str, str], ...]
    how: str

    def holds(self, l: Dataset, r: Dataset, plan: Dataset) -> bool:
        return self.left is l.df and self.right is r.df and self.plan is plan.df


@dataclass(frozen=True)
class Terms:
    """The predicates that made a plan of all pairs: one more over the same frames and the unfiltered plan is then tested
    in the same join, not on the written-out pairs."""

    left: DataFrame
    right: DataFrame
    plan: DataFrame
    each: tuple[tuple[Column, Column, MatchPredicate], ...]

    def holds(self, l: Dataset, r: Dataset, plan: Dataset) -> bool:
        return self.left is l.df and self.right is r.df and self.plan is plan.df


def _side(ds: Dataset, columns: dict[str, Column], label: str) -> DataFrame:
    return ds.df.select(F.col(f"`{ds.index_name}`").alias(label), *(c.alias(n) for n, c in columns.items()))


def _listed(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def join(l: Dataset, r: Dataset, *, strategy=None, on: str | Sequence[str] | None = None, how: str | None = None, dense: bool = True) -> Dataset:
    """A plan (join_id, left_index, right_index): by index labels, by equal fields (null equals null) or by overlap.

    dense numbers the pairs in label order; without it join_id is a text made of both labels, which needs no sort.
    """
    if strategy is not None and on is not None:
        raise ValueError("give on or strategy")
    s = strategy or (FieldEqualityJoin(on) if on is not None else IndexJoin())
    kind = how or s.how
    if kind not in _HOW:
        raise ValueError(f"how must be one of {tuple(_HOW)}")
    if isinstance(s, DimensionJoin):
        return _plan(_dimension_pairs(l, r, s, kind), l, r, "join_id", dense)
    names = _listed(s.on) if isinstance(s, FieldEqualityJoin) else []
    for n in names:
        a, b = l.schema.get(n), r.schema.get(n)
        if isinstance(a, IndexField) or isinstance(b, IndexField):
            raise ValueError(f"{n!r} is an index field")
        if type(a) is not type(b):
            raise ValueError(f"fields {n!r} don't compose: {type(a).__name__}, {type(b).__name__}")
    if isinstance(s, FieldEqualityJoin) and not names:
        raise ValueError("no field to join on")
    keys = {f"_k{i}": F.col(f"`{n}`") for i, n in enumerate(names)} or None
    a = _side(l, keys or {"_k0": F.col(f"`{l.index_name}`")}, LEFT).alias("a")
    b = _side(r, keys or {"_k0": F.col(f"`{r.index_name}`")}, RIGHT).alias("b")
    if keys and dense:
        numbered = _numbered_pairs(a, b, list(keys), kind)
        if numbered is not None:
            return _described(numbered, l, r, "join_id")
    match_ = fold(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (keys or {"_k0": 0})))
    plan = _plan(a.join(b, match_, _HOW[kind]), l, r, "join_id", dense)
    if dense:
        return plan
    on = tuple((n, n) for n in names) or ((l.index_name, r.index_name),)
    return plan.with_(metadata=plan.metadata | {"pairing": Pairing(l.df, r.df, plan.df, on, _HOW[kind])})


#: Rows of one key and side that meet as many of the other side in a task: a key of more is dealt out in squares.
PIECE = 2048


def _numbered_pairs(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame | None:
    """Pairs of equal keys with join_id, their place by (left label, right label), of which no pair is sorted or written.

    A left row's pairs begin where those of the rows before it end, and a right row comes in its key's own order: both
    follow from counts of the keys and from sorted sides, so what is sorted and written is as large as the sides. Pairs
    are then made in squares of a key's rows, so a hot key is no single task. A pair's task has its ids at once.
    None if left labels repeat (or null ones meet lone right rows): their pairs interleave, and have to be sorted.
    """
    spark, wanted = a.sparkSession, how in ("left", "outer")
    counts = a.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(b.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    counts = written(counts.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r")).withColumn("_g", F.monotonically_increasing_id()))
    alone = counts.agg(F.bool_or(F.col("_r") == 0).alias("left"), F.bool_or(F.col("_l") == 0).alias("right")).first()
    named = counts.select(*(F.col(k).alias("_n" + k) for k in keys), "_l", "_r", "_g")
    known = lambda side: side.join(named, fold(Column.__and__, (F.col(k).eqNullSafe(F.col("_n" + k)) for k in keys))).drop(*keys, *("_n" + k for k in keys))

    many = F.greatest("_r", F.lit(1)) if wanted else F.col("_r")
    lefts = _ranged(known(a).withColumn("_many", many.cast("long")), [LEFT])
    told = lefts.groupBy("_part").agg(F.sum("_many").alias("n"), F.count(F.lit(1)).alias("rows"), F.count(LEFT).alias("labels"), F.count_distinct(LEFT).alias("own")).collect()
    nulls = sum(t["rows"] - t["labels"] for t in told)
    if any(t["labels"] != t["own"] for t in told) or nulls > (how in ("inner", "left")):
        return None
    lone, start = None, 0
    if how in ("right", "outer") and alone["right"]:  # to number no rows takes as many jobs as to number some
        lone = with_row_id(known(b).where("_l = 0").select(RIGHT), "join_id", [RIGHT])
        start = lone.count()
    lefts = _offset(lefts, {t["_part"]: t["n"] for t in told}, start)
    before = Window.partitionBy("_part").orderBy("_nth").rowsBetween(Window.unboundedPreceding, -1)
    lefts = lefts.withColumn("_at", F.col("_start") + F.coalesce(F.sum("_many").over(before), F.lit(0)))

    rights = _ranged(known(b).where("_l > 0"), ["_g", RIGHT])
    rights = _offset(rights, {t["_part"]: t["count"] for t in rights.groupBy("_part").count().collect()}, 0)
    rights = rights.withColumn("_row", F.col("_start") + F.col("_nth"))
    firsts = rights.groupBy(F.col("_g").alias("_fg")).agg(F.min("_row").alias("_first"))
    rights = rights.join(firsts, F.col("_g") == F.col("_fg")).withColumn("_rank", F.col("_row") - F.col("_first"))

    pieces = lambda n: F.ceil(F.col(n) / F.lit(PIECE)).cast("long")
    total = sum(t["n"] for t in told)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(total // 20_000_000, 10_000))
    dealt = lambda side, other, n: side.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), pieces(n) - 1))).repartition(tasks, "_g", "_i", "_j")
    met = dealt(lefts.where("_r > 0").select(LEFT, "_g", "_at", "_r", F.pmod(F.xxhash64(LEFT), pieces("_l")).alias("_i")), "_j", "_r")
    # a square's right labels are one array in their order: a pair is an element of it, and its place there the rest of its id
    few = min(tasks, spark.sparkContext.defaultParallelism)  # Spark makes one task of a small side, however many squares it goes to
    placed = rights.select(RIGHT, "_g", "_rank", "_l", F.floor(F.col("_rank") / PIECE).cast("long").alias("_j")).repartition(few, "_g", "_j")
    arrays = placed.groupBy("_g", "_j", "_l").agg(F.array_sort(F.collect_list(F.struct("_rank", RIGHT))).alias("_rows"))
    with_ = dealt(arrays.select("_g", "_j", "_l", F.col("_rows")[RIGHT].alias("_labels")), "_i", "_l")
    square = ["_g", "_i", "_j"]
    pairs = met.select(LEFT, "_at", *square).join(with_.select("_labels", *square).hint("merge"), square)
    pairs = pairs.select((F.col("_at") + F.col("_j") * PIECE).alias("_first"), LEFT, F.posexplode("_labels").alias("_in", RIGHT))
    pairs = pairs.select((F.col("_first") + F.col("_in")).alias("join_id"), LEFT, RIGHT)
    if wanted and alone["left"]:
        pairs = pairs.unionByName(lefts.where("_r = 0").select(F.col("_at").alias("join_id"), LEFT), allowMissingColumns=True)
    return pairs if lone is None else pairs.unionByName(lone.select("join_id", RIGHT), allowMissingColumns=True)


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted into ranges and written once: _part is a row's range, _nth its place there."""
    raw = F.monotonically_increasing_id()
    return written(df.sort(*order).withColumn("_part", F.shiftright(raw, 33)).withColumn("_nth", raw.bitwiseAND(F.lit((1 << 33) - 1))))


def _offset(df: DataFrame, sizes: dict[int, int], start: int) -> DataFrame:
    """The sum of the sizes of the ranges before a row's own as _start: one number per range is broadcast."""
    parts, starts = sorted(sizes), []
    for part in parts:
        starts.append(start)
        start += sizes[part]
    told = pa.table({"_part": pa.array(parts, pa.int64()), "_start": pa.array(starts, pa.int64())})  # rows as Python tuples would start a worker per core
    return df.join(F.broadcast(df.sparkSession.createDataFrame(told)), "_part")


def _dimension_pairs(l: Dataset, r: Dataset, s: DimensionJoin, how: str) -> DataFrame:
    for p in s.predicates.values():
        if not isinstance(p, overlap):
            raise ValueError("only overlap() is supported between slices")
    on = _listed(s.on)
    dims = {f"_d{i}": d for i, d in enumerate(s.dimensions)}
    if not dims:
        raise ValueError("no dimension to join on")
    side = lambda ds, f, label, p: _side(ds, {p + k: F.col(f"`{f}`")[d] for k, d in dims.items()} | {p + f"_k{i}": F.col(f"`{n}`") for i, n in enumerate(on)}, label)
    a, b = side(l, s.left_field, LEFT, "l"), side(r, s.right_field, RIGHT, "r")
    for df, p in ((a, "l"), (b, "r")):
        if strict():
            bad = fold(Column.__or__, (F.coalesce(F.col(p + k)["start"] >= F.col(p + k)["stop"], F.lit(True)) for k in dims))
            bad = fold(Column.__or__, (F.col(f"{p}_k{i}").isNull() for i in range(len(on))), bad)
            if df.where(bad).limit(1).count():
                raise ValueError("slices must be non-null, bounded and not empty, scopes non-null")
    pads = {k: s.predicates[d].pad if d in s.predicates else 0 for k, d in dims.items()}
    first, *others = dims
    rest = [overlap(pads[k]).condition(F.col("l" + k), F.col("r" + k)) for k in others] + [F.col(f"l_k{i}") == F.col(f"r_k{i}") for i in range(len(on))]
    pairs = range_join(a, b, "l" + first, "r" + first, fold(Column.__and__, rest) if rest else None, pads[first], scoped=bool(on)).select(LEFT, RIGHT)
    lone = [_lone(pairs, side, label, other) for side, label, other, kinds in ((a, LEFT, RIGHT, ("left", "outer")), (b, RIGHT, LEFT, ("right", "outer"))) if how in kinds]
    return fold(lambda x, y: x.unionByName(y, allowMissingColumns=True), lone, pairs)


def _lone(pairs: DataFrame, side: DataFrame, label: str, other: str) -> DataFrame:
    """The labels of a side that have no pair. A task makes its pairs' labels distinct before it sends them, so no more is
    sent than the side's rows in their cells, however many pairs there are. The pairs are made again, of the cells as they
    were sent: their count, always there, keeps both labels in the plan, and a null-safe equality adds no filter to a side,
    either of which would make Spark send the cells anew."""
    some = pairs.groupBy(F.col(label).alias("_some")).agg(F.count(other).alias("_n")).where("_n >= 0")
    return side.select(label).join(some.hint("merge"), F.col(label).eqNullSafe(F.col("_some")), "left_anti")


def _operand(ds: Dataset, on: str | tuple[str, str], dimension: str | None) -> Column:
    if isinstance(on, tuple):
        return F.struct(F.col(f"`{on[0]}`").alias("start"), F.col(f"`{on[1]}`").alias("stop"))
    ds.schema.get(on)
    return F.col(f"`{on}`")[dimension] if dimension and isinstance(ds.schema.get(on), DimensionedSliceField) else F.col(f"`{on}`")


def dimension_join(
    l: Dataset, r: Dataset, candidates: Dataset | None = None, *, predicate: MatchPredicate, left_on, right_on, dimension: str | None = None, dense: bool = True, cross: bool = False
) -> Dataset:
    """Pairs (pair_id) that one predicate holds for: among all, or among a prior plan's pairs.

    A predicate that is neither equality nor overlap has no key to join on: it needs candidates, or cross=True, which
    compares every pair and is for small sides only.
    """
    term = (_operand(l, left_on, dimension), _operand(r, right_on, dimension), predicate)
    if candidates is None:
        return _matched(l, r, (term,), dense, cross, "a filter predicate needs candidates, or cross=True for small sides")
    if candidates.schema.get(LEFT).target != l.identity or candidates.schema.get(RIGHT).target != r.identity:
        raise ValueError("the candidates belong to other datasets")
    known = candidates.metadata.get("terms")
    if known is not None and known.holds(l, r, candidates):
        return _matched(l, r, (*known.each, term), dense, True)
    a, b = _side(l, {"_x": term[0]}, LEFT), _side(r, {"_y": term[1]}, RIGHT)
    pairs = candidates.df.select(LEFT, RIGHT).join(a, LEFT).join(b, RIGHT).where(predicate.condition(F.col("_x"), F.col("_y")))
    return _plan(pairs, l, r, "pair_id", dense)


def _matched(l: Dataset, r: Dataset, terms: tuple[tuple[Column, Column, MatchPredicate], ...], dense: bool, cross: bool, lacking: str = "") -> Dataset:
    """The plan of the pairs that hold all terms: the first overlap pairs them, or else the equalities do."""
    a = _side(l, {f"_x{i}": t[0] for i, t in enumerate(terms)}, LEFT)
    b = _side(r, {f"_y{i}": t[1] for i, t in enumerate(terms)}, RIGHT)
    holds = [t[2].condition(F.col(f"_x{i}"), F.col(f"_y{i}")) for i, t in enumerate(terms)]
    pairer = next((i for i, t in enumerate(terms) if isinstance(t[2], overlap)), None)
    if pairer is None and not cross and all(t[2].stage == "filter" for t in terms):
        raise ValueError(lacking)
    if pairer is None:
        pairs = a.join(b, fold(Column.__and__, holds))
    else:
        rest = fold(Column.__and__, holds[:pairer] + holds[pairer + 1 :]) if len(holds) > 1 else None
        bounded = lambda c: F.col(c)["start"].isNotNull() & F.col(c)["stop"].isNotNull()
        pairs = range_join(a.where(bounded(f"_x{pairer}")), b.where(bounded(f"_y{pairer}")), f"_x{pairer}", f"_y{pairer}", rest, terms[pairer][2].pad, any(t[2].stage == "partitioner" for t in terms))
    plan = _plan(pairs, l, r, "pair_id", dense)
    return plan.with_(metadata=plan.metadata | {"terms": Terms(l.df, r.df, plan.df, tuple(terms))})


def _slice_of(ds: Dataset, dimension: str) -> Column:
    found = [f for f in ds.schema.fields if isinstance(f, DimensionedSliceField) and dimension in [d.name for d in f.dimensions]]
    if len(found) != 1:
        raise ValueError(f"{len(found)} slice fields have dimension {dimension!r}")
    return F.col(f"`{found[0].name}`")[dimension]


def match(l: Dataset, r: Dataset, *, on: Sequence = (), predicates: Mapping[str, MatchPredicate] | None = None, dense: bool = True, cross: bool = False) -> Dataset:
    """Pairs that satisfy all terms: equal values of each `on` (a name or a pair of names), and a predicate per dimension.

    Without an equality or overlap term cross=True is needed: it compares every pair and is for small sides only.
    """
    terms = [(F.col(f"`{n if isinstance(n, str) else n[0]}`"), F.col(f"`{n if isinstance(n, str) else n[1]}`"), equals()) for n in ([on] if isinstance(on, str) else on)]
    terms += [(_slice_of(l, d), _slice_of(r, d), p) for d, p in (predicates or {}).items()]
    if not terms:
        raise ValueError("match needs a term")
    return _matched(l, r, tuple(terms), dense, cross, "filter predicates need an equality or overlap term, or cross=True for small sides")


@dataclass(frozen=True)
class ColumnCollision:
    """What becomes of a field that both sides have: error, keep one side, or fill the chosen side's nulls from the other."""

    mode: str = "error"
    side: str = "left"
    on_conflict: str = "ignore"

    def combine(self, name: str, left: Column, right: Column) -> Column:
        mine, other = (left, right) if self.side == "left" else (right, left)
        if self.mode == "keep":
            return mine
        if self.mode in ("update_missing", "coalesce"):
            filled = F.coalesce(mine, other)
            if self.on_conflict == "raise":
                clash = mine.isNotNull() & other.isNotNull() & (mine != other)
                return F.when(clash, F.raise_error(F.lit(f"{name} differs between the sides"))).otherwise(filled)
            return filled
        raise ValueError(f"both sides have {name!r}" if self.mode == "error" else f"collision mode {self.mode!r} is not supported")


def _fields(ds: Dataset, prefix: str) -> tuple[list[Field], list[Column]]:
    fields = ds.values
    return fields, [F.col(f"`{c}`").alias(prefix + c) for f in fields for c in f.columns]


def _meets(plan: Dataset, ds: Dataset, column: str) -> None:
    target = plan.schema.get(column).target
    if target is not None and target != ds.identity:
        raise ValueError(f"{column!r} points into another dataset")


def merge(l: Dataset, r: Dataset, plan: Dataset, *, collision: ColumnCollision | None = None) -> Dataset:
    """The plan's rows with both sides' fields; a null label gives nulls, a label without a row fails."""
    collision = collision or ColumnCollision()
    _meets(plan, l, LEFT)
    _meets(plan, r, RIGHT)
    (lf, lc), (rf, rc) = _fields(l, "_l_"), _fields(r, "_r_")
    both = {f.name for f in lf} & {f.name for f in rf}
    if {LEFT, RIGHT} & {f.name for f in (*lf, *rf)}:
        raise ValueError("left_index and right_index are reserved")
    side = lambda ds, cols, p: ds.df.select(F.col(f"`{ds.index_name}`").alias(p), F.lit(True).alias(p + "_there"), *cols)
    pairing = plan.metadata.get("pairing")
    if pairing is not None and pairing.holds(l, r, plan):  # one join, not one for the plan and two for its labels
        keys = lambda i, p: [F.col(f"`{pair[i]}`").alias(f"{p}{n}") for n, pair in enumerate(pairing.on)]
        a, b = side(l, [*lc, *keys(0, "_lk")], "_li"), side(r, [*rc, *keys(1, "_rk")], "_ri")
        same = fold(Column.__and__, (F.col(f"_lk{n}").eqNullSafe(F.col(f"_rk{n}")) for n in range(len(pairing.on))))
        df = with_label(a.join(b, same, pairing.how).withColumns({LEFT: F.col("_li"), RIGHT: F.col("_ri")}), plan.index_name, [LEFT, RIGHT])
    else:
        df = plan.df.join(side(l, lc, "_li"), F.col(LEFT) == F.col("_li"), "left").join(side(r, rc, "_ri"), F.col(RIGHT) == F.col("_ri"), "left")
        for label, there in ((LEFT, "_li_there"), (RIGHT, "_ri_there")):
            lost = F.col(label).isNotNull() & F.col(there).isNull()
            df = df.withColumn(label, F.when(lost, F.raise_error(F.concat(F.lit(f"{label} has no row: "), F.col(label).cast("string")))).otherwise(F.col(label)))
    out, fields = [F.col(f"`{c}`") for f in plan.schema.fields for c in f.columns], list(plan.schema.fields)
    for f in lf:
        for c in f.columns:
            col = collision.combine(f.name, F.col(f"`_l_{c}`"), F.col(f"`_r_{c}`")) if f.name in both else F.col(f"`_l_{c}`")
            out.append(col.alias(c))
        fields.append(f)
    for f in rf:
        if f.name not in both:
            out += [F.col(f"`_r_{c}`").alias(c) for c in f.columns]
            fields.append(f)
    schema = Schema(tuple(fields))
    return Dataset(df.select(*out), schema, _carried(l, r, plan, schema, both, collision), union_sources(l.sources, r.sources, plan.sources))


def _carried(l: Dataset, r: Dataset, plan: Dataset, schema: Schema, both: set[str], collision: ColumnCollision) -> tuple[Coupling, ...]:
    """The pending columns of all sides: of an output that both sides have, the chosen side's; those whose inputs the
    result lacks, or has from the other side, go with a warning."""
    pending = {id(d): {c.output for c in d.couplings} for d in (l, r)}
    clash = (pending[id(l)] & ({f.name for f in r.values} | pending[id(r)])) | (pending[id(r)] & {f.name for f in l.values})
    if clash and collision.mode == "error":
        raise ValueError(f"both sides have {sorted(clash)}")
    if clash and collision.mode != "keep":
        raise ValueError(f"pending columns {sorted(clash)} can only be kept, not filled; consume them first")
    kept, gone = list(plan.couplings), []
    for side, d in (("left", l), ("right", r)):
        lost = (both | clash) if collision.side != side else set()
        have = {f.name for f in d.values} - lost
        for c in ordered(d.couplings):
            if c.output in lost or not set(c.inputs) <= have:
                gone.append(c.output)
            else:
                kept.append(c)
                have.add(c.output)
    if gone:
        warnings.warn(f"pending columns without their inputs go: {gone}", UserWarning, stacklevel=3)
    return tuple(kept)


def _foreign(plan: Dataset, ds: Dataset, name: str | None) -> str:
    if name is not None:
        return name
    found = [f.name for f in plan.schema.fields if isinstance(f, ForeignIndexField) and f.target == ds.identity]
    if len(found) != 1:
        raise ValueError(f"{len(found)} foreign fields point into the dataset")
    return found[0]


def make_plan(target: Dataset, labels, *, source_index_field: str = "source_index", plan_index_name: str = "plan_id", dense: bool = True, metadata: dict | None = None) -> Dataset:
    """A plan over target's rows: labels is a list, or a DataFrame whose column source_index_field has them (more columns
    stay). target may be a handle on the rows' index field."""
    if isinstance(target, FieldHandle):
        if target.context.dataset.schema.index is None or target.name != target.context.dataset.schema.index.name:
            raise ValueError("the handle is on no index field")
        target = target.context.dataset
    if not isinstance(labels, DataFrame) and any(v is None for v in labels):
        raise ValueError("null labels")
    kind = target.df.schema[target.index_name].dataType
    if not isinstance(labels, DataFrame):
        labels = target.df.sparkSession.createDataFrame([(i, v) for i, v in enumerate(labels)], f"{plan_index_name} long, {source_index_field} {kind.simpleString()}")
    elif plan_index_name not in labels.columns:
        labels = with_row_id(labels, plan_index_name, labels.columns if dense else None)
    if strict():
        lost = labels.join(target.df.select(F.col(target.index_name).alias("_t")), F.col(source_index_field) == F.col("_t"), "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"labels without a row: {[x[source_index_field] for x in lost]}")
    rest = [c for c in labels.columns if c not in (plan_index_name, source_index_field)]
    schema = Schema((IndexField(plan_index_name), ForeignIndexField(source_index_field, target=target.identity), *(ValueField(c) for c in rest)))
    return Dataset(labels.select(plan_index_name, source_index_field, *rest), schema, sources=target.sources, metadata={"plan": True} | (metadata or {}))


def _plan_from_dataframe(target: Dataset, table, **names) -> Dataset:
    """make_plan() of a Spark or pandas frame; a pandas index gives the plan's labels."""
    name, source = names.get("plan_index_name", "plan_id"), names.get("source_index_field", "source_index")
    if not isinstance(table, DataFrame):
        flat = table.rename_axis(name).reset_index()
        kinds = {source: target.df.schema[target.index_name].dataType.simpleString()}
        made = target.df.sparkSession.createDataFrame(flat)
        table = made.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in kinds.items()})
    return make_plan(target, table, **names)


def _plan_from_series(target: Dataset, series, **names) -> Dataset:
    """make_plan() of a pandas Series of labels; its index gives the plan's labels."""
    return _plan_from_dataframe(target, series.rename(names.get("source_index_field", "source_index")).to_frame(), **names)


make_plan.from_dataframe, make_plan.from_series = _plan_from_dataframe, _plan_from_series


def explode(source: Dataset, plan: Dataset, *, foreign_index_field: str | None = None, overlay_fields: Sequence[str] | None = None, carry: Sequence[str] = ()) -> Dataset:
    """Source rows gathered by the plan's labels, repeats included; fields that both have take the plan's values.

    A null label, or one without a row, fails in the query that meets it. `carry` names plan fields that stay as well.
    """
    key = _foreign(plan, source, foreign_index_field)
    _meets(plan, source, key)
    if plan.couplings:
        warnings.warn(f"the plan's pending columns are left out: {[c.output for c in plan.couplings]}", UserWarning, stacklevel=2)
    if overlay_fields is not None and not overlay_fields:
        raise ValueError("no overlay field is named")
    shared = [f.name for f in plan.values if source.schema.has(f.name) and f.name != source.index_name]
    over = list(overlay_fields) if overlay_fields is not None else shared
    fields, cols = _fields(source, "_s_")
    there = source.df.select(F.col(f"`{source.index_name}`").alias("_si"), F.lit(True).alias("_there"), *cols)
    df = plan.df.join(there.hint("merge"), F.col(f"`{key}`") == F.col("_si"), "left")  # Spark judges a table by its packed file, and broadcast it through the driver
    ok = lambda c: F.when(F.col("_there").isNull(), F.raise_error(F.concat(F.lit("a plan label has no row: "), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null"))))).otherwise(c)
    index = plan.index_name
    out = [ok(F.col(f"`{index}`")).alias(index)]
    for f in fields:
        out += [F.col(f"`{c}`") for c in f.columns] if f.name in over else [F.col(f"`_s_{c}`").alias(c) for c in f.columns]
    out += [F.col(f"`{c}`") for c in carry]
    return Dataset(df.select(*out), Schema((plan.schema.index, *fields, *(plan.schema.get(c) for c in carry))), source.couplings, union_sources(source.sources, plan.sources))


def implode(members: Dataset, plan: Dataset, domain: Dataset | None = None, *, group_ref: str = LEFT, member_ref: str = RIGHT, into: str = "matched"):
    """The members of each group that a plan pairs them with, as a factored bundle; with a domain, also empty groups."""
    from spanweave.operators.groups import partition

    paired = plan.with_(plan.df.where(F.col(member_ref).isNotNull() & F.col(group_ref).isNotNull()))
    gathered = explode(members, paired, foreign_index_field=member_ref, carry=[group_ref])
    return partition(gathered, group_ref, domain, into=into)
