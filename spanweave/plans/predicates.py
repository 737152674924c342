"""Match predicates, and the range join that interval overlap without an equality scope is lowered to."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanweave.dimensions import overlaps


class MatchPredicate:
    """A condition between a left and a right operand. stage: partitioner (equality), pairer (ranges) or filter.

    A subclass gives condition(), which Catalyst plans, or only matches(), which then runs per pair on Arrow batches.
    """

    stage = "filter"

    def matches(self, left: Any, right: Any) -> bool:
        """Whether one left value goes with one right value: what condition() must agree with."""
        raise NotImplementedError

    def correspond(self, left: Sequence, right: Sequence, candidates: Sequence[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        """Positions of the pairs that match, among all or among candidates; for values on the driver."""
        pairs = candidates if candidates is not None else ((i, j) for i in range(len(left)) for j in range(len(right)))
        return [(i, j) for i, j in pairs if self.matches(left[i], right[j])]

    def applies_to(self, left: Any, right: Any) -> bool:
        """Whether fields of these kinds can be compared."""
        return True

    def condition(self, left: Column, right: Column) -> Column:
        return F.coalesce(F.udf(lambda a, b: bool(self.matches(a, b)), "boolean", useArrow=True)(left, right), F.lit(False))


@dataclass(frozen=True)
class equals(MatchPredicate):  # noqa: N801
    """Equal labels; an absent one matches nothing."""

    stage = "partitioner"

    def matches(self, left: Any, right: Any) -> bool:
        return left is not None and right is not None and left == right

    def correspond(self, left: Sequence, right: Sequence, candidates: Sequence[tuple[int, int]] | None = None) -> list[tuple[int, int]]:
        if candidates is not None:
            return super().correspond(left, right, candidates)
        where: dict[Any, list[int]] = {}
        for j, v in enumerate(right):
            where.setdefault(v, []).append(j)
        return [(i, j) for i, v in enumerate(left) if v is not None for j in where.get(v, ())]

    def condition(self, left: Column, right: Column) -> Column:
        return left == right


@dataclass(frozen=True)
class overlap(MatchPredicate):  # noqa: N801
    """Half-open overlap of intervals, the left one padded."""

    pad: float = 0
    stage = "pairer"

    def matches(self, left: Any, right: Any) -> bool:
        if left is None or right is None:
            return False
        (a, b), (c, d) = (tuple(x.values()) if isinstance(x, dict) else (x.start, x.stop) if hasattr(x, "start") else tuple(x) for x in (left, right))
        return None not in (a, b, c, d) and c < b + self.pad and d > a - self.pad

    def applies_to(self, left: Any, right: Any) -> bool:
        return left.comparable_with(right)

    def condition(self, left: Column, right: Column) -> Column:
        return overlaps(left, right, self.pad)


def assert_predicate_contract(predicate: MatchPredicate, left: Sequence, right: Sequence, df: DataFrame | None = None) -> None:
    """correspond() finds what matches() accepts, within candidates too; and, given a frame of all pairs (i, j, left,
    right), so does condition()."""
    expected = {(i, j) for i in range(len(left)) for j in range(len(right)) if predicate.matches(left[i], right[j])}
    assert set(predicate.correspond(left, right)) == expected, "correspond() and matches() differ"
    some = [(i, j) for i in range(len(left)) for j in range(len(right)) if (i + j) % 2 == 0]
    assert set(predicate.correspond(left, right, some)) == expected & set(some), "correspond() leaves its candidates"
    assert predicate.stage in ("partitioner", "pairer", "filter"), "unknown stage"
    if df is not None:
        found = {(r.i, r.j) for r in df.where(predicate.condition(F.col("left"), F.col("right"))).select("i", "j").collect()}
        assert found == expected, "condition() and matches() differ"


#: An interval of level m is at most BASE ** m long and touches SPLIT + 1 cells of its level at most. Cells of about an
#: interval's length compare about two candidates a pair, and send each row two or three times.
BASE, SPLIT = 4.0, 2.0
#: Levels below a value's own magnitude that cells can still be told apart at: 2 * 4 ** 24 is below 2 ** 53.
DEPTH = 24
#: Rows of a cell that stand in one array of the right side, in the order of their starts.
PIECE = 256


def _level(start: Column, stop: Column, pad: float) -> Column:
    """The level of an interval by its length: one long interval among short ones is alone on its level."""
    log = lambda x: F.ceil(F.log(BASE, F.greatest(x, F.lit(1e-30)))).cast("int")
    low, high = start.cast("double") - F.lit(float(pad)), stop.cast("double") + F.lit(float(pad))
    return F.greatest(log(high - low), log(F.greatest(F.abs(low), F.abs(high), F.lit(1e-6))) - F.lit(DEPTH))


def range_join(left: DataFrame, right: DataFrame, a: str, b: str, rest: Column | None, pad: float = 0, scoped: bool = False) -> DataFrame:
    """Inner theta join of interval columns a and b that overlap, and of what else must hold (rest), as an equality join on
    cells of levels.

    Intervals stand at the level of their length. Two of them meet at the coarser one's level: each row stands once in
    each cell that it touches, at its own level and at those coarser levels that the other side has (a scalar subquery
    of the same query, so nothing runs before it). A pair is taken in the one cell of that level where its overlap
    begins. So an outlier of any length only adds a level. No side is crossed, nor broadcast: Spark judges a side by its
    rows before they are dealt to cells. Equalities in the rest (scoped) join the cell as keys, so even one key that
    holds a large share of the rows is dealt out by its cells.

    Without equalities a cell's pairs are as many as its rows squared: its right rows then stand in arrays, which a left row
    joins if it can meet one of them, and the pairs come from the arrays' elements. Elements are compared only in arrays
    that the left row overlaps in part.
    """
    x, y = F.col(a), F.col(b)
    low, high = x["start"].cast("double") - F.lit(float(pad)), x["stop"].cast("double") + F.lit(float(pad))
    l = _flat(left.withColumn("_lv", _level(x["start"], x["stop"], pad)).withColumns({"_la": low, "_lb": high}), a, "l")
    r = _flat(right.withColumn("_rv", _level(y["start"], y["stop"], 0)).withColumns({"_ra": y["start"].cast("double"), "_rb": y["stop"].cast("double")}), b, "r")
    l_has, r_has = l.agg(F.collect_set("_lv")).scalar(), r.agg(F.collect_set("_rv")).scalar()
    grid = lambda v, m: F.floor(v * F.lit(SPLIT) / F.pow(F.lit(BASE), m)).cast("long")

    def dealt(df: DataFrame, p: str, others: Column) -> DataFrame:
        """Levels where something of the other side can meet the row: its own if a level up to it is there, and coarser ones."""
        met = F.array_distinct(F.transform("_has", lambda m: F.greatest(m, F.col(f"{p}v"))))
        at = df.withColumn("_has", F.coalesce(others, F.array().cast("array<int>"))).withColumn(f"{p}l", F.explode(met)).drop("_has")
        at = at.withColumn(f"{p}f", grid(F.col(f"{p}a"), F.col(f"{p}l")))
        return at.withColumn(f"{p}c", F.explode(F.sequence(f"{p}f", F.greatest(grid(F.col(f"{p}b"), F.col(f"{p}l")), F.col(f"{p}f"))))).drop(f"{p}a", f"{p}b")

    same = (F.col("_ll") == F.col("_rl")) & (F.col("_lc") == F.col("_rc"))
    once = (F.col("_ll") == F.greatest("_lv", "_rv")) & (F.col("_lc") == F.greatest("_lf", "_rf"))
    at_l, at_r = dealt(l, "_l", r_has), dealt(r, "_r", l_has)
    meet = overlaps(_ends("_lstart", "_lstop"), _ends("_rstart", "_rstop"), pad)
    met = at_l.join(at_r.hint("merge"), same & once & meet) if scoped else _unpacked(at_l, at_r, same, pad).where(F.col("_sure") | meet)
    found = met.withColumns({a: _ends("_lstart", "_lstop"), b: _ends("_rstart", "_rstop")})
    return (found if rest is None else found.where(rest)).drop("_sure", *(f"_{p}{c}" for p in "lr" for c in ("v", "l", "c", "f", "start", "stop")))


def _ends(start: str, stop: str) -> Column:
    return F.struct(F.col(start).alias("start"), F.col(stop).alias("stop"))


def _unpacked(l: DataFrame, r: DataFrame, same: Column, pad: float) -> DataFrame:
    """The pairs of dealt rows of which an array's ends leave it open whether they overlap, or tell that they do (_sure),
    each in its one cell.

    An array holds rows of one cell that are all at their own level or not, and all begin in the cell or before it, so
    both are told for an array at once. Tasks are as many as the session's shuffle has: the sides' bytes, by which Spark
    would make them fewer, tell nothing of the pairs.
    """
    tasks = int(l.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in r.columns if c not in ("_rl", "_rc", "_rv", "_rf")]
    kinds = {"_rown": F.col("_rl") == F.col("_rv"), "_rnew": F.col("_rc") == F.col("_rf")}
    alike = ["_rl", "_rc", *kinds]
    nth = F.row_number().over(Window.partitionBy(*alike).orderBy("_rstart")) - 1
    r = r.repartition(tasks, "_rl", "_rc").withColumns(kinds).withColumn("_piece", F.floor(nth / F.lit(PIECE)))
    bounds = {"_rmin": F.min("_rstart"), "_rmax": F.max("_rstop"), "_rlast": F.max("_rstart"), "_rfirst": F.min("_rstop")}
    arrays = r.groupBy(*alike, "_piece").agg(*(c.alias(n) for n, c in bounds.items()), F.collect_list(F.struct(*rest)).alias("_rows"))
    arrays = arrays.select(*alike, *bounds, *(F.col("_rows")[c].alias("_all" + c) for c in rest))

    once = (F.col("_rown") | (F.col("_ll") == F.col("_lv"))) & (F.col("_rnew") | (F.col("_lc") == F.col("_lf")))
    left = _ends("_lstart", "_lstop")
    can, sure = overlaps(left, _ends("_rmin", "_rmax"), pad), overlaps(left, _ends("_rlast", "_rfirst"), pad)
    met = l.repartition(tasks, "_ll", "_lc").join(arrays.hint("merge"), same & once & can).withColumn("_sure", sure)
    first, *more = rest
    kept = [c for c in l.columns if c in ("_lstart", "_lstop") or not c.startswith("_l")]
    pairs = met.select(*kept, "_sure", *("_all" + c for c in more), F.posexplode("_all" + first).alias("_at", first))
    return pairs.select(*kept, "_sure", first, *(F.get("_all" + c, F.col("_at")).alias(c) for c in more))


def _flat(df: DataFrame, name: str, p: str) -> DataFrame:
    """The level's rows with an interval's ends as columns: candidates are compared without a look into structs. No filter
    on the level, which is never null: Spark would compute an interval anew for each of its mentions there."""
    return df.withColumns({f"_{p}start": F.col(name)["start"], f"_{p}stop": F.col(name)["stop"]}).drop(name)
