"""Operators on ordered rows: quotas, projections, streaks, neighbours, as-of lookups.

Windows over a key's rows would put a hot key into one task. So rows are cut
into slices of the first order column, at quantiles of all rows, and windows run
by key and slice; what a slice needs from those before it (a sum, a last value)
comes from a small table of one row a key and slice. Equal values of that column
share a slice, so a column of few values can't be cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows of a slice, about; and the most slices.
SLICE_ROWS = 2_000_000
MOST_SLICES = 1024


def sliced(rows: DataFrame, order: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with ``__slice``, which rises with ``order``; nulls are in slice 0.

    A column that is no number, date or timestamp isn't cut.

    Bounds are approximate quantiles, 1,023 numbers at most, found in one pass
    and then fixed, so a row's slice is the same whenever it is computed, by binary search.
    """
    place, kind = F.col(order), dict(rows.dtypes)[order]
    if kind.startswith("timestamp"):
        place = F.unix_micros(place.cast("timestamp"))
    elif kind == "date":
        place = F.unix_date(place)
    elif kind in ("string", "binary", "boolean") or kind.startswith(("struct", "array")):
        return rows.withColumn("__slice", F.lit(0))
    n = min(MOST_SLICES, -(-rows.count() // slice_rows))
    if n <= 1:
        return rows.withColumn("__slice", F.lit(0))
    found = rows.agg(F.percentile_approx(place, [i / n for i in range(1, n)], 10 * n)).first()[0] or []
    bounds = sorted(set(found))

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(place > bounds[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return rows.withColumn("__slice", search(0, len(bounds)))


def _with_carried(rows: DataFrame, by: Sequence[str], facts: Sequence[Column], carry: dict[str, Column]) -> DataFrame:
    """``rows`` with, for each slice of a key, what ``carry`` makes of the ``facts`` of the key's other slices."""
    per = rows.groupBy(*by, "__slice").agg(*facts)
    per = per.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(by)), F.col("__slice").alias("__s"), *(c.over(w).alias(n) for n, (c, w) in ((n, (c, _slices(by, way))) for n, (c, way) in carry.items())))
    met = F.col("__slice") == F.col("__s")
    for i, k in enumerate(by):
        met &= F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(per, met).drop("__s", *(f"__k{i}" for i in range(len(by))))


def _slices(by: Sequence[str], way: str):
    w = W.partitionBy(*by).orderBy("__slice")
    return w.rowsBetween(W.unboundedPreceding, -1) if way == "before" else w


def _sum_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], amount: str, name: str, *, ties: bool = False) -> DataFrame:
    """``rows`` (sliced) with the sum over the rows before each; with ``ties`` over those, itself and its equals."""
    w = W.partitionBy(*by, "__slice").orderBy(*order)
    own = F.sum(amount).over(w.rangeBetween(W.unboundedPreceding, 0) if ties else w.rowsBetween(W.unboundedPreceding, -1))
    carried = _with_carried(rows, by, [F.sum(amount).alias("__total")], {"__base": (F.sum("__total"), "before")})
    return carried.withColumn(name, F.coalesce(own, F.lit(0)) + F.coalesce("__base", F.lit(0))).drop("__base")


def _beside(rows: DataFrame, by: Sequence[str], order: Sequence[str], column: str) -> DataFrame:
    """``rows`` (sliced) with ``__back`` and ``__next``: the column in the rows before and after, and ``__first``."""
    w, place = W.partitionBy(*by, "__slice").orderBy(*order), F.struct(*order)
    facts = [F.min_by(column, place).alias("__head"), F.max_by(column, place).alias("__tail")]
    carried = _with_carried(rows, by, facts, {"__before": (F.lag("__tail"), "all"), "__after": (F.lead("__head"), "all"), "__nth": (F.row_number(), "all")})
    first, last = F.row_number().over(w) == 1, F.lead(F.lit(1)).over(w).isNull()
    carried = carried.withColumn("__first", first & (F.col("__nth") == 1))
    carried = carried.withColumn("__back", F.when(first, F.col("__before")).otherwise(F.lag(column).over(w))).withColumn("__next", F.when(last, F.col("__after")).otherwise(F.lead(column).over(w)))
    return carried.drop("__before", "__after", "__nth")


def quota(requests: DataFrame, by: Sequence[str], order: Sequence[str], amount: str, cap: int, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """What each request is granted, in order, until ``cap`` is used up."""
    before = _sum_before(sliced(requests, order[0], slice_rows), by, order, amount, "__before")
    return before.withColumn("granted", F.least(F.col(amount), F.greatest(F.lit(0), F.lit(cap) - F.col("__before")))).drop("__before", "__slice")


def project(events: DataFrame, by: Sequence[str], field: str, value: str, seq: str) -> DataFrame:
    """The last value written to each field."""
    return events.groupBy(*by, field).agg(F.max_by(value, seq).alias("value"), F.max(seq).alias("seq"))


def first_of(events: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """One row per key, the first in order: an idempotent append."""
    others = [c for c in events.columns if c not in by]
    kept = events.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("__e"))
    return kept.select(*by, *(F.col(f"__e.{c}").alias(c) for c in others))


def streaks(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, least: int, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Runs of at least ``least`` consecutive rows with the same value; nulls are one value."""
    needed = rows.select(*dict.fromkeys([*by, *order, value]))
    beside = _beside(sliced(needed, order[0], slice_rows), by, order, value)
    new = beside.withColumn("__new", (F.col("__first") | ~F.col(value).eqNullSafe(F.col("__back"))).cast("int"))
    island = _sum_before(new, by, order, "__new", "__i").withColumn("__i", F.col("__i") + F.col("__new"))
    runs = island.groupBy(*by, value, "__i").agg(F.count("*").alias("length"), F.min(order[0]).alias("first"), F.max(order[0]).alias("last"))
    return runs.where(F.col("length") >= least).drop("__i")


def neighbours(rows: DataFrame, by: Sequence[str], order: Sequence[str], text: str, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Each text with the one before and after it, joined by spaces."""
    beside = _beside(sliced(rows, order[0], slice_rows), by, order, text)
    return beside.withColumn("context", F.concat_ws(" ", "__back", text, "__next")).select(*rows.columns, "context")


def last_before(rows: DataFrame, by: Sequence[str], order: Sequence[str], mark: Column, value: str, name: str, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """For each row the value of the last row before it, or itself, that has the mark."""
    marked = sliced(rows, order[0], slice_rows).withColumn("__v", F.when(mark, F.col(value)))
    w = W.partitionBy(*by, "__slice").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    there = F.when(F.col("__v").isNotNull(), F.struct(*order))
    carried = _with_carried(marked, by, [F.max_by("__v", there).alias("__tail")], {"__carried": (F.last("__tail", ignorenulls=True), "before")})
    return carried.withColumn(name, F.coalesce(F.last("__v", ignorenulls=True).over(w), F.col("__carried"))).drop("__v", "__slice", "__carried")


def resolve(facts: DataFrame, by: str, priority: Column, value: str, *, volatile: Column, time: str, confidence: str) -> DataFrame:
    """The value of the strongest layer per dimension, or null and UNRESOLVED_CONFLICT.

    Values that differ there beyond case and outer blanks are a conflict, but
    if all facts are volatile and dated the newest wins, if no other value is
    as new; else a fact with strictly more confidence than all others does. An
    undated fact has no ``time``. Three aggregations that combine before their
    shuffles, and a join of one row per dimension.
    """
    said = facts.select(by, priority.alias("__p"), F.lower(F.trim(F.col(value).cast("string"))).alias("__said"), F.col(value).alias("__v"), (volatile & F.col(time).isNotNull()).alias("__live"), F.col(time).alias("__t"), F.col(confidence).alias("__c"))
    values = said.groupBy(by, "__p", "__said").agg(F.min("__v").alias("__v"), F.bool_and("__live").alias("__live"))
    level = values.groupBy(by, "__p").agg(F.count("*").alias("n_values"), F.min("__v").alias("__v"), F.bool_and("__live").alias("__live"))
    best = level.groupBy(by).agg(F.max_by(F.struct("__p", "n_values", "__v", "__live"), "__p").alias("b"))

    def strongest(order: str, what: Column, name: str) -> DataFrame:
        each = said.where(F.col(order).isNotNull()).groupBy(by, "__p", order).agg(what.alias("__n"), F.max_by("__v", F.struct("__c", "__v")).alias("__v"))
        return each.groupBy(by).agg(F.max_by(F.struct("__p", "__n", "__v"), F.struct("__p", order)).alias(name))

    newest = strongest("__t", F.count_distinct("__said"), "t")
    surest = strongest("__c", F.count("*"), "c")
    joined = best.join(newest, by, "left").join(surest, by, "left")
    conflict = F.col("b.n_values") > 1
    # the two tables may know other layers than the top one, where that has no time or confidence
    by_time = F.when((F.col("t.__p") == F.col("b.__p")) & (F.col("t.__n") == 1), F.col("t.__v"))
    by_trust = F.when((F.col("c.__p") == F.col("b.__p")) & (F.col("c.__n") == 1), F.col("c.__v"))
    won = F.when(~conflict, F.col("b.__v")).when(F.col("b.__live"), by_time).otherwise(by_trust)
    return joined.select(by, won.alias("value"), F.col("b.__p").alias("priority"), F.col("b.n_values").alias("n_values"), F.when(conflict & won.isNull(), "UNRESOLVED_CONFLICT").otherwise("RESOLVED").alias("status"))


def top_k(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark keeps k rows a key and task before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def split_at(rows: DataFrame, by: Sequence[str], order: Sequence[Column], cap: int) -> DataFrame:
    """All rows; those past ``cap`` are UNPROCESSED rather than gone."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("state", F.when(rank <= cap, "PROCESSED").otherwise("UNPROCESSED"))


def shifts(clusters: DataFrame, by: Sequence[str], start: str, name: str) -> DataFrame:
    """Pairs of consecutive clusters, where the later one starts strictly later."""
    w = W.partitionBy(*by).orderBy(start, name)
    pairs = clusters.select(*by, F.col(name).alias("earlier"), F.col(start).alias("earlier_start"), F.lead(name).over(w).alias("later"), F.lead(start).over(w).alias("later_start"))
    return pairs.where(F.col("later_start") > F.col("earlier_start"))


def tolerance_clusters(values: DataFrame, by: Sequence[str], value: str, tolerance: float, *, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Sorted values in clusters: one joins if it is within ``tolerance`` of the mean of those before it in the cluster.

    A step over ``tolerance`` always begins a cluster, as the mean is below the
    last value; so keys are cut into such runs in a distributed way first, and
    only the distinct values of one run are folded in order.
    """
    # equal values join together, so each counts once and carries its number
    counted = values.groupBy(*by, value).agg(F.count("*").alias("__rows"))
    beside = _beside(sliced(counted, value, slice_rows), by, [value], value)
    marked = beside.withColumn("__n", F.when(F.col(value) - F.col("__back") > tolerance, 1).otherwise(0))
    placed = _sum_before(marked, by, [value], "__n", "__run", ties=True)
    run = placed.groupBy(*by, "__run").agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v"), F.col("__rows").alias("n")))).alias("__all"))

    def fresh(x: Column) -> Column:
        return F.struct(x["v"].alias("centre"), x["n"].alias("members"), x["v"].alias("least"), x["v"].alias("greatest"))

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        members = last["members"] + x["n"]
        grown = F.struct(((last["centre"] * last["members"] + x["v"] * x["n"]) / members).alias("centre"), members.alias("members"), last["least"].alias("least"), x["v"].alias("greatest"))
        return F.when(x["v"] - last["centre"] <= tolerance, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(fresh(x))))

    rest = F.slice("__all", 2, F.size("__all"))
    folded = run.select(*by, F.explode(F.aggregate(rest, F.array(fresh(F.element_at("__all", 1))), step)).alias("c"))
    return folded.select(*by, F.col("c.members").alias("members"), F.col("c.least").alias("least"), F.col("c.greatest").alias("greatest"))
