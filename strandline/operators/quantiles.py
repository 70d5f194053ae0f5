"""Exact quantiles by rank, without sorting a large group.

A small group's distinct values are counted and ranked by a window. A large one is first cut into ranges of values at
splitters that a mergeable sketch suggests; exact counts of the ranges say which range holds the wanted rank, and only that
range's rows are counted further, in the same way. A value that is a splitter is a range of its own, so that a value that
most rows have ends the search, and every other range has a small part of the group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.spans import stepped
from strandline.sources.checkpoints import cut

#: Rows of a group up to which its distinct values go through one window.
GROUP_ROWS = 1_000_000
#: Ranges into which a larger group is cut at once: one list of splitters for each such group is broadcast, and there are
#: fewer of these groups than rows / GROUP_ROWS.
RANGES = 64


def _ranked(counts: DataFrame, by: list[str]) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("_v")
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(*by, "_v", (upto - F.col("_c")).alias("_below"), upto.alias("_upto"))


def _selected(rows: DataFrame, sizes: DataFrame, wanted: DataFrame, by: list[str], most: int) -> DataFrame:
    """(by, _id, _v): of rows (by, _v) the value at rank _r (from 1) for each of wanted (by, _id, _r); sizes has (by, n)."""
    holds = (F.col("_below") < F.col("_r")) & (F.col("_r") <= F.col("_upto"))
    large = sizes.where(F.col("n") > most).select(*by)
    some = not large.isEmpty()
    small = (rows.join(F.broadcast(large), by, "left_anti") if some else rows).groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    out = _ranked(small, by).join(wanted, by).where(holds).select(*by, "_id", "_v")
    if not some:
        return out
    steps = [k / RANGES for k in range(1, RANGES)]
    splitters = cut(rows.join(F.broadcast(large), by).groupBy(*by).agg(F.array_distinct(F.percentile_approx("_v", steps, 1_000)).alias("_cuts")))
    # Below the k-th splitter and above the one before it: 2 k; the splitter itself: 2 k + 1.
    place = 2 * F.size(F.filter("_cuts", lambda x: x < F.col("_v"))) + F.array_contains("_cuts", F.col("_v")).cast("int")
    placed = rows.join(F.broadcast(splitters), by).select(*by, "_v", place.alias("_range"))
    ranges = placed.groupBy(*by, "_range").agg(F.count("*").alias("_c"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    upto = F.sum("_c").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    found = ranges.select(*by, "_range", "_least", "_most", (upto - F.col("_c")).alias("_below"), upto.alias("_upto")).join(wanted, by).where(holds)
    found = cut(found.select(*by, "_range", "_id", (F.col("_r") - F.col("_below")).alias("_r"), "_least", "_most"))
    out = out.unionByName(found.where("_least = _most").select(*by, "_id", F.col("_least").alias("_v")))
    open_ = found.where("_least <> _most").drop("_least", "_most")
    if open_.isEmpty():
        return out
    inside = placed.join(F.broadcast(open_.select(*by, "_range").distinct()), [*by, "_range"], "left_semi")
    sizes = cut(inside.groupBy(*by, "_range").agg(F.count("*").alias("n")))
    # Ranges of different depths of the search are told apart by their columns' names.
    deeper = [*by, f"_range{len(by)}"]
    inside, sizes, open_ = (x.withColumnRenamed("_range", deeper[-1]) for x in (inside, sizes, open_))
    return out.unionByName(_selected(inside, sizes, open_, deeper, most).select(*by, "_id", "_v"))


def at_ranks(df: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, Column], most: int = GROUP_ROWS) -> DataFrame:
    """(by, n, name...): the values at ranks (from 1), given as columns of n, the number of rows with a value.

    A group without a value has no row. Keys are not null.
    """
    keys, by = list(by), list(by) or ["_all"]
    rows = df.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("_all")]), F.col(value).alias("_v"))
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("n")))
    each = F.array(*[F.struct(F.lit(name).alias("_id"), rank.cast("long").alias("_r")) for name, rank in ranks.items()])
    wanted = sizes.select(*by, F.inline(each))
    found = _selected(rows, sizes, wanted, by, most).groupBy(*by).agg(*[F.max(F.when(F.col("_id") == name, F.col("_v"))).alias(name) for name in ranks])
    return sizes.join(found, by, "left").select(*keys, "n", *ranks)


def _scaled(p: str) -> tuple[int, int]:
    """p as a fraction with a power of ten below; 0.95 in binary could move a rank by one."""
    d = Decimal(p)
    scale = 10 ** max(0, -d.as_tuple().exponent)
    return int(d * scale), scale


def nearest_ranks(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[str], names: Sequence[str] | None = None, most: int = GROUP_ROWS) -> DataFrame:
    """One row for each group: n, and for each p (a decimal string) the value at rank ceil(p * n), 1-based."""
    ranks = {}
    for p, name in zip(probabilities, names or [f"p{x}" for x in probabilities], strict=True):
        part, scale = _scaled(p)
        ranks[name] = F.expr(f"(n * {part} + {scale - 1}) div {scale}")
    return at_ranks(df, by, value, ranks, most)


def type7(df: DataFrame, by: Sequence[str], value: str, probabilities: Sequence[str], names: Sequence[str] | None = None, most: int = GROUP_ROWS) -> DataFrame:
    """Linearly interpolated quantiles (as DOUBLE) from two exact ranks; n = 0 gives no row."""
    names = list(names or [f"p{x}" for x in probabilities])
    ranks, parts = {}, []
    for p, name in zip(probabilities, names, strict=True):
        part, scale = _scaled(p)
        low = F.expr(f"((n - 1) * {part}) div {scale}")
        ranks |= {f"_low_{name}": low + 1, f"_high_{name}": F.least(low + 2, F.col("n"))}
        parts.append(F.expr(f"((n - 1) * {part}) % {scale}") / F.lit(float(scale)))
    found = at_ranks(df, by, value, ranks, most)
    between = [(F.col(f"_low_{n}").cast("double") + (F.col(f"_high_{n}").cast("double") - F.col(f"_low_{n}").cast("double")) * f).alias(n) for n, f in zip(names, parts, strict=True)]
    return found.select(*by, "n", *between)


def median(df: DataFrame, by: Sequence[str], value: str, name: str = "median", most: int = GROUP_ROWS) -> DataFrame:
    """Mean of the two middle values, as twice_median (exact) and DOUBLE."""
    found = at_ranks(df, by, value, {"_low": F.expr("(n + 1) div 2"), "_high": F.expr("n div 2 + 1")}, most)
    twice = F.col("_low") + F.col("_high")
    return found.select(*by, "n", twice.alias(f"twice_{name}"), (twice / F.lit(2.0)).alias(name))


def positive_deltas(df: DataFrame, by: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """(by, delta): steps between neighbours in time that are greater than 0."""
    return stepped(df.select(*by, time, *ties), by, time, ties).select(*by, F.col("step").alias("delta")).where("delta > 0")


def chronological_edge(df: DataFrame, time: str, most: int = GROUP_ROWS) -> DataFrame:
    """One row with edge: the time of the last row of the first half (n div 2 rows); no row if that half is empty."""
    return at_ranks(df, [], time, {"edge": F.expr("n div 2")}, most).where("edge IS NOT NULL").select("edge")


def share(flag: Column) -> Column:
    return F.avg(flag.cast("double"))
