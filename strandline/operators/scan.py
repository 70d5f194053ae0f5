"""Running values along time without one window over a whole domain.

A domain's rows are cut into cells of time. A window scans each cell by itself; each cell is summed up in one row; the
cells' rows, a few for each domain, are scanned in turn; and what comes out of earlier cells is added to the cell's own
values. A domain with nine tenths of all rows is thus as many tasks as it has cells.

A cell is `width` wide, or, where it would hold more than `most` rows, one of up to SPLITS equal parts of that. Which cells
are so dense is one count by cell beforehand; there are fewer than rows / most of them, and that list is broadcast. Rows of
one time stay in one cell. Times are integers and domains are not null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000
#: Rows of a cell beyond which it is split, and into how many parts at most (a power of two).
CELL_ROWS, SPLITS = 500_000, 4_096
CELL = "_cell"


def coarse(time: str, width: int) -> Column:
    """Number of the cell of full width, exact for all 64-bit times and below 0 too."""
    return F.expr(f"(`{time}` - pmod(`{time}`, {width}L)) div {width}L")


class Cells:
    """How the times of a table are cut: a rule that other columns of times can be cut by as well."""

    def __init__(self, df: DataFrame, by: Sequence[str], time: str, width: int = DAY, most: int = CELL_ROWS):
        self.by, self.width = list(by), width
        counts = df.select(*by, coarse(time, width).alias("_coarse")).groupBy(*by, "_coarse").agg(F.count("*").alias("_n")).where(F.col("_n") > most)
        parts = F.least(F.lit(SPLITS), F.expr(f"shiftleft(1, cast(ceil(log2(_n / {most})) as int))"))
        self.dense = counts.select(*by, "_coarse", parts.cast("long").alias("_parts"))

    def put(self, df: DataFrame, time: str, name: str = CELL) -> DataFrame:
        """df with the cell of `time` as `name`: cells are numbered in the order of time."""
        found = df.withColumn("_coarse", coarse(time, self.width)).join(F.broadcast(self.dense), [*self.by, "_coarse"], "left")
        part = F.coalesce(F.expr(f"pmod(`{time}`, {self.width}L) * _parts div {self.width}L"), F.lit(0))
        return found.withColumn(name, F.col("_coarse") * SPLITS + part).drop("_coarse", "_parts")


def scanned(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, reach: Mapping[str, Column] | None = None, lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None, totals: Mapping[str, Column] | None = None, width: int = DAY, most: int = CELL_ROWS, keep: bool = False,
) -> DataFrame:
    """df with running values along `order` (its first column is the time), in each domain `by`:

    sums: so far, this row included (null counts as 0). reach: the highest of earlier rows. lags, leads: the value of the
    row before, after. totals: the sum over the domain, on every row. keep: leave the cells for a next scan.
    """
    by, order = list(by), list(order)
    sums, reach, lags, leads, totals = (dict(x or {}) for x in (sums, reach, lags, leads, totals))
    if CELL not in df.columns:
        df = Cells(df, by, order[0], width, most).put(df, order[0])
    names = [c for c in df.columns if c not in {*sums, *reach, *lags, *leads, *totals}]
    boxed = {n: F.struct(c.alias("v")) for n, c in (lags | leads).items()}  # tells a null value from no row
    inputs = {n: F.coalesce(c, F.lit(0)) for n, c in (sums | totals).items()} | reach | boxed
    rows = df.select(*names, *[c.alias(f"_in_{n}") for n, c in inputs.items()])

    here = Window.partitionBy(*by, CELL).orderBy(*order)
    upto, before = here.rowsBetween(Window.unboundedPreceding, 0), here.rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        *names, *[F.sum(f"_in_{n}").over(upto).alias(f"_own_{n}") for n in sums], *[F.max(f"_in_{n}").over(before).alias(f"_own_{n}") for n in reach],
        *[F.lag(f"_in_{n}").over(here).alias(f"_own_{n}") for n in lags], *[F.lead(f"_in_{n}").over(here).alias(f"_own_{n}") for n in leads],
    )
    place = F.struct(*order)
    each = rows.groupBy(*by, CELL).agg(
        F.count("*").alias("_rows"), *[F.sum(f"_in_{n}").alias(n) for n in (*sums, *totals)], *[F.max(f"_in_{n}").alias(n) for n in reach],
        *[F.max_by(f"_in_{n}", place).alias(n) for n in lags], *[F.min_by(f"_in_{n}", place).alias(n) for n in leads],
    )
    cells = Window.partitionBy(*by).orderBy(CELL)
    earlier, later = cells.rowsBetween(Window.unboundedPreceding, -1), cells.rowsBetween(1, Window.unboundedFollowing)
    carried = each.select(
        *by, CELL, *[F.sum(n).over(earlier).alias(f"_far_{n}") for n in sums], *[F.max(n).over(earlier).alias(f"_far_{n}") for n in reach], *[F.last(n).over(earlier).alias(f"_far_{n}") for n in lags],
        *[F.first(n).over(later).alias(f"_far_{n}") for n in leads], *[F.sum(n).over(Window.partitionBy(*by)).alias(f"_far_{n}") for n in totals],
    )
    own, far = (lambda n: F.col(f"_own_{n}")), (lambda n: F.col(f"_far_{n}"))
    out = local.join(carried, [*by, CELL], "left").select(
        *names, *[(own(n) + F.coalesce(far(n), F.lit(0))).alias(n) for n in sums], *[F.greatest(own(n), far(n)).alias(n) for n in reach],
        *[F.coalesce(own(n), far(n)).getField("v").alias(n) for n in (*lags, *leads)], *[far(n).alias(n) for n in totals],
    )
    return out if keep else out.drop(CELL)


def with_predecessors(df: DataFrame, by: Sequence[str], order: Sequence[str], value: Column, lags: int, name: str = "previous", width: int = DAY, most: int = CELL_ROWS) -> DataFrame:
    """df with an array of the values of up to `lags` rows before, nearest first.

    Each cell gets the last rows of the cells before it as a halo; `lags` cells are enough, as no cell is empty.
    """
    by, order = list(by), list(order)
    names = [c for c in df.columns if c != name]
    rows = Cells(df, by, order[0], width, most).put(df, order[0]).withColumn("_value", F.struct(value.alias("v")))
    here = Window.partitionBy(*by, CELL).orderBy(*order)
    ends = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*by, CELL).orderBy(*[F.desc(c) for c in order]))).where(F.col("_back") <= lags)
    tails = ends.groupBy(*by, CELL).agg(F.array_sort(F.collect_list(F.struct("_back", "_value"))).alias("_tail"))
    near = Window.partitionBy(*by).orderBy(F.desc(CELL)).rowsBetween(1, lags)
    halo = tails.select(*by, CELL, F.slice(F.transform(F.flatten(F.collect_list("_tail").over(near)), lambda x: x["_value"]), 1, lags).alias("_halo"))
    own = F.array_compact(F.array(*[F.lag("_value", k).over(here) for k in range(1, lags + 1)]))
    both = rows.withColumn("_own", own).drop("_value").join(halo, [*by, CELL], "left")
    joined = F.slice(F.concat("_own", F.coalesce("_halo", F.array().cast(both.schema["_own"].dataType))), 1, lags)
    return both.select(*names, F.transform(joined, lambda x: x["v"]).alias(name))
