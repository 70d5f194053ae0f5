"""As-of joins as one union and one window; no pairs are made.

Right rows and left rows of a domain are put in one order of time; the last right row so far is each left row's match.
A domain is cut into time buckets, so that one dominant domain is many window groups; what a bucket needs from earlier
ones is their last right row, carried over by a running value on one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def asof_join(
    left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, values: Sequence[str], ties: Sequence[str] = (),
    prefix: str = "r_", bucket: int | None = DAY, forward: bool = False, strict: bool = False,
) -> DataFrame:
    """left with `values` of the latest right row at or before (forward: first at or after) each left time, else null.

    Right rows of one time are ordered by `ties`; the highest wins backward, the lowest forward. strict: only before
    (or after), not at the left time. bucket: width of a time bucket in the unit of time, None for one for all.
    """
    by = list(by)
    sign = -1 if forward else 1
    payload = F.struct(*[F.col(v).alias(v) for v in values])
    order = F.struct(*[(F.col(t) * sign).alias(f"k{i}") for i, t in enumerate(ties)]) if ties else F.struct(F.lit(0).alias("k0"))
    cell = (lambda t: (F.floor(t / bucket) * sign).cast("long")) if bucket else (lambda t: F.lit(0).cast("long"))
    # At one time right rows come before left rows, unless the match must be strict.
    r = right.select(*by, cell(F.col(right_time)).alias("_cell"), (F.col(right_time) * sign).alias("_t"), F.lit(1 if strict else 0).alias("_side"), order.alias("_order"), payload.alias("_value"))
    names = [c for c in left.columns if c not in by]
    none = F.lit(None)
    l_rows = left.select(*by, cell(F.col(left_time)).alias("_cell"), (F.col(left_time) * sign).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.struct(*names).alias("_left"))
    both = r.withColumn("_left", none.cast(l_rows.schema["_left"].dataType)).unionByName(
        l_rows.withColumn("_order", none.cast(r.schema["_order"].dataType)).withColumn("_value", none.cast(r.schema["_value"].dataType))
    )
    w = Window.partitionBy(*by, "_cell").orderBy("_t", "_side", "_order").rowsBetween(Window.unboundedPreceding, 0)
    matched = both.withColumn("_match", F.last("_value", ignorenulls=True).over(w)).where("_left IS NOT NULL")
    if bucket:
        last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.struct("_t", "_order"))).alias("_last")
        ends = both.groupBy(*by, "_cell").agg(last)
        before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*by, "_cell", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
        matched = matched.join(carried, [*by, "_cell"], "left").withColumn("_match", F.coalesce("_match", "_carry"))
    return matched.select(*by, "_left.*", *[F.col(f"_match.{v}").alias(f"{prefix}{v}") for v in values])


def fresh(value: Column, at: Column, source: Column, tolerance: int) -> Column:
    """value if its source time is at most `tolerance` before `at`; a stale match is null and not searched further."""
    return F.when(at - source <= tolerance, value)
