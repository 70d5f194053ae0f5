"""As-of join on two clocks: the latest right row, by its first clock, that is not later than the left row on either clock.

A wall clock may run back, so that the nearest row may be barred and an older one is wanted, at any distance. No pairs are
made. Inside a cell of the first clock, right and left rows are put in one order, and each left row skips back over barred
rows by powers of two: the least wall clock of every run of 2**k rows is known. A left row whose own cell bars every row
asks which earlier cell is the latest with a row that is not barred; that is the same question, with one row (its least
wall clock) for each cell, and is answered in the same way. So a left row is looked at in its own cell, in the cell of the
answer and once for each level between, and there are never more rows than left and right rows together.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.scan import CELL, CELL_ROWS, DAY, SPLITS, Cells
from strandline.sources.checkpoints import cut

#: Cells of full width that make one of the next level.
FAN = 64
#: Width of a cell of the first level; dense cells are split by Cells.
WIDTH = 64 * DAY
LAST, NEVER = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def latest_allowed(walls: np.ndarray, starts: np.ndarray, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """For each query the last place j <= at in its group (from starts[j] on) with walls[j] <= limit, or -1."""
    place, first = at.copy(), starts[at]
    longest = int((np.arange(len(walls)) - starts).max(initial=0)) + 1
    least = [walls]  # least[k][i]: of the 2**k places that end at i
    while 2 ** len(least) <= longest:
        half, below = 2 ** (len(least) - 1), least[-1]
        both = below.copy()
        both[half:] = np.minimum(below[half:], below[:-half])
        least.append(both)
    for k in reversed(range(len(least))):
        inside = place - 2**k + 1 >= first
        barred = inside & (least[k][np.maximum(place, 0)] > limit)
        place = np.where(barred, place - 2**k, place)
    return np.where(place >= first, place, -1)


def _in_cells(left: DataFrame, right: DataFrame, by: list[str], ties: list[str], most: int) -> DataFrame:
    """left (by, CELL, _m, _w, _left) with _value, that of its cell's latest allowed row, and _met."""
    nothing = F.lit(None)
    kinds = dict(right.dtypes)
    l_rows = left.select(*by, CELL, "_m", "_w", F.lit(1).alias("_side"), *[nothing.cast(kinds[t]).alias(t) for t in ties], "_left", nothing.cast(right.schema["_value"].dataType).alias("_value"))
    r_rows = right.select(*by, CELL, "_m", "_w", F.lit(0).alias("_side"), *ties, nothing.cast(left.schema["_left"].dataType).alias("_left"), "_value")
    rows = r_rows.unionByName(l_rows)
    buckets = max(left.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // most))
    groups = [*by, CELL]

    def run(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in (*groups, "_m", "_side", "_w", *ties)])
        table = table.take(order).combine_chunks()
        code = table.select(groups).to_pandas().groupby(groups, sort=False, dropna=False).ngroup().to_numpy()
        starts = np.maximum.accumulate(np.where(np.diff(code, prepend=-1) != 0, np.arange(len(code)), 0))
        is_left = table.column("_side").to_numpy() == 1
        wall = table.column("_w").fill_null(NEVER).to_numpy()
        at = np.flatnonzero(is_left)
        found = latest_allowed(np.where(is_left, LAST, wall), starts, at, np.minimum(wall[at], LAST - 1))
        met = found >= 0
        value = table.column("_value").take(pa.array(found, mask=~met))
        out = table.select([*by, CELL, "_w", "_left"]).take(pa.array(at))
        return out.append_column("_value", value).append_column("_met", pa.array(met))

    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*groups), F.lit(buckets)))
    schema = left.select(*by, CELL, "_w", "_left").schema.add("_value", right.schema["_value"].dataType, True).add("_met", "boolean")
    return dealt.groupBy("_bucket").applyInArrow(run, schema)


def _latest(left: DataFrame, right: DataFrame, by: list[str], ties: list[str], width: int, most: int) -> DataFrame:
    """(by, _left, _value) for each of left (by, _m, _w, _left); right has (by, _m, _w, ties, _value)."""
    cells = Cells(left.select(*by, "_m").unionByName(right.select(*by, "_m")), by, "_m", width, most)
    right = cut(cells.put(right, "_m"))
    found = cut(_in_cells(cells.put(left, "_m"), right, by, ties, most))
    result = [*by, "_left", "_value"]
    least = right.groupBy(*by, CELL).agg(F.min("_w").alias("_w"))
    if least.groupBy(*by).count().where("count > 1").isEmpty() or found.where("NOT _met").isEmpty():
        return found.select(*result)
    # Counted from the first one, so that at some level all cells are one.
    low = int(least.agg(F.min(CELL)).first()[0])
    open_ = found.where("NOT _met").select(*by, (F.col(CELL) - low - 1).alias("_m"), "_w", F.struct("_w", "_left").alias("_left"))
    place = least.select(*by, (F.col(CELL) - low).alias("_m"), "_w", F.struct(F.col(CELL).alias("cell")).alias("_value"))
    answer = cut(_latest(open_, place, by, [], FAN * SPLITS, max(most, FAN)))
    there = answer.where("_value IS NOT NULL").select(*by, F.col("_value.cell").alias(CELL), F.lit(int(LAST)).alias("_m"), F.col("_left._w").alias("_w"), F.col("_left._left").alias("_left"))
    wanted = right.join(there.select(*by, CELL).distinct(), [*by, CELL], "left_semi")
    nowhere = answer.where("_value IS NULL").select(*by, F.col("_left._left").alias("_left"), F.lit(None).cast(right.schema["_value"].dataType).alias("_value"))
    return found.where("_met").select(*result).unionByName(_in_cells(there, wanted, by, ties, most).select(*result)).unionByName(nowhere)


def dual_clock_asof(
    left: DataFrame, right: DataFrame, by: Sequence[str], mono: str, wall: str, right_mono: str, right_wall: str, values: Sequence[str], ties: Sequence[str],
    lookback: int | None = None, prefix: str = "r_", width: int = WIDTH, most: int = CELL_ROWS,
) -> DataFrame:
    """left with `values` of the latest right row, by (mono, wall, ties), with both clocks at or before the left row's.

    lookback: a match that is more than this back in mono is none. A row without one of its clocks matches nothing.
    """
    by = list(by)
    l_rows = left.select(*by, F.col(mono).alias("_m"), F.col(wall).alias("_w"), F.struct(*left.columns).alias("_left"))
    own = [f"_tie{k}" for k in range(len(ties))]
    r_rows = right.where(F.col(right_mono).isNotNull() & F.col(right_wall).isNotNull()).select(
        *by, F.col(right_mono).alias("_m"), F.col(right_wall).alias("_w"), *[F.col(t).alias(o) for t, o in zip(ties, own, strict=True)], F.struct(F.col(right_mono).alias("_m"), F.struct(*values).alias("v")).alias("_value")
    )
    found = _latest(l_rows, r_rows, by, own, width, most)
    near = F.lit(True) if lookback is None else F.col(f"_left.{mono}") - F.col("_value._m") <= lookback
    return found.select("_left.*", *[F.when(near, F.col(f"_value.v.{v}")).alias(f"{prefix}{v}") for v in values])
