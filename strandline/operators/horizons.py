"""Fixed-horizon windows over the rows of a domain.

Every row's exit is the first later row at or after its time plus the horizon: one forward as-of join. Which rows start a
window depends on where the last one ended; so each row also points to where the next window would start, and the rows
that are reached from a domain's first one are the windows (pointers.py). No domain is walked in one task.

A domain is whatever `by` says. Where windows may not cross days, the day belongs to `by`. Keys are unique in a domain.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.asof import asof_join
from strandline.operators.pointers import reached
from strandline.operators.scan import DAY, scanned
from strandline.operators.spans import bad_gaps
from strandline.sources.checkpoints import cut

#: Horizons that make one cell: a walk through a cell has at most so many windows, and a cell about one entry in so many rows.
CELL_HORIZONS = 64


def _exits(rows: DataFrame, by: list[str], time: str, key: str, horizon: int, values: Sequence[str], bucket: int) -> DataFrame:
    """rows with exit_time, exit_key and exit_<value>s of the first row at or after time + horizon, or nulls."""
    target = rows.withColumn("_target", F.col(time) + horizon)
    right = rows.select(*by, F.col(time).alias("_rt"), F.col(key).alias("_rk"), *values)
    found = asof_join(target, right, by, "_target", "_rt", ["_rt", "_rk", *values], ties=["_rk"], prefix="exit_", forward=True, bucket=bucket)
    return found.drop("_target").withColumnsRenamed({"exit__rt": "exit_time", "exit__rk": "exit_key"})


def greedy(df: DataFrame, by: Sequence[str], time: str, key: str, horizon: int, most_step: int, width: int | None = None, bucket: int = DAY) -> DataFrame:
    """Rule A. (by, entry_key, entry_time, exit_key, exit_time, has_gap): exit is the first later row at or after
    entry + horizon; the next entry is the row after the exit. A last entry without exit is kept with nulls, and ends it.
    has_gap: a step over most_step lies between entry and exit.
    """
    by = list(by)
    rows = bad_gaps(df.select(*by, time, key), by, time, most_step, [key], width=bucket, keep=True)
    rows = cut(scanned(rows, by, [time, key], leads={"_after": F.struct(F.col(time).alias("t"), F.col(key).alias("k"))}, width=bucket))
    ends = _exits(rows, by, time, key, horizon, ["_after", "bad_before"], bucket)
    pointed = ends.select(*by, time, key, "bad_before", "exit_time", "exit_key", "exit_bad_before", F.col("exit__after.t").alias("_next_time"), F.col("exit__after.k").alias("_next_key"))
    kept = reached(pointed, by, time, key, "_next_time", "_next_key", width or CELL_HORIZONS * horizon)
    gap = F.when(F.col("exit_time").isNotNull(), F.col("exit_bad_before") > F.col("bad_before"))
    return kept.select(*by, F.col(key).alias("entry_key"), F.col(time).alias("entry_time"), "exit_key", "exit_time", gap.alias("has_gap"))


def touching(df: DataFrame, by: Sequence[str], time: str, key: str, horizon: int, tolerance: int, width: int | None = None, bucket: int = DAY) -> DataFrame:
    """Rule B. (by, entry_key, entry_time, exit_key, exit_time, excluded): the next entry is the exit itself; if the exit
    overshoots by more than `tolerance`, the window is excluded and the next row is tried. No terminal row.
    """
    by = list(by)
    rows = cut(scanned(df.select(*by, time, key), by, [time, key], leads={"_after": F.struct(F.col(time).alias("t"), F.col(key).alias("k"))}, width=bucket))
    over = F.col("exit_time") - (F.col(time) + horizon) > tolerance
    ends = _exits(rows, by, time, key, horizon, [], bucket).where("exit_time IS NOT NULL").withColumn("excluded", over)
    pointed = ends.select(
        *by, time, key, "exit_time", "exit_key", "excluded",
        F.when(F.col("excluded"), F.col("_after.t")).otherwise(F.col("exit_time")).alias("_next_time"), F.when(F.col("excluded"), F.col("_after.k")).otherwise(F.col("exit_key")).alias("_next_key"),
    )
    # A pointer to a row without an exit leads nowhere: such rows are not there.
    kept = reached(pointed, by, time, key, "_next_time", "_next_key", width or CELL_HORIZONS * horizon)
    return kept.select(*by, F.col(key).alias("entry_key"), F.col(time).alias("entry_time"), "exit_key", "exit_time", "excluded")


def overlapping(df: DataFrame, by: Sequence[str], time: str, key: str, horizon: int, values: Sequence[str] = ()) -> DataFrame:
    """Rule C. Every row is a start; its exit is the first later row at or after start + horizon, if there is one."""
    starts = df.withColumn("_target", F.col(time) + horizon)
    found = asof_join(starts, df.select(*by, F.col(time).alias("_rt"), key, *values), by, "_target", "_rt", ["_rt", key, *values], ties=[key], prefix="exit_", forward=True)
    return found.drop("_target").withColumnRenamed("exit__rt", "exit_time")


def halves(df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "half", width: int = DAY) -> DataFrame:
    """EARLY for the first n div 2 rows, LATE for the others; an odd one more is late."""
    counted = scanned(df, by, order, sums={"_place": F.lit(1)}, totals={"_n": F.lit(1)}, width=width)
    return counted.withColumn(name, F.when(F.col("_place") <= F.expr("_n div 2"), "EARLY").otherwise("LATE")).drop("_place", "_n")
