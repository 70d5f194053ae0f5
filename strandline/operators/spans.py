"""Intervals and gaps, from values that run along a domain in cells of time (scan.py); no window spans a domain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.scan import DAY, scanned


def merged(df: DataFrame, by: Sequence[str], start: str, end: str, width: int = DAY) -> DataFrame:
    """(by, start, end) of the union of intervals; touching ones merge."""
    order = [start, end]
    reached = scanned(df.select(*by, start, end), by, order, reach={"_reach": F.col(end)}, width=width, keep=True)
    apart = F.when(F.col(start) <= F.col("_reach"), 0).otherwise(1)
    islands = scanned(reached, by, order, sums={"_island": apart}, width=width)
    return islands.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlaps(df: DataFrame, by: Sequence[str], start: str, end: str, keys: Sequence[str] = (), width: int = DAY) -> DataFrame:
    """Rows that start at or before the end of their predecessor; touching counts."""
    return scanned(df, by, [start, end, *keys], lags={"previous_end": F.col(end)}, width=width).where(F.col(start) <= F.col("previous_end"))


def stepped(df: DataFrame, by: Sequence[str], time: str, ties: Sequence[str] = (), width: int = DAY, keep: bool = False) -> DataFrame:
    """df with step: the time since the row before, null on a domain's first row."""
    before = scanned(df, by, [time, *ties], lags={"_before": F.col(time)}, width=width, keep=keep)
    return before.withColumn("step", F.col(time) - F.col("_before")).drop("_before")


def bad_gaps(df: DataFrame, by: Sequence[str], time: str, most: int, ties: Sequence[str] = (), width: int = DAY, keep: bool = False) -> DataFrame:
    """df with step (to the predecessor) and bad_before: how many steps over `most` lie at or before the row."""
    bad = F.when(F.col("step") > most, 1).otherwise(0)
    return scanned(stepped(df, by, time, ties, width, keep=True), by, [time, *ties], sums={"bad_before": bad}, width=width, keep=keep)
