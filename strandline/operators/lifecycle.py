"""Campaign bookkeeping: what was captured, published, bound and is pending; and checks of contracts between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(ready: DataFrame, published: DataFrame, started: DataFrame, key: str) -> DataFrame:
    """Ready, not published and not started."""
    return ready.join(published.select(key), key, "left_anti").join(started.select(key), key, "left_anti")


def bound(evidence: DataFrame, membership: DataFrame, attempts: DataFrame, key: str, start: Column, deadline: Column) -> DataFrame:
    """evidence with `binding`: BOUND if a membership and an attempt that began in [start, deadline) are there, else why not."""
    m = membership.select(key, F.lit(True).alias("_m")).distinct()
    a = attempts.groupBy(key).agg(F.min("began").alias("_began"))
    rows = evidence.join(m, key, "left").join(a, key, "left")
    state = (
        F.when(F.col("_m").isNull(), "NO_MEMBERSHIP").when(F.col("_began").isNull(), "NO_ATTEMPT").when((F.col("_began") < start) | (F.col("_began") >= deadline), "OUT_OF_TIME").otherwise("BOUND")
    )
    return rows.withColumn("binding", state).drop("_m", "_began")


def mismatches(left: DataFrame, right: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, column) wherever two tables disagree on a column of a common key; nulls are equal to nulls."""
    key = list(key)
    l_rows = left.select(*key, F.struct(*columns).alias("_l"))
    r_rows = right.select(*key, F.struct(*columns).alias("_r"))
    bad = F.array_compact(F.array(*[F.when(~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}")), F.lit(c)) for c in columns]))
    return l_rows.join(r_rows, key).select(*key, F.explode(bad).alias("column"))


def reconnect_delay(attempt: Column, base: float, most: float, jitter: Column, floor: float = 2.0) -> Column:
    """Exponential back-off: min(most, base * 2**(attempt - 1)) +- jitter share, at least `floor` seconds."""
    plain = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    return F.greatest(F.lit(floor), plain * (1 + jitter))


def scaled(value: Column, digits: int) -> Column:
    """A decimal as an integer of 10**-digits; null if it has more digits than that."""
    big = value.cast("decimal(38,18)") * F.lit(10**digits).cast("decimal(20,0)")
    return F.when(big == F.floor(big), big.cast("long"))


def exit_code(durable: Column, appended: Column, shutdown: Column) -> Column:
    """How a capture run ended."""
    return F.when(durable > appended, "CORRUPT_COUNTERS").when(shutdown == "DRAINED", F.when(durable == appended, "OK").otherwise("LOST_TAIL")).when(shutdown == "TIMEOUT", "DRAIN_TIMEOUT").otherwise("CRASHED")


def due(facts: DataFrame, verified: str, days: Column, now_us: int) -> DataFrame:
    """facts with due_us and is_due against a given time; a batch never reads the clock."""
    at = F.col(verified) + days * 86_400_000_000
    return facts.withColumn("due_us", at).withColumn("is_due", at <= now_us)
