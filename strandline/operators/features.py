"""Causal features: every value comes from rows at or before the decision."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import prices
from strandline.operators.asof import asof_join
from strandline.operators.scan import DAY, scanned, with_predecessors


def last_per_time(df: DataFrame, by: Sequence[str], time: str, order: str) -> DataFrame:
    """The last row, by `order`, of each time."""
    rest = [c for c in df.columns if c not in {*by, time}]
    return df.groupBy(*by, time).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(*by, time, "_row.*")


def running_flow(trades: DataFrame, by: Sequence[str], time: str = "us", width: int = DAY) -> DataFrame:
    """(by, time, buy, sell, unknown): sizes so far, one row for each time with a trade."""
    amount = lambda side: F.sum(F.when(F.col("side") == side, F.col("size")).otherwise(0))
    each = trades.groupBy(*by, time).agg(*[amount(s).alias(s) for s in ("buy", "sell", "unknown")])
    return scanned(each, by, [time], sums={s: F.col(s) for s in ("buy", "sell", "unknown")}, width=width)


def trade_flow(decisions: DataFrame, trades: DataFrame, by: Sequence[str], key: str, time: str, lookback: int) -> DataFrame:
    """(key, by, time, buy, sell, flow): trades in (t - lookback, t] as a difference of two running sums.

    buy and sell are null without a trade in the window or with one of unknown side; flow is (buy - sell) / (buy + sell).
    """
    sums = running_flow(trades, by).withColumnRenamed("us", "_at")
    sides = ["buy", "sell", "unknown"]
    now = decisions.select(key, *by, time)
    ends = now.select(key, *by, F.col(time).alias("_t"), F.lit(1).alias("_end")).unionByName(now.select(key, *by, (F.col(time) - lookback).alias("_t"), F.lit(0).alias("_end")))
    found = asof_join(ends, sums, by, "_t", "_at", sides, prefix="s_")
    at = lambda side, end: F.coalesce(F.max(F.when(F.col("_end") == end, F.col(f"s_{side}"))), F.lit(0))
    diff = found.groupBy(key, *by).agg(F.max("_t").alias(time), *[(at(s, 1) - at(s, 0)).alias(s) for s in sides])
    known = (F.col("unknown") == 0) & (F.col("buy") + F.col("sell") > 0)
    out = diff.select(key, *by, time, *[F.when(known, F.col(s)).alias(s) for s in ("buy", "sell")])
    return out.withColumn("flow", prices.imbalance(F.col("buy"), F.col("sell")))


def reference_return(decisions: DataFrame, reference: DataFrame, by: Sequence[str], key: str, time: str, lookback: int, tolerance: int) -> DataFrame:
    """(key, value, reason): return of the reference mid over (t - lookback, t] or the first reason why there is none.

    reference has us, bid, ask, flags. Both ends must be at most `tolerance` old, each against its own target.
    """
    now = decisions.select(key, *by, F.col(time).alias("_now"))
    ref = reference.select(*by, F.col("us").alias("_us"), F.col("event_id").alias("_id"), "bid", "ask", "flags")
    cols = ["_us", "bid", "ask", "flags"]
    first = asof_join(now, ref, by, "_now", "_us", cols, ties=["_id"], prefix="c_").withColumn("_back", F.col("_now") - lookback)
    both = asof_join(first, ref, by, "_back", "_us", cols, ties=["_id"], prefix="l_")
    domain = reference.select(*by).distinct().withColumn("_known", F.lit(True))
    both = both.join(domain, list(by), "left")
    ok = lambda p: prices.usable(F.col(f"{p}bid"), F.col(f"{p}ask")) & ~prices.flagged(F.col(f"{p}flags"), 2 + 4 + 16 + 32)
    reason = (
        F.when(F.col("_known").isNull(), "UNAVAILABLE")
        .when(F.col("c__us").isNull(), "CURRENT_UNAVAILABLE")
        .when(F.col("_back") < 0, "LOOKBACK_BEFORE_DOMAIN_START")
        .when(F.col("l__us").isNull(), "LOOKBACK_UNAVAILABLE")
        .when(F.col("_now") - F.col("c__us") > tolerance, "CURRENT_STALE")
        .when(F.col("_back") - F.col("l__us") > tolerance, "LOOKBACK_STALE")
        .when(~(ok("c_") & ok("l_")), "BBO_INVALID")
    )
    value = F.when(reason.isNull(), prices.return_bps(F.col("l_bid") + F.col("l_ask"), F.col("c_bid") + F.col("c_ask")))
    return both.select(key, *by, value.alias("value"), reason.alias("reason"))


def missing_counts(rows: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, missing, present), one pass over the rows."""
    counts = rows.groupBy(*by).agg(*[F.count(f).alias(f) for f in features], F.count("*").alias("_n"))
    long = counts.select(*by, "_n", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("present")) for f in features])).alias("_f"))
    return long.select(*by, "_f.feature", (F.col("_n") - F.col("_f.present")).alias("missing"), F.col("_f.present").alias("present"))


def autocorrelation(df: DataFrame, by: Sequence[str], order: Sequence[str], bit: str, lags: int, width: int = DAY) -> DataFrame:
    """(by, lag, n, ones, pairs, product): integer sums from which the biased autocorrelation of a 0/1 series follows exactly.

    The first column of `order` is an integer that the series is cut by; each cell gets the last rows of its predecessors.
    """
    before = with_predecessors(df.select(*by, *order, F.col(bit).alias("_x")), by, order, F.col("_x"), lags, "_before", width)
    lagged = before.select(*by, "_x", *[F.get("_before", F.lit(k - 1)).alias(f"_l{k}") for k in range(1, lags + 1)])
    sums = [F.struct(F.lit(k).alias("lag"), F.count(f"_l{k}").alias("pairs"), F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0)).alias("product"), F.coalesce(F.sum(F.when(F.col(f"_l{k}").isNotNull(), F.col("_x") + F.col(f"_l{k}"))), F.lit(0)).alias("both")) for k in range(1, lags + 1)]
    wide = lagged.groupBy(*by).agg(F.count("*").alias("n"), F.sum("_x").alias("ones"), F.array(*sums).alias("_s"))
    out = wide.select(*by, "n", "ones", F.explode("_s").alias("_s")).select(*by, "n", "ones", "_s.*")
    mean = F.col("ones") / F.col("n")
    top = F.col("product") - mean * F.col("both") + F.col("pairs") * mean * mean
    bottom = F.col("ones") * (1 - mean)
    return out.withColumn("rho", F.when(F.col("pairs") > 0, F.when(bottom == 0, 0.0).otherwise(top / bottom)))
