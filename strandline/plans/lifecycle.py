"""Campaign bookkeeping, contracts, ordering and the remaining scalar operators."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import prices, statistics
from strandline.operators import horizons, lifecycle, quantiles
from strandline.operators.spans import stepped
from strandline.plans.core import query
from strandline.plans.market import SHORT
from strandline.sources import tables as t


def segments(spark, d, kind: str):
    """(segment, began) of the user-days with an event of a kind."""
    e = t.events(spark, d).where(F.col("event_type") == kind)
    return e.groupBy(F.concat_ws("/", F.col("dom").cast("string"), "day").alias("segment")).agg(F.min("us").alias("began"))


SEGMENTS = "SELECT dom || '/' || day AS segment, event_type, min(us) AS began FROM ev GROUP BY ALL"


@query(f"WITH s AS ({SEGMENTS}) SELECT segment, began FROM s r WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM s p WHERE p.segment = r.segment AND p.event_type IN ('purchase', 'click'))")
def pending_segments(spark, d):
    """SRC-30, TOPK-06: ready segments that are neither published nor started."""
    return lifecycle.pending(segments(spark, d, "view"), segments(spark, d, "purchase"), segments(spark, d, "click"), "segment")


@query(f"WITH s AS ({SEGMENTS}) SELECT min(segment) AS segment FROM s r WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM s p WHERE p.segment = r.segment AND p.event_type IN ('purchase', 'click'))")
def oldest_pending(spark, d):
    """TOPK-05, TOPK-06: the first pending segment by name."""
    return pending_segments(spark, d).agg(F.min("segment").alias("segment"))


@query(f"""WITH s AS ({SEGMENTS}), e AS (SELECT segment FROM s WHERE event_type = 'view'), m AS (SELECT segment FROM s WHERE event_type = 'click'), a AS (SELECT segment, began FROM s WHERE event_type = 'signup')
SELECT CASE WHEN m.segment IS NULL THEN 'NO_MEMBERSHIP' WHEN a.began IS NULL THEN 'NO_ATTEMPT' WHEN a.began < 1704672000000000 OR a.began >= 1705881600000000 THEN 'OUT_OF_TIME' ELSE 'BOUND' END AS binding, count(*) AS n
FROM e LEFT JOIN m USING (segment) LEFT JOIN a USING (segment) GROUP BY ALL""")
def membership_binding(spark, d):
    """JOIN-19, SUP-44: evidence bound to a membership and an attempt inside the campaign."""
    rows = lifecycle.bound(segments(spark, d, "view").select("segment"), segments(spark, d, "click"), segments(spark, d, "signup"), "segment", F.lit(1704672000000000), F.lit(1705881600000000))
    return rows.groupBy("binding").agg(F.count("*").alias("n"))


@query(f"WITH s AS ({SEGMENTS}), w AS (SELECT segment, bool_or(event_type = 'view') AS captured, bool_or(event_type = 'purchase') AS published, bool_or(event_type = 'error') AS failed FROM s GROUP BY segment) SELECT captured, published, failed, count(*) AS n FROM w GROUP BY ALL")
def operational_status(spark, d):
    """AGG-40, SRC-28, SRC-29: states of all segments from their markers."""
    has = lambda k, n: F.bool_or(F.col("event_type") == k).alias(n)
    w = t.events(spark, d).groupBy("dom", "day").agg(has("view", "captured"), has("purchase", "published"), has("error", "failed"))
    return w.groupBy("captured", "published", "failed").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, 'l_linestatus' AS "column", count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus <> o_orderstatus GROUP BY l_orderkey""", views=False)
def provenance_mismatches(spark, d):
    """FIL-14, SET-04: columns on which a row and its source disagree."""
    lines = t.table(spark, d, "lineitem").select("l_orderkey", "l_linestatus")
    orders = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("l_linestatus"))
    return lifecycle.mismatches(lines, orders, ["l_orderkey"], ["l_linestatus"]).groupBy("l_orderkey", "column").agg(F.count("*").alias("n"))


@query("SELECT event_id, least(60.0::DOUBLE, 1.0 * pow(2.0::DOUBLE, event_id % 9)) AS plain, greatest(2.0::DOUBLE, least(60.0::DOUBLE, 1.0 * pow(2.0::DOUBLE, event_id % 9)) * (1 + (event_id % 3 - 1) * 0.25::DOUBLE)) AS delay FROM ev WHERE event_type = 'error'")
def reconnect_delays(spark, d):
    """SRC-05, SRC-06: capped exponential back-off with jitter and a floor."""
    e = t.events(spark, d).where("event_type = 'error'")
    attempt, jitter = F.col("event_id") % 9 + 1, (F.col("event_id") % 3 - 1) * F.lit(0.25)
    return e.select("event_id", lifecycle.reconnect_delay(attempt, 1.0, 60.0, F.lit(0.0), 0.0).alias("plain"), lifecycle.reconnect_delay(attempt, 1.0, 60.0, jitter).alias("delay"))


@query("SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS scaled_2, CASE WHEN CAST(round(p_retailprice * 100) AS BIGINT) % 10 = 0 THEN CAST(round(p_retailprice * 100) AS BIGINT) // 10 END AS scaled_1 FROM part", views=False)
def scaled_decimals(spark, d):
    """MTH-01, MTH-02: decimals as scaled integers; excess digits are refused."""
    price = F.round("p_retailprice", 2).cast("decimal(18,2)")
    return t.table(spark, d, "part").select("p_partkey", lifecycle.scaled(price, 2).alias("scaled_2"), lifecycle.scaled(price, 1).alias("scaled_1"))


@query("SELECT event_id, us - lag(us) OVER (PARTITION BY dom ORDER BY us, event_id) AS elapsed_us, CASE WHEN event_id % 4 <> 0 THEN event_id % 1000 END AS apparent_lag_us, (us - lag(us) OVER (PARTITION BY dom ORDER BY us, event_id)) // 21600000000 AS windows FROM ev")
def clock_spans(spark, d):
    """PRJ-16, PRJ-17, WIN-21: elapsed time in a domain, null-safe apparent lag, whole windows in a span."""
    exchange = F.when(F.col("event_id") % 4 != 0, F.col("us") - F.col("event_id") % 1000)
    e = stepped(t.events(spark, d).select("event_id", "dom", "us"), ["dom"], "us", ["event_id"]).withColumnRenamed("step", "elapsed_us")
    return e.select("event_id", "elapsed_us", (F.col("us") - exchange).alias("apparent_lag_us"), F.expr(f"elapsed_us div {SHORT}").alias("windows"))


@query("SELECT event_id, sum_bps, sum_bps * 45.0::DOUBLE / 10000.0::DOUBLE AS cost FROM (SELECT event_id, cents AS sum_bps FROM ev WHERE event_type = 'purchase')")
def notional_costs(spark, d):
    """PRJ-15: a rate in basis points of a notional."""
    return t.events(spark, d).where("event_type = 'purchase'").select("event_id", F.col("cents").alias("sum_bps"), prices.bps_cost(F.col("cents"), F.lit(45.0)).alias("cost"))


@query("SELECT day, day < '2024-01-19' AS train, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM ev GROUP BY ALL")
def day_split(spark, d):
    """FIL-11, FIL-12, SORT-06, SET-07: whole days are for training or for test, never both."""
    return t.events(spark, d).groupBy("day", (F.col("day") < "2024-01-19").alias("train")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


@query("SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY cents DESC, us, event_id) AS rank FROM ev) WHERE rank <= 25")
def top_rows(spark, d):
    """SORT-01..05, TOPK-01..03: the first rows of a total order, without a full sort."""
    order = [F.desc("cents"), F.col("us"), F.col("event_id")]
    top = t.events(spark, d).orderBy(*order).limit(25)
    return top.select("event_id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("rank"))  # of 25 rows


@query("""WITH s AS (SELECT dom, count(*) FILTER (event_type = 'view') AS n, count(*) FILTER (event_type = 'view' AND cents % 2 = 0) AS k FROM ev GROUP BY dom), r AS (SELECT dom, n, k, list_filter([-0.1::DOUBLE, (k % 5)::DOUBLE / 10.0::DOUBLE, 0.05::DOUBLE], lambda x: x > 0) AS pos FROM s WHERE n > 0)
SELECT dom, n, 1 + 2 * list_sum(pos)::DOUBLE AS effect, greatest(1, least(n, CAST(floor(n / (1 + 2 * list_sum(pos)::DOUBLE)) AS BIGINT))) AS effective FROM r""")
def effective_sizes(spark, d):
    """MTH-10, MTH-11: design effect of positive correlations and effective sizes."""
    view = F.col("event_type") == "view"
    s = t.events(spark, d).groupBy("dom").agg(F.count(F.when(view, 1)).alias("n"), F.count(F.when(view & (F.col("cents") % 2 == 0), 1)).alias("k")).where("n > 0")
    rho = F.array(F.lit(-0.1), (F.col("k") % 5).cast("double") / F.lit(10.0), F.lit(0.05))
    return s.select("dom", "n", statistics.design_effect(rho).alias("effect")).withColumn("effective", statistics.effective_n(F.col("n"), F.col("effect")))


@query("""WITH r AS (SELECT event_type, count(*) AS n, count(*) FILTER (cents % 10 <> 0) AS ready, count(*) FILTER (cents % 10 <> 0 AND cents % 3 <> 0) AS labelled FROM ev GROUP BY event_type)
SELECT event_type, n, ready, labelled, (783 * n + labelled - 1) // labelled AS rows_needed FROM r""")
def attrition_funnel(spark, d):
    """MTH-03, MTH-08, MTH-14: rows to plan for when only part of them is usable."""
    c = F.col("cents")
    r = t.events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(c % 10 != 0, 1)).alias("ready"), F.count(F.when((c % 10 != 0) & (c % 3 != 0), 1)).alias("labelled"))
    return r.withColumn("rows_needed", F.expr("(783 * n + labelled - 1) div labelled"))


@query("SELECT unnest([1, 2, 5, 10, 20, 50, 100, 200, 500])::BIGINT AS horizon, 86400 // unnest([1, 2, 5, 10, 20, 50, 100, 200, 500])::BIGINT AS windows", views=False)
def horizon_grid(spark, d):
    """MTH-04, MTH-05, WIN-21, GAT-04: the 1-2-5 grid and how many windows a day holds."""
    grid = spark.createDataFrame([(h,) for h in statistics.grid_125(1, 500)], "horizon long")
    return grid.select("horizon", F.expr("86400 div horizon").alias("windows"))


@query("SELECT event_type, round(avg(cents)::DOUBLE, 6) AS mean, round(stddev_pop(cents)::DOUBLE, 6) AS deviation, count(*) AS n FROM ev GROUP BY event_type")
def standardisation(spark, d):
    """AGG-38: mean and population deviation of features."""
    return t.events(spark, d).groupBy("event_type").agg(F.round(F.avg("cents"), 6).alias("mean"), F.round(F.stddev_pop("cents"), 6).alias("deviation"), F.count("*").alias("n"))


@query("SELECT event_type, status, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 4 = 3 THEN CASE WHEN event_id % 9 = 0 THEN 'LOST_TAIL' ELSE 'OK' END WHEN event_id % 4 = 2 THEN 'DRAIN_TIMEOUT' ELSE 'CRASHED' END AS status FROM ev) GROUP BY ALL")
def run_outcomes(spark, d):
    """STM-04, STM-06, SNK-02: how captures ended, by truthful counters."""
    e = F.col("event_id")
    durable = F.when(e % 9 == 0, e - 1).otherwise(e)
    shutdown = F.when(e % 4 == 3, "DRAINED").when(e % 4 == 2, "TIMEOUT")
    return t.events(spark, d).select("event_type", lifecycle.exit_code(durable, e, shutdown).alias("status")).groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query("SELECT event_type, us + (1 + event_id % 30) * 86400000000 <= 1706745600000000 AS is_due, count(*) AS n FROM ev GROUP BY ALL")
def facts_due(spark, d):
    """SRC-38, DT-08: facts that have to be verified again at a given time."""
    f = lifecycle.due(t.events(spark, d), "us", 1 + F.col("event_id") % 30, 1706745600000000)
    return f.groupBy("event_type", "is_due").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT event_id, bid, ask, flags, CASE WHEN event_id % 10 = 0 THEN NULL ELSE bid END AS b2 FROM q), r AS (SELECT event_id, list_filter([CASE WHEN b2 IS NULL THEN 'MISSING_BBO_SIDE' END, CASE WHEN b2 >= ask THEN 'CROSSED_OR_LOCKED_BBO' END, CASE WHEN flags & 54 <> 0 THEN 'QUALITY_FLAGS_' || (flags & 54) END], lambda x: x IS NOT NULL) AS x FROM b)
SELECT event_id, array_to_string(x, ',') AS reasons, array_to_string(list_sort(list_distinct(list_concat(x, ['ENTRY', 'ENTRY']))), ',') AS merged FROM r""")
def quote_reasons(spark, d):
    """FIL-04..06, SET-08: reasons against a quote in order, and sorted distinct unions of reasons."""
    bid = F.when(F.col("event_id") % 10 != 0, F.col("bid"))
    reasons = prices.quote_reasons(bid, F.col("ask"), F.col("flags"), t.GAP | t.STALE | t.BACKFILL | t.SUSPECT)
    merged = prices.merged_reasons(reasons, F.array(F.lit("ENTRY"), F.lit("ENTRY")))
    return t.quotes(spark, d).select("event_id", F.array_join(reasons, ",").alias("reasons"), F.array_join(merged, ",").alias("merged"))


@query("WITH m AS (SELECT event_type, day, quantile_disc(cents, 0.9) AS q90 FROM ev WHERE day < '2024-01-19' GROUP BY ALL), t AS (SELECT event_type, max(q90) AS threshold FROM m GROUP BY event_type) SELECT e.event_type, threshold, count(*) FILTER (cents > threshold) AS above, count(*) AS n FROM ev e JOIN t USING (event_type) WHERE day >= '2024-01-19' GROUP BY ALL")
def train_thresholds(spark, d):
    """MDL-06, SUP-31: thresholds from training days only, used on test days."""
    e = t.events(spark, d)
    m = quantiles.nearest_ranks(e.where("day < '2024-01-19'"), ["event_type", "day"], "cents", ["0.9"], ["q90"]).groupBy("event_type").agg(F.max("q90").alias("threshold"))
    test = e.where("day >= '2024-01-19'").join(m, "event_type")
    return test.groupBy("event_type", "threshold").agg(F.count(F.when(F.col("cents") > F.col("threshold"), 1)).alias("above"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT us, row_number() OVER (ORDER BY us, event_id) AS rn, count(*) OVER () AS n FROM ev WHERE event_type = 'view'), b AS (SELECT us AS edge FROM r WHERE rn = n // 2)
SELECT CASE WHEN us <= edge THEN 'DEV_A' ELSE 'DEV_B' END AS part, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM r, b GROUP BY ALL""")
def chrono_split(spark, d):
    """WIN-15: chronological halves; rows with the time of the last row of the first half all go to DEV_A.

    The edge is a rank that ranges of times are searched for, so that no global row order is needed.
    """
    q = t.events(spark, d).where("event_type = 'view'").select("us")
    edge = quantiles.chronological_edge(q, "us")
    part = F.when(F.col("us") <= F.col("edge"), "DEV_A").otherwise("DEV_B")
    return q.crossJoin(F.broadcast(edge)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))  # one edge


@query("""WITH s AS (SELECT event_type, count(*) AS n, count(*) FILTER (cents % 2 = 0) AS k FROM ev GROUP BY event_type), x AS (SELECT event_type, n, k, unnest(range(k, n + 1)) AS i FROM s)
SELECT event_type, n, k, round(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0))), 6) AS p_value FROM x GROUP BY event_type, n, k""")
def binomial_tail(spark, d):
    """MTH-09: exact upper tails of fair coins, by big integers on one row for each group."""
    s = t.events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("cents") % 2 == 0, 1)).alias("k"))

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([float(statistics.upper_tail(int(a), int(b))) for a, b in zip(k, n, strict=True)])

    return s.select("event_type", "n", "k", F.round(tail("k", "n"), 6).alias("p_value"))


@query(f"""WITH g AS (SELECT dom, us - lag(us) OVER (PARTITION BY dom ORDER BY us, event_id) AS delta FROM ev), c AS (SELECT dom, greatest(quantile_disc(delta, 0.99), 1) AS tolerance FROM g WHERE delta > 0 GROUP BY dom)
SELECT s.dom, count(*) AS candidates, count(*) FILTER (e.us - (s.us + {SHORT}) > tolerance) AS excluded, max(tolerance) AS tolerance FROM ev s ASOF JOIN ev e ON s.dom = e.dom AND s.us + {SHORT} <= e.us JOIN c ON c.dom = s.dom GROUP BY s.dom""")
def overshoot_filter(spark, d):
    """WIN-11 rule C: overlapping windows whose exit overshoots by more than the domain's 99 % cadence are counted out."""
    e = t.events(spark, d).select("event_id", "dom", "us")
    tolerance = quantiles.nearest_ranks(quantiles.positive_deltas(e, ["dom"], "us", ["event_id"]), ["dom"], "delta", ["0.99"], ["p99"]).select("dom", F.greatest("p99", F.lit(1)).alias("tolerance"))
    w = horizons.overlapping(e, ["dom"], "us", "event_id", SHORT).where("exit_time IS NOT NULL").join(tolerance, "dom")
    over = F.col("exit_time") - (F.col("us") + SHORT) > F.col("tolerance")
    return w.groupBy("dom").agg(F.count("*").alias("candidates"), F.count(F.when(over, 1)).alias("excluded"), F.max("tolerance").alias("tolerance"))


@query("SELECT o_orderkey, c_mktsegment, n_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1995-04-01'", views=False)
def pruned_scan(spark, d):
    """SRC-10..13, SRC-27: columns and ranges reach the scan."""
    day = F.col("o_orderdate")
    o = t.table(spark, d, "orders").where((day >= F.lit("1995-01-01").cast("timestamp")) & (day < F.lit("1995-04-01").cast("timestamp"))).select("o_orderkey", "o_custkey", "o_totalprice")
    c = t.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    n = t.table(spark, d, "nation").select("n_nationkey", "n_name")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_mktsegment", "n_name", "o_totalprice")
