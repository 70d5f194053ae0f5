"""Quotes, books, as-of joins, windows and quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import prices
from strandline.operators import features, horizons, quantiles, spans
from strandline.operators.asof import asof_join
from strandline.operators.dominance import dual_clock_asof
from strandline.operators.scan import scanned
from strandline.plans.core import query
from strandline.sources import tables as t

H = t.HOUR
LOOKBACK, STALE, SHORT, LONG = 24 * H, 12 * H, 6 * H, 36 * H
IDS = 1 << 20  # width of a cell of ids, where rows are in the order of the file


def good(df: DataFrame) -> DataFrame:
    """Quotes without the suspect flag and with a usable book."""
    return df.where((F.col("flags").bitwiseAND(t.SUSPECT) == 0) & prices.usable(F.col("bid"), F.col("ask")))


# -- order book ---------------------------------------------------------------------------------------------------


@query("SELECT event_id, dom, us, bid, ask, bid + ask AS twice_mid, 20000.0::DOUBLE * (ask - bid) / (ask + bid)::DOUBLE AS spread_bps FROM q WHERE (flags & 32) = 0 AND bid > 0 AND ask > bid")
def spread_bps(spark: SparkSession, d: str) -> DataFrame:
    """FIL-01, PRJ-01, PRJ-02: conjunctive quote filter and spread."""
    q = good(t.quotes(spark, d))
    return q.select("event_id", "dom", "us", "bid", "ask", prices.twice_mid(F.col("bid"), F.col("ask")).alias("twice_mid"), prices.spread_bps(F.col("bid"), F.col("ask")).alias("spread_bps"))


@query("""SELECT event_id, greatest((10000 * (ask * 100045 - bid * 99955))::DOUBLE / (ask * 100045)::DOUBLE, (10000 * (ask * 100045 - bid * 99955))::DOUBLE / (bid * 99955)::DOUBLE) AS friction_bps,
  ((10000 * (ask * 100045 - bid * 99955))::DOUBLE / (bid * 99955)::DOUBLE) / 50.0::DOUBLE AS capture_50 FROM q WHERE bid > 0 AND ask > bid""")
def friction_bps(spark, d):
    """PRJ-05..07: round-trip friction in one book at 4.5 bps a side."""
    f = prices.friction_bps(F.col("bid"), F.col("ask"), 45)
    q = t.quotes(spark, d).where(prices.usable(F.col("bid"), F.col("ask")))
    return q.select("event_id", f.alias("friction_bps"), prices.capture_fraction(f, F.lit(50.0)).alias("capture_50"))


@query("SELECT event_id, (bid_sz - ask_sz)::DOUBLE / (bid_sz + ask_sz)::DOUBLE AS imbalance, CAST(sign(bid_sz - ask_sz) AS INTEGER) AS direction FROM q")
def top_imbalance(spark, d):
    """PRJ-08, PRJ-13, MTH-19: top-of-book imbalance and its sign."""
    i = prices.imbalance(F.col("bid_sz"), F.col("ask_sz"))
    return t.quotes(spark, d).select("event_id", i.alias("imbalance"), prices.direction(i).alias("direction"))


@query("""WITH b AS (SELECT book, CAST(sum(CASE WHEN side = 'BID' THEN size ELSE 0 END) AS BIGINT) AS bid_size, CAST(sum(CASE WHEN side = 'ASK' THEN size ELSE 0 END) AS BIGINT) AS ask_size,
  count(*) AS levels FROM lv WHERE level <= 5 GROUP BY book)
SELECT book, bid_size, ask_size, levels, (bid_size - ask_size)::DOUBLE / (bid_size + ask_size)::DOUBLE AS imbalance FROM b""")
def depth_imbalance(spark, d):
    """JOIN-03, PRJ-09, ARR-04: sums over the five best levels of either side."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("size")).otherwise(0))
    b = t.levels(spark, d).where("level <= 5").groupBy("book").agg(side("BID").alias("bid_size"), side("ASK").alias("ask_size"), F.count("*").alias("levels"))
    return b.withColumn("imbalance", prices.imbalance(F.col("bid_size"), F.col("ask_size")))


@query("""WITH w AS (SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY book, side ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM lv),
f AS (SELECT *, greatest(0, least(size, 60 - before)) AS fill FROM w)
SELECT book, side, CAST(sum(fill) AS BIGINT) AS filled, 60 - CAST(sum(fill) AS BIGINT) AS unfilled, CAST(sum(fill * price) AS BIGINT) AS notional,
  sum(fill * price)::DOUBLE / sum(fill)::DOUBLE AS vwap, arg_max(price, level) FILTER (fill > 0) AS worst_price, count(*) FILTER (fill > 0) AS levels_used FROM f GROUP BY book, side""")
def book_walk(spark, d):
    """WIN-20: fill 60 units level by level."""
    w = Window.partitionBy("book", "side").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)
    fill = F.greatest(F.lit(0), F.least(F.col("size"), 60 - F.coalesce(F.sum("size").over(w), F.lit(0))))
    f = t.levels(spark, d).withColumn("fill", fill)
    used = F.col("fill") > 0
    out = f.groupBy("book", "side").agg(F.sum("fill").alias("filled"), F.sum(F.col("fill") * F.col("price")).alias("notional"), F.max_by(F.when(used, F.col("price")), F.when(used, F.col("level"))).alias("worst_price"), F.count(F.when(used, 1)).alias("levels_used"))
    return out.select("book", "side", "filled", (60 - F.col("filled")).alias("unfilled"), "notional", (F.col("notional").cast("double") / F.col("filled").cast("double")).alias("vwap"), "worst_price", "levels_used")


@query("""WITH n AS (SELECT *, lag(price) OVER (PARTITION BY book, side ORDER BY level) AS prev FROM lv)
SELECT book, count(*) FILTER (side = 'BID') AS bids, count(*) FILTER (side = 'ASK') AS asks, bool_and(CASE WHEN prev IS NULL THEN true WHEN side = 'BID' THEN prev >= price ELSE prev <= price END) AS in_order,
  count(*) FILTER (side = 'BID') > 0 AND count(*) FILTER (side = 'ASK') > 0 AS two_sided FROM n GROUP BY book""")
def book_order(spark, d):
    """WIN-18, WIN-19, SUP-09, SUP-10: monotone levels and two-sided books, on arrays."""
    each = t.levels(spark, d).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("side", "level", "price"))).alias("x"))
    side = lambda s: F.transform(F.filter("x", lambda v: v.side == s), lambda v: v.price)
    ordered = lambda a, up: F.array_sort(a) == a if up else F.reverse(F.array_sort(a)) == a
    b, a = side("BID"), side("ASK")
    return each.select("book", F.size(b).cast("long").alias("bids"), F.size(a).cast("long").alias("asks"), (ordered(b, False) & ordered(a, True)).alias("in_order"), ((F.size(b) > 0) & (F.size(a) > 0)).alias("two_sided"))


# -- windows over time --------------------------------------------------------------------------------------------


@query("SELECT dom, day, event_id, cents FROM ev QUALIFY row_number() OVER (PARTITION BY dom, day ORDER BY event_id DESC) = 1")
def last_per_timestamp(spark, d):
    """WIN-02: the last row of each time unit, as a partial aggregate."""
    return features.last_per_time(t.events(spark, d).select("dom", "day", "event_id", "cents"), ["dom"], "day", "event_id")


@query("""WITH e AS (SELECT dom, us, CAST(sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS BIGINT) AS b, CAST(sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS BIGINT) AS s, CAST(sum(CASE WHEN side = 'unknown' THEN size ELSE 0 END) AS BIGINT) AS u FROM tr GROUP BY dom, us)
SELECT dom, us, CAST(sum(b) OVER w AS BIGINT) AS buy, CAST(sum(s) OVER w AS BIGINT) AS sell, CAST(sum(u) OVER w AS BIGINT) AS unknown FROM e WINDOW w AS (PARTITION BY dom ORDER BY us ROWS UNBOUNDED PRECEDING)""")
def running_flow(spark, d):
    """AGG-22, WIN-03: trade sizes for each time, then running sums."""
    return features.running_flow(t.trades(spark, d), ["dom"])


@query("""SELECT dom, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (us < prev) AS reversals
FROM (SELECT dom, us, lag(us) OVER (PARTITION BY dom ORDER BY event_id) AS prev FROM ev) GROUP BY dom""")
def reversals(spark, d):
    """AGG-23, WIN-04: rows whose time runs back against file order."""
    e = scanned(t.events(spark, d).select("dom", "us", "event_id"), ["dom"], ["event_id"], lags={"prev": F.col("us")}, width=IDS)
    return e.groupBy("dom").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.when(F.col("us") < F.col("prev"), 1)).alias("reversals"))


@query("""SELECT event_id, dom, us, us - lag(us) OVER w AS step, CAST(sum(CASE WHEN us - p > 43200000000 THEN 1 ELSE 0 END) OVER w2 AS BIGINT) AS bad_before
FROM (SELECT *, lag(us) OVER (PARTITION BY dom ORDER BY us, event_id) AS p FROM ev) WINDOW w AS (PARTITION BY dom ORDER BY us, event_id), w2 AS (PARTITION BY dom ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)""")
def gap_flags(spark, d):
    """WIN-05..07, STM-10: steps and a running count of gaps over the longest allowed step."""
    return spans.bad_gaps(t.events(spark, d).select("event_id", "dom", "us"), ["dom"], "us", STALE, ["event_id"])


# -- as-of joins --------------------------------------------------------------------------------------------------

ASOF = "SELECT e.event_id, e.dom, e.us, r.event_id AS r_event_id, r.us AS r_us, r.bid AS r_bid, r.ask AS r_ask FROM q e ASOF LEFT JOIN rq r ON e.dom = r.dom AND e.us >= r.us"


def pairs(spark, d, **options):
    left, right = t.quotes(spark, d).select("event_id", "dom", "us"), t.quotes(spark, d, "click")
    return asof_join(left, right, ["dom"], "us", "us", ["event_id", "us", "bid", "ask"], ties=["event_id"], **options)


@query(ASOF)
def asof_backward(spark, d):
    """JOIN-07: latest reference quote at or before each quote; domains are cut by day."""
    return pairs(spark, d)


@query(ASOF)
def asof_backward_unbucketed(spark, d):
    """JOIN-07 with one window for each domain."""
    return pairs(spark, d, bucket=None)


@query(ASOF.replace(">=", ">"))
def asof_strictly_before(spark, d):
    return pairs(spark, d, strict=True)


@query(ASOF.replace(">=", "<="))
def asof_forward(spark, d):
    """JOIN-13: first reference quote at or after."""
    return pairs(spark, d, forward=True)


@query(f"SELECT event_id, dom, us, r_us, CASE WHEN us - r_us <= {STALE} THEN r_bid + r_ask END AS fresh_twice_mid, CASE WHEN r_us IS NULL THEN 'UNAVAILABLE' WHEN us - r_us > {STALE} THEN 'STALE' END AS reason FROM ({ASOF})")
def asof_tolerance(spark, d):
    """JOIN-10: a stale match is null, with the reason; it is not searched further."""
    m = pairs(spark, d)
    stale = F.col("us") - F.col("r_us") > STALE
    reason = F.when(F.col("r_us").isNull(), "UNAVAILABLE").when(stale, "STALE")
    return m.select("event_id", "dom", "us", "r_us", F.when(~stale, F.col("r_bid") + F.col("r_ask")).alias("fresh_twice_mid"), reason.alias("reason"))


@query(f"""WITH l AS (SELECT event_id, dom, us, us + (event_id % 5 - 2) * 3600000000 AS wall FROM q),
r AS (SELECT event_id AS rid, dom, us AS rus, us + (event_id % 7 - 3) * 3600000000 AS rwall, bid FROM rq)
SELECT l.event_id, l.dom, l.us, arg_max(rid, (rus, rwall, rid)) AS r_rid, arg_max(bid, (rus, rwall, rid)) AS r_bid
FROM l LEFT JOIN r ON l.dom = r.dom AND rus <= us AND rwall <= wall AND us - rus <= {LOOKBACK} GROUP BY l.event_id, l.dom, l.us""")
def asof_dual_clock(spark, d):
    """JOIN-08, JOIN-09, I4: both clocks must be at or before the decision's; wall clocks run apart here."""
    e = F.col("event_id")
    left = t.quotes(spark, d).select("event_id", "dom", "us", (F.col("us") + (e % 5 - 2) * H).alias("wall"))
    right = t.quotes(spark, d, "click").select(e.alias("rid"), "dom", F.col("us").alias("rus"), (F.col("us") + (e % 7 - 3) * H).alias("rwall"), "bid")
    return dual_clock_asof(left, right, ["dom"], "us", "wall", "rus", "rwall", ["rid", "bid"], ["rid"], LOOKBACK).select("event_id", "dom", "us", "r_rid", "r_bid")


@query("""WITH l AS (SELECT event_id, dom, us, us + (event_id % 5 - 2) * 3600000000 AS wall FROM q),
r AS (SELECT event_id AS rid, dom, us AS rus, us + (event_id % 7 - 3) * 36000000000 AS rwall FROM rq)
SELECT l.event_id, l.dom, l.us, arg_max(rid, (rus, rwall, rid)) AS r_rid, l.us - arg_max(rus, (rus, rwall, rid)) AS age_us FROM l LEFT JOIN r ON l.dom = r.dom AND rus <= us AND rwall <= wall GROUP BY l.event_id, l.dom, l.us""")
def asof_dual_clock_unbounded(spark, d):
    """JOIN-08, JOIN-09: however far back the last row is that both clocks allow; reference clocks run apart by up to 30 hours."""
    e = F.col("event_id")
    left = t.quotes(spark, d).select("event_id", "dom", "us", (F.col("us") + (e % 5 - 2) * H).alias("wall"))
    right = t.quotes(spark, d, "click").select(e.alias("rid"), "dom", F.col("us").alias("rus"), (F.col("us") + (e % 7 - 3) * 10 * H).alias("rwall"))
    found = dual_clock_asof(left, right, ["dom"], "us", "wall", "rus", "rwall", ["rid", "rus"], ["rid"])
    return found.select("event_id", "dom", "us", "r_rid", (F.col("us") - F.col("r_rus")).alias("age_us"))


@query(f"""WITH s AS (SELECT e.event_id, e.dom, e.us, sum(CASE WHEN side = 'buy' THEN size ELSE 0 END) AS b, sum(CASE WHEN side = 'sell' THEN size ELSE 0 END) AS s, sum(CASE WHEN side = 'unknown' THEN size ELSE 0 END) AS u, count(tr.event_id) AS n
  FROM q e LEFT JOIN tr ON tr.dom = e.dom AND tr.us > e.us - {LOOKBACK} AND tr.us <= e.us GROUP BY e.event_id, e.dom, e.us)
SELECT event_id, dom, us, CASE WHEN u = 0 AND n > 0 THEN CAST(b AS BIGINT) END AS buy, CASE WHEN u = 0 AND n > 0 THEN CAST(s AS BIGINT) END AS sell, CASE WHEN u = 0 AND n > 0 THEN (b - s)::DOUBLE / (b + s)::DOUBLE END AS flow FROM s""")
def trade_flow_window(spark, d):
    """JOIN-14, FEA-04: signed flow in (t - 24 h, t] from running sums; the oracle is an independent range join."""
    return features.trade_flow(t.quotes(spark, d), t.trades(spark, d), ["dom"], "event_id", "us", LOOKBACK)


# -- horizons -----------------------------------------------------------------------------------------------------

ORDERED = "SELECT dom, day, event_id, us, row_number() OVER (PARTITION BY {by} ORDER BY us, event_id) AS rn FROM ev"


@query(f"""WITH o AS (SELECT dom, event_id, us, row_number() OVER (PARTITION BY dom ORDER BY us, event_id) AS rn FROM ev),
w(dom, rn) AS (SELECT dom, CAST(1 AS BIGINT) FROM o WHERE rn = 1
  UNION ALL SELECT w.dom, x.rn + 1 FROM w JOIN o s ON s.dom = w.dom AND s.rn = w.rn, LATERAL (SELECT min(rn) AS rn FROM o e WHERE e.dom = w.dom AND e.rn > w.rn AND e.us >= s.us + {LONG}) x WHERE x.rn IS NOT NULL),
p AS (SELECT w.dom, s.rn, s.event_id, s.us, (SELECT min(rn) FROM o e WHERE e.dom = w.dom AND e.rn > w.rn AND e.us >= s.us + {LONG}) AS ex FROM w JOIN o s ON s.dom = w.dom AND s.rn = w.rn)
SELECT p.dom, p.event_id AS entry_key, p.us AS entry_time, e.event_id AS exit_key, e.us AS exit_time,
  CASE WHEN p.ex IS NOT NULL THEN (SELECT count(*) > 0 FROM o a JOIN o b ON a.dom = b.dom AND b.rn = a.rn + 1 WHERE a.dom = p.dom AND a.rn >= p.rn AND b.rn <= p.ex AND b.us - a.us > {STALE}) END AS has_gap
FROM p LEFT JOIN o e ON e.dom = p.dom AND e.rn = p.ex""")
def windows_exit_plus_one(spark, d):
    """WIN-08, WIN-09: greedy non-overlapping windows; the next entry is the row after the exit."""
    return horizons.greedy(t.events(spark, d), ["dom"], "us", "event_id", LONG, STALE)


@query(f"""WITH o AS (SELECT dom, day, event_id, us, row_number() OVER (PARTITION BY dom, day ORDER BY us, event_id) AS rn FROM ev),
w(dom, day, rn) AS (SELECT dom, day, CAST(1 AS BIGINT) FROM o WHERE rn = 1
  UNION ALL SELECT w.dom, w.day, x.rn + 1 FROM w JOIN o s ON s.dom = w.dom AND s.day = w.day AND s.rn = w.rn, LATERAL (SELECT min(rn) AS rn FROM o e WHERE e.dom = w.dom AND e.day = w.day AND e.rn > w.rn AND e.us >= s.us + {H}) x WHERE x.rn IS NOT NULL),
p AS (SELECT w.dom, w.day, s.rn, s.event_id, s.us, (SELECT min(rn) FROM o e WHERE e.dom = w.dom AND e.day = w.day AND e.rn > w.rn AND e.us >= s.us + {H}) AS ex FROM w JOIN o s ON s.dom = w.dom AND s.day = w.day AND s.rn = w.rn)
SELECT p.dom, p.day, p.event_id AS entry_key, p.us AS entry_time, e.event_id AS exit_key, e.us AS exit_time,
  CASE WHEN p.ex IS NOT NULL THEN (SELECT count(*) > 0 FROM o a JOIN o b ON a.dom = b.dom AND a.day = b.day AND b.rn = a.rn + 1 WHERE a.dom = p.dom AND a.day = p.day AND a.rn >= p.rn AND b.rn <= p.ex AND b.us - a.us > {H // 2}) END AS has_gap
FROM p LEFT JOIN o e ON e.dom = p.dom AND e.day = p.day AND e.rn = p.ex""")
def windows_within_days(spark, d):
    """WIN-09: greedy windows of one hour that never cross a day: the day is part of the domain."""
    return horizons.greedy(t.events(spark, d), ["dom", "day"], "us", "event_id", H, H // 2)


@query(f"""WITH o AS (SELECT dom, event_id, us, row_number() OVER (PARTITION BY dom ORDER BY us, event_id) AS rn, max(us) OVER (PARTITION BY dom) AS last FROM ev),
w(dom, rn, nxt, ex, over) AS (
  SELECT dom, rn, CASE WHEN over THEN rn + 1 ELSE ex END, ex, over FROM (SELECT s.dom, s.rn, x.rn AS ex, x.us - s.us - {LONG} > {2 * H} AS over FROM o s, LATERAL (SELECT rn, us FROM o e WHERE e.dom = s.dom AND e.rn > s.rn AND e.us >= s.us + {LONG} ORDER BY rn LIMIT 1) x WHERE s.rn = 1 AND s.us + {LONG} <= s.last)
  UNION ALL
  SELECT dom, rn, CASE WHEN over THEN rn + 1 ELSE ex END, ex, over FROM (SELECT s.dom, s.rn, x.rn AS ex, x.us - s.us - {LONG} > {2 * H} AS over FROM w JOIN o s ON s.dom = w.dom AND s.rn = w.nxt, LATERAL (SELECT rn, us FROM o e WHERE e.dom = s.dom AND e.rn > s.rn AND e.us >= s.us + {LONG} ORDER BY rn LIMIT 1) x WHERE s.us + {LONG} <= s.last))
SELECT w.dom, s.event_id AS entry_key, s.us AS entry_time, e.event_id AS exit_key, e.us AS exit_time, w.over AS excluded FROM w JOIN o s ON s.dom = w.dom AND s.rn = w.rn JOIN o e ON e.dom = w.dom AND e.rn = w.ex""")
def windows_touching(spark, d):
    """WIN-10: the next entry is the exit itself; an overshoot excludes the window and moves on by one row."""
    return horizons.touching(t.events(spark, d), ["dom"], "us", "event_id", LONG, 2 * H)


@query(f"SELECT s.event_id, s.dom, s.us, e.event_id AS exit_event_id, e.us AS exit_time, e.cents AS exit_cents FROM ev s ASOF LEFT JOIN ev e ON s.dom = e.dom AND s.us + {SHORT} <= e.us")
def windows_overlapping(spark, d):
    """WIN-11: every row starts a window; its exit is a forward as-of match."""
    return horizons.overlapping(t.events(spark, d).select("event_id", "dom", "us", "cents"), ["dom"], "us", "event_id", SHORT, ["cents"]).select("event_id", "dom", "us", "exit_event_id", "exit_time", "exit_cents")


@query("SELECT event_id, dom, CASE WHEN row_number() OVER (PARTITION BY dom ORDER BY us, event_id) <= count(*) OVER (PARTITION BY dom) // 2 THEN 'EARLY' ELSE 'LATE' END AS half FROM ev")
def early_late_halves(spark, d):
    """WIN-16, AGG-31: chronological halves, an odd row is late."""
    return horizons.halves(t.events(spark, d).select("event_id", "dom", "us"), ["dom"], ["us", "event_id"]).select("event_id", "dom", "half")


# -- quantiles ----------------------------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, quantile_disc(cents, 0.5) AS p50, quantile_disc(cents, 0.75) AS p75, quantile_disc(cents, 0.9) AS p90, quantile_disc(cents, 0.95) AS p95 FROM ev GROUP BY event_type")
def nearest_rank(spark, d):
    """AGG-05, AGG-09..14: exact nearest-rank quantiles."""
    return quantiles.nearest_ranks(t.events(spark, d), ["event_type"], "cents", ["0.5", "0.75", "0.9", "0.95"], ["p50", "p75", "p90", "p95"])


@query("""WITH s AS (SELECT event_type, cents, row_number() OVER (PARTITION BY event_type ORDER BY cents) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM ev)
SELECT event_type, max(n) AS n, max(CASE WHEN k = (n - 1) * 9 // 10 THEN cents END)::DOUBLE + (max(CASE WHEN k = least((n - 1) * 9 // 10 + 1, n - 1) THEN cents END)::DOUBLE - max(CASE WHEN k = (n - 1) * 9 // 10 THEN cents END)::DOUBLE) * (max((n - 1) * 9 % 10)::DOUBLE / 10.0::DOUBLE) AS q90 FROM s GROUP BY event_type""")
def quantile_type7(spark, d):
    """AGG-15, AGG-16: linear interpolation between two exact ranks."""
    return quantiles.type7(t.events(spark, d), ["event_type"], "cents", ["0.9"], ["q90"])


@query("""WITH s AS (SELECT dom, cents, row_number() OVER (PARTITION BY dom ORDER BY cents) - 1 AS k, count(*) OVER (PARTITION BY dom) AS n FROM ev)
SELECT dom, max(n) AS n, CAST(sum(CASE WHEN k = (n - 1) // 2 THEN cents ELSE 0 END) + sum(CASE WHEN k = n // 2 THEN cents ELSE 0 END) AS BIGINT) AS twice_median, (sum(CASE WHEN k = (n - 1) // 2 THEN cents ELSE 0 END) + sum(CASE WHEN k = n // 2 THEN cents ELSE 0 END))::DOUBLE / 2.0::DOUBLE AS median FROM s GROUP BY dom""")
def exact_median(spark, d):
    """AGG-17: mean of the two middle values."""
    return quantiles.median(t.events(spark, d), ["dom"], "cents")


@query("""WITH g AS (SELECT event_type, us - lag(us) OVER (PARTITION BY event_type ORDER BY us, event_id) AS delta FROM ev)
SELECT event_type, count(*) AS n, quantile_disc(delta, 0.5) AS p50, quantile_disc(delta, 0.9) AS p90, quantile_disc(delta, 0.99) AS p99, max(delta) AS longest FROM g WHERE delta > 0 GROUP BY event_type""")
def cadence(spark, d):
    """AGG-08: quantiles of positive inter-arrival times."""
    g = quantiles.positive_deltas(t.events(spark, d), ["event_type"], "us", ["event_id"])
    return quantiles.nearest_ranks(g, ["event_type"], "delta", ["0.5", "0.9", "0.99", "1"], ["p50", "p90", "p99", "longest"])


# -- buckets and intervals ----------------------------------------------------------------------------------------


@query(f"SELECT dom, us // {SHORT} AS bucket, arg_min(cents, (us, event_id)) AS first_cents, arg_max(cents, (us, event_id)) AS last_cents, count(*) AS n FROM ev GROUP BY dom, us // {SHORT}")
def bucket_first_last(spark, d):
    """AGG-25, DT-04, STM-12: first and last value of clock-aligned buckets."""
    at = F.struct("us", "event_id")
    return t.events(spark, d).groupBy("dom", F.expr(f"us div {SHORT}").alias("bucket")).agg(F.min_by("cents", at).alias("first_cents"), F.max_by("cents", at).alias("last_cents"), F.count("*").alias("n"))


@query("""WITH h AS (SELECT unnest([1, 6, 24]) AS hours), b AS (SELECT hours, dom, us // (hours * 3600000000) AS bucket, arg_min(cents, (us, event_id)) AS a, arg_max(cents, (us, event_id)) AS z FROM ev, h GROUP BY ALL)
SELECT hours, count(*) AS buckets, count(*) FILTER (abs(z - a) * 10 > a) AS exceeding, count(*) FILTER (abs(z - a) * 10 > a)::DOUBLE / count(*)::DOUBLE AS share FROM b GROUP BY hours""")
def horizon_scan(spark, d):
    """AGG-26: buckets of several widths in one pass and the share that moves over a tenth."""
    at = F.struct("us", "event_id")
    wide = t.events(spark, d).withColumn("hours", F.explode(F.array(F.lit(1), F.lit(6), F.lit(24))))
    b = wide.groupBy("hours", "dom", F.expr("us div (hours * 3600000000L)").alias("bucket")).agg(F.min_by("cents", at).alias("a"), F.max_by("cents", at).alias("z"))
    moved = F.count(F.when(F.abs(F.col("z") - F.col("a")) * 10 > F.col("a"), 1))
    return b.groupBy("hours").agg(F.count("*").alias("buckets"), moved.alias("exceeding"), (moved.cast("double") / F.count("*").cast("double")).alias("share"))


@query("""WITH b AS (SELECT event_type, day, count(DISTINCT us // 3600000000) AS present FROM ev GROUP BY event_type, day)
SELECT event_type, day, CAST(sum(present) AS BIGINT) AS present, CAST(sum(24 - present) AS BIGINT) AS missing FROM b GROUP BY ROLLUP (event_type, day)""")
def missing_buckets(spark, d):
    """AGG-27: hourly buckets that a day lacks, rolled up."""
    b = t.events(spark, d).groupBy("event_type", "day").agg(F.count_distinct(F.expr("us div 3600000000L")).alias("present"))
    return b.rollup("event_type", "day").agg(F.sum("present").alias("present"), F.sum(24 - F.col("present")).alias("missing"))


INTERVALS = f"SELECT dom, us AS a, us + {SHORT} AS z FROM ev"


@query(f"""WITH i AS ({INTERVALS}), m AS (SELECT *, max(z) OVER (PARTITION BY dom ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i),
n AS (SELECT *, sum(CASE WHEN a <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY dom ORDER BY a, z ROWS UNBOUNDED PRECEDING) AS island FROM m), s AS (SELECT dom, island, min(a) AS a, max(z) AS z FROM n GROUP BY dom, island)
SELECT dom, count(*) AS islands, CAST(sum(z - a) AS BIGINT) AS covered_us FROM s GROUP BY dom""")
def interval_union(spark, d):
    """AGG-39: length of the union of intervals; touching ones merge."""
    i = t.events(spark, d).select("dom", F.col("us").alias("a"), (F.col("us") + SHORT).alias("z"))
    return spans.merged(i, ["dom"], "a", "z").groupBy("dom").agg(F.count("*").alias("islands"), F.sum(F.col("z") - F.col("a")).alias("covered_us"))


@query(f"SELECT dom, event_id, a, previous_end FROM (SELECT dom, event_id, us AS a, lag(us + {SHORT}) OVER (PARTITION BY dom ORDER BY us, us + {SHORT}, event_id) AS previous_end FROM ev) WHERE a <= previous_end")
def interval_overlaps(spark, d):
    """SET-06: intervals that start before their predecessor ends."""
    i = t.events(spark, d).select("dom", "event_id", F.col("us").alias("a"), (F.col("us") + SHORT).alias("z"))
    return spans.overlaps(i, ["dom"], "a", "z", ["event_id"]).select("dom", "event_id", "a", "previous_end")
