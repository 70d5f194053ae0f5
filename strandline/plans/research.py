"""Features, simulation, models and gates over the market views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import prices, statistics
from strandline.operators import descent, features, horizons, models, quantiles, selection, simulate
from strandline.operators.asof import asof_join
from strandline.operators.scan import scanned
from strandline.plans.core import query
from strandline.plans.market import IDS, LOOKBACK, SHORT, STALE
from strandline.sources import tables as t
from strandline.sources.checkpoints import cut

OPPORTUNITIES = f"""WITH o AS (SELECT e.event_id, e.dom, e.day, e.us, e.bid AS entry_bid, e.ask AS entry_ask, e.bid_sz, e.ask_sz, e.flags, x.event_id AS exit_id, x.us AS exit_us, x.bid AS exit_bid, x.ask AS exit_ask, x.flags AS exit_flags
  FROM q e ASOF LEFT JOIN q x ON e.dom = x.dom AND e.us + {SHORT} <= x.us),
op AS (SELECT *, CASE WHEN exit_us IS NULL THEN 'MISSING_EXIT_QUOTE' WHEN flags & 54 <> 0 OR exit_flags & 54 <> 0 THEN 'QUALITY' WHEN exit_us - us > {4 * SHORT} THEN 'LATE_EXIT' END AS invalid FROM o)"""


def opportunities(spark: SparkSession, d: str) -> DataFrame:
    """Each quote as an entry, the first quote at or after the horizon as its exit, and the reasons against it."""
    q = t.quotes(spark, d)
    out = horizons.overlapping(q, ["dom"], "us", "event_id", SHORT, ["bid", "ask", "flags"])
    mask = t.GAP | t.STALE | t.BACKFILL | t.SUSPECT
    late = F.col("exit_time") - F.col("us") > 4 * SHORT
    missing = F.col("exit_time").isNull()
    bad = prices.flagged(F.col("flags"), mask) | F.coalesce(prices.flagged(F.col("exit_flags"), mask), F.lit(False))
    reason = F.when(missing, "MISSING_EXIT_QUOTE").when(bad, "QUALITY").when(late, "LATE_EXIT")
    return out.select(
        "event_id", "dom", "day", "us", F.col("bid").alias("entry_bid"), F.col("ask").alias("entry_ask"), "bid_sz", "ask_sz", "flags", F.col("exit_event_id").alias("exit_id"), F.col("exit_time").alias("exit_us"), "exit_bid", "exit_ask", "exit_flags", reason.alias("invalid"),
        F.array_compact(F.array(reason)).alias("invalid_reasons"),
    )


@query(f"{OPPORTUNITIES} SELECT event_id, dom, us, exit_id, exit_us, invalid FROM op")
def opportunity_rows(spark, d):
    """JOIN-05, JOIN-13, FIL-04, FIL-05: entries, exits and invalid reasons."""
    return opportunities(spark, d).select("event_id", "dom", "us", "exit_id", "exit_us", "invalid")


LEDGER = """, pol AS (SELECT op.*, policy, CASE policy WHEN 'none' THEN 'ABSTAIN' WHEN 'sign' THEN CASE WHEN bid_sz > ask_sz THEN 'LONG' WHEN bid_sz < ask_sz THEN 'SHORT' ELSE 'ABSTAIN' END
    ELSE CASE WHEN ('0x' || substr(sha256('11|' || CAST(event_id AS VARCHAR)), 1, 2))::INTEGER % 2 = 1 THEN 'LONG' ELSE 'SHORT' END END AS action FROM op, (VALUES ('none'), ('sign'), ('random')) p(policy)),
px AS (SELECT *, CASE WHEN invalid IS NOT NULL THEN 'INVALID' WHEN action = 'ABSTAIN' THEN 'NO_TRADE' ELSE 'TRADED' END AS status, CASE WHEN action = 'LONG' THEN entry_ask ELSE entry_bid END AS ep, CASE WHEN action = 'LONG' THEN exit_bid ELSE exit_ask END AS xp FROM pol),
led AS (SELECT *, CASE status WHEN 'TRADED' THEN CASE WHEN action = 'LONG' THEN xp - ep ELSE ep - xp END WHEN 'NO_TRADE' THEN 0 END AS gross, CASE status WHEN 'TRADED' THEN (ep + xp) * 450 WHEN 'NO_TRADE' THEN 0 END AS fee_micro FROM px)"""


def ledger(spark, d) -> DataFrame:
    o = opportunities(spark, d)
    signal = (F.col("bid_sz") - F.col("ask_sz")).cast("double")
    policies = {"none": simulate.no_trade(), "sign": simulate.sign_policy(signal), "random": simulate.random_direction("11", "event_id")}
    return simulate.run(simulate.with_policies(o, policies))


@query(f"{OPPORTUNITIES}{LEDGER} SELECT event_id, policy, action, status, gross, fee_micro, gross * 1000000 - fee_micro AS known_net_micro, CASE WHEN status = 'NO_TRADE' THEN 0 END::BIGINT AS business_net_micro, CASE WHEN status = 'TRADED' THEN 'FUNDING,IMPACT,SLIPPAGE' ELSE '' END AS unknown FROM led")
def sim_ledger(spark, d):
    """SIM-01..04, SUP-24..28, I6, I10: the ledger of three policies; unknown costs stay null."""
    return ledger(spark, d).select("event_id", "policy", "action", "status", "gross", "fee_micro", "known_net_micro", "business_net_micro", F.array_join("unknown_costs", ",").alias("unknown"))


@query(f"""{OPPORTUNITIES}{LEDGER} SELECT policy, count(*) AS opportunities, count(*) FILTER (status = 'INVALID') AS invalid, count(*) FILTER (status = 'NO_TRADE') AS no_trade, count(*) FILTER (status = 'TRADED') AS traded, CAST(sum(gross) AS BIGINT) AS gross,
  CAST(sum(gross * 1000000 - fee_micro) AS BIGINT) AS known_net_micro, CASE WHEN count(*) FILTER (status = 'TRADED') = 0 THEN 0 END::BIGINT AS business_net_micro, count(*) FILTER (status = 'TRADED' AND gross * 1000000 - fee_micro > 0) AS winners FROM led GROUP BY policy""")
def sim_summary(spark, d):
    """AGG-35, AGG-36: report totals."""
    return simulate.summary(ledger(spark, d), "policy")


@query(f"""{OPPORTUNITIES}{LEDGER}, i AS (SELECT policy, status, (status = 'NO_TRADE' AND gross = 0 AND fee_micro = 0) OR (status = 'INVALID' AND gross IS NULL AND fee_micro IS NULL) OR (status = 'TRADED' AND gross IS NOT NULL AND fee_micro > 0) AS sound FROM led),
r AS (SELECT count(*) - count(DISTINCT event_id) AS again FROM op) SELECT policy, status, count(*) AS rows, count(*) FILTER (sound) AS sound, max(again) AS repeated FROM i, r GROUP BY policy, status""")
def sim_invariants(spark, d):
    """SIM-05, SUP-29, SET-05: how many rows of each status keep the ledger's invariants, and how many ids repeat."""
    rows = ledger(spark, d)
    bad = simulate.violations(rows).groupBy("policy", "status").agg(F.count("*").alias("bad"))
    again = simulate.repeated(opportunities(spark, d), "event_id").agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated"))
    counts = rows.groupBy("policy", "status").agg(F.count("*").alias("rows")).join(bad, ["policy", "status"], "left")
    return counts.crossJoin(F.broadcast(again)).select("policy", "status", "rows", (F.col("rows") - F.coalesce("bad", F.lit(0))).alias("sound"), "repeated")  # one row


CANDIDATES = [(f"C{k}", least) for k, least in enumerate((0, 1, 2, 3, 4))]


@query(f"""{OPPORTUNITIES}, c AS (SELECT * FROM (VALUES ('C0', 0), ('C1', 1), ('C2', 2), ('C3', 3), ('C4', 4)) x(candidate, least)),
a AS (SELECT candidate, CASE WHEN us < 1705276800000000 THEN 'DEV_A' ELSE 'DEV_B' END AS part, CASE WHEN bid_sz > ask_sz THEN exit_bid - entry_ask ELSE entry_bid - exit_ask END AS gross FROM op, c WHERE invalid IS NULL AND abs(bid_sz - ask_sz) > least)
SELECT candidate, part, count(*) AS trades, CAST(sum(gross) AS BIGINT) AS gross, count(*) FILTER (gross > 0) AS winners, sum(gross)::DOUBLE / count(*)::DOUBLE AS mean_gross FROM a GROUP BY GROUPING SETS ((candidate, part), (candidate))""")
def candidate_grouping_sets(spark, d):
    """PRJ-19, PRJ-20, AGG-20, AGG-21: candidate rules for each part and all parts in one pass."""
    diff = F.col("bid_sz") - F.col("ask_sz")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(least).alias("least")) for n, least in CANDIDATES]))
    rows = opportunities(spark, d).where("invalid IS NULL").withColumn("c", each).where(F.abs(diff) > F.col("c.least"))
    gross = F.when(diff > 0, F.col("exit_bid") - F.col("entry_ask")).otherwise(F.col("entry_bid") - F.col("exit_ask"))
    rows = rows.select(F.col("c.candidate").alias("candidate"), F.when(F.col("us") < 1705276800000000, "DEV_A").otherwise("DEV_B").alias("part"), gross.alias("gross"))
    out = rows.groupingSets([["candidate", "part"], ["candidate"]], "candidate", "part").agg(F.count("*").alias("trades"), F.sum("gross").alias("gross"), F.count(F.when(F.col("gross") > 0, 1)).alias("winners"))
    return out.withColumn("mean_gross", F.col("gross").cast("double") / F.col("trades").cast("double"))


@query(f"""{OPPORTUNITIES}, c AS (SELECT * FROM (VALUES ('C0', 0), ('C1', 1), ('C2', 2), ('C3', 3), ('C4', 4)) x(candidate, least)),
a AS (SELECT candidate, CASE WHEN bid_sz > ask_sz THEN exit_bid - entry_ask ELSE entry_bid - exit_ask END AS gross FROM op, c WHERE invalid IS NULL AND abs(bid_sz - ask_sz) > least),
m AS (SELECT candidate, count(*) AS trades, sum(gross)::DOUBLE / count(*)::DOUBLE AS mean_gross FROM a GROUP BY candidate HAVING count(*) >= 30) SELECT * FROM m ORDER BY mean_gross DESC, candidate LIMIT 2""")
def shortlist(spark, d):
    """TOPK-01..04, SUP-33..35: the two best supported candidates; ties go by name."""
    m = candidate_grouping_sets(spark, d).where("part IS NULL AND trades >= 30").select("candidate", "trades", "mean_gross")
    return m.orderBy(F.desc("mean_gross"), "candidate").limit(2)


# -- features -----------------------------------------------------------------------------------------------------

RETURNS = f"""WITH n AS (SELECT e.event_id, e.dom, e.us, r.us AS cus, r.bid AS cb, r.ask AS ca, r.flags AS cf FROM q e ASOF LEFT JOIN rq r ON e.dom = r.dom AND e.us >= r.us),
b AS (SELECT n.*, n.us - {LOOKBACK} AS back, r.us AS lus, r.bid AS lb, r.ask AS la, r.flags AS lf FROM n ASOF LEFT JOIN rq r ON n.dom = r.dom AND n.us - {LOOKBACK} >= r.us),
rr AS (SELECT *, CASE WHEN dom NOT IN (SELECT dom FROM rq) THEN 'UNAVAILABLE' WHEN cus IS NULL THEN 'CURRENT_UNAVAILABLE' WHEN lus IS NULL THEN 'LOOKBACK_UNAVAILABLE' WHEN us - cus > {2 * STALE} THEN 'CURRENT_STALE'
  WHEN back - lus > {2 * STALE} THEN 'LOOKBACK_STALE' WHEN NOT (cb > 0 AND ca > cb AND lb > 0 AND la > lb AND cf & 54 = 0 AND lf & 54 = 0) THEN 'BBO_INVALID' END AS reason FROM b)"""
RETURN_VALUE = "CASE WHEN reason IS NULL AND lb + la > 0 THEN (10000 * ((cb + ca) - (lb + la)))::DOUBLE / (lb + la)::DOUBLE END"


@query(f"{RETURNS} SELECT event_id, dom, {RETURN_VALUE} AS value, reason FROM rr")
def reference_return(spark, d):
    """JOIN-10, JOIN-11, PRJ-10, PRJ-11, I5: a return with staleness at both ends and one ordered reason."""
    return features.reference_return(t.quotes(spark, d), t.quotes(spark, d, "click"), ["dom"], "event_id", "us", LOOKBACK, 2 * STALE)


def feature_table(spark, d) -> DataFrame:
    """One row for each opportunity: spread, imbalance, reference return, trade flow, label and reasons."""
    o = opportunities(spark, d)
    ref = features.reference_return(t.quotes(spark, d), t.quotes(spark, d, "click"), ["dom"], "event_id", "us", LOOKBACK, 2 * STALE).select("event_id", F.col("value").alias("ref_return_bps"), F.col("reason").alias("ref_reason"))
    flow = features.trade_flow(t.quotes(spark, d), t.trades(spark, d), ["dom"], "event_id", "us", LOOKBACK).select("event_id", "flow")
    label = prices.return_bps(F.col("entry_bid") + F.col("entry_ask"), F.col("exit_bid") + F.col("exit_ask"))
    base = o.select("event_id", "dom", "day", "us", prices.spread_bps(F.col("entry_bid"), F.col("entry_ask")).alias("spread_bps"), prices.imbalance(F.col("bid_sz"), F.col("ask_sz")).alias("imbalance"), F.when(F.col("invalid").isNull(), label).alias("label_bps"), "invalid")
    return base.join(ref, "event_id", "left").join(flow, "event_id", "left")


FEATURES = f"""{OPPORTUNITIES}, {RETURNS[5:]}, fl AS (SELECT e.event_id, CASE WHEN count(*) FILTER (side = 'unknown') = 0 AND count(tr.event_id) > 0 THEN (sum(CASE WHEN side = 'buy' THEN size ELSE -size END))::DOUBLE / sum(size)::DOUBLE END AS flow
  FROM q e LEFT JOIN tr ON tr.dom = e.dom AND tr.us > e.us - {LOOKBACK} AND tr.us <= e.us GROUP BY e.event_id),
ft AS (SELECT op.event_id, op.dom, op.day, op.us, CASE WHEN entry_bid > 0 THEN 20000.0::DOUBLE * (entry_ask - entry_bid) / (entry_ask + entry_bid)::DOUBLE END AS spread_bps, (bid_sz - ask_sz)::DOUBLE / (bid_sz + ask_sz)::DOUBLE AS imbalance,
  CASE WHEN invalid IS NULL AND entry_bid + entry_ask > 0 THEN (10000 * ((exit_bid + exit_ask) - (entry_bid + entry_ask)))::DOUBLE / (entry_bid + entry_ask)::DOUBLE END AS label_bps, invalid, {RETURN_VALUE} AS ref_return_bps, reason AS ref_reason, flow
  FROM op JOIN rr USING (event_id) JOIN fl USING (event_id))"""


@query(f"{FEATURES} SELECT event_id, dom, day, us, spread_bps, imbalance, label_bps, invalid, ref_return_bps, ref_reason, flow FROM ft")
def feature_rows(spark, d):
    """FEA-01..06, PRJ-12, PRJ-22, PRJ-23: the causal feature rows."""
    return feature_table(spark, d)


@query(f"""{FEATURES} SELECT feature, CAST(missing AS BIGINT) AS missing, CAST(present AS BIGINT) AS present FROM (
  SELECT 'spread_bps' AS feature, count(*) - count(spread_bps) AS missing, count(spread_bps) AS present FROM ft UNION ALL SELECT 'ref_return_bps', count(*) - count(ref_return_bps), count(ref_return_bps) FROM ft
  UNION ALL SELECT 'flow', count(*) - count(flow), count(flow) FROM ft UNION ALL SELECT 'label_bps', count(*) - count(label_bps), count(label_bps) FROM ft)""")
def feature_missingness(spark, d):
    """AGG-30, FIL-08: missing values of each feature in one pass."""
    return features.missing_counts(feature_table(spark, d), ["spread_bps", "ref_return_bps", "flow", "label_bps"])


@query(f"{FEATURES} SELECT day, count(*) AS rows, count(*) FILTER (c) AS complete, count(*) FILTER (c AND label_bps > 0) AS positive, count(*) FILTER (c AND label_bps <= 0) AS non_positive FROM (SELECT *, spread_bps IS NOT NULL AND ref_return_bps IS NOT NULL AND imbalance IS NOT NULL AS c FROM ft) GROUP BY day")
def support_summary(spark, d):
    """AGG-28, AGG-29, AGG-37, GAT-12: rows that a model can be trained on, for each day."""
    return models.support(feature_table(spark, d), ["spread_bps", "ref_return_bps", "imbalance"], "label_bps", ["day"])


# -- statistics ---------------------------------------------------------------------------------------------------


@query(f"""WITH s AS (SELECT event_type, count(*) AS n, count(*) FILTER (cents % 2 = 0) AS hits FROM ev GROUP BY event_type),
w AS (SELECT *, hits::DOUBLE / n::DOUBLE AS p, n::DOUBLE AS m, {statistics.Z_95_ONE_SIDED!r}::DOUBLE AS z FROM s)
SELECT event_type, n, hits, round(greatest(0.0::DOUBLE, (p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)), 10) AS lower_bound FROM w""")
def wilson_bounds(spark, d):
    """MTH-12, MTH-13: lower Wilson bounds of shares."""
    s = t.events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count(F.when(F.col("cents") % 2 == 0, 1)).alias("hits"))
    return s.select("event_type", "n", "hits", F.round(statistics.wilson_lower(F.col("hits"), F.col("n")), 10).alias("lower_bound"))


@query("SELECT * FROM (VALUES ('dkw_0.95_0.025', 2952::BIGINT), ('power_0.55', 783), ('power_0.54', 1225)) x(name, n)", views=False)
def power_counts(spark, d):
    """MTH-06, MTH-07, MTH-08: planning counts; the oracle holds the published constants."""
    rows = [("dkw_0.95_0.025", statistics.dkw_count("0.95", "0.025")), ("power_0.55", planned(0.55)), ("power_0.54", planned(0.54))]
    return spark.createDataFrame(rows, "name string, n long")


def planned(accuracy: float) -> int:
    return statistics.power_count(accuracy, z_alpha=1.959963984540054)


@query("""WITH o AS (SELECT event_type, event_id, CAST(cents % 2 AS BIGINT) AS x FROM ev), l AS (SELECT event_type, x, lag(x, 1) OVER w AS l1, lag(x, 2) OVER w AS l2, lag(x, 3) OVER w AS l3 FROM o WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
p AS (SELECT event_type, x, unnest([1, 2, 3]) AS lag, unnest([l1, l2, l3]) AS y FROM l)
SELECT event_type, CAST(lag AS INTEGER) AS lag, count(*) AS n, CAST(sum(x) AS BIGINT) AS ones, count(y) AS pairs, CAST(sum(x * y) AS BIGINT) AS product FROM p GROUP BY event_type, lag""")
def autocorrelation(spark, d):
    """WIN-12, MTH-10: integer sums of lagged products of a 0/1 series."""
    o = t.events(spark, d).select("event_type", "event_id", (F.col("cents") % 2).alias("x"))
    return features.autocorrelation(o, ["event_type"], ["event_id"], "x", 3, IDS).select("event_type", "lag", "n", "ones", "pairs", "product")


@query("""WITH s AS (SELECT dom, us, event_id, sign(cents - lag(cents) OVER (PARTITION BY dom ORDER BY us, event_id)) AS s FROM ev), z AS (SELECT dom, s, lag(s) OVER (PARTITION BY dom ORDER BY us, event_id) AS p FROM s WHERE s <> 0)
SELECT (SELECT count(*) FROM s WHERE s = 0) AS zero_moves, count(*) FILTER (p IS NOT NULL) AS adjacent, count(*) FILTER (s = p) AS agreeing FROM z""")
def sign_agreement(spark, d):
    """AGG-41, PRJ-03, PRJ-04: moves of zero and agreement of neighbouring signs."""
    order = ["us", "event_id"]
    s = scanned(t.events(spark, d).select("dom", "us", "event_id", "cents"), ["dom"], order, lags={"before": F.col("cents")}, keep=True)
    s = s.withColumn("s", F.signum(F.col("cents") - F.col("before")))
    z = scanned(s.where("s <> 0"), ["dom"], order, lags={"p": F.col("s")})
    pairs = z.agg(F.count("p").alias("adjacent"), F.count(F.when(F.col("s") == F.col("p"), 1)).alias("agreeing"))
    return s.agg(F.count(F.when(F.col("s") == 0, 1)).alias("zero_moves")).crossJoin(F.broadcast(pairs))  # one row each


@query("""WITH r AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS rn FROM ev), s AS (SELECT *, count(*) FILTER (event_type = 'view') OVER w AS a, count(*) FILTER (event_type = 'click') OVER w AS b FROM r WINDOW w AS (ORDER BY us DESC, event_id DESC ROWS UNBOUNDED PRECEDING)),
c AS (SELECT max(us) AS boundary_us FROM s WHERE a >= 300 AND b >= 300) SELECT boundary_us, (SELECT count(*) FROM ev WHERE us < boundary_us) AS development, (SELECT count(*) FROM ev WHERE us >= boundary_us) AS confirmation FROM c""")
def partition_plan(spark, d):
    """WIN-13..15, GAT-05, I8: the latest time whose suffix supports both hypotheses; equal times go to one side.

    Counts for each day are summed backwards first, so that only the one day that holds the boundary is ordered by row.
    """
    needed = 300
    e = t.events(spark, d)
    kinds = lambda: [F.count(F.when(F.col("event_type") == k, 1)).alias(n) for k, n in (("view", "a"), ("click", "b"))]
    days = e.groupBy("day").agg(*kinds())
    after = Window.partitionBy(F.lit(0)).orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    later = days.select("day", "a", "b", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"{c}_later") for c in ("a", "b")])
    holds = later.where((F.col("a") + F.col("a_later") >= needed) & (F.col("b") + F.col("b_later") >= needed)).agg(F.max(F.struct("day", "a_later", "b_later")).alias("m")).select("m.*")
    back = Window.partitionBy("day").orderBy(F.desc("us"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    inside = e.join(F.broadcast(holds), "day")
    so_far = [(F.col(f"{n}_later") + F.count(F.when(F.col("event_type") == k, 1)).over(back)).alias(f"n_{n}") for k, n in (("view", "a"), ("click", "b"))]
    boundary = inside.select("us", *so_far).where((F.col("n_a") >= needed) & (F.col("n_b") >= needed)).agg(F.max("us").alias("boundary_us"))
    return e.crossJoin(F.broadcast(boundary)).groupBy("boundary_us").agg(F.count(F.when(F.col("us") < F.col("boundary_us"), 1)).alias("development"), F.count(F.when(F.col("us") >= F.col("boundary_us"), 1)).alias("confirmation"))


@query(f"""{OPPORTUNITIES}, w AS (SELECT *, row_number() OVER (ORDER BY us, event_id) AS rn FROM op WHERE invalid IS NULL), f AS (SELECT abs(10000 * ((exit_bid + exit_ask) - (entry_bid + entry_ask)))::DOUBLE / (entry_bid + entry_ask)::DOUBLE AS move,
  (10000 * (entry_ask * 100045 - entry_bid * 99955))::DOUBLE / (entry_bid * 99955)::DOUBLE AS friction FROM w WHERE rn <= 300 AND entry_bid > 0)
SELECT count(*) AS windows, quantile_disc(move, 0.95) AS q95_move, quantile_disc(friction, 0.5) AS q50_friction, CASE WHEN count(*) < 100 THEN 'INCONCLUSIVE' WHEN quantile_disc(move, 0.95) > quantile_disc(friction, 0.5) THEN 'PASS' ELSE 'FAIL' END AS status FROM f""")
def first_n_windows_gate(spark, d):
    """GAT-01, GAT-02, WIN-22, AGG-12, AGG-13: movement against friction on the first windows; equality fails."""
    o = opportunities(spark, d).where("invalid IS NULL").orderBy("us", "event_id").limit(300).where("entry_bid > 0")
    move = F.abs(prices.return_bps(F.col("entry_bid") + F.col("entry_ask"), F.col("exit_bid") + F.col("exit_ask")))
    rows = o.select(F.lit(0).alias("g"), move.alias("move"), prices.friction_bps(F.col("entry_bid"), F.col("entry_ask"), 45).alias("friction"))
    m = quantiles.nearest_ranks(rows, ["g"], "move", ["0.95"], ["q95_move"])
    f = quantiles.nearest_ranks(rows, ["g"], "friction", ["0.5"], ["q50_friction"]).drop("n")
    got = m.join(f, "g")
    status = F.when(F.col("n") < 100, "INCONCLUSIVE").when(F.col("q95_move") > F.col("q50_friction"), "PASS").otherwise("FAIL")
    return got.select(F.col("n").alias("windows"), "q95_move", "q50_friction", status.alias("status"))


@query("""WITH x AS (SELECT CAST(event_id % 7 AS BIGINT) - 3 AS a, CAST(event_id % 5 AS BIGINT) - 2 AS b, CAST(cents % 2 AS BIGINT) AS y FROM ev)
SELECT count(*) AS n, CAST(sum(2 * y - 1) AS BIGINT) AS g0, CAST(sum((2 * y - 1) * a) AS BIGINT) AS g1, CAST(sum((2 * y - 1) * b) AS BIGINT) AS g2, CAST(sum(a * a) AS BIGINT) AS h11, CAST(sum(a * b) AS BIGINT) AS h12, CAST(sum(b * b) AS BIGINT) AS h22 FROM x""")
def logistic_gradient(spark, d):
    """MDL-01, MDL-02: the sums of the first Newton step (times 2 and 4), exact in integers."""
    x = t.events(spark, d).select((F.col("event_id") % 7 - 3).alias("a"), (F.col("event_id") % 5 - 2).alias("b"), (F.col("cents") % 2).alias("y"))
    s = 2 * F.col("y") - 1
    return x.agg(F.count("*").alias("n"), F.sum(s).alias("g0"), F.sum(s * F.col("a")).alias("g1"), F.sum(s * F.col("b")).alias("g2"), F.sum(F.col("a") * F.col("a")).alias("h11"), F.sum(F.col("a") * F.col("b")).alias("h12"), F.sum(F.col("b") * F.col("b")).alias("h22"))


@query()
def logistic_fit(spark, d):
    """MDL-01, MDL-04, UDF-05: a ridge logistic model by Newton's method and its scores; tests check its stationary point."""
    rows = feature_table(spark, d).withColumn("y", F.when(F.col("label_bps").isNotNull(), (F.col("label_bps") > 0).cast("int")))
    model = models.fit_logistic(rows, ["spread_bps", "imbalance", "ref_return_bps"], "y")
    return rows.dropna(subset=[*model.features, "y"]).select("event_id", "y", model.probability().alias("probability"))


@query("""WITH s AS (SELECT event_type, avg(CASE WHEN cents > 5000 THEN cents - 5000 END)::DOUBLE AS w, avg(CASE WHEN cents < 5000 THEN cents - 5000 END)::DOUBLE AS l, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM ev GROUP BY event_type)
SELECT event_type, total, n, round(total::DOUBLE / n::DOUBLE, 6) AS mean, CASE WHEN w > 0 AND l < 0 THEN round(-l / (w - l), 9) END AS hurdle FROM s""")
def probability_hurdle(spark, d):
    """MTH-15, MTH-16, AGG-18, AGG-19: break-even probability from mean win and mean loss."""
    c = F.col("cents")
    s = t.events(spark, d).groupBy("event_type").agg(F.avg(F.when(c > 5000, c - 5000)).alias("w"), F.avg(F.when(c < 5000, c - 5000)).alias("l"), F.sum(c).alias("total"), F.count("*").alias("n"))
    return s.select("event_type", "total", "n", F.round(F.col("total").cast("double") / F.col("n").cast("double"), 6).alias("mean"), F.round(statistics.probability_hurdle(F.col("w"), F.col("l")), 9).alias("hurdle"))


# -- reports ------------------------------------------------------------------------------------------------------

LEAST_EVALUABLE, ALPHA, LAGS = 300, 0.025, 10

TRIALS = f"""{OPPORTUNITIES}, {RETURNS[5:]}, rv AS (SELECT event_id, {RETURN_VALUE} AS ref FROM rr),
tp AS (SELECT op.*, policy, coalesce(sign(CASE policy WHEN 'H_IMBALANCE' THEN (bid_sz - ask_sz)::DOUBLE ELSE ref END), 0)::INTEGER AS said, sign((exit_bid + exit_ask) - (entry_bid + entry_ask))::INTEGER AS moved FROM op JOIN rv USING (event_id), (VALUES ('H_IMBALANCE'), ('H_REFERENCE')) p(policy)),
tc AS (SELECT *, CASE WHEN said <> 0 AND invalid IS NULL AND moved <> 0 THEN (said = moved)::BIGINT END AS hit, CASE WHEN said <> 0 AND invalid IS NULL THEN
  CASE WHEN said > 0 THEN (exit_bid - entry_ask) * 1000000 - (entry_ask + exit_bid) * 450 ELSE (entry_bid - exit_ask) * 1000000 - (entry_bid + exit_ask) * 450 END END AS net FROM tp),
ts AS (SELECT policy, count(*) AS rows, count(*) FILTER (said = 0) AS abstained, count(*) FILTER (invalid IS NULL) AS valid, count(hit) AS evaluable, CAST(coalesce(sum(hit), 0) AS BIGINT) AS correct, count(net) AS traded, sum(net)::DOUBLE / count(net)::DOUBLE AS mean_net_micro FROM tc GROUP BY policy),
sr AS (SELECT policy, hit, row_number() OVER (PARTITION BY policy ORDER BY us, event_id) AS i, avg(hit) OVER (PARTITION BY policy) AS m FROM tc WHERE hit IS NOT NULL),
rh AS (SELECT a.policy, b.i - a.i AS lag, sum((a.hit - a.m) * (b.hit - b.m)) AS top FROM sr a JOIN sr b ON a.policy = b.policy AND b.i - a.i BETWEEN 1 AND {LAGS} GROUP BY ALL),
de AS (SELECT policy, greatest(1.0::DOUBLE, 1 + 2 * sum(CASE WHEN top > 0 THEN top / bottom ELSE 0 END)) AS design_effect FROM rh JOIN (SELECT policy, sum((hit - m) * (hit - m)) AS bottom FROM sr GROUP BY policy) USING (policy) GROUP BY policy),
pv AS (SELECT policy, sum(exp(lgamma(evaluable + 1) - lgamma(i + 1) - lgamma(evaluable - i + 1) - evaluable * ln(2.0))) AS p_value FROM (SELECT policy, evaluable, unnest(range(correct, evaluable + 1)) AS i FROM ts) GROUP BY policy),
te AS (SELECT ts.*, p_value, design_effect, greatest(1, least(evaluable, floor(evaluable / design_effect)))::BIGINT AS effective_n FROM ts JOIN de USING (policy) JOIN pv USING (policy)),
tw AS (SELECT *, greatest(0.0::DOUBLE, (p + z2 / (2 * effective_n) - z * sqrt(p * (1 - p) / effective_n + z2 / (4 * effective_n::DOUBLE * effective_n))) / (1 + z2 / effective_n)) AS lower_bound
  FROM (SELECT *, correct::DOUBLE / evaluable AS p, {selection.Z_975!r}::DOUBLE AS z, {selection.Z_975!r}::DOUBLE * {selection.Z_975!r}::DOUBLE AS z2 FROM te)),
tf AS (SELECT *, array_to_string(list_sort(list_filter([CASE WHEN evaluable < {LEAST_EVALUABLE} THEN '{selection.SUPPORT}' END, CASE WHEN p_value > {ALPHA} THEN '{selection.P_VALUE}' END, CASE WHEN lower_bound <= 0.5 THEN '{selection.LOWER_BOUND}' END,
  CASE WHEN mean_net_micro <= 0 THEN '{selection.MEAN_NET}' END], lambda x: x IS NOT NULL)), ',') AS failures FROM tw),
th AS (SELECT *, max(evaluable < {LEAST_EVALUABLE}) OVER () AS thin, first(CASE WHEN failures = '' THEN policy END) OVER (ORDER BY failures <> '', -lower_bound, policy ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS best FROM tf)"""


@query(f"""{TRIALS} SELECT policy, rows, abstained, valid, evaluable, correct, traded, round(mean_net_micro, 3) AS mean_net_micro, round(p_value + 1e-9, 6) AS p_value, round(design_effect, 8) AS design_effect, effective_n, round(lower_bound, 8) AS lower_bound, failures,
  CASE WHEN NOT thin THEN best END AS champion, CASE WHEN thin THEN 'INCONCLUSIVE' WHEN best IS NULL THEN 'STOP' ELSE 'CHAMPION' END AS decision FROM th""")
def registered_selection(spark, d):
    """GAT-06, GAT-07, MTH-09..12, WIN-12: two trials over the same rows, judged by four codes, and the decision."""
    ref = features.reference_return(t.quotes(spark, d), t.quotes(spark, d, "click"), ["dom"], "event_id", "us", LOOKBACK, 2 * STALE).select("event_id", F.col("value").alias("ref"))
    o = opportunities(spark, d).join(ref, "event_id").withColumn("moved", F.signum((F.col("exit_bid") + F.col("exit_ask") - F.col("entry_bid") - F.col("entry_ask")).cast("double")).cast("int"))
    trials = {"H_IMBALANCE": simulate.sign_policy((F.col("bid_sz") - F.col("ask_sz")).cast("double")), "H_REFERENCE": simulate.sign_policy(F.col("ref"))}
    done = selection.decided(selection.evaluate(simulate.run(simulate.with_policies(o, trials)), ["us", "event_id"], "moved", LAGS, LEAST_EVALUABLE, ALPHA), LEAST_EVALUABLE)
    return done.select(
        "policy", "rows", "abstained", "valid", "evaluable", "correct", "traded", F.round("mean_net_micro", 3).alias("mean_net_micro"), F.round(F.col("p_value") + 1e-9, 6).alias("p_value"),
        F.round("design_effect", 8).alias("design_effect"), "effective_n", F.round("lower_bound", 8).alias("lower_bound"), "failures", "champion", "decision",
    )


def candidate_trades(spark, d) -> DataFrame:
    """(candidate, part, event_id, entry, gross, fee_micro, net_micro): each candidate's trades, in their part and in ALL."""
    diff = F.col("bid_sz") - F.col("ask_sz")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.lit(least).alias("least")) for n, least in CANDIDATES]))
    rows = opportunities(spark, d).where("invalid IS NULL").withColumn("c", each).where(F.abs(diff) > F.col("c.least"))
    long = diff > 0
    entry, exit_ = F.when(long, F.col("entry_ask")).otherwise(F.col("entry_bid")), F.when(long, F.col("exit_bid")).otherwise(F.col("exit_ask"))
    part = F.when(F.col("us") < 1705276800000000, "DEV_A").otherwise("DEV_B")
    rows = rows.select(F.col("c.candidate").alias("candidate"), F.explode(F.array(part, F.lit("ALL"))).alias("part"), "event_id", entry.alias("entry"), F.when(long, exit_ - entry).otherwise(entry - exit_).alias("gross"), ((entry + exit_) * 450).alias("fee_micro"))
    return rows.withColumn("net_micro", F.col("gross") * 1_000_000 - F.col("fee_micro"))


CANDIDATE_TRADES = f"""{OPPORTUNITIES}, c AS (SELECT * FROM (VALUES ('C0', 0), ('C1', 1), ('C2', 2), ('C3', 3), ('C4', 4)) x(candidate, least)),
a AS (SELECT candidate, us, CASE WHEN bid_sz > ask_sz THEN entry_ask ELSE entry_bid END AS entry, CASE WHEN bid_sz > ask_sz THEN exit_bid ELSE exit_ask END AS ex, bid_sz > ask_sz AS long FROM op, c WHERE invalid IS NULL AND abs(bid_sz - ask_sz) > least),
n AS (SELECT candidate, unnest([CASE WHEN us < 1705276800000000 THEN 'DEV_A' ELSE 'DEV_B' END, 'ALL']) AS part, entry, CASE WHEN long THEN ex - entry ELSE entry - ex END AS gross, (entry + ex) * 450 AS fee_micro FROM a),
tr2 AS (SELECT *, gross * 1000000 - fee_micro AS net_micro FROM n)"""


@query(f"""{CANDIDATE_TRADES}, s AS (SELECT candidate, part, count(*) AS trades, count(*) FILTER (net_micro > 0) AS winners, CAST(sum(gross) AS BIGINT) AS gross, CAST(sum(fee_micro) AS BIGINT) AS fee_micro, CAST(sum(net_micro) AS BIGINT) AS net_micro,
  sum(net_micro)::DOUBLE / count(*)::DOUBLE AS mean_net, median(net_micro)::DOUBLE AS median_net_micro, round(avg(CASE WHEN entry > 0 THEN net_micro::DOUBLE / entry::DOUBLE / 100.0 END), 6) AS mean_net_bps FROM tr2 GROUP BY candidate, part),
g AS (SELECT *, trades >= 30 AND mean_net > 0 AS part_passes FROM s), b AS (SELECT candidate, bool_and(part_passes) AS passes FROM g GROUP BY candidate)
SELECT candidate, part, trades, winners, gross, fee_micro, net_micro, median_net_micro, mean_net_bps, part_passes, passes, row_number() OVER (PARTITION BY part ORDER BY mean_net DESC, candidate) AS place FROM g JOIN b USING (candidate)""")
def candidate_report(spark, d):
    """AGG-20, AGG-21, GAT-09, GAT-11, GAT-14, SUP-33..35: fees, net, bps and exact medians of each candidate, its gates and its place."""
    rows = candidate_trades(spark, d)
    by = ["candidate", "part"]
    n = F.count("*")
    sums = rows.groupBy(*by).agg(
        n.alias("trades"), F.count(F.when(F.col("net_micro") > 0, 1)).alias("winners"), F.sum("gross").alias("gross"), F.sum("fee_micro").alias("fee_micro"), F.sum("net_micro").alias("net_micro"),
        (F.sum("net_micro").cast("double") / n.cast("double")).alias("mean_net"), F.round(F.avg(F.when(F.col("entry") > 0, F.col("net_micro").cast("double") / F.col("entry").cast("double") / 100)), 6).alias("mean_net_bps"),
    )
    middle = quantiles.median(rows, by, "net_micro", "median_net_micro").select(*by, "median_net_micro")
    gated = sums.join(middle, by).withColumn("part_passes", (F.col("trades") >= 30) & (F.col("mean_net") > 0))
    # From here on there is a row for each candidate and part.
    passes = F.min("part_passes").over(Window.partitionBy("candidate"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("mean_net"), "candidate"))
    return gated.withColumn("passes", passes).withColumn("place", place).drop("mean_net")


FEES = [0, 150, 300, 450, 600, 900]


@query(f"""{CANDIDATE_TRADES}, f AS (SELECT unnest({FEES}) AS fee) SELECT candidate, CAST(fee AS INTEGER) AS fee, count(*) AS trades, CAST(sum(gross * 1000000 - fee_micro // 450 * fee) AS BIGINT) AS net_micro, count(*) FILTER (gross * 1000000 - fee_micro // 450 * fee > 0) AS winners,
  CASE WHEN sum(gross) <= 0 THEN 0 ELSE round(4.5 * (sum(gross)::DOUBLE / count(*)::DOUBLE) / (sum(fee_micro)::DOUBLE / 1000000.0 / count(*)::DOUBLE), 6) END::DOUBLE AS break_even_bps FROM tr2, f WHERE part = 'ALL' GROUP BY candidate, fee""")
def fee_sensitivity(spark, d):
    """GAT-13, MTH-15: what is left at other fees (hundredths of a basis point a side), and the fee at which nothing is."""
    rows = candidate_trades(spark, d).where("part = 'ALL'").withColumn("fee", F.explode(F.array(*[F.lit(x) for x in FEES])))
    net, n = F.col("gross") * 1_000_000 - F.expr("fee_micro div 450") * F.col("fee"), F.count("*").cast("double")
    even = statistics.break_even_fee(F.sum("gross").cast("double") / n, F.sum("fee_micro").cast("double") / 1_000_000 / n, 4.5)
    return rows.groupBy("candidate", "fee").agg(F.count("*").alias("trades"), F.sum(net).alias("net_micro"), F.count(F.when(net > 0, 1)).alias("winners"), F.round(even, 6).alias("break_even_bps"))


@query(f"""{FEATURES}, x AS (SELECT CASE WHEN label_bps > 0 THEN 0.5 ELSE -0.5 END::DOUBLE AS r, imbalance AS a, flow AS b FROM ft WHERE label_bps IS NOT NULL AND imbalance IS NOT NULL AND flow IS NOT NULL)
SELECT unnest(['g0', 'g1', 'g2', 'h00', 'h01', 'h02', 'h11', 'h12', 'h22']) AS name, unnest([round(sum(r), 6), round(sum(r * a), 6), round(sum(r * b), 6), round(count(*) / 4.0, 6)::DOUBLE, round(sum(a) / 4.0, 6), round(sum(b) / 4.0, 6), round(sum(a * a) / 4.0, 6), round(sum(a * b) / 4.0, 6), round(sum(b * b) / 4.0, 6)]) AS value FROM x""")
def newton_sums(spark, d):
    """MDL-01, MDL-02: gradient and Hessian of the first Newton step over the feature rows, as the fit asks for them."""
    rows = feature_table(spark, d).dropna(subset=["label_bps", "imbalance", "flow"])
    gradient, hessian = models.newton_sums(rows, [F.lit(1.0), F.col("imbalance"), F.col("flow")], F.col("label_bps") > 0, [0.0, 0.0, 0.0])
    cells = [(f"g{i}", g) for i, g in enumerate(gradient)] + [(f"h{i}{j}", hessian[i][j]) for i in range(3) for j in range(i, 3)]
    return spark.createDataFrame([(name, round(float(v), 6)) for name, v in cells], "name string, value double")


STEPS = 1_000


@query()
def direction_gates(spark, d):
    """MDL-03, SUP-50, GAT-10: batch gradient descent on both directions of DEV_A's rows; gates at its top tenth and twentieth, for each part."""
    nets = lambda entry, exit_, gross: gross * 1_000_000 - (entry + exit_) * 450
    c = F.col
    o = opportunities(spark, d).where("invalid IS NULL").select(
        "event_id", F.when(c("us") < 1705276800000000, "DEV_A").otherwise("DEV_B").alias("part"), prices.imbalance(c("bid_sz"), c("ask_sz")).alias("imbalance"),
        nets(c("entry_ask"), c("exit_bid"), c("exit_bid") - c("entry_ask")).alias("long_net"), nets(c("entry_bid"), c("exit_ask"), c("entry_bid") - c("exit_ask")).alias("short_net"),
    )
    ref = features.reference_return(t.quotes(spark, d), t.quotes(spark, d, "click"), ["dom"], "event_id", "us", LOOKBACK, 2 * STALE).select("event_id", F.col("value").alias("ref"))
    rows = cut(o.join(ref, "event_id"))
    signed = ["imbalance", "ref"]
    model = descent.fit_directions(rows.where("part = 'DEV_A'"), signed, "long_net", "short_net", steps=STEPS)
    return descent.top_gates(descent.best_direction(rows, model, signed, "long_net", "short_net"), "part", "DEV_A", {"TOP10": "0.90", "TOP05": "0.95"})
