"""Frames of both feeds, made from events, through the payload parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import statistics, text
from strandline.operators import normalize
from strandline.plans.core import query
from strandline.sources import tables as t

#: A good quote, one without an ask, one with a price of zero; a book; a context with strings and one with a number; a
#: reference quote; a reference trade; an answer; a pong; no JSON; something else.
FEED_SQL = """CASE event_id % 12
  WHEN 0 THEN '{"channel":"bbo","data":{"coin":"C' || dom || '","time":' || us // 1000 || ',"bbo":[{"px":"' || cents || '.5","sz":"2","n":1},{"px":"' || (cents + 1) || '.50","sz":"3.0","n":2}]}}'
  WHEN 1 THEN '{"channel":"bbo","data":{"coin":"C' || dom || '","time":' || us // 1000 || ',"bbo":[{"px":"' || cents || '.5","sz":"2","n":1},null]}}'
  WHEN 2 THEN '{"channel":"bbo","data":{"coin":"C' || dom || '","time":' || us // 1000 || ',"bbo":[{"px":"0","sz":"2","n":1},{"px":"1","sz":"3.0","n":2}]}}'
  WHEN 3 THEN '{"channel":"l2Book","data":{"coin":"C' || dom || '","time":1,"levels":[[{"px":"' || (cents + 1) || '","sz":"1","n":4},{"px":"' || cents || '","sz":"2.0","n":5}],[{"px":"' || (cents + 2) || '","sz":"3","n":6}]]}}'
  WHEN 4 THEN '{"channel":"activeAssetCtx","data":{"coin":"C' || dom || '","ctx":{"funding":"0.000' || event_id || '","markPx":"' || cents || '.25","oraclePx":"7"}}}'
  WHEN 5 THEN '{"channel":"activeAssetCtx","data":{"coin":"C' || dom || '","ctx":{"funding":"0.1","markPx":' || cents || ',"oraclePx":"7"}}}'
  WHEN 6 THEN '{"stream":"q","data":{"e":"bookTicker","s":"C' || dom || 'X","b":"' || (cents + 1) || '","B":"2.0","a":"' || (cents + 2) || '","A":"4","T":' || us // 1000 || '}}'
  WHEN 7 THEN '{"stream":"t","data":{"e":"aggTrade","s":"C' || dom || 'X","p":"' || (cents + 1) || '.0","q":"5","m":' || CASE WHEN event_id % 24 = 7 THEN 'true' ELSE 'false' END || ',"a":' || event_id || ',"T":' || us // 1000 || '}}'
  WHEN 8 THEN '{"channel":"subscriptionResponse","data":{}}' WHEN 9 THEN '{"channel":"pong"}' WHEN 10 THEN '{"channel":' ELSE '{"x":1}' END"""


def framed(events: DataFrame, *others: str) -> DataFrame:
    return events.select("event_id", *others, F.expr(FEED_SQL.replace(" // ", " div ")).alias("payload"))


def frames(spark, d) -> DataFrame:
    return framed(t.events(spark, d))


@query("""SELECT CASE WHEN event_id % 12 < 8 THEN 'MARKET' WHEN event_id % 12 = 8 THEN 'ACK' WHEN event_id % 12 = 9 THEN 'PONG' WHEN event_id % 12 = 10 THEN 'MALFORMED' ELSE 'UNKNOWN' END AS kind,
  count(*) AS n FROM ev GROUP BY ALL""")
def frame_kinds(spark, d):
    """SRC-08, SRC-09, JSN-05: what each frame is."""
    return frames(spark, d).groupBy(normalize.classify(F.col("payload")).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, 'C' || dom AS coin, us // 1000 * 1000000 AS exchange_ts_ns, cents || '.5' AS bid_exact, '2' AS bid_size_exact,
  CASE event_id % 12 WHEN 0 THEN (cents + 1) || '.50' END AS ask_exact, CASE event_id % 12 WHEN 0 THEN '3.0' END AS ask_size_exact FROM ev WHERE event_id % 12 IN (0, 1) AND cents >= 0""")
def bbo_frames(spark, d):
    """JSN-01, JSN-06, FIL-02: best bid and offer; a missing side is a null pair, a price of zero refuses the frame."""
    return normalize.bbo_events(frames(spark, d), "event_id")


@query("""SELECT event_id, v.side, v.level, v.price_exact, v.size_exact, v.order_count FROM (SELECT event_id, unnest([
  {'side': 'BID', 'level': 0, 'price_exact': (cents + 1)::VARCHAR, 'size_exact': '1', 'order_count': 4}, {'side': 'BID', 'level': 1, 'price_exact': cents::VARCHAR, 'size_exact': '2.0', 'order_count': 5},
  {'side': 'ASK', 'level': 0, 'price_exact': (cents + 2)::VARCHAR, 'size_exact': '3', 'order_count': 6}]) AS v FROM ev WHERE event_id % 12 = 3)""")
def book_frames(spark, d):
    """ARR-01, JSN-06, WIN-18: levels of both sides, best first, with the source's decimal text."""
    return normalize.book_levels(frames(spark, d), "event_id")


@query("""SELECT event_id, 'C' || dom AS coin, v.event_type, v.value_exact FROM (SELECT event_id, dom, unnest([
  {'event_type': 'FUNDING_RATE', 'value_exact': '0.000' || event_id}, {'event_type': 'MARK_PRICE', 'value_exact': cents || '.25'}, {'event_type': 'ORACLE_PRICE', 'value_exact': '7'}]) AS v FROM ev WHERE event_id % 12 = 4)""")
def context_frames(spark, d):
    """ARR-03, JSN-08: three events of one frame; a frame with a number instead of a string gives none."""
    return normalize.context_events(frames(spark, d), "event_id")


@query("SELECT event_id, 'c' || dom || 'x' AS symbol, (cents + 1)::VARCHAR AS bid_exact, '2.0' AS bid_size_exact, (cents + 2)::VARCHAR AS ask_exact, '4' AS ask_size_exact, us // 1000 * 1000000 AS exchange_ts_ns FROM ev WHERE event_id % 12 = 6 AND cents >= 0")
def ticker_frames(spark, d):
    """JSN-03, JSN-07, SUP-02: best quotes of the reference feed."""
    return normalize.ticker_events(frames(spark, d), "event_id")


@query("SELECT event_id, 'c' || dom || 'x' AS symbol, (cents + 1) || '.0' AS price_exact, '5' AS size_exact, CASE WHEN event_id % 24 = 7 THEN 'SELL' ELSE 'BUY' END AS aggressor_side, event_id AS trade_id, us // 1000 * 1000000 AS exchange_ts_ns FROM ev WHERE event_id % 12 = 7 AND cents >= 0")
def aggregate_trade_frames(spark, d):
    """JSN-04, SUP-02: trades of the reference feed; the maker flag gives the aggressor's side."""
    return normalize.aggregate_trades(frames(spark, d), "event_id")


@query("SELECT event_id, round(1 / (1 + exp(-least(40.0, greatest(-40.0, (event_id % 201 - 100) / 2.0)))), 12) AS p FROM ev")
def clipped_sigmoid(spark, d):
    """MTH-17: the logistic function, clipped at 40."""
    return t.events(spark, d).select("event_id", F.round(statistics.sigmoid((F.col("event_id") % 201 - 100) / F.lit(2.0)), 12).alias("p"))


@query("SELECT event_id, regexp_full_match(CASE event_id % 3 WHEN 0 THEN sha256(props) WHEN 1 THEN upper(sha256(props)) ELSE 'x' || event_id END, '[0-9a-f]{64}') AS valid FROM ev WHERE props IS NOT NULL")
def digest_shapes(spark, d):
    """STR-10: what has the shape of a SHA-256 digest."""
    e = t.events(spark, d).where("props IS NOT NULL")
    digest = F.sha2("props", 256)
    raw = F.when(F.col("event_id") % 3 == 0, digest).when(F.col("event_id") % 3 == 1, F.upper(digest)).otherwise(F.concat(F.lit("x"), F.col("event_id")))
    return e.select("event_id", text.is_digest(raw).alias("valid"))


COUNTED = ["nation", "customer", "orders", "lineitem", "events"]


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in COUNTED), views=False)
def row_counts(spark, d):
    """SRC-16: rows of tables by scans that read no column, which Parquet answers from its footers."""
    counts = [t.table(spark, d, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in COUNTED]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out
