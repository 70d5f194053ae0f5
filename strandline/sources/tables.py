"""Market views over the stored tables: integer prices and microsecond clocks, so that results are exact.

quotes: `view` events, reference quotes: `click`; trades: `purchase` buys, `error` sells, `signup` of unknown side. A
user is a causal domain: times of two domains are never compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUSPECT = 32
GAP, STALE, DUPLICATE, BACKFILL = 2, 4, 8, 16
HOUR = 3_600_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, whatever the session's zone is."""
    return F.expr(f"unix_date(cast({ts} as date)) * 86400000000L + hour({ts}) * 3600000000L + minute({ts}) * 60000000L + cast(extract(SECOND FROM {ts}) * 1000000 as bigint)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, dom, us, event_type, cents, day, props) of the event table."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("dom"),
        micros("ts").alias("us"),
        "event_type",
        F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        "props",
    )


def quotes(spark: SparkSession, sf_dir: str, kind: str = "view") -> DataFrame:
    """Top-of-book quotes (event_id, dom, us, day, bid, ask, bid_sz, ask_sz, flags)."""
    e = F.col("event_id")
    return events(spark, sf_dir).where(F.col("event_type") == kind).select(
        "event_id", "dom", "us", "day",
        F.col("cents").alias("bid"), (F.col("cents") + 1 + e % 5).alias("ask"),
        (1 + e % 7).alias("bid_sz"), (1 + (3 * e) % 11).alias("ask_sz"),
        F.when(e % 17 == 0, SUSPECT).otherwise(0).cast("long").alias("flags"),
    )


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, dom, us, side, size)."""
    side = F.when(F.col("event_type") == "purchase", "buy").when(F.col("event_type") == "error", "sell").otherwise("unknown")
    kept = events(spark, sf_dir).where(F.col("event_type").isin("purchase", "error", "signup"))
    return kept.select("event_id", "dom", "us", side.alias("side"), (1 + F.col("event_id") % 9).alias("size"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book levels (book, side, level, price, size): an order is a book, returned lines its bids, others its asks."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("book"), "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag").isin("A", "R"), "BID").otherwise("ASK").alias("side"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.col("l_quantity").cast("long").alias("size"),
    )
    order = Window.partitionBy("book", "side").orderBy("l_linenumber", "l_partkey", "price", "size")
    return lines.select("book", "side", F.row_number().over(order).alias("level"), "price", "size")


#: The same views for DuckDB.
SQL_VIEWS = """
ev AS (SELECT event_id, user_id AS dom, epoch_us(ts) AS us, event_type, CAST(round(value * 100) AS BIGINT) AS cents, strftime(ts, '%Y-%m-%d') AS day, props FROM events),
q AS (SELECT event_id, dom, us, day, cents AS bid, cents + 1 + event_id % 5 AS ask, 1 + event_id % 7 AS bid_sz, 1 + (3 * event_id) % 11 AS ask_sz,
             CASE WHEN event_id % 17 = 0 THEN 32 ELSE 0 END AS flags FROM ev WHERE event_type = 'view'),
rq AS (SELECT event_id, dom, us, day, cents AS bid, cents + 1 + event_id % 5 AS ask, 1 + event_id % 7 AS bid_sz, 1 + (3 * event_id) % 11 AS ask_sz,
              CASE WHEN event_id % 17 = 0 THEN 32 ELSE 0 END AS flags FROM ev WHERE event_type = 'click'),
tr AS (SELECT event_id, dom, us, CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' ELSE 'unknown' END AS side, 1 + event_id % 9 AS size
       FROM ev WHERE event_type IN ('purchase', 'error', 'signup')),
lv AS (SELECT l_orderkey AS book, CASE WHEN l_returnflag IN ('A', 'R') THEN 'BID' ELSE 'ASK' END AS side,
              CAST(round(l_extendedprice * 100) AS BIGINT) AS price, CAST(l_quantity AS BIGINT) AS size,
              row_number() OVER (PARTITION BY l_orderkey, CASE WHEN l_returnflag IN ('A', 'R') THEN 'BID' ELSE 'ASK' END
                                 ORDER BY l_linenumber, l_partkey, CAST(round(l_extendedprice * 100) AS BIGINT), CAST(l_quantity AS BIGINT)) AS level
       FROM lineitem)"""
