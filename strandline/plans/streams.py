"""Streaming queries; each oracle is the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.plans.core import ORACLES, query
from strandline.plans.market import LONG
from strandline.sources import tables as t
from strandline.streaming import captures
from strandline.streaming.supervise import supervised


def stream(spark, d):
    schema = t.table(spark, d, "events").schema
    e = captures.replay(spark, d, "events", schema)
    return e.select("event_id", F.col("user_id").alias("dom"), t.micros("ts").alias("us"), F.col("ts").cast("timestamp").alias("ts"), "event_type")


@query("SELECT us // 900000000 * 900000000 AS segment_start_us, event_type, count(*) AS n FROM ev GROUP BY ALL")
def stream_segments(spark, d):
    """STM-07, STM-12: counts of fifteen-minute segments."""
    return captures.drain(captures.segments(stream(spark, d), "ts", "15 minutes", ["event_type"]), "complete")


@query("SELECT feed, count(*) AS n, count(DISTINCT dom) AS domains, min(us) AS first, max(us) AS last FROM (SELECT dom, us, 'primary' AS feed FROM q UNION ALL SELECT dom, us, 'reference' FROM rq) GROUP BY feed")
def stream_multiplex(spark, d):
    """STM-01, STM-05, SET-01: two feeds as one stream and its running state."""
    e = stream(spark, d)
    both = captures.multiplex(("primary", e.where("event_type = 'view'")), ("reference", e.where("event_type = 'click'")))
    return captures.drain(captures.observed(both, ["feed"], "us", "dom"), "complete")


@query("SELECT event_id, CASE WHEN event_id % 13 * 1000000 > 10000000 THEN 'LATE_BACKFILL' ELSE 'LIVE_CAPTURE' END AS availability FROM ev")
def stream_availability(spark, d):
    """STM-09: late rows are flagged and kept."""
    e = stream(spark, d).withColumn("received", F.col("us") + F.col("event_id") % 13 * 1_000_000)
    return captures.drain(captures.availability(e, "us", "received", 10_000_000).select("event_id", "availability"))


@query()
def stream_windows(spark, d):
    """WIN-08 as a keyed state machine."""
    return captures.drain(captures.streaming_windows(stream(spark, d), "dom", "us", "event_id", LONG))


ORACLES["stream_windows"] = f"SELECT dom, entry_key, entry_time, exit_key, exit_time FROM ({ORACLES['windows_exit_plus_one']}) WHERE exit_key IS NOT NULL"


@query("SELECT 'COMPLETE' AS state, count(*) AS rows_in, count(*) AS rows_out FROM ev")
def stream_counters(spark, d):
    """SNK-02, STM-02, STM-05: the listener's count of a supervised run against what its sink holds."""
    out = captures.folder(spark)
    rows = stream(spark, d).select("event_id", "us")
    run = supervised(spark, lambda: rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start())
    return spark.read.parquet(f"{out}/rows").agg(F.lit(run.state).alias("state"), F.lit(run.rows).cast("long").alias("rows_in"), F.count("*").alias("rows_out"))
