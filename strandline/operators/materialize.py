"""Captured frames to the normalized dataset: frames, events (the header) and one table for each payload.

Everything is derived from one classified frame table; a frame gives all its events or none. Events carry the envelope of
their frame, and tables join by event_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import normalize
from strandline.operators.publish import publish

ENVELOPE = ["source_id", "recv_wall_ns", "recv_mono_ns", "host_id", "boot_id", "connection_id", "ingest_seq", "capture_flags", "raw_sha256"]
#: Total order of each table.
ORDER = {
    "frames": ["recv_mono_ns", "recv_wall_ns", "source_id", "frame_id"],
    "events": ["recv_mono_ns", "recv_wall_ns", "source_id", "frame_id", "ordinal"],
    "l2_snapshots": ["event_id"], "l2_levels": ["event_id", "side", "level"], "bbo": ["event_id"], "trades": ["event_id"], "funding_rates": ["event_id"],
    "mark_prices": ["event_id"], "oracle_prices": ["event_id"], "reference_bbo": ["event_id"], "reference_trades": ["event_id"],
}


def classified(frames: DataFrame) -> DataFrame:
    """Raw frames with frame_id, payload as text, kind, whether the payload is what was hashed at capture, the events that
    it gives as `heads`, and its outcome. All this is of one row, so that counts and headers need no join."""
    text = F.col("payload").cast("string")
    rows = frames.select(
        F.concat_ws(":", "segment", F.col("frame_offset").cast("string")).alias("frame_id"), *ENVELOPE, "channel_hint", text.alias("payload"),
        normalize.classify(text).alias("kind"), (F.sha2(F.col("payload"), 256) == F.col("raw_sha256")).alias("hash_ok"),
    )
    p = F.col("payload")
    rows = rows.withColumn("heads", F.when(F.col("hash_ok"), normalize.heads(p)).otherwise(F.array().cast("array<struct<event_type:string,ordinal:int>>")))
    empty = F.coalesce((F.get_json_object(p, "$.channel") == "trades") & (F.get_json_object(p, "$.data") == "[]"), F.lit(False))
    outcome = (
        F.when(~F.col("hash_ok"), "ERROR").when(F.size("heads") > 0, "EVENTS").when(F.col("kind").isin("ACK", "PONG"), "NOT_APPLICABLE").when(empty, "EMPTY").otherwise("ERROR")
    )
    return rows.withColumn("outcome", outcome)


def event_id(kind: Column, ordinal: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", "frame_id", kind, ordinal.cast("string")), 256)


def normalized(frames: DataFrame) -> dict[str, DataFrame]:
    """The eleven tables."""
    f = classified(frames)
    good = f.where("hash_ok")
    key = "frame_id"
    zero = F.lit(0)
    context = normalize.context_events(good, key)
    levels = normalize.book_levels(good, key)
    typed = {
        "bbo": ("BBO", normalize.bbo_events(good, key).withColumn("ordinal", zero)),
        "trades": ("TRADE", normalize.trade_events(good, key).drop("event_id")),
        "funding_rates": ("FUNDING_RATE", context.where("event_type = 'FUNDING_RATE'").drop("event_type").withColumn("ordinal", zero)),
        "mark_prices": ("MARK_PRICE", context.where("event_type = 'MARK_PRICE'").drop("event_type").withColumn("ordinal", F.lit(1))),
        "oracle_prices": ("ORACLE_PRICE", context.where("event_type = 'ORACLE_PRICE'").drop("event_type").withColumn("ordinal", F.lit(2))),
        "reference_bbo": ("REFERENCE_BBO", normalize.ticker_events(good, key).withColumn("ordinal", zero)),
        "reference_trades": ("REFERENCE_TRADE", normalize.aggregate_trades(good, key).withColumn("ordinal", zero)),
        "l2_snapshots": ("L2_SNAPSHOT", levels.groupBy(key).agg(F.count(F.when(F.col("side") == "BID", 1)).alias("bids"), F.count(F.when(F.col("side") == "ASK", 1)).alias("asks")).withColumn("ordinal", zero)),
    }
    out = {}
    for name, (kind, rows) in typed.items():
        out[name] = rows.withColumn("event_id", event_id(F.lit(kind), F.col("ordinal"))).drop(key, "ordinal")
    out["l2_levels"] = levels.withColumn("event_id", event_id(F.lit("L2_SNAPSHOT"), zero)).drop(key)
    each = f.select(key, *ENVELOPE, F.explode("heads").alias("h"))
    out["events"] = each.select(key, "h.event_type", "h.ordinal", event_id(F.col("h.event_type"), F.col("h.ordinal")).alias("event_id"), *ENVELOPE)
    out["frames"] = f.select(key, *ENVELOPE, "channel_hint", "kind", "outcome", F.size("heads").cast("long").alias("n_events"))
    return out


def report(tables: dict[str, DataFrame]) -> DataFrame:
    """(what, name, n): frames by outcome, events by type, causal domains."""
    count = lambda df, what, c: df.groupBy(F.lit(what).alias("what"), c.alias("name")).agg(F.count("*").alias("n"))
    domains = tables["frames"].select(F.concat_ws("/", "host_id", "boot_id").alias("name")).distinct()
    return (
        count(tables["frames"], "outcome", F.col("outcome")).unionByName(count(tables["events"], "event_type", F.col("event_type"))).unionByName(count(domains, "domain", F.col("name")))
    )


def frames_report(frames: DataFrame) -> DataFrame:
    """report(normalized(frames)) in one pass: each table reads its frames again, and decoding them is what costs."""
    name = lambda what, c: F.struct(F.lit(what).alias("what"), c.alias("name"))
    own = F.array(name("outcome", F.col("outcome")), name("domain", F.concat_ws("/", "host_id", "boot_id")))
    named = classified(frames).select(F.explode(F.concat(own, F.transform("heads", lambda h: name("event_type", h["event_type"])))).alias("x"))
    return named.groupBy("x.what", "x.name").agg(F.count("*").alias("_n")).select("what", "name", F.when(F.col("what") == "domain", 1).otherwise(F.col("_n")).alias("n"))


def publish_normalized(frames: DataFrame, root: str) -> dict:
    """Write the dataset once, named by its content."""
    tables = normalized(frames)
    return publish(tables, {name: ORDER[name] for name in tables}, root)
