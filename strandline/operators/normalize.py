"""Feed payloads to typed rows: one parse with a declared schema, then an ordered chain of checks per frame.

A frame is good or bad as a whole: the first failing check names its error, and a bad frame gives no events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DECIMAL = r"^-?[0-9]+(\.[0-9]+)?$"
#: Trade ids stay below this number; sides of the feed.
MAX_TRADE_ID = 2**50
SIDES = {"A": "SELL", "B": "BUY"}

LEVEL = T.StructType([T.StructField("px", T.StringType()), T.StructField("sz", T.StringType()), T.StructField("n", T.LongType())])
BBO = T.StructType([T.StructField("coin", T.StringType()), T.StructField("time", T.LongType()), T.StructField("bbo", T.ArrayType(LEVEL))])
BOOK = T.StructType([T.StructField("coin", T.StringType()), T.StructField("time", T.LongType()), T.StructField("levels", T.ArrayType(T.ArrayType(LEVEL)))])
TRADE = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("coin", "side", "px", "sz", "hash")]
    + [T.StructField("time", T.LongType()), T.StructField("tid", T.LongType()), T.StructField("users", T.ArrayType(T.StringType()))]
)
CONTEXT = T.StructType([T.StructField("coin", T.StringType()), T.StructField("ctx", T.MapType(T.StringType(), T.StringType()))])


def exact(value: Column) -> Column:
    """A plain decimal string, or null."""
    return F.when(value.rlike(DECIMAL), value)


def positive(value: Column) -> Column:
    return F.coalesce(exact(value).isNotNull() & (value.try_cast("decimal(38,18)") > 0), F.lit(False))


def json_text(payload: Column, path: str) -> Column:
    return F.get_json_object(payload, path)


def is_string(payload: Column, path: str) -> Column:
    """The JSON value at a path is a string, not a number: exact decimals must be written as strings."""
    return F.coalesce(F.schema_of_variant(F.variant_get(F.try_parse_json(payload), path, "variant")) == "STRING", F.lit(False))


def classify(payload: Column) -> Column:
    """What a feed frame is: subscription answer, pong, market data, malformed or unknown."""
    channel = json_text(payload, "$.channel")
    return (
        F.when(F.try_parse_json(payload).isNull(), "MALFORMED")
        .when(channel == "subscriptionResponse", "ACK")
        .when(channel == "pong", "PONG")
        .when(channel.isin("bbo", "l2Book", "trades", "activeAssetCtx"), "MARKET")
        .when(json_text(payload, "$.stream").isNotNull() & json_text(payload, "$.data").isNotNull(), "MARKET")
        .when(json_text(payload, "$.result").isNotNull() | json_text(payload, "$.id").isNotNull(), "ACK")
        .otherwise("UNKNOWN")
    )


def first_failure(*checks: tuple[Column, str]) -> Column:
    """Name of the first check that does not hold, null if all do."""
    out = F
    for ok, name in checks:
        out = out.when(~F.coalesce(ok, F.lit(False)), name)
    return out


def trade_error(x: Column) -> Column:
    """First error of one trade element."""
    return first_failure(
        (x["coin"].isNotNull(), "MISSING_COIN"),
        (x["side"].isin(*SIDES), "BAD_SIDE"),
        (positive(x["px"]), "BAD_PRICE"),
        (positive(x["sz"]), "BAD_SIZE"),
        (x["hash"].isNotNull(), "MISSING_HASH"),
        (x["time"] >= 0, "BAD_TIME"),
        ((x["tid"] >= 0) & (x["tid"] < MAX_TRADE_ID), "BAD_TRADE_ID"),
        (F.size(x["users"]) == 2, "BAD_USERS"),
    )


def trades_in(payload: Column) -> Column:
    """Trades that a frame gives: none if it is no trade frame or any element fails."""
    data = F.array(F.from_json(json_text(payload, "$.data"), T.ArrayType(TRADE)))
    good = F.filter(data, lambda x: x.isNotNull() & (F.size(F.array_compact(F.transform(x, trade_error))) == 0))
    return F.when(json_text(payload, "$.channel") == "trades", F.coalesce(F.try_element_at(F.transform(good, F.size), F.lit(1)), F.lit(0))).otherwise(0)


def trade_frames(frames: DataFrame, payload: str = "payload") -> DataFrame:
    """frames with outcome (EVENTS, EMPTY, ERROR, NOT_APPLICABLE), error, and elements of good trade frames."""
    p = F.col(payload)
    data = F.from_json(json_text(p, "$.data"), T.ArrayType(TRADE))
    errors = F.array_compact(F.transform("_data", trade_error))
    mine = json_text(p, "$.channel") == "trades"
    out = frames.withColumn("_data", F.when(mine, data)).withColumn("_errors", errors)
    error = F.when(mine & F.col("_data").isNull(), "NOT_A_LIST").when(F.size("_errors") > 0, F.col("_errors")[0])
    outcome = (
        F.when(~F.coalesce(mine, F.lit(False)), "NOT_APPLICABLE").when(error.isNotNull(), "ERROR").when(F.size("_data") == 0, "EMPTY").otherwise("EVENTS")
    )
    return out.withColumn("error", error).withColumn("outcome", outcome).withColumn("elements", F.when(outcome == "EVENTS", F.col("_data"))).drop("_data", "_errors")


def trade_events(frames: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """One row for each trade of good frames, with its place in the frame, a stable trade id and an event id."""
    rows = trade_frames(frames, payload).where("outcome = 'EVENTS'").select(key, F.posexplode("elements").alias("ordinal", "x"))
    stable = F.concat_ws(":", F.col("x.time").cast("string"), "x.coin", F.col("x.tid").cast("string"))
    return rows.select(
        key, "ordinal", F.col("x.coin").alias("coin"), F.col("x.px").alias("price_exact"), F.col("x.sz").alias("size_exact"),
        F.when(F.col("x.side") == "A", SIDES["A"]).otherwise(SIDES["B"]).alias("aggressor_side"), (F.col("x.time") * 1_000_000).alias("exchange_ts_ns"), stable.alias("trade_id"),
        F.sha2(F.concat_ws("\u0000", F.col(key).cast("string"), F.col("ordinal").cast("string"), stable), 256).alias("event_id"),
    )


def good_bbo(x: Column) -> Column:
    """A parsed `bbo` payload has two sides, and each is null or has a good price and size."""
    side = lambda k, n: F.get(x["bbo"], k)[n]
    good = lambda k: side(k, "px").isNull() | (positive(side(k, "px")) & positive(side(k, "sz")))
    return (F.size(x["bbo"]) == 2) & good(0) & good(1)


def bbo_events(frames: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Best bid and offer of `bbo` frames; a missing side is null as a pair."""
    p = F.col(payload)
    x = F.from_json(json_text(p, "$.data"), BBO)
    rows = frames.where(json_text(p, "$.channel") == "bbo").select(key, x.alias("x"))
    side = lambda k, n: F.get("x.bbo", k)[n]
    return rows.where(good_bbo(F.col("x"))).select(
        key, "x.coin", (F.col("x.time") * 1_000_000).alias("exchange_ts_ns"), side(0, "px").alias("bid_exact"), side(0, "sz").alias("bid_size_exact"), side(1, "px").alias("ask_exact"), side(1, "sz").alias("ask_size_exact")
    )


def book_levels(frames: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """One row for each level of `l2Book` frames, best first."""
    p = F.col(payload)
    x = F.from_json(json_text(p, "$.data"), BOOK)
    rows = frames.where(json_text(p, "$.channel") == "l2Book").select(key, x.alias("x")).where(F.size("x.levels") == 2)
    sides = rows.select(key, F.posexplode("x.levels").alias("s", "levels"))
    each = sides.select(key, F.when(F.col("s") == 0, "BID").otherwise("ASK").alias("side"), F.posexplode("levels").alias("level", "v"))
    return each.select(key, "side", "level", F.col("v.px").alias("price_exact"), F.col("v.sz").alias("size_exact"), F.col("v.n").alias("order_count"))


#: Events of a context frame, in their order, with the field of each.
CONTEXTS = [("FUNDING_RATE", "funding"), ("MARK_PRICE", "markPx"), ("ORACLE_PRICE", "oraclePx")]


def is_context(p: Column) -> Column:
    """A context frame whose three values are strings."""
    found = json_text(p, "$.channel") == "activeAssetCtx"
    for _, n in CONTEXTS:
        found = found & is_string(p, f"$.data.ctx.{n}")
    return found


def context_events(frames: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Three events of each context frame: funding rate, mark price and oracle price; numbers instead of strings are refused."""
    p = F.col(payload)
    rows = frames.where(is_context(p))
    events = F.explode(F.array(*[F.struct(F.lit(kind).alias("event_type"), json_text(p, f"$.data.ctx.{n}").alias("value_exact")) for kind, n in CONTEXTS]))
    return rows.select(key, json_text(p, "$.data.coin").alias("coin"), events.alias("e")).select(key, "coin", "e.*").where(exact(F.col("value_exact")).isNotNull())


def is_ticker(p: Column) -> Column:
    get = lambda n: json_text(p, f"$.data.{n}")
    return (get("e") == "bookTicker") & positive(get("b")) & positive(get("a")) & positive(get("B")) & positive(get("A"))


def is_aggregate_trade(p: Column) -> Column:
    get = lambda n: json_text(p, f"$.data.{n}")
    return (get("e") == "aggTrade") & positive(get("p")) & positive(get("q")) & get("m").isin("true", "false")


def ticker_events(frames: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Reference feed: best quotes of `bookTicker` frames."""
    p = F.col(payload)
    get = lambda n: json_text(p, f"$.data.{n}")
    rows = frames.where(is_ticker(p))
    return rows.select(key, F.lower(get("s")).alias("symbol"), get("b").alias("bid_exact"), get("B").alias("bid_size_exact"), get("a").alias("ask_exact"), get("A").alias("ask_size_exact"), (get("T").cast("long") * 1_000_000).alias("exchange_ts_ns"))


def aggregate_trades(frames: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """Reference feed: trades of `aggTrade` frames; if the buyer made the book, the seller took it."""
    p = F.col(payload)
    get = lambda n: json_text(p, f"$.data.{n}")
    rows = frames.where(is_aggregate_trade(p))
    return rows.select(key, F.lower(get("s")).alias("symbol"), get("p").alias("price_exact"), get("q").alias("size_exact"), F.when(get("m") == "true", "SELL").otherwise("BUY").alias("aggressor_side"), get("a").cast("long").alias("trade_id"), (get("T").cast("long") * 1_000_000).alias("exchange_ts_ns"))


def heads(p: Column) -> Column:
    """(event_type, ordinal) of every event that the tables above hold of a frame, from its payload alone."""
    head = lambda kind, ordinal: F.struct(F.lit(kind).alias("event_type"), F.lit(ordinal).cast("int").alias("ordinal"))
    none = F.array().cast("array<struct<event_type:string,ordinal:int>>")
    if_ = lambda good, *events: F.when(F.coalesce(good, F.lit(False)), F.array(*events)).otherwise(none)
    channel, data = json_text(p, "$.channel"), json_text(p, "$.data")
    parsed = lambda schema, check: F.exists(F.array(F.from_json(data, schema)), check)
    some = lambda x: F.coalesce(F.size(x) > 0, F.lit(False))
    book = parsed(BOOK, lambda x: (F.size(x["levels"]) == 2) & (some(F.get(x["levels"], 0)) | some(F.get(x["levels"], 1))))
    context = [F.struct(F.lit(kind).alias("event_type"), F.lit(k).alias("ordinal"), exact(json_text(p, f"$.data.ctx.{n}")).isNotNull().alias("good")) for k, (kind, n) in enumerate(CONTEXTS)]
    kept = F.transform(F.filter(F.array(*context), lambda x: x["good"]), lambda x: F.struct(x["event_type"].alias("event_type"), x["ordinal"].alias("ordinal")))
    # A frame of a feed's channel may also be one of the reference feed: both read the same payload.
    by_channel = (
        F.when(channel == "bbo", if_(parsed(BBO, good_bbo), head("BBO", 0)))
        .when(channel == "l2Book", if_(book, head("L2_SNAPSHOT", 0)))
        .when(channel == "activeAssetCtx", F.when(F.coalesce(is_context(p), F.lit(False)), kept).otherwise(none))
        .when(channel == "trades", F.transform(F.slice(F.sequence(F.lit(0), trades_in(p)), 2, 1 << 30), lambda k: F.struct(F.lit("TRADE").alias("event_type"), (k - 1).alias("ordinal"))))
        .otherwise(none)
    )
    return F.concat(by_channel, if_(is_ticker(p), head("REFERENCE_BBO", 0)), if_(is_aggregate_trade(p), head("REFERENCE_TRADE", 0)))
