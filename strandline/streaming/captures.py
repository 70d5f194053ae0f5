"""Structured Streaming forms of capture and processing.

Sources are replayed files or the raw-log source. Late rows are kept and flagged; a watermark only bounds state. A batch
run over the same rows gives the same results, which the queries check.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from strandline.sources.checkpoints import checkpoint_folder
from strandline.sources.rawlog import RawLog


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def replay(spark: SparkSession, sf_dir: str, name: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stored table as a stream of its files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


def raw_stream(spark: SparkSession, path: str) -> DataFrame:
    """Sealed raw-log segments as they appear."""
    spark.dataSource.register(RawLog)
    return spark.readStream.format("rawlog").load(path)


def multiplex(*feeds: tuple[str, DataFrame]) -> DataFrame:
    """Several feeds as one stream, each row with its feed's name. Back-pressure is the sources' rate limit."""
    out = None
    for name, feed in feeds:
        named = feed.withColumn("feed", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def availability(rows: DataFrame, event: str, received: str, most_late: int) -> DataFrame:
    """Late rows are LATE_BACKFILL and barred from decisions, not dropped."""
    late = F.col(received) - F.col(event) > most_late
    return rows.withColumn("availability", F.when(late, "LATE_BACKFILL").otherwise("LIVE_CAPTURE")).withColumn("decision_ok", ~late)


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is there now, and give what it wrote."""
    spark = stream.sparkSession
    out = folder(spark)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    else:
        # The result of a complete aggregation replaces the last one.
        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/rows")

        stream.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def observed(stream: DataFrame, by: Sequence[str], time: str, domain: str) -> DataFrame:
    """Running state of a capture: rows, domains (exact: their set is the state) and span of each source."""
    return stream.groupBy(*by).agg(F.count("*").alias("n"), F.size(F.collect_set(domain)).cast("long").alias("domains"), F.min(time).alias("first"), F.max(time).alias("last"))


def segments(stream: DataFrame, event: str, width: str, by: Sequence[str]) -> DataFrame:
    """Clock-aligned segments of a fixed width."""
    w = F.window(F.col(event), width)
    return stream.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.unix_micros("w.start").alias("segment_start_us"), *by, "n")


def processed(stream: DataFrame, work: Callable[[DataFrame], DataFrame], target: str, log: str) -> None:
    """Process captured segments oldest first, each once: a batch that is run again replaces its own folder."""

    def one(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{target}/batch={number:06d}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


def streaming_windows(stream: DataFrame, by: str, time: str, key: str, horizon: int) -> DataFrame:
    """Non-overlapping windows (by, entry_key, entry_time, exit_key, exit_time) as a state machine for each domain.

    The state is the open entry. Rows must come in order of time from batch to batch; inside a batch they are sorted.
    """

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches), ignore_index=True).sort_values([time, key], kind="stable")
        entry = state.get if state.exists else None
        out = []
        for k, t in zip(rows[key].tolist(), rows[time].tolist(), strict=True):
            if entry is None:
                entry = (k, t)
            elif t >= entry[1] + horizon:
                out.append((group[0], *entry, k, t))
                entry = None
        if entry is None:
            if state.exists:
                state.remove()
        else:
            state.update(entry)
        yield pd.DataFrame(out, columns=[by, "entry_key", "entry_time", "exit_key", "exit_time"])

    schema = f"{by} long, entry_key long, entry_time long, exit_key long, exit_time long"
    return stream.select(by, time, key).groupBy(by).applyInPandasWithState(step, schema, "entry_key long, entry_time long", "append", GroupStateTimeout.NoTimeout)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside have a state store with lists and timers; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class OrderedWindows(StatefulProcessor):
    """Rows wait in a list until the watermark has passed them; then they are taken in order, whatever batch brought them."""

    def __init__(self, by: str, time: str, key: str, horizon: int):
        self.by, self.time, self.key, self.horizon = by, time, key, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, k long")
        self.entry = handle.getValueState("entry", "t long, k long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            new = [(int(t), int(k)) for t, k in zip(pdf[self.time], pdf[self.key], strict=True)]
            self.waiting.appendList(new)
            # In whole milliseconds, so that the timer is not before its last row.
            self.handle.registerTimer(max(t for t, _ in new) // 1000 + 1)
        yield pd.DataFrame(columns=[self.by, "entry_key", "entry_time", "exit_key", "exit_time"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(t), int(k)) for t, k in self.waiting.get())
        self.waiting.clear()
        if rest := [r for r in rows if r[0] > passed]:
            self.waiting.put(rest)
        entry, out = self.entry.get() if self.entry.exists() else None, []
        for t, k in rows[: len(rows) - len(rest)]:
            if entry is None:
                entry = (t, k)
            elif t >= entry[0] + self.horizon:
                out.append((key[0], entry[1], entry[0], k, t))
                entry = None
        if entry is None:
            self.entry.clear()
        else:
            self.entry.update((int(entry[0]), int(entry[1])))
        yield pd.DataFrame(out, columns=[self.by, "entry_key", "entry_time", "exit_key", "exit_time"])

    def close(self) -> None:
        pass


def ordered_windows(stream: DataFrame, by: str, time: str, key: str, event: str, delay: str, horizon: int) -> DataFrame:
    """Like streaming_windows, for rows that come up to `delay` late, in any batch: the windows are those of a batch run.

    event is the timestamp of `time` (microseconds). Later rows than that are dropped by the watermark. A window comes out
    once the watermark has passed its exit. Start it inside `list_state`.
    """
    rows = stream.withWatermark(event, delay).select(by, time, key, event)
    return rows.groupBy(by).transformWithStateInPandas(OrderedWindows(by, time, key, horizon), f"{by} long, entry_key long, entry_time long, exit_key long, exit_time long", "Append", "EventTime")
