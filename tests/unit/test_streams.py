"""Rows that come late in a later batch are still in order."""

import random

from pyspark.sql import functions as F

from strandline.operators import horizons
from strandline.streaming import captures

SECOND = 1_000_000


def test_shuffled_batches_give_the_batch_result(spark, tmp_path):
    rng = random.Random(1)
    rows = [(d, (1_000 + rng.randint(0, 400)) * SECOND + d, k) for k, d in enumerate(rng.choice([1, 1, 1, 2]) for _ in range(200))]
    rng.shuffle(rows)
    schema = "dom long, us long, k long, ts timestamp"
    full = spark.createDataFrame(rows, "dom long, us long, k long").withColumn("ts", F.timestamp_micros("us"))
    for n in range(4):
        part = spark.createDataFrame(rows[n * 50 : n * 50 + 50], "dom long, us long, k long").withColumn("ts", F.timestamp_micros("us"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{n}"))
    # A row far ahead moves the watermark past all others.
    spark.createDataFrame([(9, 99_999 * SECOND, 999)], "dom long, us long, k long").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in9"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in*"))
    with captures.list_state(spark):
        got = captures.drain(captures.ordered_windows(stream, "dom", "us", "k", "ts", "1 hour", 30 * SECOND)).collect()
    want = horizons.greedy(full, ["dom"], "us", "k", 30 * SECOND, 10 * SECOND).where("exit_key IS NOT NULL").collect()
    pick = lambda r: (r.dom, r.entry_key, r.entry_time, r.exit_key, r.exit_time)
    assert len(want) > 10 and sorted(map(pick, got)) == sorted(map(pick, want))
    assert "RocksDB" not in (spark.conf.get(captures.PROVIDER, None) or "")
