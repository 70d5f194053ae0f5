"""How supervised streams end, and what their counters say."""

import time

from strandline.streaming import supervise


def files(spark, folder, n):
    for k in range(n):
        spark.range(10 * k, 10 * k + 10).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_complete(spark, tmp_path):
    rows = files(spark, tmp_path / "in", 3)
    run = supervise.supervised(spark, lambda: rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start())
    assert run == supervise.Outcome("COMPLETE", 3, 30, 10, None)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_failure_is_reported_and_the_next_start_repeats_the_batch(spark, tmp_path):
    rows, broken, seen = files(spark, tmp_path / "in", 3), [True], []

    def work(batch, number):
        if number == 1 and broken[0]:
            raise RuntimeError("disk of the sink is full")
        seen.append((number, batch.count()))

    start = lambda: rows.writeStream.foreachBatch(work).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    run = supervise.supervised(spark, start)
    assert (run.state, run.rows) == ("FAILED", 10) and "disk of the sink is full" in run.failure
    broken[0] = False
    assert supervise.supervised(spark, start).state == "COMPLETE" and seen == [(0, 10), (1, 10), (2, 10)]


def test_deadline_finishes_the_batch_at_work(spark, tmp_path):
    rows = spark.readStream.format("rate").option("rowsPerSecond", 50).load()
    run = supervise.supervised(spark, lambda: rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log")).trigger(processingTime="1 second").start(), seconds=6)
    assert run.state == "DRAINED" and run.batches > 0 and run.most_rows <= run.rows
    assert spark.read.parquet(str(tmp_path / "out")).count() == run.rows


def test_a_batch_that_does_not_end_is_given_up(spark, tmp_path):
    rows = files(spark, tmp_path / "in", 1)
    run = supervise.supervised(spark, lambda: rows.writeStream.foreachBatch(lambda batch, number: time.sleep(8)).option("checkpointLocation", str(tmp_path / "log")).start(), seconds=3, drain_seconds=0.5)
    assert (run.state, run.rows) == ("TIMED_OUT", 0)
