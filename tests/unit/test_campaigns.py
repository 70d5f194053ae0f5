"""Captured, sealed, lost and doubled segments."""

import os

import pytest
from pyspark.sql import functions as F

from strandline.sources import campaigns


def made(spark, root):
    rows = spark.createDataFrame([(k, 1_000 + k, ["a", "b/c d", "e"][k % 3]) for k in range(30)], "id long, us long, segment string")
    campaigns.capture(rows, root)
    return rows.drop("segment").schema


def states(spark, root):
    return {r.segment: r.state for r in campaigns.discover(spark, root).collect()}


def test_states_of_segments(spark, tmp_path):
    root = str(tmp_path)
    schema = made(spark, root)
    assert states(spark, root) == {"a": "INCOMPLETE", "b/c d": "INCOMPLETE", "e": "INCOMPLETE"}
    one = spark.createDataFrame([("b/c d",), ("nowhere",)], "segment string")
    for _ in range(2):  # the second time changes nothing
        campaigns.seal(spark, root, schema, "us", one)
    assert states(spark, root) == {"a": "INCOMPLETE", "b/c d": "PUBLISHED", "e": "INCOMPLETE"}
    got = campaigns.discover(spark, root).where("state = 'PUBLISHED'").first()
    assert (got.n, got.first, got.last) == (10, 1_001, 1_028)
    assert sorted(r.id for r in campaigns.published(spark, root, schema).collect()) == list(range(1, 30, 3))
    campaigns.recover(spark, root, schema, "us")
    assert set(states(spark, root).values()) == {"PUBLISHED"} and campaigns.published(spark, root, schema).count() == 30


def test_unfit_segments_end_the_read(spark, tmp_path):
    root = str(tmp_path)
    schema = made(spark, root)
    campaigns.recover(spark, root, schema, "us")
    campaigns.evidence(spark, root).where("segment = 'a'").withColumn("n", F.lit(99).cast("long")).coalesce(1).write.mode("append").parquet(f"{root}/evidence")
    spark.createDataFrame([(7, 7, "e")], "id long, us long, segment string").write.mode("append").partitionBy("segment").parquet(f"{root}/rows")
    spark.createDataFrame([("gone", 1, 1, 1, 1, 1)], campaigns.EVIDENCE).coalesce(1).write.mode("append").parquet(f"{root}/evidence")
    assert states(spark, root) == {"a": "DUPLICATE", "b/c d": "PUBLISHED", "e": "CHANGED", "gone": "MISSING"}
    with pytest.raises(ValueError, match=r"a \(DUPLICATE\), e \(CHANGED\), gone \(MISSING\)"):
        campaigns.published(spark, root, schema)


def test_incomplete_segments_are_not_opened(spark, tmp_path):
    root = str(tmp_path)
    schema = made(spark, root)
    campaigns.seal(spark, root, schema, "us", spark.createDataFrame([("a",)], "segment string"))
    for folder, _, names in os.walk(f"{root}/rows/segment=e"):
        for n in names:
            if n.endswith(".parquet"):
                with open(f"{folder}/{n}", "wb") as f:
                    f.write(b"torn")
    assert campaigns.published(spark, root, schema).count() == 10
