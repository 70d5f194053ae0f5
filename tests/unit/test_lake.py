"""Tables laid out by time: what is not asked for is never opened."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.sources import timetable

DAYS = 10


@pytest.fixture
def root(spark, tmp_path):
    k = F.col("id")
    rows = spark.range(1000).select(k, (k * timetable.DAY * DAYS / 1000 - timetable.DAY).cast("long").alias("us"), F.lit("x").alias("v"))
    timetable.write_timetable(rows, "us", str(tmp_path / "t"), partitions=4)
    return tmp_path / "t"


def spoil(root: Path, first: int) -> int:
    """Overwrite every file of the slots from `first` on."""
    n = 0
    for f in root.glob("_slot=*/*.parquet"):
        if int(f.parent.name.split("=")[1]) >= first:
            f.write_bytes(b"no parquet")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
            n += 1
    return n


def files_read(df) -> int:
    """Files that the plan's scan will open: what its partition filters leave of the table's listing."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    (scan,) = [leaves.apply(i) for i in range(leaves.size())]
    found = scan.relation().location().listFiles(scan.partitionFilters(), scan.dataFilters())
    return sum(found.apply(i).files().size() for i in range(found.size()))


def test_rows_before_a_bound_open_no_later_file(spark, root):
    bound = 3 * timetable.DAY
    whole = timetable.read_timetable(spark, str(root), "us", end=bound)
    want = sorted(r.id for r in whole.collect())
    assert len(want) == 400 and all(k < 400 for k in want)
    every = len(list(root.glob("_slot=*/*.parquet")))
    assert files_read(whole) == len([f for f in root.glob("_slot=*/*.parquet") if int(f.parent.name.split("=")[1]) < 3]) < every
    spoiled = spoil(root, 3)
    assert spoiled and sorted(r.id for r in timetable.read_timetable(spark, str(root), "us", end=bound).collect()) == want
    with pytest.raises(Exception, match="(?i)parquet"):
        timetable.read_timetable(spark, str(root), "us", end=bound + 1).collect()


def test_both_bounds_and_times_below_zero(spark, root):
    rows = timetable.read_timetable(spark, str(root), "us", -timetable.DAY, 1).collect()
    assert sorted(r.id for r in rows) == list(range(101)) and {r[timetable.SLOT] for r in rows} == {-1, 0}
    assert timetable.read_timetable(spark, str(root), "us", timetable.DAY, timetable.DAY).count() == 0


def test_slots_that_another_table_names(spark, root):
    spoil(root, 4)
    asked = timetable.read_timetable(spark, str(root), "us", end=4 * timetable.DAY).where("id IN (150, 151, 320)").select(timetable.SLOT).distinct()
    found = timetable.rows_in_slots(spark, str(root), asked)
    assert sorted(r.id for r in found.collect()) == [*range(100, 200), *range(300, 400)]


def test_checksum_tokens(spark):
    digest = "ab" * 32
    rows = [(f"{digest}  a.zip",), (f"\t{digest.upper()}\n",), (digest,), (f"{digest}0 a",), ("",), (None,), (digest[:-1],)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(text.checksum_token(F.col("s"))).collect()]
    assert got == [digest, digest, digest, None, None, None, None]
