"""Tables laid out by time, so that a bound on time decides which files are opened.

Rows lie in one folder for each slot of time, in time order inside a file. A bound known when the query is planned prunes
folders at once; bounds that another table holds prune them when they are known, before any file is opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.scan import DAY, coarse

SLOT = "_slot"


def write_timetable(df: DataFrame, time: str, root: str, width: int = DAY, partitions: int | None = None) -> None:
    """Write df into root/_slot=<time div width>/. A slot with many rows is several files, dealt by time."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slotted = df.withColumn(SLOT, coarse(time, width))
    slotted.repartitionByRange(n, SLOT, time).sortWithinPartitions(SLOT, time).write.partitionBy(SLOT).option("compression", "zstd").parquet(root)


def read_timetable(spark: SparkSession, root: str, time: str, start: int | None = None, end: int | None = None, width: int = DAY) -> DataFrame:
    """Rows with start <= time < end. Folders outside are not listed, files in them never opened."""
    rows = spark.read.parquet(root)
    if start is not None:
        rows = rows.where((F.col(SLOT) >= start // width) & (F.col(time) >= start))
    if end is not None:
        rows = rows.where((F.col(SLOT) <= (end - 1) // width) & (F.col(time) < end))
    return rows


def rows_in_slots(spark: SparkSession, root: str, slots: DataFrame) -> DataFrame:
    """Rows of the slots that `slots` (one column, SLOT, without repeats) names: dynamic partition pruning reads only these.

    slots has a row for each folder at most, so that it may be broadcast.
    """
    return spark.read.parquet(root).join(F.broadcast(slots), SLOT)
