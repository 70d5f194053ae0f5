"""Captured segments and the evidence that publishes them.

A campaign is a folder with `rows`, a table partitioned by segment, and `evidence`, a table with a row for each segment that
was sealed. A segment is captured first and sealed after: one without evidence is incomplete, whatever its files hold, and
is found by listing, as no reader of published data sees it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.sources.checkpoints import cut

SEGMENT = "segment"
EVIDENCE = "segment string, n long, first long, last long, files long, bytes long"
PUBLISHED, INCOMPLETE, MISSING, CHANGED, DUPLICATE = "PUBLISHED", "INCOMPLETE", "MISSING", "CHANGED", "DUPLICATE"


def capture(rows: DataFrame, root: str) -> None:
    """Write rows, which have a column `segment`, as segments that are not sealed yet."""
    rows.repartition(SEGMENT).write.mode("append").partitionBy(SEGMENT).parquet(f"{root}/rows")


def found(spark: SparkSession, root: str) -> DataFrame:
    """(segment, files, bytes) of all captured segments, from the listing alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{root}/rows")
    name = F.url_decode(F.regexp_extract("path", rf"/{SEGMENT}=([^/]+)/[^/]+$", 1))
    return files.select(name.alias(SEGMENT), "length").groupBy(SEGMENT).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def evidence(spark: SparkSession, root: str) -> DataFrame:
    """What was sealed; empty before the first time."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/evidence")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], EVIDENCE)
    return spark.read.schema(EVIDENCE).parquet(f"{root}/evidence")


def discover(spark: SparkSession, root: str) -> DataFrame:
    """One row for each segment that was captured or sealed: its state and its evidence."""
    sealed = evidence(spark, root).groupBy(SEGMENT).agg(F.count("*").alias("_seals"), *[F.first(c).alias(c) for c in ("n", "first", "last", "files", "bytes")])
    held = found(spark, root).select(SEGMENT, F.col("files").alias("_files"), F.col("bytes").alias("_bytes"))
    state = (
        F.when(F.col("_seals").isNull(), INCOMPLETE)
        .when(F.col("_seals") > 1, DUPLICATE)
        .when(F.col("_files").isNull(), MISSING)
        .when((F.col("files") != F.col("_files")) | (F.col("bytes") != F.col("_bytes")), CHANGED)
        .otherwise(PUBLISHED)
    )
    # Written down, so that a choice by state is a plain filter, by which scans of the rows can be pruned.
    return cut(held.join(sealed, SEGMENT, "full").select(SEGMENT, state.alias("state"), "n", "first", "last", "files", "bytes"))


def rows_in(spark: SparkSession, root: str, schema: StructType, segments: DataFrame) -> DataFrame:
    """Rows of the given segments, which were chosen by a filter; `schema` is that of the rows without segment.

    Dynamic partition pruning opens no other segment's files. segments has a row for each folder at most.
    """
    all_rows = spark.read.schema(StructType(schema.fields).add(SEGMENT, "string")).parquet(f"{root}/rows")
    return all_rows.join(F.broadcast(segments.select(SEGMENT).distinct()), SEGMENT, "left_semi")


def seal(spark: SparkSession, root: str, schema: StructType, time: str, segments: DataFrame) -> None:
    """Write the evidence of captured segments that have none; those that are sealed already stay as they are."""
    open_ = discover(spark, root).where(F.col("state") == INCOMPLETE).join(segments.select(SEGMENT).distinct(), SEGMENT, "left_semi").select(SEGMENT)
    counted = rows_in(spark, root, schema, open_).groupBy(SEGMENT).agg(F.count("*").alias("n"), F.min(time).alias("first"), F.max(time).alias("last"))
    counted.join(found(spark, root), SEGMENT).select(SEGMENT, "n", "first", "last", "files", "bytes").coalesce(1).write.mode("append").parquet(f"{root}/evidence")


def recover(spark: SparkSession, root: str, schema: StructType, time: str) -> None:
    """Seal what a lost run has captured, before new work."""
    seal(spark, root, schema, time, discover(spark, root).where(F.col("state") == INCOMPLETE))


def published(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    """Rows of published segments. A segment that was sealed twice, changed or lost ends the read with its name."""
    state = discover(spark, root)
    wrong = state.where(F.col("state").isin(DUPLICATE, MISSING, CHANGED)).orderBy(SEGMENT).limit(5).collect()
    if wrong:
        raise ValueError("segments unfit for reading: " + ", ".join(f"{r.segment} ({r.state})" for r in wrong))
    return rows_in(spark, root, schema, state.where(F.col("state") == PUBLISHED))
