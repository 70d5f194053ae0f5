"""Helpers that several training-data operators share."""

from __future__ import annotations

import inspect
import math
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One whole input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_checkpoints(spark: SparkSession) -> SparkSession:
    """Use the cluster's checkpoint folder; only where none is named, as in tests, one in the warehouse, which is shared too."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/strandline-checkpoints")
    return spark


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    with_checkpoints(df.sparkSession)
    return df.checkpoint()


#: Rows and bytes of one Arrow batch: rows carry whole texts, and ten thousand long ones would not fit a worker.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after making Arrow batches of this session small enough for rows with whole texts.

    Spark reads these settings when it runs a plan, so that they have to stay; both only ever get smaller.
    """
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(conf.get(key).rstrip("bB"))
        if now <= 0 or now > most:
            conf.set(key, str(most))
    return df


def blocks_for(total: float, each: float, least: int = 1) -> int:
    """How many blocks of about `each` units hold `total` units."""
    return max(least, math.ceil(total / each))


def key128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes: an equality key for texts that need not be shipped whole."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second key"), *columns).alias("h2")]


def stored(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed columnar table in the same folder: for rows that carry texts."""
    spark = with_checkpoints(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Parameters that name a column of the documents.
ROLES = ("text", "doc", "url")


def apart(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """operator, which gets all columns that none of its parameters names under names that its plan does not use.

    They come back under their own names, whatever these are (dots too), except where the operator adds a column of that
    name, which replaces it.
    """
    signature = inspect.signature(operator)

    @wraps(operator)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        bound = signature.bind(docs, *args, **options)
        bound.apply_defaults()
        named = {bound.arguments[r] for r in ROLES if r in bound.arguments}
        aside = {c: f"_carried{k}" for k, c in enumerate(docs.columns) if c not in named}
        out = operator(docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]), *args, **options)
        own = {k: c for c, k in aside.items()}
        made = set(out.columns) - set(own)
        return out.select(*[F.col(k).alias(own.get(k, k)) for k in out.columns if own.get(k) not in made])

    return run


#: Buckets of one table at most; a bucket then holds several blocks.
MOST_BUCKETS = 20_000


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Like stored, bucketed by key: groups and joins by it read the rows where they lie, and do not shuffle them again."""
    spark = with_checkpoints(df.sparkSession)
    name, n = f"blocks_{uuid.uuid4().hex}", min(buckets, MOST_BUCKETS)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


#: Rows of one key beyond which it counts as heavy, and how many heavy keys there can be at most.
HEAVY_ROWS, HEAVY_KEYS = 2_000, 1_000


def joined(rows: DataFrame, keyed: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """rows joined with keyed, which has one row for each key and how many of `rows` have it (`n`, which is dropped).

    Keys with more than HEAVY_ROWS rows, and more than 1 / HEAVY_KEYS of all, are broadcast, so that no task gets all rows
    of one key; there are at most HEAVY_KEYS of them, whatever the input. All other keys meet in a plain join.
    """
    keyed = cut(keyed)
    most = max(HEAVY_ROWS, (keyed.agg(F.sum(n)).first()[0] or 0) // HEAVY_KEYS)
    heavy = keyed.where(F.col(n) > most).drop(n)
    light = rows.join(F.broadcast(heavy.select(*by)), by, "left_anti").join(keyed.where(F.col(n) <= most).drop(n), by)
    return light.unionByName(rows.join(F.broadcast(heavy), by))
