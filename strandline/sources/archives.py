"""Historical CSV archives: every column is read as text, then cast by contract."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators.scan import scanned

PRICE = "decimal(38,18)"
#: Rows of a file that are looked at together; the last one before is carried into the next.
ROWS = 1_000_000
PREFIX = {"exchange": "string", "symbol": "string", "timestamp": "long", "local_timestamp": "long"}
#: Columns of the three archive kinds.
COLUMNS = {
    "quotes": PREFIX | {"ask_amount": PRICE, "ask_price": PRICE, "bid_price": PRICE, "bid_amount": PRICE},
    "trades": PREFIX | {"id": "string", "side": "string", "price": PRICE, "amount": PRICE},
    "book_snapshot_5": PREFIX | {f"{s}[{k}].{v}": PRICE for k in range(5) for s in ("asks", "bids") for v in ("price", "amount")},
}


def text_schema(kind: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in COLUMNS[kind]])


def plain(name: str) -> str:
    return name.replace("[", "_").replace("].", "_").replace("asks_", "ask_").replace("bids_", "bid_")


def read_archive(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Typed rows of gzipped CSV archives with source_row_number (file order, from 0). A text that its type cannot hold fails the query.

    A gzip file is one task, so that the order of its rows is the order of ids made in it. Other files may be split, and
    their rows have no number that could be known: such a file fails the query.
    """
    raw = spark.read.csv(path, header=True, schema=text_schema(kind), mode="FAILFAST", enforceSchema=False)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file")).withColumn("_id", F.monotonically_increasing_id())
    first = raw.groupBy("_file").agg(F.min("_id").alias("_first"))
    number = F.when(F.col("_file").endswith(".gz"), F.col("_id") - F.col("_first")).otherwise(F.raise_error(F.concat(F.col("_file"), F.lit(" is not gzipped"))))
    numbered = raw.join(first, "_file").withColumn("source_row_number", number.cast("long"))
    typed = [F.col(f"`{c}`").cast(t).alias(plain(c)) for c, t in COLUMNS[kind].items()]
    out = numbered.select("source_row_number", *typed)
    return out.withColumnsRenamed({"timestamp": "exchange_timestamp_us", "local_timestamp": "local_timestamp_us", "id": "trade_id"})


def store_archive(archive: DataFrame, root: str, data_type: str) -> None:
    """Write into root/exchange=/data_type=/day=, compressed, one group of files a day."""
    day = F.date_format(F.timestamp_micros("local_timestamp_us"), "yyyy-MM-dd")
    out = archive.withColumn("data_type", F.lit(data_type)).withColumn("day", day)
    out.repartition("exchange", "day").sortWithinPartitions("exchange", "day", "symbol", "source_row_number").write.partitionBy("exchange", "data_type", "day").mode("append").option("compression", "zstd").parquet(root)


def views(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """A temporary view for each exchange and data type below root."""
    out = {}
    lake = spark.read.parquet(root)
    for r in lake.select("exchange", "data_type").distinct().collect():  # one row for each folder
        name = f"{r.exchange}_{r.data_type}".replace("-", "_")
        out[name] = lake.where((F.col("exchange") == r.exchange) & (F.col("data_type") == r.data_type))
        out[name].createOrReplaceTempView(name)
    return out


def archive_stats(rows: DataFrame, day: str) -> DataFrame:
    """(n, first_us, last_us, reversals, outside): reversals run against row order; outside the UTC day there must be none."""
    stepped = scanned(rows, ["symbol"], ["source_row_number"], lags={"_prev": F.col("local_timestamp_us")}, width=ROWS)
    t = F.col("local_timestamp_us")
    inside = F.date_format(F.timestamp_micros(t), "yyyy-MM-dd") == day
    return stepped.agg(F.count("*").alias("n"), F.min(t).alias("first_us"), F.max(t).alias("last_us"), F.count(F.when(t < F.col("_prev"), 1)).alias("reversals"), F.count(F.when(~inside, 1)).alias("outside"))


def read_zipped_csv(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Rows, as text, of zip files that hold one CSV each; another header or another number of files fails the query."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if len(z.namelist()) != 1:
                        raise ValueError(f"{name} holds {len(z.namelist())} files")
                    with z.open(z.namelist()[0]) as f:
                        for part in pd.read_csv(f, dtype=str, chunksize=100_000, keep_default_na=False):
                            if list(part.columns) != header:
                                raise ValueError(f"{name} has the header {list(part.columns)}")
                            yield part.assign(source_row_number=part.index.astype("int64"))[["source_row_number", *header]]

    schema = T.StructType([T.StructField("source_row_number", T.LongType()), *[T.StructField(h, T.StringType()) for h in header]])
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)
