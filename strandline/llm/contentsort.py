"""Exact dedup by content sort: equal texts become neighbours, and neighbours are compared whole. DataFrame functions only.

Texts are compared after each run of blanks has become one space. Rows are range-partitioned by sampled splitters, sorted
in each partition (Spark's external sort, which spills) and compared with their neighbours byte by byte; of equal ones the
smallest id stays. The order is that of the first LEAD characters, then of a 64-bit hash, then of the whole text: so the
sampled splitters that reach the driver are short whatever the texts' lengths, texts with a common beginning are spread,
and a hash alone never makes two texts equal.

A group of copies that would fill a large part of one partition is cut into cells by the hash of the id. Each cell is
sorted and compared like a group; then the cells' first rows, of which there are a few for each partition, are compared
with each other by their whole texts. Which groups are large is known from one count of the hashes beforehand, at most
2 * MOST_PARTS of them, so that this list may be broadcast.

Defined cases: a null text counts as empty. A null id is larger than any other; if all ids of a group are null, keep_id is
null and one row is kept. Of repeated rows (equal text and id) one is kept. An empty table gives an empty result. Extra
columns pass through unless they have the name of an added one, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import blocks_for, cut, stored

LEAD = 32
#: Bytes of text that one partition sorts, and what a row counts besides its text.
PART_BYTES, ROW_BYTES = 64 << 20, 64
#: A group is cut beyond half the load of one of so many partitions.
MOST_PARTS = 50_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, text: str = "text", order: str = "doc_id", with_text: bool = False) -> DataFrame:
    """docs (with_text: with the text) and keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    spark = docs.sparkSession
    added = {"keep_id", "group_size", "kept", "text_sha256"}
    names = {c: f"_carried{k}" for k, c in enumerate(c for c in docs.columns if c not in added and (with_text or c != text))}
    # Every column goes on under a name of our own, so that none of the input's can clash with the plan's.
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()], F.col(f"`{order}`").alias("_id"), normalised(F.col(f"`{text}`")).alias("_norm"))
    rows = rows.withColumn("_h", F.xxhash64("_norm"))
    loads = cut(rows.groupBy("_h").agg(F.sum(F.octet_length("_norm") + ROW_BYTES).alias("_load")))
    total = loads.agg(F.sum("_load")).first()[0] or 0
    parts = blocks_for(total, PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = max(1, total // (2 * min(parts, MOST_PARTS)))
    large = loads.where(F.col("_load") > most).select("_h", F.ceil(F.col("_load") / most).alias("_cells"))

    spread = F.pmod(F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.to_json(F.struct(*names.values())))), F.col("_cells"))
    dealt = rows.join(F.broadcast(large), "_h", "left").withColumn("_cell", F.coalesce(spread, F.lit(0))).withColumn("_lead", F.substring("_norm", 1, LEAD))
    dealt = dealt.repartitionByRange(parts, "_lead", "_h", "_cell")
    # The range partitioning holds whole groups of these keys: the window sorts what lies there and shuffles nothing.
    equal = Window.partitionBy("_lead", "_h", "_norm", "_cell").orderBy(F.col("_id").isNull(), "_id")
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = dealt.select(
        *names.values(), "_cell", F.sha2("_norm", 256).alias("text_sha256"), F.first("_id").over(whole).alias("_least"), F.count("*").over(whole).alias("_size"),
        (F.row_number().over(equal) == 1).alias("_first"), "_cells", "_norm",
    )
    head = F.when(F.col("_first") & F.col("_cells").isNotNull(), F.col("_norm"))
    seen = stored(seen.withColumn("_head", head).drop("_norm", "_cells"))

    least = F.min(F.struct(F.col("_least").isNull().alias("none"), F.col("_least").alias("id"), F.col("_cell").alias("cell")))
    met = seen.where("_head IS NOT NULL").groupBy("_head").agg(F.first("text_sha256").alias("text_sha256"), least.alias("_best"), F.sum("_size").alias("_total")).drop("_head")
    out = seen.join(F.broadcast(met), "text_sha256", "left")
    cut_up = F.col("_best").isNotNull()
    return out.select(
        *[F.col(k).alias(c) for c, k in names.items()],
        F.when(cut_up, F.col("_best.id")).otherwise(F.col("_least")).alias("keep_id"), F.coalesce("_total", "_size").alias("group_size"),
        (F.col("_first") & (~cut_up | (F.col("_cell") == F.col("_best.cell")))).alias("kept"), "text_sha256",
    )
