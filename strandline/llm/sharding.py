"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows with equal text form a group that stays together. A group is put into the shard whose residual capacity has the
highest dot product with the group's weights, largest groups first (Panigrahy et al., 2011). One packer for all
groups would not scale, so:

* groups that weigh more than a set part of one shard (there are at most `dims * shards * HEAVY` of them) are placed
  first and globally; those above a whole part are split, as a group of a third of all rows fits into no shard;
* the others are dealt by hash into blocks of bounded size, and each block fills its share of what is left of every
  shard. As all blocks are balanced in themselves, so is their sum.

Defined cases: a null text weighs `overhead` bytes, no tokens and one row, and all null texts are one group; an empty
text likewise, as another group. Repeated rows are rows of their own with slots of their own. Fewer rows than shards
leave shards empty. An empty table gives an empty result. Extra columns pass through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import blocks_for, cut, key128

#: A group is heavy beyond 1 / HEAVY of a shard's capacity in some dimension.
HEAVY = 16
#: Groups that one block places.
BLOCK_GROUPS = 8_000
DIMS = ["size", "tokens", "rows"]


def place(weights: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Shard of each group (rows of `weights`, n x dims, all in shares of a shard's capacity), largest first.

    `residual` (shards x dims) is what each shard can still take. Shards that have room in every dimension come
    first; the highest dot product of weights and residual wins, ties go to the lower shard number.
    """
    left = residual.astype(float).copy()
    chosen = np.zeros(len(weights), dtype=np.int32)
    for i in np.lexsort((np.arange(len(weights)), -weights.max(axis=1, initial=0))):
        w = weights[i]
        dot = left @ w
        fits = (left >= w - 1e-12).all(axis=1)
        k = int(np.argmax(np.where(fits, dot, dot - 1e6)))
        chosen[i] = k
        left[k] -= w
    return chosen


def vector_shards(docs: DataFrame, shards: int, text: str = "text", order: str = "doc_id", overhead: int = 8, block_groups: int = BLOCK_GROUPS) -> DataFrame:
    """docs without the text, with size, n_tokens, text_crc32, shard and slot (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    added = {"size", "n_tokens", "text_crc32", "shard", "slot"}
    names = {c: f"_carried{k}" for k, c in enumerate(c for c in docs.columns if c != text and c not in added)}
    # Under names of our own, so that no input column clashes with one of the plan's.
    carried = list(names.values())
    body = F.col(text)
    rows = cut(docs.select(
        *[F.col(f"`{c}`").alias(k) for c, k in names.items()],
        (F.coalesce(F.octet_length(body), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.regexp_count(body, F.lit(r"\S+")), F.lit(0)).cast("long").alias("n_tokens"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
        *key128(body),
    ))
    total = rows.agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")).first()
    if not total["rows"]:
        return rows.drop("h1", "h2").withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")).withColumnsRenamed({k: c for c, k in names.items()})
    capacity = np.array([max(total[d], 1) / shards for d in DIMS])
    groups = rows.groupBy("h1", "h2").agg(F.sum("size").alias("size"), F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    share = F.greatest(*[F.col(d) / F.lit(float(c)) for d, c in zip(DIMS, capacity, strict=True)])
    # A part of a group holds at most 1 / HEAVY of a shard; at most len(DIMS) * shards * (HEAVY + 1) parts can exist.
    groups = cut(groups.withColumn("pieces", F.ceil(share * F.lit(float(HEAVY))).cast("int")))
    heavy = groups.where("pieces > 1").orderBy("h1", "h2").toPandas()
    pieces = heavy.loc[heavy.index.repeat(heavy["pieces"])].copy() if len(heavy) else heavy.assign(piece=pd.Series(dtype="int32"))
    pieces["piece"] = pieces.groupby(["h1", "h2"]).cumcount().astype("int32")
    # A group that fits into one shard whole stays whole; only larger ones are split.
    fits = (pieces["pieces"] <= HEAVY) if len(pieces) else pd.Series(dtype=bool)
    weights = pieces[DIMS].to_numpy(dtype=float).reshape(-1, len(DIMS)) / capacity
    whole = np.asarray(fits, dtype=bool)
    keep = ~whole | (pieces["piece"].to_numpy() == 0)
    pieces, whole, weights = pieces[keep], whole[keep], weights[keep]
    weights = np.where(whole[:, None], weights, weights / np.maximum(pieces["pieces"].to_numpy(dtype=float), 1)[:, None])
    residual = np.ones((shards, len(DIMS)))
    chosen = place(weights, residual)
    np.subtract.at(residual, chosen, weights)
    residual = np.maximum(residual, 0)
    placed = [(int(a), int(b), int(p), 1 if w else int(n), int(s)) for a, b, p, n, w, s in zip(pieces["h1"], pieces["h2"], pieces["piece"], pieces["pieces"], whole, chosen, strict=True)]
    heavy_df = spark.createDataFrame(placed, "h1 long, h2 long, piece int, parts int, shard int")

    light = groups.where("pieces <= 1")
    n_blocks = blocks_for(light.count(), block_groups)

    def pack(key, pdf):
        w = pdf[DIMS].to_numpy(dtype=float) / capacity
        # This block's share of what is left of each shard, by dimension.
        room = residual * (w.sum(axis=0) / np.maximum(residual.sum(axis=0), 1e-12))
        pdf = pdf.sort_values(["h1", "h2"])
        w = pdf[DIMS].to_numpy(dtype=float) / capacity
        return pdf[["h1", "h2"]].assign(piece=np.int32(0), parts=np.int32(1), shard=place(w, room))

    packed = light.withColumn("block", F.pmod(F.xxhash64("h1"), F.lit(n_blocks))).groupBy("block").applyInPandas(pack, "h1 long, h2 long, piece int, parts int, shard int")
    # Heavy groups are a bounded number of rows, so that they are broadcast and their rows never meet in one task.
    parts = F.broadcast(heavy_df.select("h1", "h2", "parts").distinct())
    of_heavy = rows.join(parts, ["h1", "h2"]).withColumn("piece", F.pmod(F.xxhash64(*[F.col(c) for c in (carried or ["h1"])]), F.col("parts")).cast("int"))
    of_heavy = of_heavy.join(F.broadcast(heavy_df.drop("parts")), ["h1", "h2", "piece"]).drop("parts", "piece")
    of_light = rows.join(parts.select("h1", "h2"), ["h1", "h2"], "left_anti").join(packed.select("h1", "h2", "shard"), ["h1", "h2"])
    placed = cut(of_light.unionByName(of_heavy).drop("h1", "h2"))
    return with_slots(placed, names[order], blocks_for(total["rows"], block_groups)).withColumnsRenamed({k: c for c, k in names.items()})


def with_slots(rows: DataFrame, order: str, blocks: int) -> DataFrame:
    """slot: gapless in each shard. Rows are numbered in blocks; running totals of the blocks' counts shift them."""
    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(F.col(order), F.lit("slot")), F.lit(blocks)))
    counts = dealt.groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select("shard", "_block", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("shard", "_block").orderBy(order, "size", "text_crc32")) - 1
    return dealt.withColumn("_local", local).join(shifts, ["shard", "_block"]).withColumn("slot", (F.col("_local") + F.col("_before")).cast("long")).drop("_block", "_local", "_before")


