"""From raw documents to packed training sequences: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import fmindex, lines, nearcopies, packing, quality
from strandline.llm.common import stored, table


def keeping_columns(stage):
    """stage, whose result has the columns of its documents, each with its own values under its own name."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"_column{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
        out = stage(spark, docs.select(*[F.col(f"`{c}`").alias(aside.get(c, c)) for c in docs.columns]), sf_dir)
        return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])

    return run


def with_words(docs: DataFrame) -> DataFrame:
    """Documents whose texts have changed, with their lengths; those without a word left are gone."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))


@keeping_columns
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(docs).where("kept")


@keeping_columns
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_words(lines.line_dedup(docs))


@keeping_columns
def minhash_neardup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.keep_one(docs)


@keeping_columns
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = fmindex.decontaminate(docs, table(spark, sf_dir, "benchmark"), with_text=True)
    return with_words(clean.withColumn("text", F.col("clean_text")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", minhash_neardup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: SQL has neither the tokenizer nor the sketches; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
