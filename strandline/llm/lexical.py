"""Ranked lexical search, exact, over a tiered index.

Building. Documents are taken where they lie, in shards of about BLOCK_BYTES of text; no text is shuffled. A shard lists,
for each of its terms, the documents that hold it and their impact (how much one unit of the term's weight adds to their
score), highest impacts first. The list is cut into tiers: the first holds an eighth of it (short lists whole), the second
goes up to a half, the third has the rest. Each piece knows its residual bound, the highest impact that the tiers below
still hold. Tiers are folders of one table, so that a search that needs no low tier does not read it.

Searching. One pass over the first tier gives, for each item, the k highest sums that are already certain; the last of
them, over all shards, is a score that every result must reach. A second pass then asks in each shard whether the first
tier proves the item's result: no document can reach that score, by what was found and the residual bounds of what was
not, but those whose sums are complete. Where the proof fails, the item falls through to the next tier, in that shard
alone, and last to the whole lists, where sums are always complete. So results are exact whatever the tiers are.

The impact of a term in a document is (10**9 * tf) div (1000 * tf + 12 * m), with m = 75 + (25 * n * N) div L; its weight is
floor(1000 * ln((2 * N + 2) / (2 * df + 1))). N counts documents with a term, L all their terms, n a document's.

Defined cases: a null text has no terms. A null id sorts before all others. Repeated documents are ranked each, and so are
repeated items. An item without terms, or without a document that scores above 0, has no row. An empty table on either
side gives an empty result. Further columns of both tables are not read.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import blocks_for, cut, with_checkpoints

#: A shard's bytes of text and its documents, at most (one longer document is a shard of its own).
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 16_384
#: A tier ends after list length div PARTS postings, or after LEAST if that is more; the last tier has no end.
PARTS, LEAST = (8, 2), 32
#: Items that are searched at once.
ITEM_BLOCK = 2_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SPACE = 32
#: Bytes outside terms become blanks, A-Z become a-z.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else SPACE for b in range(256))
CATALOGUE = -1


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass(frozen=True)
class Index:
    """A stored index: rows of (shard, tier, term, df, residual, postings, ids), and the corpus's two counts."""

    path: str
    table: DataFrame
    n_docs: int
    n_terms: int
    tiers: int
    id_type: str


def shard_of(texts: list[bytes], n_docs: int, n_terms: int, parts: tuple[int, ...] = PARTS, least: int = LEAST) -> dict[str, pa.Array]:
    """The pieces of one shard's lists: tier, term, df (in the first piece of a term, else 0), residual, postings.

    A posting is one 64-bit number: the document's place in the shard, then 32 bits of impact.
    """
    folded = np.frombuffer(b" ".join(texts).translate(FOLD), dtype=np.uint8)
    starts_of = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])[: len(texts)]
    inside = folded != SPACE
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
    starts, ends = edges[0::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(folded[inside])]).dictionary_encode()
    doc = np.searchsorted(starts_of, starts, side="right") - 1
    n = np.bincount(doc, minlength=len(texts)).astype(np.int64)
    m = 75 + (25 * n * n_docs) // n_terms
    pairs, tf = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(texts) + doc, return_counts=True)
    term, row = np.divmod(pairs, len(texts))
    impact = impacts(tf.astype(np.int64), m[row])
    order = np.lexsort((row, -impact, term))
    term, row, impact = term[order], row[order], impact[order]
    df = np.bincount(term, minlength=len(words.dictionary))
    rank = np.arange(len(term)) - (np.cumsum(df) - df)[term]
    tier = np.zeros(len(term), dtype=np.int32)
    for part in parts:
        tier += rank >= np.maximum(-(-df // part), least)[term]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(term) != 0) | (np.diff(tier) != 0)])) if len(term) else np.zeros(0, dtype=np.int64)
    after = np.append(first[1:], len(term))
    goes_on = (after < len(term)) & (np.append(term, -1)[after] == term[first])
    residual = np.where(goes_on, np.append(impact, 0)[after], 0)
    packed = (row.astype(np.int64) << 32) | impact
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(np.append(first, len(term)).astype(np.int64) * 8), pa.py_buffer(packed)])
    return {
        "tier": pa.array(tier[first]),
        "term": words.dictionary.take(pa.array(term[first])).cast(pa.binary()),
        "df": pa.array(np.where(tier[first] == 0, df[term[first]], 0).astype(np.int32)),
        "residual": pa.array(residual.astype(np.int32)),
        "postings": pieces.cast(pa.binary()),
    }


def build_index(docs: DataFrame, text: str = "text", doc: str = "doc_id", parts: tuple[int, ...] = PARTS, least: int = LEAST, block_bytes: int = BLOCK_BYTES, block_docs: int = BLOCK_DOCS) -> Index:
    """Index every document's whole text, and store the index in the shared checkpoint folder."""
    spark = with_checkpoints(docs.sparkSession)
    kind = docs.schema[doc].dataType.simpleString()
    n_words = F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(TERM)), F.lit(0))
    counts = docs.select(n_words.alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = counts["docs"], max(1, counts["terms"])

    def run(batches: Iterator[pa.RecordBatch]):
        here, number = TaskContext.get().partitionId(), 0
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def shard() -> Iterator[pa.RecordBatch]:
            pieces = shard_of(texts, n_docs, n_terms, parts, least)
            n = len(pieces["tier"])
            name = here << 32 | number
            none = pa.nulls(n, pa.list_(id_kind))
            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(n, name)), **pieces, "ids": none})
            yield pa.RecordBatch.from_pydict({
                "shard": pa.array([name], pa.int64()), "tier": pa.array([CATALOGUE], pa.int32()), "term": pa.array([b""], pa.binary()), "df": pa.array([0], pa.int32()),
                "residual": pa.array([0], pa.int32()), "postings": pa.array([b""], pa.binary()), "ids": pa.array([ids], pa.list_(id_kind)),
            })

        id_kind = pa.int64()
        for batch in batches:
            id_kind = batch.column("_id").type
            for i, t in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= block_bytes or len(ids) >= block_docs:
                    yield from shard()
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield from shard()

    rows = docs.select(F.col(f"`{doc}`").alias("_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"))
    pieces = rows.mapInArrow(run, f"shard long, tier int, term binary, df int, residual int, postings binary, ids array<{kind}>")
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/index-{uuid.uuid4().hex}"
    pieces.write.partitionBy("tier").option("compression", "zstd").parquet(path)
    table = spark.read.schema(f"shard long, term binary, df int, residual int, postings binary, ids array<{kind}>, tier int").parquet(path)
    return Index(path, table, n_docs, n_terms, len(parts) + 1, kind)


@dataclass
class Sums:
    """What a shard knows of an item's scores: certain parts, and bounds with what lower tiers may add."""

    certain: np.ndarray
    bound: np.ndarray


def sums_of(pieces: dict[bytes, list[tuple[int, int, bytes]]], query: list[tuple[bytes, int]], n: int) -> Sums:
    certain, open_ = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    rest = 0
    for term, weight in query:
        own = pieces.get(term)
        if not own:
            continue
        left = weight * max(own)[1]  # of the lowest tier at hand
        rest += left
        for _, _, packed in own:
            postings = np.frombuffer(packed, dtype=np.int64)
            rows = postings >> 32
            certain[rows] += weight * (postings & 0xFFFFFFFF)
            open_[rows] -= left
    return Sums(certain, certain + open_ + rest)


def pieces_of(table: pa.Table) -> tuple[dict[bytes, list[tuple[int, int, bytes]]], list]:
    """(pieces by term as (tier, residual, postings), ids of the documents) of one shard."""
    found: dict[bytes, list[tuple[int, int, bytes]]] = {}
    ids: list = []
    for tier, term, residual, postings, own in zip(*(table.column(c).to_pylist() for c in ("tier", "term", "residual", "postings", "ids")), strict=True):
        if tier == CATALOGUE:
            ids = own
        else:
            found.setdefault(term, []).append((tier, residual, postings))
    return found, ids


Queries = dict[int, list[tuple[bytes, int]]]


def certain_sums(rows: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, score): of each shard and item the k highest certain sums above 0."""

    def run(table: pa.Table) -> pa.Table:
        pieces, ids = pieces_of(table)
        items, scores = [], []
        for item, query in queries.items():
            certain = sums_of(pieces, query, len(ids)).certain
            best = np.sort(certain[certain > 0])[::-1][:k]
            items.append(np.full(len(best), item))
            scores.append(best)
        return pa.table({"item": pa.array(np.concatenate(items).astype(np.int32)), "score": pa.array(np.concatenate(scores).astype(np.int64))})

    return rows.groupBy("shard").applyInArrow(run, "item int, score long")


def judged(rows: DataFrame, open_: DataFrame | None, queries: Queries, least: dict[int, int], k: int, kind: str) -> DataFrame:
    """(shard, item, id, score, proven): for each open shard and item the documents of its proven result, or one row that it is open."""

    def run(table: pa.Table, of: list[int]) -> pa.Table:
        pieces, ids = pieces_of(table)
        shard = table.column("shard")[0].as_py()
        out = []
        for item in of:
            sums = sums_of(pieces, queries[item], len(ids))
            may = np.flatnonzero(sums.bound >= max(1, least.get(item, 0)))
            if not (sums.bound[may] == sums.certain[may]).all():
                out.append((shard, item, None, None, False))
                continue
            scores = sums.certain[may]
            if len(may) > k:
                last = np.partition(scores, -k)[-k]
                may, scores = may[scores >= last], scores[scores >= last]
            best = sorted(((-s, ids[i] is not None, ids[i]) for i, s in zip(may.tolist(), scores.tolist(), strict=True)), key=lambda x: x[:2] + (x[2:] if x[1] else ()))[:k]
            out += [(shard, item, i, -s, True) for s, _, i in best]
        columns = list(zip(*out, strict=True)) if out else [()] * 5
        id_kind = table.schema.field("ids").type.value_type
        return pa.table(dict(zip(("shard", "item", "id", "score", "proven"), (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), id_kind, pa.int64(), pa.bool_()), strict=True)), strict=True)))

    schema = f"shard long, item int, id {kind}, score long, proven boolean"
    if open_ is None:
        return rows.groupBy("shard").applyInArrow(lambda table: run(table, list(queries)), schema)
    return rows.groupBy("shard").cogroup(open_.groupBy("shard")).applyInArrow(lambda table, own: run(table, own.column("item").to_pylist()), schema)


def search_block(index: Index, items: list[tuple[object, list[bytes]]], k: int) -> DataFrame:
    """(number, id, score, rank) of one block of items; number is the item's place in the block."""
    spark = index.table.sparkSession

    def listed(terms: set[bytes]) -> DataFrame:
        """A block's terms: as many as its items have."""
        return F.broadcast(spark.createDataFrame([(bytearray(t),) for t in sorted(terms)], "term binary"))

    def rows(tier: int, terms: set[bytes]) -> DataFrame:
        lists = index.table.where(F.col("tier").between(0, tier)).join(listed(terms), "term", "left_semi").select("shard", "tier", "term", "residual", "postings", "ids")
        return lists.unionByName(index.table.where(F.col("tier") == CATALOGUE).select(*lists.columns))

    words = {t for _, terms in items for t in terms}
    counted = index.table.where("tier = 0").select("term", "df").join(listed(words), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = {bytes(r.term): math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * r.df + 1))) for r in counted}
    queries: Queries = {}
    for number, (_, terms) in enumerate(items):
        query = [(t, n * weight[t]) for t, n in Counter(terms).items() if weight.get(t)]
        if query:
            queries[number] = query
    found = spark.createDataFrame([], f"item int, id {index.id_type}, score long")
    if queries:
        words = {t for query in queries.values() for t, _ in query}
        best = Window.partitionBy("item").orderBy(F.desc("score"))
        top = certain_sums(rows(0, words), queries, k).withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)
        least = {r.item: r.score for r in top.where(F.col("place") == k).select("item", "score").collect()}
        open_: DataFrame | None = None
        for tier in range(index.tiers):
            lists = rows(tier, words)
            if open_ is not None:
                lists = lists.join(open_.select("shard").distinct(), "shard", "left_semi")
            verdict = cut(judged(lists, open_, queries, least, k, index.id_type))
            found = found.unionByName(verdict.where("proven").select("item", "id", "score"))
            open_ = verdict.where("NOT proven").select("shard", "item")
            still = {r.item for r in open_.select("item").distinct().collect()}
            if not still:
                break
            words = {t for item in still for t, _ in queries[item]}
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 20, text: str = "text", item: str = "item_id", item_block: int = ITEM_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item, equal scores by ascending id."""
    spark, kind = items.sparkSession, items.schema[item].dataType.simpleString()
    own = items.select(F.col(f"`{item}`").alias("name"), F.col(f"`{text}`").alias("words"))
    blocks = blocks_for(own.count(), item_block)
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id {index.id_type}, score long")
    for block in range(blocks):
        rows = [(r.name, terms_of(r.words)) for r in own.where(F.pmod(F.xxhash64("name", "words"), F.lit(blocks)) == block).collect()]
        names = F.broadcast(spark.createDataFrame([(k, name) for k, (name, _) in enumerate(rows)], f"item int, item_id {kind}"))
        out = out.unionByName(search_block(index, rows, k).join(names, "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score"))
    return out
