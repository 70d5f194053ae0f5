"""Best-fit packing of tokenised documents into fixed-length training sequences.

Every piece is a vector (tokens, documents, attention cost = tokens squared) and every sequence has a capacity in each
dimension. Pieces are taken longest first; among the open sequences that still satisfy every constraint, the one with
the highest weighted dot product of piece and residual ("dot"), or with the smallest weighted norm of what would be
left ("norm"), gets the piece.

Only a document longer than a sequence is cut: into full pieces, the first of which may be shorter. A full piece fills
a sequence of its own. All others are dealt by hash into blocks of bounded size that are packed apart; the blocks hold
equal mixes of lengths, so that the loss against one packer for all is a few sequences a block.

Defined cases: a null text counts as empty; every document ends with the end id, so that an empty one is one piece of
one id. Repeated rows and equal ids are packed as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import blocks_for, cut, small_batches

#: Pieces that one block packs.
BLOCK_PIECES = 16_000
#: Beyond these characters the two tokenizer libraries' character classes may differ, and the slower one is asked.
PLAIN = re.compile(r"[^\x00-\x1b\x20-\x7e\xa1-ɏ]|<\|")


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold, and the weight of each dimension in the fit."""

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.2)
    fit: str = "norm"

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], dtype=float)


@lru_cache(maxsize=2)
def tokenizer(json_file: str, ranks_file: str) -> Callable[[str], list[int]]:
    """Ids as the `tokenizers` file gives them; texts of plain characters go through the same vocabulary in tiktoken, which is five times faster."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    @lru_cache(maxsize=1)
    def slow() -> Tokenizer:
        return Tokenizer.from_file(json_file)

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if PLAIN.search(text):
            return slow().encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def public_files() -> tuple[str, str]:
    """Places of the vocabulary in the two libraries' formats, on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def cut_points(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first may be shorter."""
    first = n % most or most
    return [(0, min(first, n))] + [(s, most) for s in range(first, n, most)]


def pieces(docs: DataFrame, most: int, text: str = "text", doc: str = "doc_id", end_id: int = 2, files: Callable[[], tuple[str, str]] = public_files) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32) of every document."""

    def run(batches: Iterator[pd.DataFrame]):
        encode = tokenizer(*files())
        for pdf in batches:
            out = []
            for d, t in zip(pdf["_doc"], pdf["_text"], strict=True):
                ids = np.array([*encode(t or ""), end_id], dtype="<u4")
                out += [(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut_points(len(ids), most))]
            yield pd.DataFrame(out, columns=["_doc", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[doc].dataType.simpleString()
    return small_batches(docs).select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).mapInPandas(run, f"_doc {kind}, piece int, start long, length long, ids_crc32 long").withColumnRenamed("_doc", doc)


def pack_vectors(vectors: np.ndarray, capacity: np.ndarray, weights: np.ndarray, fit: str = "norm") -> np.ndarray:
    """Sequence number of each vector (in the given order). A vector beyond a capacity gets a sequence of its own.

    Sequences with equal residuals are interchangeable, so that open ones are kept as a table of distinct residuals.
    """
    scaled = weights / capacity**2
    chosen = np.zeros(len(vectors), dtype=np.int64)
    room = np.empty((1024, vectors.shape[1] if len(vectors) else 3))
    bins: list[list[int]] = []  # open sequences with this residual
    where: dict[tuple, int] = {}
    used = made = 0

    def put(left: np.ndarray, number: int) -> None:
        nonlocal room, used
        key = tuple(left)
        k = where.get(key)
        if k is None:
            if used == len(room):
                room = np.concatenate([room, np.empty_like(room)])
            k = where[key] = used
            room[k] = left
            bins.append([])
            used += 1
        bins[k].append(number)

    def drop(k: int) -> None:
        nonlocal used
        used -= 1
        del where[tuple(room[k])]
        if k != used:
            room[k], bins[k] = room[used], bins[used]
            where[tuple(room[k])] = k
        bins.pop()

    for i, v in enumerate(vectors):
        open_ = room[:used]
        after = open_ - v
        ok = (after >= 0).all(axis=1)
        if ok.any():
            score = (open_ @ (scaled * v)) if fit == "dot" else -(after * after) @ scaled
            k = int(np.argmax(np.where(ok, score, -np.inf)))
            number, left = bins[k].pop(), after[k].copy()
            if not bins[k]:
                drop(k)
        else:
            number, left = made, capacity - v
            made += 1
        chosen[i] = number
        if (left > 0).all():
            put(left, number)
    return chosen


def best_fit(found: DataFrame, capacity: Capacity, doc: str = "doc_id", block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """found (rows of `pieces`) with sequence_id and offset (the place in the sequence, gapless from 0)."""
    found = cut(found)
    n = found.where(F.col("length") < capacity.tokens).count()
    blocks = blocks_for(n, block_pieces)
    limits, weights = capacity.vector(), np.array(capacity.weights, dtype=float)
    full = found.where(F.col("length") >= capacity.tokens)
    rest = found.where(F.col("length") < capacity.tokens).withColumn("_block", F.pmod(F.xxhash64(doc, "piece", "start", "ids_crc32"), F.lit(blocks)))

    def pack(key, pdf):
        pdf = pdf.sort_values(["length", doc, "piece"], ascending=[False, True, True], kind="stable")
        size = pdf["length"].to_numpy(dtype=float)
        number = pack_vectors(np.stack([size, np.ones_like(size), size * size], axis=1), limits, weights, capacity.fit)
        place = pdf.assign(sequence_id=number)
        place["offset"] = (place.groupby("sequence_id")["length"].cumsum() - place["length"]).astype("int64")
        # Even numbers are these, odd ones the full pieces; a block never has 2**31 pieces.
        place["sequence_id"] = (int(key[0]) << 32 | place["sequence_id"]) * 2
        return place.drop(columns="_block")

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema) + ", sequence_id long, offset long"
    packed = rest.groupBy("_block").applyInPandas(pack, schema)
    alone = full.withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(alone)


def pack_documents(docs: DataFrame, capacity: Capacity = Capacity(), text: str = "text", doc: str = "doc_id", end_id: int = 2) -> DataFrame:
    return best_fit(pieces(docs, capacity.tokens, text, doc, end_id), capacity, doc)
