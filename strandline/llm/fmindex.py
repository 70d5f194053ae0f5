"""Benchmark decontamination with one FM-index for each shard of training documents.

A shard is a run of whole documents of one task, bounded in words. Its words become symbols: the number of the word in
the phrase vocabulary, or 0 for any other word. Words outside the vocabulary can be in no occurrence, so a run of them
is kept as one 0, which no phrase contains; runs of vocabulary words shorter than the shortest phrase go the same way.
Over what is left the shard builds a suffix array (by prefix doubling; every 0 is a symbol of its own there), its
Burrows-Wheeler transform, a wavelet tree whose bit vectors answer rank, and a sample of the suffix positions. All
phrases are searched backwards at once; their occurrences are located by walking to the next sampled position. The
spans are then merged document by document.

The phrases are a stated query set: they are read in blocks of bounded size, one after the other, and each block is
searched against all documents without a shuffle of texts.

Defined cases: a null text or one without words has no words, no hits and no items; an item without words has no
window and is never found; equal windows of several items count for each of them. Very long documents make a shard of
their own. Repeated rows are judged each. Without items nothing is hit. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import apart, small_batches

WIDTH = 10
#: Words of one shard.
SHARD_WORDS = 500_000
#: Items of one block of the query set, and bytes of text it may bring to the driver.
BLOCK_ITEMS = 20_000
SAMPLE = 8

BLOCK_BYTES = 32 << 20

#: Bytes of words become lower case, all other ASCII becomes a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


class WaveletTree:
    """rank and access over numbers below 2**levels: one bit vector with running counts a level."""

    def __init__(self, values: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        now = values
        for level in range(levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.int32)
            run = np.zeros(len(now) + 1, dtype=np.int32)
            np.cumsum(bit, out=run[1:])
            self.ones.append(run)
            self.zeros.append(len(now) - int(run[-1]))
            now = np.concatenate([now[bit == 0], now[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, at = np.zeros(len(symbol), dtype=np.int64), at.astype(np.int64)
        for depth in range(self.levels):
            run, zeros = self.ones[depth], self.zeros[depth]
            one = (symbol >> (self.levels - 1 - depth) & 1) == 1
            low = np.where(one, zeros + run[low], low - run[low])
            at = np.where(one, zeros + run[at], at - run[at])
        return at - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The numbers at these positions."""
        at, value = at.astype(np.int64), np.zeros(len(at), dtype=np.int64)
        for depth in range(self.levels):
            run, zeros = self.ones[depth], self.zeros[depth]
            one = run[at + 1] - run[at]
            value = value * 2 + one
            at = np.where(one == 1, zeros + run[at], at - run[at])
        return value


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order. Every 0 counts as a symbol of its own, smaller than all others and ordered by position."""
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + int(zero.sum()))
    have = 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        have *= 2
        if rank[order[-1]] == n - 1 or have >= n:
            return order


class FMIndex:
    """Backward search and locate over one shard's symbols; 0 separates, and the last symbol is 0."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        sa = suffix_array(symbols)
        before = symbols[sa - 1]
        self.n = len(symbols)
        self.tree = WaveletTree(before, max(1, int(sigma).bit_length()))
        self.start = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma + 1))])
        # A walk must not pass a separator, so that positions after one are all sampled.
        self.sampled = np.where((sa % SAMPLE == 0) | (before == 0), sa, -1)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of phrases (padded at the left), all at once, last word first."""
        low, high = np.zeros(len(phrases), dtype=np.int64), np.full(len(phrases), self.n, dtype=np.int64)
        width = phrases.shape[1]
        for k in range(width - 1, -1, -1):
            live = np.flatnonzero((width - k <= lengths) & (low < high))
            if len(live):
                s = phrases[live, k]
                low[live], high[live] = (self.start[s] + self.tree.rank(s, x[live]) for x in (low, high))
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: back through the transform until a sampled row."""
        at, found, steps = rows.astype(np.int64), np.full(len(rows), -1, dtype=np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            known = self.sampled[at]
            done = known >= 0
            found[live[done]] = known[done] + steps
            live, at = live[~done], at[~done]
            s = self.tree.access(at)
            at = self.start[s] + self.tree.rank(s, at)
            steps += 1
        return found


class Phrases:
    """The windows of one block of items, as rows of vocabulary numbers."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        windows: dict[tuple, set] = {}
        for item, text in items:
            ids = [number(w) for w in words_of(text.encode() if text is not None else None)]
            for k in range(max(1, len(ids) - width + 1)) if ids else ():
                windows.setdefault(tuple(ids[k : k + width]), set()).add(str(item))
        self.lengths = np.array([len(w) for w in windows], dtype=np.int64)
        self.rows = np.array([(0,) * (width - len(w)) + w for w in windows], dtype=np.int64).reshape(-1, width)
        self.items = [sorted(x) for x in windows.values()]

    @property
    def shortest(self) -> int:
        return int(self.lengths.min(initial=WIDTH))


def occurrences(ids: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(positions in ids, phrase numbers) of all occurrences; ids has a 0 wherever a word is unknown or a text ends."""
    known = np.concatenate([[False], ids > 0, [False]])
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    long = ends - starts >= phrases.shortest
    keep = np.zeros(len(ids) + 1, dtype=np.int32)
    keep[starts[long]], keep[ends[long]] = 1, -1
    inside = np.cumsum(keep) > 0
    inside[ends[long]] = True  # one separator after each run
    origin = np.flatnonzero(inside)
    if not len(origin):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    symbols = np.concatenate([ids, [0]])[origin]
    index = FMIndex(symbols, len(phrases.vocabulary))
    low, high = index.search(phrases.rows, phrases.lengths)
    which = np.flatnonzero(high > low)
    count = (high - low)[which]
    if not len(which):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    first = np.repeat(low[which] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    return origin[index.locate(first + np.arange(count.sum()))], np.repeat(which, count)


def spans_of(mask: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs [start, end) of a mask."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def search_shard(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, np.ndarray, set]]:
    """(words, hit mask, items) of each text of one shard."""
    get = phrases.vocabulary.get
    chunks, bounds = [], [0]
    for t in texts:
        ids = [get(w, 0) for w in words_of(t)]
        chunks.append(np.array([*ids, 0], dtype=np.int64))
        bounds.append(bounds[-1] + len(ids) + 1)
    ids = np.concatenate(chunks)
    at, which = occurrences(ids, phrases)
    marks = np.zeros(len(ids) + 1, dtype=np.int32)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + phrases.lengths[which], -1)
    hit = np.cumsum(marks[:-1]) > 0
    doc = np.searchsorted(bounds, at, side="right") - 1
    items: list[set] = [set() for _ in texts]
    for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
        items[d].update(phrases.items[p])
    return [(bounds[k + 1] - bounds[k] - 1, hit[bounds[k] : bounds[k + 1] - 1], items[k]) for k in range(len(texts))]


def shards(batches: Iterator[pd.DataFrame], most: int = SHARD_WORDS) -> Iterator[pd.DataFrame]:
    """Batches cut or joined to about `most` words (taken as six bytes each)."""
    held, size = [], 0
    for pdf in batches:
        start = 0
        lengths = pdf["_bytes"].map(lambda b: len(b) if b is not None else 0).to_numpy()
        for k, n in enumerate(lengths):
            if size and size + n > most * 6:
                held.append(pdf.iloc[start:k])
                yield pd.concat(held, ignore_index=True)
                held, size, start = [], 0, k
            size += n
        held.append(pdf.iloc[start:])
    if held and sum(map(len, held)):
        yield pd.concat(held, ignore_index=True)


def blocks_of(items: DataFrame, item: str, text: str, most_items: int, most_bytes: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in items.select(item, text).orderBy(item).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "")
        if len(held) >= most_items or size >= most_bytes:
            yield held
            held, size = [], 0
    yield held  # the last block may be empty


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """text without the words of the spans and what stands between words of one span."""
    clean = text.translate(TABLE)
    array = np.frombuffer(clean, dtype=np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate([[0], array.astype(np.int8), [0]])))
    starts, ends = edge[::2], edge[1::2]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : starts[a]])
        last = int(ends[b - 1])
    return b"".join([*out, text[last:]])


@apart
def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", most_items: int = BLOCK_ITEMS, with_text: bool = False) -> DataFrame:
    """docs (without the text) with n_words, n_hit, item_ids (sorted as strings) and spans (hit runs of words); with_text: and clean_text."""
    added = {"n_words", "n_hit", "item_ids", "spans", "clean_text"}
    left = [c for c in docs.columns if c != text and c not in added]
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in left)
    inner = f"{schema}_bytes binary, _hit binary, _items array<string>"
    found = f"{schema}n_words long, n_hit long, item_ids array<string>, spans array<struct<start: int, end: int>>, clean_text binary"
    df = small_batches(docs).select(*[F.col(f"`{c}`") for c in left], F.col(text).cast("binary").alias("_bytes"), F.lit(None).cast("binary").alias("_hit"), F.array().cast("array<string>").alias("_items"))

    def search(block: list[tuple], last: bool):
        """Adds the hits of one block of items; the last block's pass also writes the result."""
        phrases = Phrases(block)

        def run(batches):
            for pdf in shards(batches):
                out = []
                for b, old_hit, old_items, (n, hit, items) in zip(pdf["_bytes"], pdf["_hit"], pdf["_items"], search_shard(pdf["_bytes"].tolist(), phrases), strict=True):
                    if old_hit is not None:
                        hit = hit | np.unpackbits(np.frombuffer(old_hit, np.uint8), count=n).astype(bool)
                    names = sorted(items.union(old_items))
                    if last:
                        spans = spans_of(hit)
                        clean = (without(b, spans) if spans else b) if with_text else None
                        out.append((n, sum(y - x for x, y in spans), names, [{"start": x, "end": y} for x, y in spans], clean))
                    else:
                        out.append((b, np.packbits(hit).tobytes(), names))
                columns = ["n_words", "n_hit", "item_ids", "spans", "clean_text"] if last else ["_bytes", "_hit", "_items"]
                yield pd.concat([pdf.drop(columns=["_bytes", "_hit", "_items"]), pd.DataFrame(out, columns=columns, index=pdf.index)], axis=1)

        return run

    blocks = blocks_of(benchmark, item, item_text, most_items, BLOCK_BYTES)
    block = next(blocks)
    for following in blocks:
        df = df.mapInPandas(search(block, False), inner)
        block = following
    done = df.mapInPandas(search(block, True), found)
    return done.withColumn("clean_text", F.col("clean_text").cast("string")) if with_text else done.drop("clean_text")
