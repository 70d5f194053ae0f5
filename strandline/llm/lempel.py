"""Substring dedup by relative Lempel-Ziv parsing over words.

The reference is the corpus itself, cut into blocks by the leading words around sampled anchors (see `repeats`): a piece
of a document can only have a long factor in the block that its anchor belongs to, so that it is parsed against that
block and no other. A block is indexed by a suffix array over its words. The parse is greedy: a phrase is the longest run
of words with another occurrence in the block, a word without one is a literal, and the next phrase begins where the last
one ends. Phrases of `width` words or more are duplicate spans. What is left are repetitions across a boundary of two
phrases, which are looked up there (`ReferenceBlock.factors`). The words of all these factors are removed at all places.

Defined cases: a null text has no words; texts of fewer than `width` words keep all. Matches never cross documents, but
a document may repeat itself. Repeated rows, even with equal ids, repeat each other. Very long texts and words are
handled in chunks. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from strandline.llm.repeats import BASES, CHUNK, Method, coverage, mixed, powers, repeated_spans, runs

WIDTH = 35
BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_bounds(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of a UTF-8 text."""
    return runs(~BLANK[np.frombuffer(text, dtype=np.uint8)])


def symbols(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word."""
    starts, ends = word_bounds(text)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    data = np.frombuffer(text, dtype=np.uint8)[starts[0] :]
    starts, ends = starts - starts[0], ends - starts[0]
    place = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    value = (data.astype(np.uint64) + np.uint64(1)) * mixed(powers(BASES[1])[0][place % CHUNK])
    value[BLANK[data]] = 0
    return mixed(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64) * np.uint64(BASES[0]))


def cutter(text: bytes):
    """Words joined by one blank: buckets are chosen by the first bytes, which must be equal for equal words."""
    starts, ends = word_bounds(text)
    return lambda start, end: b" ".join(text[starts[start] : ends[end - 1]].split())


class ReferenceBlock:
    """A block of reference pieces under a suffix array over words; a suffix ends with its piece."""

    def __init__(self, pieces: list[bytes]):
        vocabulary: dict[bytes, int] = {}
        words = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in p.split()] for p in pieces]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        self.edge = np.concatenate([[0], np.cumsum(sizes)])
        self.ids = np.array([i for w in words for i in w], dtype=np.int64)
        n = len(self.ids)
        self.end = np.repeat(self.edge[1:], sizes)
        # Ranks of the first 1, 2, 4, ... words of all suffixes; 0 stands for the end of the piece.
        rank, have, levels = self.ids, 1, [self.ids]
        while have < sizes.max(initial=0):
            after = np.zeros(n, dtype=np.int64)
            inside = np.flatnonzero(np.arange(n) + have < self.end)
            after[inside] = rank[inside + have]
            rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)[1] + 1
            have *= 2
            levels.append(rank)
        order = np.argsort(rank, kind="stable")
        common = self.common(order[:-1], order[1:], levels)
        # The longest other occurrence of what begins at a place is at a neighbour in suffix order.
        length, source = np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int64)
        length[order[1:]], source[order[1:]] = common, order[:-1]
        better = common > length[order[:-1]]
        length[order[:-1][better]], source[order[:-1][better]] = common[better], order[1:][better]
        self.length, self.source = length.tolist(), source.tolist()

    def common(self, one: np.ndarray, two: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """How many words the suffixes at places `one` and `two` have in common."""
        most = np.minimum(self.end[one] - one, self.end[two] - two)
        n = np.zeros(len(one), dtype=np.int64)
        for k in range(len(levels) - 1, -1, -1):
            open_ = np.flatnonzero(n < most)
            same = open_[levels[k][one[open_] + n[open_]] == levels[k][two[open_] + n[open_]]]
            n[same] += 1 << k
        return np.minimum(n, most)

    def parse(self, piece: int) -> list[tuple[int, int, int]]:
        """The piece's greedy phrases (first word, source in the block, words), one after another without a gap.

        A phrase is the longest run of words with another occurrence in the block; a word without one is a literal, with
        source -1 and no words.
        """
        begin, stop = int(self.edge[piece]), int(self.edge[piece + 1])
        out, i = [], begin
        while i < stop:
            n = self.length[i]
            out.append((i - begin, self.source[i] if n else -1, n))
            i += n or 1
        return out

    def factors(self, piece: int, width: int) -> list[tuple[int, int, int]]:
        """(first word, source, words) of factors of `width` words or more that together hold every such repetition.

        They are the long phrases, and those found at boundaries: a phrase with the word after it occurs nowhere else, so
        that a repetition can cross one boundary, not two, and lies in the two phrases around it, less their first word.
        """
        begin = int(self.edge[piece])
        phrases = self.parse(piece)
        out = [p for p in phrases if p[2] >= width]
        for (i, _, n), (boundary, _, after) in zip(phrases, phrases[1:], strict=False):
            if after and n + after > width:
                for j in range(max(i + 1, boundary - width + 1), min(boundary, boundary + after - width + 1)):
                    if self.length[begin + j] >= width:
                        out.append((j, self.source[begin + j], self.length[begin + j]))
        return out


def matches(payloads: list[bytes], width: int) -> list[np.ndarray]:
    """For each piece the flags of the windows that its factors hold."""
    block = ReferenceBlock(payloads)
    flags = []
    for k in range(len(payloads)):
        flag = np.zeros(max(0, int(block.edge[k + 1] - block.edge[k]) - width + 1), dtype=bool)
        for start, _, n in block.factors(k, width):
            flag[start : start + n - width + 1] = True
        flags.append(flag)
    return flags


def lempel_ziv_dedup(docs: DataFrame, width: int = WIDTH, text: str = "text", doc: str = "doc_id", with_kept: bool = False, **options) -> DataFrame:
    """doc, n_words, n_removed, kept_sha256, spans of removed words, and with_kept the kept words joined by one blank."""

    def finish(body: bytes | None, spans: np.ndarray) -> tuple:
        words = (body or b"").split()
        gone = coverage(len(words), spans)
        a, b = runs(gone)
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if len(a) else b" ".join(words)
        out = (len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
        return (*out, kept.decode()) if with_kept else out

    method = Method(width, symbols, cutter, matches)
    schema = "n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept string" * with_kept
    return repeated_spans(docs, method, text, doc, finish, schema, **options)
