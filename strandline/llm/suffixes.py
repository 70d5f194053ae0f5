"""Substring dedup with a sampled suffix array.

Which suffixes can have a twin is found by anchors (see `repeats`); only suffixes at the edges of repeated passages have
to be ordered. Sampled splitters over their leading bytes range-partition them; as a splitter never divides equal
leading bytes, neighbours on either side of a boundary differ within these bytes and need no further comparison. Each
bucket sorts its suffixes by multikey quicksort, eight bytes a step, and neighbours that agree in `width` bytes are
repeated. Every byte that a repeated window covers is removed, at all its places.

Defined cases: a null text is empty: no bytes, no spans, the digest of nothing. Texts shorter than `width` keep all.
Matches never cross documents, but a document may repeat itself. Repeated rows, even with equal ids, repeat each other.
Very long texts are handled in overlapping chunks. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from strandline.llm.repeats import Method, coverage, repeated_spans, runs

WIDTH = 200


def symbols(text: bytes) -> np.ndarray:
    return np.frombuffer(text, dtype=np.uint8)  # widened chunk by chunk


def cutter(text: bytes):
    return lambda start, end: text[start:end]


def multikey_groups(data: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): suffixes at `starts` ordered by their first `width` bytes, as far as ties go on; suffixes that
    differ from all others are left out, and equal ones have equal group numbers.

    Multikey quicksort for all groups of ties at once: each step looks at the next eight bytes of the suffixes that are
    still tied; groups whose members all agree are not sorted.
    """
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)

    def word(at: np.ndarray, size: int) -> np.ndarray:
        w = np.ascontiguousarray(words[at]).view(">u8").ravel().astype(np.uint64)
        return w if size == 8 else w >> np.uint64(8 * (8 - size))

    order, group = np.arange(len(starts)), np.zeros(len(starts), dtype=np.int64)
    for depth in range(0, width, 8):
        if not len(order):
            break
        key = word(starts[order] + depth, min(8, width - depth))
        head = np.concatenate([[True], group[1:] != group[:-1]])
        first = key[np.flatnonzero(head)][np.cumsum(head) - 1]
        differs = np.zeros(int(group.max()) + 1, dtype=bool)
        differs[group[key != first]] = True
        todo = differs[group]
        if todo.any():
            sub = np.flatnonzero(todo)
            by = np.lexsort((key[sub], group[sub]))
            order[sub], key[sub] = order[sub][by], key[sub][by]
            fresh = head | np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(fresh) - 1
            tied = np.bincount(group)[group] > 1
            order, group = order[tied], group[tied]
            if len(group):
                group = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1
    return order, group


def matches(payloads: list[bytes], width: int) -> list[np.ndarray]:
    """For each payload, which of its windows occur again among all payloads' windows."""
    sizes = np.array([len(p) for p in payloads], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)])
    counts = np.maximum(sizes - width + 1, 0)
    edge = np.concatenate([[0], np.cumsum(counts)])
    starts = np.arange(edge[-1]) + np.repeat(base[:-1] - edge[:-1], counts)
    order, _ = multikey_groups(np.frombuffer(b"".join(payloads), dtype=np.uint8), starts, width)
    flags = np.zeros(edge[-1], dtype=bool)
    flags[order] = True
    return [flags[edge[k] : edge[k + 1]] for k in range(len(payloads))]


def substring_dedup(docs: DataFrame, width: int = WIDTH, text: str = "text", doc: str = "doc_id", with_kept: bool = False, **options) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans, kept_sha256, spans of removed bytes, and with_kept the remaining bytes."""

    def finish(body: bytes | None, spans: np.ndarray) -> tuple:
        data = np.frombuffer(body or b"", dtype=np.uint8)
        gone = coverage(len(data), spans)
        a, b = runs(gone)
        kept = data[~gone].tobytes()
        out = (len(data), int(gone.sum()), len(a), hashlib.sha256(kept).hexdigest(), [{"start": int(x), "end": int(y)} for x, y in zip(a, b, strict=True)])
        return (*out, kept) if with_kept else out

    method = Method(width, symbols, cutter, matches)
    schema = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>" + ", kept binary" * with_kept
    return repeated_spans(docs, method, text, doc, finish, schema, **options)
