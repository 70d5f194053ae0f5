"""Line dedup by winnowing over line hashes.

Lines with a word are numbered in a document; each has a 64-bit hash. At every line begins a window: the fewest lines that
hold `words` words, or `run` lines if these hold fewer. So a window depends on its own lines alone, and every repeated run of
`run` lines, and every shorter one of `words` words, has whole windows. In each window the smallest hash is selected (the
leftmost of equal ones), so that two equal windows are guaranteed to share a fingerprint at the same place. Only
fingerprints travel: the place, the hashes of the `run - 1` lines on either side, and which of the windows around it have
selected it. Fingerprints that occur once are dropped by a partially aggregated count. The others' places are joined, and a
match is extended both ways over these neighbours: every window of a fingerprint whose lines all agree is a match, and
longer runs go on at the next fingerprint. Of equal windows the first place in the corpus stays, and every line of the
later ones is deleted. "Earlier" is by document id, then by line. Fingerprints and windows that very many documents have are
joined by broadcast (`joined`), as there can only be few.

Defined cases: a null or blank text has no lines and stays as it is. Lines without a word are never deleted. Repeated runs
of fewer lines than `run` and fewer words than `words` stay. Rows with the same id and the same text have the same
places and delete nothing of each other; with the same id and other texts the text's hash decides. A null id comes
before all others. Windows overlap in a document that repeats itself. Extra columns pass through. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import apart, cut, joined, small_batches

#: Lines of a window at most (up to 7), and words that fewer lines must hold.
RUN, WORDS = 3, 20


def numbered(text: bytes | None) -> list[bytes]:
    """Lines with a word."""
    return [x for x in (text or b"").split(b"\n") if x.strip()]


def window_sizes(words: np.ndarray, run: int, least: int) -> np.ndarray:
    """For each line the lines of the window that begins there: as many as hold `least` words, at most `run`; 0 if the text
    ends before."""
    before = np.concatenate([[0], np.cumsum(words)])
    start = np.arange(len(words))
    size = np.minimum(np.searchsorted(before, before[:-1] + least) - start, run)
    return np.where(start + size <= len(words), size, 0)


def selected(hashes: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each window, by its size, the place of its fingerprint: the leftmost smallest hash."""
    pick = np.arange(len(hashes))
    for k in range(1, int(size.max(initial=0))):
        # Windows of more than k lines: is the line k places on smaller than the one picked so far?
        wide = np.flatnonzero(size > k)
        wide = wide[hashes[wide + k] < hashes[pick[wide]]]
        pick[wide] = wide + k
    return pick


def fingerprints(docs: DataFrame, text: str, doc: str, run: int, least: int) -> DataFrame:
    """(_doc, h, line, mark, around, chosen): every selected line, the hashes of it and its run - 1 neighbours on either side
    (0 beyond the text), and a bit for each window that selected it: bit run * (size - 1) + run - 1 - (lines before it)."""
    kind = docs.schema[doc].dataType.simpleString()

    def emit(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            at, marks, around, chosen, counts, keep = [], [], [], [], [], []
            for place, t in enumerate(pdf["_text"]):
                lines = numbered(t)
                size = window_sizes(np.array([len(x.split()) for x in lines], dtype=np.int64), run, least)
                start = np.flatnonzero(size)
                if not len(start):
                    continue
                each = np.array([xxhash.xxh3_64_intdigest(x) for x in lines], dtype=np.uint64)
                pick = selected(each, size)[start]
                lines_at = np.unique(pick)
                bits = np.zeros(len(each), dtype=np.int64)
                np.bitwise_or.at(bits, pick, np.left_shift(1, run * (size[start] - 1) + run - 1 - (pick - start)))
                padded = np.concatenate([np.zeros(run - 1, dtype=np.uint64), each, np.zeros(run - 1, dtype=np.uint64)])
                at.append(lines_at)
                marks.append(each[lines_at])
                around.append(np.lib.stride_tricks.sliding_window_view(padded, 2 * run - 1)[lines_at])
                chosen.append(bits[lines_at])
                counts.append(len(lines_at))
                keep.append(place)
            if at:
                rows = pdf[["_doc", "h"]].iloc[np.repeat(keep, counts)].reset_index(drop=True)
                yield rows.assign(line=np.concatenate(at).astype(np.int32), mark=np.concatenate(marks).view(np.int64), around=list(np.concatenate(around).view(np.int64)), chosen=np.concatenate(chosen))

    source = small_batches(docs).select(F.col(doc).alias("_doc"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("_text"))
    return source.mapInPandas(emit, f"_doc {kind}, h long, line int, mark long, around array<long>, chosen long")


def later_windows(docs: DataFrame, text: str, doc: str, run: int, least: int) -> DataFrame:
    """(_doc, h, lines): the lines of windows that occur earlier."""
    found = cut(fingerprints(docs, text, doc, run, least))
    marks = found.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1")
    met = joined(found, marks, ["mark"])
    # The windows of a fingerprint, as far as they have selected it: their first line, and their lines' hashes.
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(run * run - 1)), lambda k: F.call_function("shiftright", F.col("chosen"), k).bitwiseAND(F.lit(1)) == 1))
    windows = met.select("_doc", "h", "line", "around", bit.alias("bit")).withColumn("k", F.col("bit") % run).withColumn("size", F.expr(f"bit div {run} + 1").cast("int"))
    windows = cut(windows.select("_doc", "h", (F.col("line") + F.col("k") - (run - 1)).alias("line"), F.slice("around", F.col("k") + 1, F.col("size")).alias("lines")))
    place = F.struct("_doc", "h", "line")
    first = windows.groupBy("lines").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = joined(windows, first, ["lines"]).where(place > F.col("first"))
    # At most `run` numbers for each of the document's lines.
    each = F.sequence(F.col("line"), F.col("line") + F.size("lines") - 1)
    return later.groupBy("_doc", "h").agg(F.flatten(F.collect_set(each)).alias("lines"))


@apart
def line_dedup(docs: DataFrame, run: int = RUN, words: int = WORDS, text: str = "text", doc: str = "doc_id") -> DataFrame:
    """docs with the text replaced by what is kept, and n_lines, n_removed, n_spans, kept_sha256."""
    added = {"n_lines", "n_removed", "n_spans", "kept_sha256"}
    carried = [c for c in docs.columns if c not in added]
    places = later_windows(docs.select(doc, text), text, doc, run, words)
    hashed = docs.select(*[F.col(f"`{c}`") for c in carried], F.xxhash64(text).alias("_h"))
    placed = hashed.join(places.select(F.col("_doc"), F.col("h").alias("_p"), F.col("lines").alias("_lines")), F.col(f"`{doc}`").eqNullSafe(F.col("_doc")) & (F.col("_h") == F.col("_p")), "left").drop("_doc", "_p", "_h")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carried)

    def delete(batches):
        for pdf in batches:
            out = [kept(t, lines) for t, lines in zip(pdf[text], pdf["_lines"], strict=True)]
            pdf = pdf.drop(columns="_lines")
            for k, name in enumerate([text, "n_lines", "n_removed", "n_spans", "kept_sha256"]):
                pdf[name] = [x[k] for x in out]
            yield pdf

    return placed.mapInPandas(delete, f"{schema}, n_lines long, n_removed long, n_spans long, kept_sha256 string")


def kept(text: str | None, places) -> tuple[str | None, int, int, int, str]:
    """(text, lines with a word, deleted ones, runs of them, digest) after deleting the lines at `places`."""
    lines = (text or "").split("\n")
    worded = [k for k, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
    gone = np.zeros(len(worded), dtype=bool)
    if places is not None:
        gone[places] = True
    if gone.any():
        dead = {worded[k] for k in np.flatnonzero(gone)}
        text = "\n".join([x for k, x in enumerate(lines) if k not in dead])
    spans = int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum())
    return text, len(worded), int(gone.sum()), spans, hashlib.sha256((text or "").encode()).hexdigest()
