"""Which fixed-length windows of symbols occur more than once in a corpus, without sending every window.

Symbols are bytes (substring dedup) or words (Lempel-Ziv dedup); a window is `width` symbols of one document. Anchors
select what can be repeated; the operator's own exact method (`Method.matches`: suffix sort or Lempel-Ziv parse) decides.

1. *Anchors.* In the middle of every window the position with the smallest hash is the window's anchor (winnowing).
   The choice depends on the window alone, so that equal windows have equal anchors at equal offsets. Windows that
   follow each other mostly share their anchor; such a run is one *entry*: document, first window, number of windows,
   a hash of the anchor's surroundings that all windows of any entry with this anchor contain (the core), and an
   independent hash of the whole run with the anchor's place in it (the full).
2. *Candidates.* Entries meet by core. A core that occurs once has no repeated window and goes no further. Entries with
   the same core and full look alike: they are one class, of which two members are sent and all others wait for the
   verdict. Any other entry whose core occurs again is sent itself. Of a core with more than `hot` fulls (a passage that a
   large part of all documents embeds) only windows whose hashes occur again are sent, as classes of their own.
3. *Verdicts.* What is sent is range-partitioned by sampled splitters over leading symbols, and the exact method says in
   each bucket which windows occur again. A class's verdict goes to all its members.
4. *Documents.* The spans come back to the documents' blocks, and are merged there.

Documents are dealt into blocks by a hash of their id, and stored once as a table that is bucketed by block: all steps read
them where they lie, and texts are shuffled once. Entries travel as packed arrays, one binary value for a pair of block
and bucket. No step gathers more in a task than a block of documents or a bucket of entries, and both are sized by bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import blocks_for, bucketed, cut

U = np.uint64
#: Symbols of one chunk that is hashed at once; positions take the low bits of the anchors' order.
CHUNK_BITS = 20
CHUNK = 1 << CHUNK_BITS
#: Bytes of text in one block, and edge records in one bucket.
BLOCK_BYTES = 6 << 20
BUCKET_RECORDS = 8_000
#: Fulls of one core beyond which its windows are counted one by one.
HOT = 1_500
#: Windows in one bucket of those counted one by one.
BUCKET_WINDOWS = 20_000
#: Cores whose leading symbols are sampled for the splitters.
SPLITTER_SAMPLE = 50_000

ENTRY = np.dtype([("core", "<u8"), ("full", "<u8"), ("doc", "<i4"), ("at", "<u4"), ("offset", "<u2"), ("more", "<u2")])
SPAN = np.dtype([("doc", "<i4"), ("start", "<u4"), ("end", "<u4")])
#: One window of a hot core, and a place that waits for a class's verdict.
WINDOW = np.dtype([("core", "<u8"), ("h", "<u8"), ("doc", "<i4"), ("at", "<u4")])
MEMBER = np.dtype([("id", "<u8"), ("block", "<i4"), ("doc", "<i4"), ("at", "<u4")])
VERDICT = np.dtype([("id", "<u8"), ("start", "<u4"), ("end", "<u4")])
#: What is sent: role SELF speaks for itself, FIRST for its class, SECOND only lets FIRST be found; `own` ones are dealt by
#: their first symbols and not by those around the anchor.
SENT = np.dtype([("core", "<u8"), ("id", "<u8"), ("meet", "<i4"), ("doc", "<i4"), ("at", "<u4"), ("offset", "<u2"), ("more", "<u2"), ("role", "u1"), ("own", "u1")])
SELF, FIRST, SECOND = 0, 1, 2


@lru_cache(maxsize=2)
def powers(base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 2**64)):
        p = np.full(CHUNK + 1, b, dtype=U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xFF51AFD7ED558CCD)
    return x ^ (x >> U(29))


class Hasher:
    """Hashes of any range of a chunk's symbols in constant time each."""

    def __init__(self, symbols: np.ndarray, base: int):
        power, self.inverse = powers(base)
        self.sums = np.zeros(len(symbols) + 1, dtype=U)
        # Bytes are looked up in a table of 256 hashes.
        values = mixed(np.arange(256, dtype=U) + U(base >> 8))[symbols] if symbols.dtype == np.uint8 else mixed(symbols + U(base >> 8))
        np.cumsum(values * power[: len(symbols)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i that fits."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, dtype=U)
    padded[:n] = x
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    back = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


@dataclass(frozen=True)
class Geometry:
    """Anchors of a window at p lie in [p + margin, p + width - margin]; the core is `margin` symbols on either side."""

    width: int

    @property
    def margin(self) -> int:
        return max(1, self.width * 24 // 100)

    @property
    def region(self) -> int:
        return self.width - 2 * self.margin + 1


def entries_of(symbols: np.ndarray, bounds: np.ndarray, g: Geometry) -> tuple[np.ndarray, np.ndarray]:
    """ENTRY rows of one chunk (doc counts from 0 in the chunk), and the chunk position of each one's first window."""
    n = len(symbols)
    if n < g.width:
        return np.zeros(0, dtype=ENTRY), np.zeros(0, dtype=np.int64)
    one, two = (Hasher(symbols, b) for b in BASES)
    gram = min(8, g.margin)
    start = np.arange(n - gram + 1)
    order = one(start, start + gram) & U(~(CHUNK - 1) & 2**64 - 1) | start.astype(U)
    # Position of the anchor of the window at p, for all p.
    last = n - g.width
    anchor = (sliding_min(order[g.margin : last + g.margin + g.region], g.region) & U(CHUNK - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: last + 1]
    valid = np.arange(last + 1) + g.width <= bounds[doc + 1]
    change = np.ones(last + 2, dtype=bool)
    change[1:-1] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (valid[1:] != valid[:-1])
    edge = np.flatnonzero(change)
    first, after = edge[:-1], edge[1:]
    ok = valid[first]
    first, after = first[ok], after[ok]
    a = anchor[first]
    out = np.zeros(len(first), dtype=ENTRY)
    out["core"] = one(a - g.margin, a + g.margin)
    out["doc"] = doc[first]
    out["at"] = first - bounds[doc[first]]
    out["offset"], out["more"] = a - first, after - first - 1
    out["full"] = mixed(two(first, after - 1 + g.width) + out["offset"].astype(U) * U(0x9E3779B97F4A7C15) + out["more"].astype(U) * U(0xC2B2AE3D27D4EB4F))
    return out, first


def chunks(texts: list[np.ndarray], width: int, most: int = CHUNK - 1) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(symbols, bounds, document numbers, first symbol's place in the document) of chunks; long documents overlap by width - 1."""
    held, size = [], 0

    def done():
        sizes = [len(x) for _, _, x in held]
        return np.concatenate([x for _, _, x in held]), np.concatenate([[0], np.cumsum(sizes)]), np.array([k for k, _, _ in held]), np.array([s for _, s, _ in held])

    for k, text in enumerate(texts):
        start = 0
        while len(text) - start >= width:
            piece = text[start : start + most]
            if held and size + len(piece) > most:
                yield done()
                held, size = [], 0
            held.append((k, start, piece))
            size += len(piece)
            start += len(piece) - width + 1
    if held:
        yield done()


def block_entries(texts: list[np.ndarray], width: int) -> np.ndarray:
    """ENTRY rows of a block's documents."""
    found = []
    for symbols, bounds, docs, starts in chunks(texts, width):
        rows, _ = entries_of(symbols, bounds, Geometry(width))
        rows["at"] += starts[rows["doc"]].astype("<u4")
        rows["doc"] = docs[rows["doc"]]
        found.append(rows)
    return np.concatenate(found) if found else np.zeros(0, dtype=ENTRY)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def by_key(rows: np.ndarray, key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(key[a]), rows[order[a:b]]


def candidates(rows: np.ndarray, block: np.ndarray, meet: int, hot: int) -> tuple[np.ndarray, ...]:
    """Of the ENTRY rows of bucket `meet`: (members, their blocks, sent ones, their blocks, hot ones, their blocks)."""
    order = np.lexsort((rows["at"], rows["doc"], block, rows["full"], rows["core"]))
    rows, block = rows[order], block[order]
    new_core = np.concatenate([[True], rows["core"][1:] != rows["core"][:-1]])
    new_full = new_core | np.concatenate([[True], rows["full"][1:] != rows["full"][:-1]])
    group, kind = np.cumsum(new_core) - 1, np.cumsum(new_full) - 1
    fulls = np.bincount(group, weights=new_full).astype(np.int64)[group]
    class_ = np.bincount(kind)[kind] > 1
    second = np.concatenate([[False], new_full[:-1]]) & ~new_full
    heavy = fulls > hot
    member = as_members(rows[class_], block[class_], mixed(rows["core"][class_] ^ mixed(rows["full"][class_])))
    pick = (class_ & (new_full | second)) | (~class_ & (fulls > 1) & ~heavy)
    sent = np.zeros(int(pick.sum()), dtype=SENT)
    for c in ("core", "doc", "at", "offset", "more"):
        sent[c] = rows[c][pick]
    sent["id"], sent["meet"] = mixed(sent["core"] ^ mixed(rows["full"][pick])), meet
    sent["role"] = np.where(~class_, SELF, np.where(new_full, FIRST, SECOND))[pick]
    sent["own"] = heavy[pick]
    return member, block[class_], sent, block[pick], rows[new_full & heavy], block[new_full & heavy]


def as_members(rows: np.ndarray, block: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.zeros(len(rows), dtype=MEMBER)
    out["id"], out["block"], out["doc"], out["at"] = ids, block, rows["doc"], rows["at"]
    return out


def same_windows(rows: np.ndarray, block: np.ndarray, meet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the WINDOW rows of one bucket those whose hashes occur again: (members, sent ones, their blocks)."""
    order = np.lexsort((rows["at"], rows["doc"], block, rows["h"], rows["core"]))
    rows, block = rows[order], block[order]
    new = np.concatenate([[True], (rows["core"][1:] != rows["core"][:-1]) | (rows["h"][1:] != rows["h"][:-1])])
    kind = np.cumsum(new) - 1
    again = np.bincount(kind)[kind] > 1
    second = np.concatenate([[False], new[:-1]]) & ~new
    ids = mixed(rows["core"] ^ mixed(rows["h"]))
    pick = again & (new | second)
    sent = np.zeros(int(pick.sum()), dtype=SENT)
    sent["id"], sent["meet"], sent["doc"], sent["at"], sent["own"] = ids[pick], meet, rows["doc"][pick], rows["at"][pick], 1
    sent["role"] = np.where(new, FIRST, SECOND)[pick]
    return as_members(rows[again], block[again], ids[again]), sent, block[pick]


@dataclass(frozen=True)
class Method:
    """What differs between the operators: symbols of a text, the text of a run of symbols, and the exact method."""

    width: int
    symbols: Callable[[bytes], np.ndarray]  # uint64, one a symbol
    cutter: Callable[[bytes], Callable[[int, int], bytes]]  # text -> (first symbol, symbol after the last) -> bytes
    matches: Callable[[list[bytes], int], list[np.ndarray]]  # payloads -> for each the flags of its repeated windows
    lead: int = 16


def in_order(pdf: pd.DataFrame) -> pd.DataFrame:
    """The documents of a block in an order that does not depend on how they arrived."""
    return pdf.sort_values(["_doc", "_h"], kind="stable", ignore_index=True)


def repeated_spans(docs: DataFrame, method: Method, text: str, doc: str, finish: Callable[[bytes | None, np.ndarray], tuple], schema: str, hot: int = HOT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document: `doc`, then what `finish(text, spans)` gives under `schema`.

    spans: rows (start, end) of symbols, in no order and overlapping, that repeated windows cover.
    """
    width, g = method.width, Geometry(method.width)
    kind = docs.schema[doc].dataType.simpleString()
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n_blocks = blocks_for(total, block_bytes)
    rows = docs.select(F.col(doc).alias("_doc"), F.col(text).cast("binary").alias("_text"), F.xxhash64(text).alias("_h"))
    grouped = bucketed(rows.withColumn("block", F.pmod(F.xxhash64("_doc"), F.lit(n_blocks)).cast("int")), "block", n_blocks).groupBy("block")
    every = max(1, int(total / max(1, g.region) * 2 / SPLITTER_SAMPLE))

    def anchors(key, pdf):
        pdf = in_order(pdf)
        texts = [t or b"" for t in pdf["_text"]]
        found = block_entries([method.symbols(t) for t in texts], width)
        out = [(b, int(key[0]), r.tobytes(), b"") for b, r in by_key(found, found["core"] % U(n_blocks))]
        picked = found[found["core"] // U(n_blocks) % U(every) == 0]
        cutters: dict[int, Callable] = {}
        leads: dict[int, list[bytes]] = {}
        for r in picked:
            d = int(r["doc"])
            cutter = cutters.get(d) or cutters.setdefault(d, method.cutter(texts[d]))
            a = int(r["at"]) + int(r["offset"])
            lead = int(r["core"]).to_bytes(8, "little") + cutter(a - g.margin, a + g.margin)[: method.lead].ljust(method.lead, b"\0")
            leads.setdefault(int(r["core"] % U(n_blocks)), []).append(lead)
        out += [(b, int(key[0]), b"", b"".join(x)) for b, x in leads.items()]
        return pd.DataFrame(out, columns=["bucket", "block", "entries", "leads"])

    def meet(key, pdf):
        blobs = [np.frombuffer(x, dtype=ENTRY) for x in pdf["entries"]]
        rows = np.concatenate(blobs)
        block = np.repeat(pdf["block"].to_numpy(dtype=np.int32), [len(x) for x in blobs])
        out = []
        if len(rows):
            members, _, sent, at, heavy, heavy_at = candidates(rows, block, int(key[0]), hot)
            out += [("member", int(key[0]), members.tobytes(), len(members))] * bool(len(members))
            out += [("sent", b, r.tobytes(), len(r)) for b, r in by_key(sent, at)]
            out += [("hot", b, r.tobytes(), len(r)) for b, r in by_key(heavy, heavy_at)]
            leads = {x[k : k + 8]: x[k + 8 : k + 8 + method.lead] for x in pdf["leads"] for k in range(0, len(x), 8 + method.lead)}
            cores, counts = np.unique(sent["core"], return_counts=True)
            for c, n in zip(cores, counts, strict=True):
                lead = leads.get(int(c).to_bytes(8, "little"))
                if lead is not None:
                    out.append(("lead", -1, lead, int(n)))
        return pd.DataFrame(out, columns=["kind", "at", "packed", "n"])

    entries = grouped.applyInPandas(anchors, "bucket int, block int, entries binary, leads binary")
    marks = cut(entries.groupBy("bucket").applyInPandas(meet, "kind string, at int, packed binary, n long"))

    # Splitters: quantiles of the sampled leading symbols of what is sent, by the number of records.
    sizes = {r["kind"]: r["n"] for r in marks.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    if sizes.get("hot"):
        n_hot = blocks_for(sizes["hot"] * g.region / 2, BUCKET_WINDOWS)

        def split(key, left, right):
            left = in_order(left)
            rows = np.concatenate([np.frombuffer(x, dtype=ENTRY) for x in right["packed"]]) if len(right) and len(left) else np.zeros(0, dtype=ENTRY)
            found = single_windows(rows, left["_text"], method)
            return pd.DataFrame([(b, int(key[0]), r.tobytes()) for b, r in by_key(found, found["h"] % U(n_hot))], columns=["bucket", "block", "packed"])

        def again(key, pdf):
            blobs = [np.frombuffer(x, dtype=WINDOW) for x in pdf["packed"]]
            rows, block = np.concatenate(blobs), np.repeat(pdf["block"].to_numpy(dtype=np.int32), [len(x) for x in blobs])
            members, sent, at = same_windows(rows, block, n_blocks + int(key[0]))
            out = [("member", n_blocks + int(key[0]), members.tobytes(), len(members))] * bool(len(members))
            return pd.DataFrame(out + [("sent", b, r.tobytes(), len(r)) for b, r in by_key(sent, at)], columns=["kind", "at", "packed", "n"])

        windows = grouped.cogroup(marks.where("kind = 'hot'").groupBy(F.col("at").alias("block"))).applyInPandas(split, "bucket int, block int, packed binary")
        more = cut(windows.groupBy("bucket").applyInPandas(again, "kind string, at int, packed binary, n long"))
        sizes["sent"] = sizes.get("sent", 0) + (more.where("kind = 'sent'").agg(F.sum("n")).first()[0] or 0)
        marks = marks.unionByName(more)
    n_buckets = blocks_for(sizes.get("sent", 0), BUCKET_RECORDS)
    sample = marks.where("kind = 'lead'").select("packed", "n").toPandas().sort_values("packed")
    weight = sample["n"].cumsum().to_numpy()
    at = np.searchsorted(weight, np.arange(1, n_buckets) * (weight[-1] / n_buckets)) if len(weight) else []
    splitters = np.unique(np.array([bytes(x) for x in sample["packed"].iloc[at]], dtype=f"S{method.lead}")) if len(at) else np.zeros(0, dtype=f"S{method.lead}")

    def payloads(key, left, right):
        left = in_order(left)
        out = []
        rows = np.concatenate([np.frombuffer(x, dtype=SENT) for x in right["packed"]]) if len(right) and len(left) else np.zeros(0, dtype=SENT)
        for d, mine in by_key(rows, rows["doc"]):
            cutter = method.cutter(left["_text"][d] or b"")
            for r in mine:
                s, a = int(r["at"]), int(r["at"]) + int(r["offset"])
                payload = cutter(s, s + int(r["more"]) + width)
                out.append((payload[: method.lead] if r["own"] else cutter(a - g.margin, a + g.margin)[: method.lead], r.tobytes(), int(key[0]), payload))
        pdf = pd.DataFrame(out, columns=["lead", "sent", "block", "payload"])
        pdf["bucket"] = np.searchsorted(splitters, np.array(pdf["lead"].tolist(), dtype=f"S{method.lead}"), side="right").astype(np.int32)
        return pdf[["bucket", "block", "sent", "payload"]]

    def resolve(key, pdf):
        rows = np.frombuffer(b"".join(pdf["sent"]), dtype=SENT)
        order = np.lexsort((rows["at"], rows["doc"], pdf["block"], rows["core"]))
        rows, pdf = rows[order], pdf.iloc[order]
        flags = method.matches(pdf["payload"].tolist(), width)
        spans, verdicts = [], []
        for r, block, flag in zip(rows, pdf["block"].tolist(), flags, strict=True):
            if r["role"] != SECOND and flag.any():
                a, b = runs(flag)
                if r["role"] == SELF:
                    spans += [(block, r["doc"], int(r["at"]) + x, int(r["at"]) + y - 1 + width) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                else:
                    verdicts += [(r["id"], r["meet"], x, y - 1 + width) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
        found = np.zeros(len(verdicts), dtype=VERDICT)
        for k, name in ((0, "id"), (2, "start"), (3, "end")):
            found[name] = [v[k] for v in verdicts]
        told = [("verdict", m, r.tobytes()) for m, r in by_key(found, np.array([v[1] for v in verdicts], dtype=np.int64))]
        return pd.DataFrame(told + [("span", b, x) for b, x in packed_spans(spans)], columns=["kind", "at", "packed"])

    def inform(key, left, right):
        if not len(left) or not len(right):
            return pd.DataFrame([], columns=["at", "packed"])
        members = np.concatenate([np.frombuffer(x, dtype=MEMBER) for x in left["packed"]])
        verdicts = np.concatenate([np.frombuffer(x, dtype=VERDICT) for x in right["packed"]])
        members, verdicts = members[np.argsort(members["id"], kind="stable")], verdicts[np.argsort(verdicts["id"], kind="stable")]
        first, after = (np.searchsorted(members["id"], verdicts["id"], side=x) for x in ("left", "right"))
        count = after - first
        which = np.repeat(np.arange(len(verdicts)), count)
        place = members[np.arange(count.sum()) + np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
        spans = np.zeros(len(place), dtype=SPAN)
        spans["doc"], spans["start"], spans["end"] = place["doc"], place["at"] + verdicts["start"][which], place["at"] + verdicts["end"][which]
        return pd.DataFrame([(b, r.tobytes()) for b, r in by_key(spans, place["block"])], columns=["at", "packed"])

    sent = grouped.cogroup(marks.where("kind = 'sent'").groupBy(F.col("at").alias("block"))).applyInPandas(payloads, "bucket int, block int, sent binary, payload binary")
    resolved = cut(sent.groupBy("bucket").applyInPandas(resolve, "kind string, at int, packed binary"))
    members, verdicts = marks.where("kind = 'member'").select("at", "packed"), resolved.where("kind = 'verdict'").select("at", "packed")
    informed = members.groupBy("at").cogroup(verdicts.groupBy("at")).applyInPandas(inform, "at int, packed binary")
    found = resolved.where("kind = 'span'").select("at", "packed").unionByName(informed)

    def merge(key, left, right):
        left = in_order(left)
        spans = np.concatenate([np.frombuffer(x, dtype=SPAN) for x in right["packed"]]) if len(right) else np.zeros(0, dtype=SPAN)
        mine = dict(by_key(spans, spans["doc"]))
        none = np.zeros(0, dtype=SPAN)
        out = [(d, *finish(t, mine.get(k, none))) for k, (d, t) in enumerate(zip(left["_doc"], left["_text"], strict=True))]
        return pd.DataFrame(out, columns=names)

    names = ["_doc", *[x.split()[0] for x in schema.split(", ")]]
    return grouped.cogroup(found.groupBy(F.col("at").alias("block"))).applyInPandas(merge, f"_doc {kind}, {schema}").withColumnRenamed("_doc", doc)


def packed_spans(rows: list[tuple]) -> list[tuple[int, bytes]]:
    """(block, SPAN rows) from (block, doc, start, end)."""
    table = np.array(rows, dtype=np.int64).reshape(-1, 4)
    spans = np.zeros(len(table), dtype=SPAN)
    spans["doc"], spans["start"], spans["end"] = table[:, 1], table[:, 2], table[:, 3]
    return [(b, r.tobytes()) for b, r in by_key(spans, table[:, 0])]


def single_windows(rows: np.ndarray, texts: pd.Series, method: Method) -> np.ndarray:
    """The windows of a block's ENTRY rows, one by one; core takes in the anchor's place in the window."""
    parts = [np.zeros(0, dtype=WINDOW)]
    for d, mine in by_key(rows, rows["doc"]):
        cutter = method.cutter(texts[d] or b"")
        for r in mine:
            start, n = int(r["at"]), int(r["more"]) + 1
            symbols = method.symbols(cutter(start, start + n - 1 + method.width))
            at = np.arange(n)
            part = np.zeros(n, dtype=WINDOW)
            part["core"] = mixed(np.full(n, r["core"], dtype=U) + (int(r["offset"]) - at).astype(U) * U(BASES[1]))
            part["h"] = Hasher(symbols, BASES[1])(at, at + method.width)
            part["doc"], part["at"] = d, start + at
            parts.append(part)
    return np.concatenate(parts)


def coverage(n: int, spans: np.ndarray) -> np.ndarray:
    """Which of n symbols are covered."""
    marks = np.zeros(n + 1, dtype=np.int32)
    np.add.at(marks, spans["start"].astype(np.int64), 1)
    np.add.at(marks, spans["end"].astype(np.int64), -1)
    return np.cumsum(marks[:-1]) > 0
