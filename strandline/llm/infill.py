"""Fill-in-the-middle examples: a text is cut at two units and put together anew with sentinels.

Units are lines, each with its end. A sparse index makes the cuts cheap on texts of any length: while the units are
counted, chunk by chunk, the byte and code-point offsets at every EVERY-th unit are noted. To find a cut, the checkpoint
before it is looked up by binary search, and at most EVERY - 1 units are scanned from there. So a worker holds a text, its
output and one number pair for each EVERY units, not a list of units.

The four numbers behind a document's cuts and form are the first 8-digit groups of sha256("<seed>:<id>"), so that they
are the same in every run and on every partition.

Defined cases: a null text counts as empty; an empty text, or one that contains a sentinel, stays plain. A null id counts
as an empty string in the hash. Repeated rows are transformed each, and alike. An empty table gives an empty result. Extra
columns pass through unless they have the name of an added one, which replaces them. Nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units between two checkpoints, and bytes that are counted at once.
EVERY, CHUNK = 64, 1 << 16
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ADDED = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}


@dataclass(frozen=True)
class Checkpoints:
    """Where units 0, every, 2 * every, ... begin."""

    n: int
    units: list[int]
    bytes: list[int]
    chars: list[int]


def checkpoints(data: bytes, every: int = EVERY, chunk: int = CHUNK) -> Checkpoints:
    """Count the units of data, and note the offsets of every `every`-th one on the way."""
    view = np.frombuffer(data, dtype=np.uint8)
    found, places, chars = 0, [0], [0]
    chars_before = 0
    for base in range(0, len(view), chunk):
        part = view[base : base + chunk]
        ends = np.flatnonzero(part == 10)
        so_far = np.cumsum((part & 0xC0) != 0x80)
        at = ends[every - 1 - found % every :: every]
        places += (base + at + 1).tolist()
        chars += (chars_before + so_far[at]).tolist()
        found += len(ends)
        chars_before += int(so_far[-1])
    n = found + bool(data and not data.endswith(b"\n"))
    return Checkpoints(n, list(range(0, every * len(places), every)), places, chars)


def place_of(data: bytes, index: Checkpoints, unit: int) -> tuple[int, int]:
    """(byte, code point) where `unit` begins; unit n is the end."""
    k = bisect_right(index.units, unit) - 1
    start = at = index.bytes[k]
    for _ in range(unit - index.units[k]):
        end = data.find(b"\n", at)
        at = len(data) if end < 0 else end + 1
    scanned = np.frombuffer(data, dtype=np.uint8, count=at - start, offset=start)
    return at, index.chars[k] + int(np.count_nonzero((scanned & 0xC0) != 0x80))


def transformed(data: bytes, numbers: list[int], rate: int, spm: int, every: int = EVERY) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output)."""
    index = checkpoints(data, every)
    h1, h2, h3, h4 = numbers
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return index.n, "plain", None, None, data
    first, second = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    (a, a_chars), (b, b_chars) = place_of(data, index, first), place_of(data, index, second)
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h4 % 100 < spm:
        return index.n, "spm", a_chars, b_chars - a_chars, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return index.n, "psm", a_chars, b_chars - a_chars, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(docs: DataFrame, text: str = "text", doc: str = "doc_id", seed: int = 7, rate: int = 100, spm: int = 50, every: int = EVERY) -> DataFrame:
    """docs without the text, with n (units), form (plain, psm or spm), prefix_chars, middle_chars (null if plain) and output.

    rate: per cent of the documents that are transformed; spm: per cent of these that have the suffix first.
    """
    names = {c: f"_carried{k}" for k, c in enumerate(c for c in docs.columns if c != text and c not in ADDED)}
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{doc}`").cast("string"), F.lit(""))), 256)
    numbers = F.array(*[F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)])
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in names.items()], numbers.alias("_numbers"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("_text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names.values()] + [f"`{c}` {kind}" for c, kind in (ADDED | {"output": "binary"}).items()])

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            numbers, texts = batch.column("_numbers"), batch.column("_text")
            made = [transformed(texts[i].as_py(), numbers[i].as_py(), rate, spm, every) for i in range(len(batch))]
            n, form, prefix, middle, output = zip(*made, strict=True) if made else ((),) * 5
            new = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in names.values()] + new, [*names.values(), *ADDED])

    done = rows.mapInArrow(run, schema)
    return done.select(*[F.col(k).alias(c) for c, k in names.items()], *[F.col(c).cast(kind).alias(c) for c, kind in ADDED.items()])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    first, second = (F.when(form == "spm", F.lit(a.decode())).otherwise(F.lit(b.decode())) for a, b in ((SUFFIX, PREFIX), (PREFIX, SUFFIX)))
    rest = F.substring(output, F.length(first) + 1, F.length(output))
    one = F.substring(rest, F.lit(1), F.call_function("locate", second, rest) - 1)
    rest = F.substring(rest, F.length(one) + F.length(second) + 1, F.length(output))
    two = F.substring(rest, F.lit(1), F.call_function("locate", F.lit(MIDDLE.decode()), rest) - 1)
    middle = F.substring(rest, F.length(two) + len(MIDDLE) + 1, F.length(output))
    return F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one)).otherwise(F.concat(one, middle, two))
