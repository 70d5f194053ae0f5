"""Identifiers and digests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slug(value: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def opportunity_id(entry: Column, exit_: Column, horizon: Column) -> Column:
    """`opp-` and 24 hex digits of entry|exit|horizon; a missing exit is the word None."""
    body = F.concat_ws("|", entry.cast("string"), F.coalesce(exit_.cast("string"), F.lit("None")), horizon.cast("string"))
    return F.concat(F.lit("opp-"), F.substring(F.sha2(body, 256), 1, 24))


def joined_id(*parts: Column) -> Column:
    """SHA-256 of parts joined by NUL."""
    return F.sha2(F.concat_ws("\u0000", *[p.cast("string") for p in parts]), 256)


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def checksum_token(content: Column) -> Column:
    """The digest that a checksum file starts with, in lower case; null if its first word is no SHA-256 digest."""
    word = F.lower(F.regexp_extract(content, r"^\s*(\S+)", 1))
    return F.when(is_digest(word), word)


def coin(seed: Column, key: Column) -> Column:
    """Reproducible LONG or SHORT: the low bit of the first byte of a digest."""
    byte = F.conv(F.substring(F.sha2(F.concat_ws("|", seed.cast("string"), key.cast("string")), 256), 1, 2), 16, 10).cast("int")
    return F.when(byte % 2 == 1, "LONG").otherwise("SHORT")


def plain_decimal(value: Column) -> Column:
    """Decimal text without exponent; minus zero is 0, and trailing zeros stay. Null for anything else."""
    kept = F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value)
    return F.when(kept.rlike(r"^-0+(\.0+)?$"), F.substring(kept, 2, 1_000_000)).otherwise(kept)
