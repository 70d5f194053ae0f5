"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact join. DataFrame functions only.

A canonical URL is `host/path` in the form of `parts_of`, without scheme, user, port 80 or 443, fragment, tracking
parameters or a last slash. The filter is a table with one row for each block of 256 bits (eight 32-bit words, one
bit set in each word by every key of the block, as in Putze et al., 2007), built by a partially aggregated bit_or and
probed by an equi-join on the block number. Its size follows the list, so that the join is broadcast only when the
table has at most `broadcast_blocks` rows and is shuffled otherwise. Only possible hits reach the exact join.

Defined cases: a null URL, or one without `://`, has an empty host and path, no canonical form and is never listed.
Null or repeated entries of the list change nothing; an empty list lists nothing. Repeated pages are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import apart, blocks_for

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: A filter of this many blocks (2 MB) may be broadcast.
BROADCAST_BLOCKS = 65_536
#: (verdict, rule) of the fixed rules: `host/path prefix`.
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def parts_of(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def canonical(url: Column) -> Column:
    """The form under which URLs are listed; null without a host."""
    host, path = parts_of(url)
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)?$", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)")))
    path = F.regexp_replace(path, r"/+$", "")
    return F.when(host != "", F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def fits(host: Column, path: Column, rule: str) -> Column:
    name, _, prefix = rule.partition("/")
    return ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. Rules of one length: the first by text."""
    ordered = sorted(rules, key=lambda x: (-len(x[1]), x[1]))
    rule = F.coalesce(*[F.when(fits(host, path, r), F.lit(r)) for _, r in ordered], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(fits(host, path, r), F.lit(v)) for v, r in ordered], F.lit(None).cast("string"))
    return rule, verdict


def block_of(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def mask(key: Column, word: int) -> Column:
    """The one bit of a key in a word."""
    bit = F.pmod(F.xxhash64(F.lit(word), key), F.lit(32)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), bit)


def bloom(listed: DataFrame, key: str, bits_per_key: float = 16.0) -> tuple[DataFrame, int]:
    """(filter table with block and word0 ... word7, number of blocks)."""
    blocks = blocks_for(listed.count() * bits_per_key, 32 * WORDS)
    words = [F.bit_or(mask(F.col(key), k)).alias(f"word{k}") for k in range(WORDS)]
    return listed.groupBy(block_of(F.col(key), blocks).alias("block")).agg(*words), blocks


@apart
def listed_pages(pages: DataFrame, listed: DataFrame, url: str = "url", key: str = "canonical", broadcast_blocks: int = BROADCAST_BLOCKS) -> DataFrame:
    """pages with host, path, canonical, possible (passed the filter) and listed (exact)."""
    entries = listed.select(F.col(key).alias("_key")).where("_key IS NOT NULL").distinct()
    table, blocks = bloom(entries, "_key")
    added = {"host", "path", "canonical", "possible", "listed"}
    host, path = parts_of(F.col(url))
    rows = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in added], host.alias("host"), path.alias("path"), canonical(F.col(url)).alias("canonical"))
    # Pages without a canonical form meet no block; numbers below 0 keep them from being one key.
    nowhere = -1 - F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), F.lit(blocks))
    probe = rows.withColumn("_block", F.when(F.col("canonical").isNull(), nowhere).otherwise(block_of(F.col("canonical"), blocks)))
    table = F.broadcast(table) if blocks <= broadcast_blocks else table
    hit = F.lit(True)
    for k in range(WORDS):
        hit = hit & (F.col(f"word{k}").bitwiseAND(mask(F.col("canonical"), k)) != 0)
    probed = probe.join(table, F.col("_block") == F.col("block"), "left").withColumn("possible", F.coalesce(hit & F.col("canonical").isNotNull(), F.lit(False)))
    probed = probed.drop("_block", "block", *[f"word{k}" for k in range(WORDS)])
    # Only possible hits take part in the exact join.
    exact = probed.where("possible").join(entries, F.col("canonical") == F.col("_key"), "left").withColumn("listed", F.col("_key").isNotNull()).drop("_key")
    return exact.unionByName(probed.where("NOT possible").withColumn("listed", F.lit(False)))


@apart
def judge_urls(pages: DataFrame, listed: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """pages with host, path, rule and verdict: the rule's, else block for listed URLs and allow for others."""
    rows = listed_pages(pages.drop("rule", "verdict"), listed, url)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return rows.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")))
