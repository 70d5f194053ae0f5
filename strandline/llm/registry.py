"""Queries of the training-data operators and the SQL that DuckDB can check them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import contentsort, fmindex, infill, lempel, lexical, lines, nearcopies, packing, quality, sharding, suffixes, urls, warc
from strandline.llm.common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.substring_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.line_dedup(docs).select("doc_id", "n_lines", "n_removed", "n_spans", "kept_sha256")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed are the URLs of the pages whose id is divisible by 20; all pages are judged."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(F.col("page_id") % 20 == 0).select(urls.canonical(F.col("url")).alias("canonical"))
    return urls.judge_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op5_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.derive(warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return records.select("page_id", "record_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "source_payload_digest", F.sha2("block", 256).alias("block_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = fmindex.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "class_id", "keeper")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_filter(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = sharding.vector_shards(docs, 24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_lempel_ziv_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lempel.lempel_ziv_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = infill.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_content_sort_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contentsort.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_tiered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexical.build_index(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return lexical.search(index, table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


SQL_PARTS = r"""
host_path AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
),
canon AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', '') || regexp_replace(path, '/+$', '')
         || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'),
               lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))) AS kept FROM host_path)
)"""

OP4_SQL = f"""
WITH {SQL_PARTS},
listed AS (SELECT DISTINCT canonical FROM canon WHERE page_id % 20 = 0 AND canonical IS NOT NULL),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM canon
)
SELECT page_id, host, path, rule, l.canonical IS NOT NULL AS listed,
       CASE rule WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block'
            ELSE CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled LEFT JOIN listed l ON ruled.canonical = l.canonical
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_suffix_dedup, op3_line_dedup, op4_url_filter, op5_warc_derivatives, op6_decontamination, op7_minhash_neardup, op8_quality_rules, op9_sharding, op10_lempel_ziv_dedup, op11_fill_in_middle, op12_content_sort_dedup, op13_tiered_search)
}

OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, pos, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
),
worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
triples AS (
  SELECT doc_id, k, n, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(n, 1) OVER w AS n2 FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY k)
),
windows AS (
  SELECT doc_id, k, size, l1, CASE WHEN size > 1 THEN l2 END AS l2, CASE WHEN size > 2 THEN l3 END AS l3
  FROM (SELECT *, CASE WHEN n >= 20 THEN 1 WHEN n + n2 >= 20 THEN 2 WHEN l3 IS NOT NULL THEN 3 END AS size FROM triples) WHERE size IS NOT NULL
),
later AS (
  SELECT doc_id, k, size FROM (
    SELECT doc_id, k, size, row_number() OVER (PARTITION BY size, l1, l2, l3 ORDER BY doc_id, k) AS nth FROM windows
  ) WHERE nth > 1
),
dead AS (SELECT DISTINCT doc_id, k + i AS k FROM later, (VALUES (0), (1), (2)) AS o(i) WHERE i < size),
marked AS (
  SELECT l.doc_id, l.pos, l.line, w.k, d.k IS NOT NULL AS gone
  FROM lines l LEFT JOIN worded w USING (doc_id, pos) LEFT JOIN dead d ON d.doc_id = l.doc_id AND d.k = w.k
),
starts AS (SELECT doc_id, count(*) AS n_spans FROM dead d WHERE NOT EXISTS (SELECT 1 FROM dead e WHERE e.doc_id = d.doc_id AND e.k = d.k - 1) GROUP BY doc_id),
sums AS (
  SELECT doc_id, count(k) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN sums USING (doc_id) LEFT JOIN starts USING (doc_id)
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
phrases AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
),
sizes AS (SELECT DISTINCT n FROM phrases),
places AS (
  SELECT doc_id, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
),
hits AS (SELECT DISTINCT doc_id, n, i, item_id FROM places JOIN phrases USING (n, phrase)),
words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::varchar AS id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 34], ' ')) AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
repeated AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM windows JOIN repeated USING (w)),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM d),
kept AS (
  SELECT doc_id, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY words.k) FILTER (g.k IS NULL) AS kept
  FROM words LEFT JOIN gone g USING (doc_id, k) GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
h AS (SELECT *, len(u)::bigint AS n, ('0x' || substr(h, 1, 8))::bigint AS h1, ('0x' || substr(h, 9, 8))::bigint AS h2, ('0x' || substr(h, 17, 8))::bigint AS h3, ('0x' || substr(h, 25, 8))::bigint AS h4 FROM d),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM h
),
c AS (SELECT *, coalesce(array_to_string(u[1 : a], ''), '') AS p, coalesce(array_to_string(u[a + 1 : b], ''), '') AS m, coalesce(array_to_string(u[b + 1 : n], ''), '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM c
"""

OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::bigint AS n_terms FROM d),
postings AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws)::bigint AS n, unnest(ws) AS term FROM d) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::double / (2 * count(*) + 1)::double))::bigint AS w FROM postings, c GROUP BY term),
asked AS (SELECT item_id, term, count(*) AS q FROM b GROUP BY ALL),
scores AS (
  SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), c GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::int AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 20
"""

ORACLES: dict[str, str] = {"op11_fill_in_middle": OP11_SQL, "op12_content_sort_dedup": OP12_SQL, "op13_tiered_search": OP13_SQL, "op3_line_dedup": OP3_SQL, "op4_url_filter": OP4_SQL, "op6_decontamination": OP6_SQL, "op10_lempel_ziv_dedup": OP10_SQL}



def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
