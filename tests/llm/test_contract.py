"""The registered queries themselves: contract columns, brute force where SQL has none, clashing names, odd source records."""

import gzip
import hashlib
import json
import os
import time
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from strandline.llm import lempel, quality, registry, sharding, suffixes, warc

DATA = "/root/testdata/sf0.001"
here = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()} if os.path.isdir(DATA) else {}


def rows_of(spark, name):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, DATA).collect()}


@here
def test_op1_sequences(spark, texts):
    rows = registry.op1_best_fit_packing(spark, DATA).collect()
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        at = 0
        for offset, n in sorted(x):
            assert offset == at
            at += n
        assert at <= 1024
    assert {r.doc_id for r in rows} == set(texts) and len(places) <= sum(r.length for r in rows) / 1024 * 1.02 + 2


@here
def test_op2_at_its_width(spark, texts):
    seen = defaultdict(list)
    data = {d: (t or "").encode() for d, t in texts.items()}
    for d, b in data.items():
        for i in range(len(b) - 199):
            seen[hash(b[i : i + 200])].append((d, i))
    gone = defaultdict(set)
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d].update(range(i, i + 200))
    got = rows_of(spark, "op2_suffix_dedup")
    assert set(got) == set(texts)
    for d, b in data.items():
        g = gone.get(d, set())
        kept = bytes(x for i, x in enumerate(b) if i not in g)
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), len(g), sum(i - 1 not in g for i in g), hashlib.sha256(kept).hexdigest())


@here
def test_op5_records(spark):
    rows = registry.op5_warc_derivatives(spark, DATA).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert Counter(r.record_type for r in rows) == {"metadata": len(pages), "conversion": len(pages)}
    assert all(r.source_payload_digest == warc.sha1((pages[r.page_id].html or "").encode()) and r.target_uri == (pages[r.page_id].url or "") for r in rows)


@here
def test_op7_and_op9_rows(spark, texts):
    classes = rows_of(spark, "op7_minhash_neardup")
    assert set(classes) == set(texts) and all(r.class_id <= d for d, r in classes.items())
    by_text = defaultdict(set)
    for d, t in texts.items():
        if t and t.split():
            by_text[t].add(classes[d].class_id)
    assert all(len(x) == 1 for x in by_text.values())
    shards = rows_of(spark, "op9_sharding")
    total = defaultdict(int)
    slots = defaultdict(set)
    for d, r in shards.items():
        b = (texts[d] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 8, zlib.crc32(b), "bytes")
        total[r.shard] += r.size
        slots[r.shard].add(r.slot)
    assert set(shards) == set(texts) and all(x == set(range(len(x))) for x in slots.values()) and set(total) <= set(range(24))


@here
def test_op8_judges(spark, texts):
    got = rows_of(spark, "op8_quality_rules")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for d, t in texts.items():
        c = quality.counts_of((t or "").encode())
        failed = c[0] < 10 or 100 * c[4] > 20 * c[0]
        assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words, got[d].base_failed) == (*c[:5], failed) and not (failed and got[d].kept)
    bad = [d for d, q in labels.items() if q == 0 and not got[d].base_failed]
    good = [d for d, q in labels.items() if q == 1 and not got[d].base_failed]
    assert sum(got[d].kept for d in bad) <= 0.1 * len(bad) and sum(got[d].kept for d in good) >= 0.97 * len(good)


@pytest.mark.parametrize("module", [suffixes, lempel])
def test_nothing_is_removed_without_the_exact_method(spark, monkeypatch, module):
    import numpy as np

    passage = " ".join(f"w{k}" for k in range(60))
    docs = spark.createDataFrame([(k, f"a{k} b{k} {passage} c{k}") for k in range(6)] + [(10, passage), (11, passage)], "doc_id long, text string")
    dedup = suffixes.substring_dedup if module is suffixes else lempel.lempel_ziv_dedup
    assert dedup(docs, width=20).selectExpr("sum(n_removed)").first()[0] > 300
    monkeypatch.setattr(module, "matches", lambda payloads, width: [np.zeros(max(0, (len(p) if module is suffixes else len(p.split())) - width + 1), dtype=bool) for p in payloads])
    for hot in (1_500, 2):
        assert dedup(docs, width=20, hot=hot).selectExpr("sum(n_removed)").first()[0] == 0


def test_clashing_names_pass_through_sharding(spark):
    names = ["h1", "h2", "parts", "piece", "_block", "heavy_shard", "_local", "_before", "_n", "size", "shard"]
    docs = spark.createDataFrame([(k, "same" if k % 3 else f"t{k}", *[f"{c}{k}" for c in names]) for k in range(60)], "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = sharding.vector_shards(docs, 4).collect()
    assert len(got) == 60 and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names[:-2]) and all(isinstance(r["size"], int) for r in got)


def test_real_response_records(spark, tmp_path):
    def record(kind, uid, headers, block):
        lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: {uid}", "WARC-Target-URI: http://h/p", "WARC-Date: 2020-01-02T03:04:05Z", *headers, f"Content-Length: {len(block)}"]
        return gzip.compress(b"WARC/1.0\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    page = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\nX-A:  b \r\nX-A: c\r\n\r\n<title>T</title><p>Gone</p>"
    (tmp_path / "a.warc.gz").write_bytes(
        record("warcinfo", "<urn:uuid:0>", [], b"software: x") + record("response", "<urn:uuid:1>", ["WARC-Payload-Digest: sha1:STATED"], page) + record("request", "<urn:uuid:2>", [], b"GET /") + record("response", "<urn:uuid:3>", [], b"no http")
    )
    rows = warc.derive(warc.from_records(warc.read_warc(spark, str(tmp_path)))).collect()
    assert [r.page_id for r in rows] == ["<urn:uuid:1>"] * 2 + ["<urn:uuid:3>"] * 2
    meta = json.loads(bytes(rows[0].block))
    assert meta["http"] == {"status": 404, "headers": [{"name": "Content-Type", "value": "text/html"}, {"name": "X-A", "value": "b"}, {"name": "X-A", "value": "c"}], "entity_length": 27}
    assert meta["warc"]["WARC-Payload-Digest"] == "sha1:STATED" == rows[1].source_payload_digest and meta["warc"]["WARC-Date"] == "2020-01-02T03:04:05Z" and bytes(rows[1].block) == b"T\nGone"
    assert json.loads(bytes(rows[2].block))["http"]["status"] is None and bytes(rows[3].block) == b"no http"
    warc.write_warc(warc.derive(warc.from_records(warc.read_warc(spark, str(tmp_path)))), str(tmp_path / "out"))
    assert {r.refers_to for r in warc.read_warc(spark, f"{tmp_path}/out/*.warc.gz").collect()} == {"<urn:uuid:1>", "<urn:uuid:3>"}


@pytest.mark.parametrize("tag", ["<head>", "<title>", "<html ", "<script ", "<!--", "<a href=", "<template"])
def test_unclosed_tags_take_linear_time(tag):
    start = time.perf_counter()
    warc.derive_one(1, "x", "http://h/", "", 200, [], None, None, (tag * (1_000_000 // len(tag))).encode())
    assert time.perf_counter() - start < 8


def test_pages_under_one_id_have_their_own_records(spark):
    pages = spark.createDataFrame([("x", "u", "<p>1"), ("x", "u", "<p>2"), (None, None, None)], "page_id string, url string, html string")
    rows = warc.derive(warc.responses(pages)).collect()
    assert len({r.record_id for r in rows}) == 6 and {r.page_id for r in rows} == {"x", None}


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"word{k}" for k in range(20_000))
    odd = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, " \n ", "en", "s", 3), (4, long, "en", "s", len(long)), (4, long, "en", "s", len(long)), (None, "some words of a document without an id, which is long enough", "en", None, 1)]
    for rows in ([], odd):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "best-fit packing":
                assert out.columns == docs.columns
                docs = spark.createDataFrame(out.collect(), schema)
        assert (out.count() > 0) == bool(rows)
