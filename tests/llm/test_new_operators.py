"""Fill-in-the-middle, content sort and lexical search: brute force, hot groups, odd tables, clashing names."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import contentsort, fmindex, infill, lexical, lines, nearcopies, quality, urls

LONG = "\n".join(f"line {k} of a long text é{k % 7}" for k in range(5_000))
ODD = [
    (1, "plain words here", "x"), (1, "plain words here", "x"), (1, "another text", None), (None, "no id at all", "x"), (None, "plain  words\there", "y"), (2, None, "x"), (3, "", "y"),
    (4, " \n\t ", "y"), (5, LONG, "y"), (6, "é日本\n ünï\x00cöde <P> here", "y"), (7, "a" * 5000, "z"), (8, "\n\n\n", "z"), (9, "no line end\nat all", "z"), (10, "plain words here", "z"),
]
NAMES = ["n", "form", "output", "kept", "group_size", "_cell", "_norm", "_h", "_id", "_lead", "_text", "_numbers", "a.b", "block", "tier", "shard"]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id long, text string, source string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def clashing(spark):
    rows = [(k, "same text" if k % 3 else f"text {k}\nand more", *[f"{c}{k}" for c in NAMES]) for k in range(40)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in NAMES))


# -- 11 ---------------------------------------------------------------------------------------------------------


def fim(doc, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("every", [1, 2, 64])
def test_fill_in_the_middle_equals_the_rule(spark, odd, every):
    rng = random.Random(1)
    texts = [(100 + k, "".join(rng.choice(["\n", "\n\n", "ab", "é", "日本語 ", "x\n", "<", "<P", "S>"]) for _ in range(rng.randint(0, 40)))) for k in range(150)]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(texts, "doc_id long, text string"))
    made = infill.fill_in_middle(docs, every=every)
    got = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = Counter((d, *fim(d, t), t or "") for d, t in [(r[0], r[1]) for r in ODD] + texts)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got) == want
    assert {r.form for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(("every", "chunk"), [(1, 3), (3, 7), (64, 1 << 16)])
def test_checkpoints_lead_to_every_unit(every, chunk):
    for text in ("", "\n", "a", "a\nbé\n\n日本", "\n" * 50, LONG[:3000], LONG[:3000] + "\n"):
        data = text.encode()
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        index = infill.checkpoints(data, every, chunk)
        assert index.n == len(units) and len(index.bytes) == data.count(b"\n") // every + 1
        for k in range(0, len(units) + 1, 1 if len(units) < 60 else 17):
            before = "".join(units[:k])
            assert infill.place_of(data, index, k) == (len(before.encode()), len(before))


def test_fill_in_the_middle_rates(odd):
    assert {r.form for r in infill.fill_in_middle(odd, rate=0).collect()} == {"plain"}
    assert {r.form for r in infill.fill_in_middle(odd, spm=100).collect()} == {"plain", "spm"}


# -- 12 ---------------------------------------------------------------------------------------------------------


def kept_rows(rows):
    """(keep_id, group_size) by normalised text."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(d)
    return {t: (min((d for d in ds if d is not None), default=None), len(ds)) for t, ds in groups.items()}


@pytest.mark.parametrize("parts", [None, 3, 50])
def test_exact_dedup_equals_grouping(spark, odd, monkeypatch, parts):
    """parts: of so few or many partitions, that groups lie whole in one, or in many cells."""
    if parts:
        monkeypatch.setattr(contentsort, "blocks_for", lambda *_: parts)
    hot = [(k, "hot  text" if k % 2 else "hot\ttext") for k in range(1000, 1400)] + [(None, "hot text")] * 9 + [(1200, "hot text")]
    rows = [r[:2] for r in ODD] + hot + [(5000 + k, f"common beginning of many texts, number {k % 60}") for k in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = contentsort.exact_dedup(docs, with_text=True).collect()
    want = kept_rows(rows)
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    by_text = defaultdict(list)
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        assert (r.keep_id, r.group_size, r.text_sha256) == (*want[norm], hashlib.sha256(norm.encode()).hexdigest())
        by_text[norm].append(r)
    for group in by_text.values():
        assert [r.doc_id for r in group if r.kept] == [group[0].keep_id]


def test_equal_hashes_are_no_equal_texts(spark, monkeypatch):
    """With a hash that all texts share, whole comparisons still tell them apart, in cells too."""
    rows = [(k, f"text {k % 5}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(contentsort.F, "xxhash64", lambda *c: F.lit(1).cast("long") if isinstance(c[0], str) and c[0] == "_norm" else real(*c))
    got = contentsort.exact_dedup(docs).collect()
    assert all((r.keep_id, r.group_size, r.kept) == (r.doc_id % 5, 40, r.doc_id < 5) for r in got) and len(got) == 200


def test_dedup_is_native_and_shuffles_texts_once(odd):
    import inspect

    source = inspect.getsource(contentsort)
    assert not re.search(r"mapIn|applyIn|udf|\.rdd|pandas|arrow", source)


# -- 13 ---------------------------------------------------------------------------------------------------------


def best(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(w for _, b in bags for w in set(b))
    out = []
    for item, text in items:
        query = Counter(terms(text))
        scores = []
        for d, b in bags:
            tf = Counter(b)
            m = 75 + (25 * len(b) * n_docs) // max(n_terms, 1)
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w, q in query.items() if tf[w])
            if s > 0:
                scores.append((-s, d is not None, d or 0))
        out += [(item, rank, d if known else None, -s) for rank, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return Counter(out)


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    words = ["the", "of", "and", "in"] * 40 + [f"w{k}" for k in range(60)] * 3 + [f"rare{k}" for k in range(400)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30, 30, 200])))) for k in range(n)]
    docs += [(n + k, docs[7][1]) for k in range(30)]  # ties beyond k
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))) for k in range(25)] + [(25, docs[7][1]), (26, "the the of"), (27, "rare1 rare2 rare3"), (28, "unheard of"), (29, ""), (30, None), (30, "w1 w2")]
    return docs, items


@pytest.mark.parametrize(("parts", "least", "block_docs"), [((8, 2), 32, 16_384), ((8, 2), 1, 37), ((4,), 2, 100), ((50, 10, 3), 1, 1)])
def test_search_equals_brute_force(spark, parts, least, block_docs):
    docs, items = corpus()
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), parts=parts, least=least, block_docs=block_docs if block_docs > 1 else 9)
    got = lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 10, item_block=1000 if block_docs > 50 else 11).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == best(docs, items, 10)


def test_high_tiers_prove_and_low_ones_are_asked_for_the_rest(spark, monkeypatch):
    docs, items = corpus()
    asked = []
    real = lexical.judged

    def judged(rows, open_, queries, least, k, kind):
        out = real(rows, open_, queries, least, k, kind)
        asked.append((out.where("proven").select("item").distinct().count(), out.where("NOT proven").select("shard", "item").count(), sorted(r.tier for r in rows.select("tier").distinct().collect())))
        return out

    monkeypatch.setattr(lexical, "judged", judged)
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), least=2, block_docs=100)
    lexical.search(index, spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert [t for *_, t in asked] == [[-1, 0], [-1, 0, 1], [-1, 0, 1, 2]]  # lower tiers are read later, and only then
    assert asked[0][0] > 0 and asked[0][1] > asked[1][1] > 0 == asked[-1][1]


def test_first_tiers_hold_the_highest_impacts():
    docs = [t.encode() for _, t in corpus(120)[0]]
    pieces = lexical.shard_of(docs, 100, 5000, (8, 2), 2)
    lists = defaultdict(list)
    for tier, term, df, residual, postings in zip(*(pieces[c].to_pylist() for c in ("tier", "term", "df", "residual", "postings")), strict=True):
        lists[term].append((tier, df, residual, [int.from_bytes(postings[i : i + 8], "little") for i in range(0, len(postings), 8)]))
    for own in lists.values():
        values = [p & 0xFFFFFFFF for *_, ps in own for p in ps]
        assert values == sorted(values, reverse=True) and own[0][0] == 0 and [t for t, *_ in own] == sorted({t for t, *_ in own})
        assert own[0][1] == len(values) and own[-1][2] == 0
        assert all(a[2] == b[3][0] & 0xFFFFFFFF for a, b in zip(own, own[1:], strict=False))
    assert max(map(len, lists.values())) == 3


# -- all --------------------------------------------------------------------------------------------------------


def test_odd_and_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "plain words"), (2, None), (None, "text")], "item_id long, text string")
    got = lexical.search(lexical.build_index(odd), items, 20).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in got) == best([r[:2] for r in ODD], [(1, "plain words"), (2, None), (None, "text")], 20)
    for docs, asked in ((none, items), (odd, items.limit(0)), (odd.where("doc_id = 4"), items)):
        assert lexical.search(lexical.build_index(docs), asked).collect() == []
    assert infill.fill_in_middle(none).collect() == [] and contentsort.exact_dedup(none).collect() == []


def test_clashing_names(spark):
    docs = clashing(spark)
    own = {c: {r.doc_id: r[c] for r in docs.collect()} for c in NAMES}
    for out, added in ((infill.fill_in_middle(docs), infill.ADDED), (contentsort.exact_dedup(docs), {"keep_id", "group_size", "kept", "text_sha256"})):
        rows = out.collect()
        assert len(rows) == 40 and all(r[c] == own[c][r.doc_id] for r in rows for c in NAMES if c not in added)
    assert lexical.search(lexical.build_index(docs), docs.withColumn("item_id", F.col("doc_id")).limit(2), 3).count() == 6


CLASHES = ["_h", "_words", "_lines", "_doc", "_p", "_bytes", "_items", "_hit", "_k", "_d", "block", "word0", "_key", "_block", "a.b", "kept", "n_words", "canonical"]


def test_no_operator_or_stage_touches_other_columns(spark, tmp_path):
    """The names of inner columns, dots, and the names of added columns; a stage of the pipeline keeps these too."""
    rows = [(k, f"text number {k} has some words of its own, {' '.join(f'w{k}x{j}' for j in range(12))} end", f"http://h{k}/p", *[f"{c}{k}" for c in CLASHES]) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, url string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    listed = docs.where("doc_id < 5").select(urls.canonical(F.col("url")).alias("canonical"))
    items = spark.createDataFrame([(1, "w3x1 w3x2 w3x3 w3x4")], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    outs = {"line": lines.line_dedup(docs), "near": nearcopies.keep_one(docs), "quality": quality.quality_filter(docs), "decontaminate": fmindex.decontaminate(docs, items, with_text=True), "urls": urls.judge_urls(docs, listed)}
    added = {"quality": {"n_words", "kept"}, "decontaminate": {"n_words"}, "urls": {"canonical"}}
    outs |= {name: stage(spark, docs, str(tmp_path)) for name, stage in corpus_pipeline.STAGES[:4]}
    for name, out in outs.items():
        got = out.collect()
        assert (len(got) == 30 or name == "quality rules" and got) and len(set(out.columns)) == len(out.columns), name
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHES if c not in added.get(name, ())), name
        if name in dict(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
