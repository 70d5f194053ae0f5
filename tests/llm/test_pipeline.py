"""The pipeline's stages, each on its predecessor's rows, against brute force."""

import os
from collections import defaultdict

import pytest

import corpus_pipeline
from strandline.llm import fmindex, quality, registry

from .test_operators import window_at

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA)
        if name == "best-fit packing":
            rows = out.collect()
            assert {r.doc_id for r in rows} == set(before)
            sizes = defaultdict(int)
            for r in rows:
                sizes[r.sequence_id] += r.length
            assert max(sizes.values()) <= 1024 and len(sizes) <= sum(sizes.values()) / 1024 * 1.05 + 2
            break
        assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept = {r.doc_id: r for r in docs.collect()}
        after = {d: r.text for d, r in kept.items()}
        assert set(after) <= set(before) and all(r.n_chars == len(r.text) for r in kept.values())
        if name == "quality rules":
            for d, t in before.items():
                c = quality.counts_of(t.encode())
                if c[0] < 10 or 100 * c[4] > 20 * c[0]:
                    assert d not in after
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
            good = [d for d, q in labels.items() if q == 1 and quality.counts_of(before[d].encode())[0] >= 10]
            assert sum(d in after for d in good) >= 0.95 * len(good)
        elif name == "line dedup":
            seen = set()
            for d in sorted(before):
                w = [x for x in before[d].split("\n") if x.strip()]
                gone = set()
                for i in range(len(w)):
                    key = window_at(w, i)
                    if key in seen:
                        gone.update(range(i, i + len(key)))
                    seen |= {key} - {None}
                left = [x for i, x in enumerate(w) if i not in gone]
                assert [x for x in after.get(d, "").split("\n") if x.strip()] == left
        elif name == "MinHash near-dedup":
            assert len(set(after.values())) == len(after)
        elif name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            windows = {tuple(w[i : i + 10]) for _, t in items if (w := fmindex.words_of(t.encode())) for i in range(max(1, len(w) - 9))}
            for d, t in before.items():
                w = fmindex.words_of(t.encode())
                hit = any(tuple(w[i : i + 10]) in windows for i in range(len(w)))
                assert (after.get(d) == t) != hit
        before = after


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, DATA).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    cursor = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.select(*names).collect()), key=key) == sorted(cursor.fetchall(), key=key)
