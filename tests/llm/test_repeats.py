import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import lempel, suffixes


def brute(texts, width):
    """Kept symbols of each sequence, by a dictionary of all windows."""
    seen = defaultdict(list)
    for k, t in enumerate(texts):
        for i in range(len(t) - width + 1):
            seen[tuple(t[i : i + width])].append((k, i))
    gone = [set() for _ in texts]
    for at in seen.values():
        if len(at) > 1:
            for k, i in at:
                gone[k].update(range(i, i + width))
    return gone


def corpus(seed, alphabet, n=60, most=300):
    rng = random.Random(seed)
    base = [[rng.choice(alphabet) for _ in range(rng.randint(0, most))] for _ in range(n)]
    for _ in range(n):
        a, b = rng.choice(base), rng.choice(base)
        i, j = rng.randint(0, len(a)), rng.randint(0, len(a))
        k = rng.randint(0, len(b))
        b[k:k] = a[min(i, j) : max(i, j)]
    for _ in range(5):
        c = list(rng.choice(base))
        if c:
            c[rng.randrange(len(c))] = rng.choice(alphabet)
        base.append(c)
    return base


@pytest.mark.parametrize(("seed", "alphabet", "hot"), [(1, "ab", 1500), (2, "abcdefgh", 1500), (3, "ab", 3), (4, "éaß", 2)])
def test_substrings_equal_brute_force(spark, seed, alphabet, hot):
    texts = ["".join(x) for x in corpus(seed, alphabet)] + ["", None, "x" * 500]
    rows = [(k // 2, t, "clash") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string")
    for width in (20, 33):
        got = suffixes.substring_dedup(docs, width, with_kept=True, hot=hot, block_bytes=3000).collect()
        data = [(t or "").encode() for t in texts]
        gone = brute(data, width)
        want = []
        for (d, _, _), b, g in zip(rows, data, gone, strict=True):
            kept = bytes(x for i, x in enumerate(b) if i not in g)
            spans = sum(i - 1 not in g for i in g)
            want.append((d, len(b), len(g), spans, hashlib.sha256(kept).hexdigest()))
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


@pytest.mark.parametrize(("seed", "hot"), [(1, 1500), (2, 2)])
def test_words_equal_brute_force(spark, seed, hot):
    words = corpus(seed, ["a", "b", "Ça", "dd"], most=200)
    rng = random.Random(seed)
    texts = ["".join(w + rng.choice([" ", "\n", " \t"]) for w in t) for t in words] + [None, "", "  \n"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for width in (8, 15):
        got = {r.doc_id: r for r in lempel.lempel_ziv_dedup(docs, width, hot=hot, block_bytes=3000).collect()}
        split = [(t or "").split() for t in texts]
        for k, (w, g) in enumerate(zip(split, brute(split, width), strict=True)):
            kept = " ".join(x for i, x in enumerate(w) if i not in g).encode()
            assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), len(g), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("seed", [3, 4])
def test_equal_words_share_a_bucket_whatever_their_blanks(spark, monkeypatch, seed):
    from strandline.llm import repeats

    monkeypatch.setattr(repeats, "BUCKET_RECORDS", 3)
    words = corpus(seed, ["a", "b", "Ça", "dd"], most=200)
    rng = random.Random(seed)
    texts = ["".join(w + rng.choice([" ", "\n", " \t", "  \r\n"]) for w in t) for t in words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = [t.split() for t in texts]
    got = {r.doc_id: r for r in lempel.lempel_ziv_dedup(docs, 15, block_bytes=3000).collect()}
    for k, (w, g) in enumerate(zip(split, brute(split, 15), strict=True)):
        kept = " ".join(x for i, x in enumerate(w) if i not in g).encode()
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (len(w), len(g), hashlib.sha256(kept).hexdigest())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.substring_dedup(docs).count() == 0
    assert lempel.lempel_ziv_dedup(docs).count() == 0


def test_chunks_of_long_texts(monkeypatch):
    from strandline.llm import repeats

    rng = np.random.default_rng(5)
    text = rng.integers(0, 3, 5000).astype(np.uint64)
    whole = repeats.block_entries([text], 20)
    starts = lambda rows: {int(a) + k for a, m in zip(rows["at"], rows["more"], strict=True) for k in range(m + 1)}
    found = [repeats.entries_of(s, b, repeats.Geometry(20))[0] for s, b, _, _ in repeats.chunks([text], 20, most=300)]
    offsets = [st[0] for _, _, _, st in repeats.chunks([text], 20, most=300)]
    assert starts(whole) == set(range(4981)) == {x + int(o) for rows, o in zip(found, offsets, strict=True) for x in starts(rows)}


def test_greedy_factors():
    block = lempel.ReferenceBlock([b"a b c d e f", b"x b c d e y", b"b c d"])
    assert block.parse(0) == [(0, -1, 0), (1, 7, 4), (5, -1, 0)]
    assert block.factors(0, 3) == [(1, 7, 4)]
    assert [(i, n) for i, _, n in block.factors(2, 3)] == [(0, 3)]


@pytest.mark.parametrize("seed", range(6))
def test_phrases_rebuild_the_pieces_and_long_factors_are_the_repeated_windows(seed):
    """Every phrase stands elsewhere in the block, is as long as can be, and together they give the text back."""
    pieces = [x for x in corpus(seed, ["a", "b", "cc"][: 2 + seed % 2] + ["d"] * (seed % 3 == 0), n=25, most=60)]
    block = lempel.ReferenceBlock([" ".join(p).encode() for p in pieces])
    flat = [w for p in pieces for w in p]
    elsewhere = lambda i, n: any(p[k : k + n] == flat[i : i + n] and int(block.edge[q]) + k != i for q, p in enumerate(pieces) for k in range(len(p) - n + 1))
    for k, piece in enumerate(pieces):
        at, rebuilt = int(block.edge[k]), []
        for i, source, n in block.parse(k):
            assert i == len(rebuilt) and (source == at + i) is False
            rebuilt += flat[source : source + n] if n else [piece[i]]
            assert i + n == len(piece) or not elsewhere(at + i, n + 1)
        assert rebuilt == piece
    for width in (3, 8, 20):
        gone = brute(pieces, width)
        for k, flag in enumerate(lempel.matches([" ".join(p).encode() for p in pieces], width)):
            assert {i + j for i in np.flatnonzero(flag).tolist() for j in range(width)} == gone[k]


def test_without_long_factors_nothing_is_removed(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "same words in both texts " * 20 + str(k)) for k in range(2)], "doc_id long, text string")
    assert {r.n_removed for r in lempel.lempel_ziv_dedup(docs, 15).collect()} == {100}
    monkeypatch.setattr(lempel.ReferenceBlock, "factors", lambda self, piece, width: [])
    flags = lempel.matches([b"a b c", b"a b c"], 2)
    assert [f.tolist() for f in flags] == [[False, False]] * 2
