import random

import numpy as np

from strandline.llm import nearcopies as nc


def jaccard(a, b, k=5):
    def grams(t):
        w = t.split()
        out, seen = set(), {}
        for i in range(max(1, len(w) - k + 1)) if w else ():
            g = tuple(w[i : i + k])
            seen[g] = seen.get(g, 0) + 1
            out.add((g, seen[g]))
        return out

    x, y = grams(a), grams(b)
    return len(x & y) / max(1, len(x | y))


def corpus(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 7)))
    texts = []
    for size in (6, 40, 200, 400, 900):
        for _ in range(4):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(6):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 60))):
                    copy[rng.randrange(size)] = word()
                texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_classes_equal_components_of_brute_force(spark):
    texts = corpus() + ["same words here", "same  words\nhere", "", None, "  "]
    rows = [(10 * k, t) for k, t in enumerate(texts)] + [(0, texts[0]), (0, "another text under a repeated id, quite long indeed")]
    got = nc.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if a and b and a.split() and b.split() and jaccard(a, b) >= 0.8:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    want = sorted((d, least[find(i)]) for i, (d, _) in enumerate(rows))
    assert sorted((r.doc_id, r.class_id) for r in got) == want
    kept = nc.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == len({find(i) for i in range(len(rows))})


def pieces(seed, families=20):
    """Families of near copies that share a middle part; among them pieces of one text, which have nothing that it lacks."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    middle = [word() for _ in range(120)]
    whole = [word() for _ in range(150)] + middle + [word() for _ in range(150)]
    texts = [whole]
    for k in range(families):
        base = whole[rng.randint(0, 150) : 270 + rng.randint(0, 150)]
        if k % 2:
            base = [word() for _ in range(rng.randint(10, 60))] + middle + [word() for _ in range(rng.randint(10, 60))]
        for _ in range(4):
            copy = list(base)
            for _ in range(3):
                copy[rng.randrange(len(copy))] = word()
            texts.append(copy)
    rng.shuffle(texts)
    return [" ".join(t) for t in texts]


def test_every_pair_of_a_bucket_counts(spark):
    for seed in (1, 2, 3):
        texts = pieces(seed)
        plain = [nc.shingles(t.encode()) for t in texts]
        keys = [int(nc.sketch(*p, bands=1, picks=1)[0]) for p in plain]
        root = list(range(len(texts)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for i in range(len(texts)):
            for j in range(i):
                if keys[i] == keys[j] and nc.aligned(plain[i][1], plain[j][1]) >= 0.8:
                    root[max(find(i), find(j))] = min(find(i), find(j))
        got = nc.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bands=1, picks=1).collect()
        # Labels of other buckets may link more; no pair of a bucket may be missing.
        where = {r.doc_id: r.class_id for r in got}
        assert [k for k in range(len(texts)) if where[k] != where[find(k)]] == []


def test_alignment():
    a = np.arange(100, dtype=np.uint64)
    assert nc.aligned(a, a) == 1
    b = a.copy()
    b[50:55] = np.arange(1000, 1005)
    assert nc.aligned(a, b) == 95 / 105
    # The same shingles in another order are not the same text.
    assert nc.aligned(a, np.concatenate([a[50:], a[:50]])) < 0.8
    rng = np.random.default_rng(1)
    for _ in range(50):
        x = rng.permutation(12)
        best = max(len(c) for m in range(4096) if (c := [v for k, v in enumerate(x) if m >> k & 1]) == sorted(c))
        assert nc.chain(np.arange(12), x) == best


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nc.near_copies(docs).count() == 0 and nc.keep_one(docs).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.node, r.root) for r in nc.components(links).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def verified_pairs(spark, monkeypatch, texts):
    """(number of pairs that are aligned after the stars, classes by id)."""
    seen = []
    real = nc.verified

    def counting(pairs, *args):
        seen.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(nc, "verified", counting)
    rows = nc.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sum(seen), {r.doc_id: r.class_id for r in rows}


def test_reordered_blocks_are_not_all_compared(spark, monkeypatch):
    rng = random.Random(3)
    blocks = [" ".join(f"b{k}w{j}" for j in range(12)) for k in range(20)]
    texts = [" ".join(rng.sample(blocks, 20)) for _ in range(200)]
    texts += [f"{t} tail end" for t in texts[:20]]
    n, classes = verified_pairs(spark, monkeypatch, texts)
    assert n <= 3 * len(texts)  # of 24,090 pairs
    assert all(classes[200 + k] == classes[k] for k in range(20)) and len(set(classes.values())) == 200


def test_variants_just_below_the_limit_are_not_all_compared(spark, monkeypatch):
    """A family in which every text has edits of its own, so that no two are similar, though each shares most with all."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for v in range(150):
        t = list(base)
        for at in rng.sample(range(0, 150, 8), 5):
            t[at] = f"v{v}x{at}"
        texts.append(" ".join(t))
    texts += [f"{t} z{k}" for k, t in enumerate(texts[:30])]
    n, classes = verified_pairs(spark, monkeypatch, texts)
    labels = [set(nc.shingles(t.encode())[1].tolist()) for t in texts]
    similar = lambda a, b: len(labels[a] & labels[b]) >= 0.8 * len(labels[a] | labels[b])
    links = [(a, b) for a in range(len(texts)) for b in range(a) if similar(a, b)]
    assert all(classes[a] == classes[b] for a, b in links) and n <= 5 * len(texts)
