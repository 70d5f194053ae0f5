"""Near-duplicate classes by Order MinHash (Marcais et al., 2019), verified by banded alignment.

A document is the sequence of its shingles (five words each; a shorter text is one shingle), each labelled with its
occurrence number, so that labels are unique in a text. A sketch holds, for each of `bands` hash functions, the `picks`
smallest labelled shingles *in the order of the text*; two texts are candidates if one of these vectors is equal in both.
With 4 picks and 20 bands a pair of similarity 0.8 is missed with a probability of about (1 - 0.8**4)**20 < 3e-5. Texts of
up to SHORT shingles also have a key for each deletion of one shingle, as few shingles give few different picks.

Candidates are verified by alignment: matching labels within a diagonal band that is wide enough for any pair of the
asked similarity, and the longest chain of them that is increasing in both texts. Similarity is
chain / (shingles of a + shingles of b - chain), at least `similarity`.

No group is expanded into pairs. Texts with equal words are one node. In each bucket every node is compared with the
most central one (whose buckets hold most nodes, which a copy with few edits has). The links' connected components are
found by min-label propagation over written tables. In buckets that hold several components, nodes of different
components meet by what they have more or less than the centre, or by their own rarest labels (`meetings`): by prefixes,
which leave out no pair; texts with the same labels in another order meet by sketches that follow the order. Of those that
meet, pairs whose finer sketches disagree are not aligned. Nothing caps the number of partners, rounds or candidates.

Defined cases: a null text or one without words is a class of its own. Repeated rows are copies of each other. The class
of a document is the smallest id in it. Extra columns are ignored here. An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import apart, cut, small_batches, stored
from strandline.llm.lempel import symbols
from strandline.llm.repeats import mixed

WORDS, SIMILARITY, BANDS, PICKS = 5, 0.8, 20, 4
#: A finer sketch of nodes that meet again: bands, of each of which 8 bits are kept, and how many must agree. A pair at the
#: limit agrees in a band with 0.33 (in short texts) to 0.41, in 64 bands 21 times or more on average; AGREE is 3.5 standard
#: deviations below that.
FINE_BANDS, AGREE = 64, 8
BIT_WORDS = FINE_BANDS // 8
#: Picks of a band where texts may have the same shingles in another order: chance agreement is one in 8! then.
TURN_PICKS = 8
#: Texts of up to so many shingles have deletion keys.
SHORT = 15
#: Over how many tasks the rows of one component are dealt, and rows of one node beyond which it counts as heavy.
SALTS, HEAVY_ROWS = 16, 10_000
U = np.uint64
ODD = U(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each shingle in text order, the same labelled with its occurrence number)."""
    w = symbols(text or b"")
    if not len(w):
        return w, w
    size = min(words, len(w))
    plain = np.zeros(len(w) - size + 1, dtype=U)
    for k in range(size):
        plain = mixed(plain * ODD + w[k : k + len(plain)])
    order = np.argsort(plain, kind="stable")
    ordered = plain[order]
    head = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    place = np.arange(len(plain))
    nth = np.empty(len(plain), dtype=U)
    nth[order] = (place - np.maximum.accumulate(np.where(head, place, 0))).astype(U)
    return plain, np.where(nth == 0, plain, mixed(plain + nth * ODD))


def constants(bands: int) -> tuple[np.ndarray, np.ndarray]:
    """(xor, odd factor) of each band's order."""
    x = mixed(np.arange(1, 2 * bands + 1, dtype=U) * ODD)
    return x[:bands, None], x[bands:, None] | U(1)


def sketch(plain: np.ndarray, labelled: np.ndarray, bands: int = BANDS, picks: int = PICKS) -> np.ndarray:
    """One number for each band: the smallest labelled shingles in text order."""
    flip, factor = constants(bands)
    n = len(plain)
    if n <= picks:
        least = np.broadcast_to(np.arange(n), (bands, n))
    else:
        # Long texts go band by band, so that the table of orders stays small.
        step = max(1, 2_000_000 // n)
        parts = []
        for k in range(0, bands, step):
            order = (labelled[None, :] ^ flip[k : k + step]) * factor[k : k + step]
            parts.append(np.argpartition(order ^ (order >> U(32)), picks - 1, axis=1)[:, :picks])
        least = np.sort(np.concatenate(parts), axis=1)
    value = np.arange(1, bands + 1, dtype=U)
    for k in range(least.shape[1]):
        value = mixed(value * ODD + plain[least[:, k]])
    return value


def deletions(plain: np.ndarray, most: int = SHORT) -> np.ndarray:
    """Keys of a short text's shingles, whole and without each one: texts that differ by one shingle share one.

    Fewer than four shingles have no other similar text than an equal one.
    """
    n = len(plain)
    if not 4 <= n <= most:
        return np.zeros(0, dtype=U)
    keys = []
    for k in range(n + 1):
        value = np.zeros(1, dtype=U)
        for x in np.delete(plain, k) if k < n else plain:
            value = mixed(value * ODD + x)
        keys.append(value)
    return np.unique(np.concatenate(keys))


def chain(at: np.ndarray, to: np.ndarray) -> int:
    """Longest increasing chain of matches, given in the order of `at`."""
    if len(to) < 2 or (np.diff(to) > 0).all():
        return len(to)
    tails: list[int] = []
    for x in to.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """Similarity of two sequences of unique labels by banded alignment; below `similarity` it may be an upper bound."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < similarity * max(n, m):
        return min(n, m) / max(n, m, 1)
    _, at, to = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at) < similarity * (n + m - len(at)):
        return len(at) / (n + m - len(at))
    # A pair of this similarity leaves at most so many shingles out, and no match of its chain is farther off the diagonal.
    band = (1 - similarity) / (1 + similarity) * (n + m)
    near = np.abs(at - to) <= band
    order = np.argsort(at[near], kind="stable")
    found = chain(at[near][order], to[near][order])
    return found / (n + m - found)


def sketches(docs: DataFrame, text: str, doc: str, words: int, bands: int, picks: int) -> DataFrame:
    """(doc, h, node, sketch): h is a hash of the text, node one of its words; null without words."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            out = []
            for t in pdf["_text"]:
                plain, labelled = shingles(t, words)
                if not len(plain):
                    out.append((None, None))
                    continue
                node = mixed(np.array([np.bitwise_xor.reduce(mixed(plain + np.arange(1, len(plain) + 1, dtype=U) * ODD))], dtype=U) + U(len(plain)))
                keys = np.concatenate([sketch(plain, labelled, bands, picks), deletions(plain)])
                out.append((int(node.view(np.int64)[0]), keys.view(np.int64)))
            yield pd.DataFrame({"_doc": pdf["_doc"], "h": pdf["h"], "node": pd.array([x[0] for x in out], dtype="Int64"), "sketch": [x[1] for x in out]})

    kind = docs.schema[doc].dataType.simpleString()
    return small_batches(docs).select(F.col(doc).alias("_doc"), F.col(text).cast("binary").alias("_text"), F.xxhash64(text).alias("h")).mapInPandas(run, f"_doc {kind}, h long, node long, sketch array<long>").withColumnRenamed("_doc", doc)


def compared(pairs: DataFrame, texts: DataFrame, words: int, run, schema: str) -> DataFrame:
    """`run(labels of a, labels of b, a, b)` gives the row of each pair (a, b), or None."""

    def each(batches):
        known: OrderedDict[int, np.ndarray] = OrderedDict()
        held = 0

        def labels(node: int, text: bytes) -> np.ndarray:
            nonlocal held
            if node in known:
                known.move_to_end(node)
                return known[node]
            known[node] = shingles(text, words)[1]
            held += len(known[node])
            while held > 4_000_000 and len(known) > 2:
                held -= len(known.popitem(last=False)[1])
            return known[node]

        names = [x.split()[0] for x in schema.split(", ")]
        for pdf in batches:
            rows = [r for a, b, s, t in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"], strict=True) if (r := run(labels(a, s), labels(b, t), a, b)) is not None]
            yield pd.DataFrame(rows, columns=names)

    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("body").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(each, schema)


def verified(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) that are similar."""
    return compared(pairs, texts, words, lambda x, y, a, b: (a, b) if aligned(x, y, similarity) >= similarity else None, "a long, b long")


def against_centre(pairs: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """pairs (node, centre) with what a node deviates from its centre by.

    size is the number of labels that only one of them has; `unlike` says that these are too many for the similarity,
    `far` that they are too many even for a node that is similar to one that is similar to the centre. Labels that the
    centre has and the node lacks are flipped, so that lacking one is another label than having it. labels are these,
    if the node is not far; marks is the node's own finer sketch.
    """
    r = (1 - similarity) / (1 + similarity)

    def each(x: np.ndarray, c: np.ndarray, node: int, centre: int) -> tuple:
        more, less = np.setdiff1d(x, c, assume_unique=True), np.setdiff1d(c, x, assume_unique=True)
        labels = np.concatenate([more, ~less])
        size = len(labels)
        similar = aligned(x, c, similarity) >= similarity
        unlike = size > r * (len(x) + len(c)) + 1e-6
        far = size > 2 * (1 - similarity) * (len(x) + len(less)) + 1e-6
        marks = sketch(x, x, FINE_BANDS).astype(np.uint8).view(np.int64)
        return node, centre, similar, unlike, far, size, len(x), len(c), None if far else labels.tobytes(), marks

    schema = "node long, centre long, similar boolean, unlike boolean, far boolean, size long, n long, nc long, labels binary, marks array<long>"
    return compared(pairs.select(F.col("node").alias("a"), F.col("centre").alias("b")), texts, words, each, schema)


def prefixes(sets: DataFrame) -> DataFrame:
    """The rows (centre, label, node, d, need, ...) of each set's prefix: two sets with max(need) labels in common share one.

    The order of labels is from rare to common, so that most of a prefix are labels that no other set has. place is the
    label's place in its set's order: what two sets have in common from their first common label on is at most what is left
    of either.
    """
    counted = sets.groupBy("centre", "label").agg(F.count("*").alias("f")).where("f > 1")
    met = sets.join(counted, ["centre", "label"])
    by = Window.partitionBy("centre", "node")
    placed = met.withColumn("nth", F.row_number().over(by.orderBy("f", F.xxhash64("label"), "label"))).withColumn("shared", F.count("*").over(by))
    # The d - shared labels that no other set has come first.
    return placed.withColumn("place", F.col("nth") + F.col("d") - F.col("shared")).where("place <= d - need + 1").drop("f", "nth", "shared")


def unpacked(sets: DataFrame) -> DataFrame:
    """One row (label) for each of the 64-bit numbers in `labels`."""
    names = [c for c in sets.columns if c != "labels"]

    def run(batches):
        for pdf in batches:
            each = [np.frombuffer(v, dtype=np.int64) for v in pdf["labels"]]
            counts = np.array([len(x) for x in each], dtype=np.int64)
            for a in range(0, len(each), 1_000):
                rows = pdf[names].iloc[a : a + 1_000]
                rows = rows.iloc[np.repeat(np.arange(len(rows)), counts[a : a + 1_000])]
                yield rows.assign(label=np.concatenate(each[a : a + 1_000]))

    return sets.select(*names, "labels").mapInPandas(run, ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in names) + ", label long")


def of_texts(nodes: DataFrame, texts: DataFrame, words: int, numbers) -> DataFrame:
    """nodes (node, ...) with labels: `numbers` of their texts' labels, as bytes."""
    names = nodes.columns

    def run(batches):
        for pdf in batches:
            yield pdf[names].assign(labels=[numbers(shingles(t, words)[1]).tobytes() for t in pdf["body"]])

    schema = ", ".join(f"{c} {nodes.schema[c].dataType.simpleString()}" for c in names) + ", labels binary"
    return nodes.join(texts, "node").select(*names, "body").mapInPandas(run, schema)


def meetings(seen: DataFrame, texts: DataFrame, similarity: float, words: int) -> DataFrame:
    """(centre, label, node, root, d, n, asks, answers, place): groups in which nodes of one bucket that can be similar meet.

    seen: rows of `against_centre`, with roots, of nodes that are not yet in their centre's component, or share a bucket with
    one that is not. Let x and y be similar, s the similarity and r = (1 - s) / (1 + s). What x and y have more or less than
    the centre c are sets X and Y, and |X ^ Y|, the labels that only one of x and y has, is at most r (|x| + |y|).

    - Both are unlike their centres: then these say little, and all such nodes meet by their own labels, in a prefix filter
      (centre 0). The rarest labels come first, so that texts that share all but what is their own do not meet.
    - x is not unlike c, y is: |X & Y| >= (|X| + |Y| - r (|x| + |y|)) / 2, and |Y| > r (|y| + |c|) bounds this from below for
      each of them alone, so that they meet in a prefix filter, which leaves out no pair. y is not far from c.
    - Neither is unlike c, and x has its labels in another order: their deviations may have nothing in common. Such nodes
      meet by FINE_BANDS bands of TURN_PICKS picks in the order of the text, which other orders hardly ever share, and two
      texts of this similarity do with 1 - (1 - s**8)**64 or more, all but 1e-5.
    """
    r = (1 - similarity) / (1 + similarity)
    columns = ["centre", "label", "node", "root", "d", "n", "asks", "answers", "place"]
    yes, long = F.lit(True), lambda k: F.lit(k).cast("long")
    alone = seen.where("unlike").select("node", "root", "n").distinct()
    own = alone.select(long(0).alias("centre"), "node", "root", F.col("n").alias("d"), F.ceil(F.col("n") * similarity - 1e-6).cast("long").alias("need"), "n", yes.alias("asks"), yes.alias("answers"))
    own = of_texts(own, texts, words, lambda x: x)

    # Only centres that have both kinds, and x with a label more or less than c.
    pairing = seen.where("NOT (unlike AND far) AND size > 0")
    kinds = pairing.groupBy("centre").agg(F.max("unlike").alias("u"), F.min("unlike").alias("v")).where("u AND NOT v").select("centre")
    bound = F.when(F.col("unlike"), F.col("size") - r * (F.col("n") + F.col("nc")) + (1 - r)).otherwise(F.col("size") + r * (F.col("nc") - F.col("n"))) / 2
    need = F.greatest(F.lit(1), F.ceil(bound - 1e-6)).cast("long")
    deviating = pairing.join(kinds, "centre", "left_semi").select("centre", "node", "root", F.col("size").alias("d"), need.alias("need"), "n", F.col("unlike").alias("asks"), (~F.col("unlike")).alias("answers"), "labels")

    # The centre's labels in another order.
    turned = seen.where("NOT similar AND NOT unlike").select("centre").distinct()
    wild = seen.where("NOT unlike").join(turned, "centre", "left_semi").select("centre", "node", "root", F.col("size").alias("d"), "n", (~F.col("similar")).alias("asks"), yes.alias("answers"))
    wild = unpacked(of_texts(wild, texts, words, lambda x: sketch(x, x, FINE_BANDS, TURN_PICKS))).withColumn("place", F.lit(None).cast("long"))
    # The sets of both kinds go through one filter: no centre is 0.
    return prefixes(unpacked(own.unionByName(deviating))).select(*columns).unionByName(wild.select(*columns))


def agreeing() -> Column:
    """Of two rows x and y with marks: whether enough of the finer sketches' bytes are equal. Short texts have too few picks."""
    differ = F.lit(0)
    for k in range(BIT_WORDS):
        bits = F.get("x.marks", F.lit(k)).bitwiseXOR(F.get("y.marks", F.lit(k)))
        for shift in (4, 2, 1):
            bits = bits.bitwiseOR(F.call_function("shiftrightunsigned", bits, F.lit(shift)))
        differ = differ + F.bit_count(bits.bitwiseAND(F.lit(0x0101010101010101)))
    return (F.least("x.n", "y.n") <= SHORT) | (FINE_BANDS - differ >= AGREE)


def spread_key(salts: int) -> Column:
    """A salt by node, so that the rows of one large component are dealt over several tasks."""
    return F.pmod(F.xxhash64("node", F.lit("salt")), F.lit(salts))


def components(links: DataFrame, salts: int = SALTS) -> DataFrame:
    """(node, root) of every node of links (a, b): the smallest node of its connected component.

    Labels go to the neighbours, and every node then takes its root's root, which halves long chains. Only roots that
    have moved are joined for the second step, once for each salt, as one root may be that of most nodes.
    """
    ends = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    state = cut(ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root")))
    while True:
        moved = state.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("next"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"))
        offered = ends.join(state.select(F.col("node").alias("b"), "root"), "b").select(F.col("a").alias("node"), "root", F.lit(None).cast("long").alias("was"))
        nearer = state.select("node", "root", F.col("root").alias("was")).unionByName(offered).groupBy("node").agg(F.max("was").alias("was"), F.min("root").alias("root"))
        new = cut(nearer.withColumn("salt", spread_key(salts)).join(moved, ["root", "salt"], "left").select("node", "was", F.least("root", "next").alias("root")))
        changed = new.where("root <> was").limit(1).count()
        state = new.select("node", "root")
        if not changed:
            return state


def merged(root: DataFrame, found: DataFrame) -> DataFrame:
    """root (node, root) after further links (a, b): components of components, which are few."""
    ends = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    # A root is the smallest node of its component, so that a node that is its own root loses to the one it has.
    known = cut(root.unionByName(ends.select("node", F.col("node").alias("root"))).groupBy("node").agg(F.min("root").alias("root")))
    of = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    links = found.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).where("a <> b")
    joined = components(links).select(F.col("node").alias("root"), F.col("root").alias("further"))
    return known.join(joined, "root", "left").select("node", F.coalesce("further", "root").alias("root"))


def near_copies(docs: DataFrame, text: str = "text", doc: str = "doc_id", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, picks: int = PICKS) -> DataFrame:
    """(doc, h, class_id, keeper): one row for each document; keeper is true on the rows of the class's first document."""
    rows = cut(sketches(docs, text, doc, words, bands, picks))
    first = F.min(F.when(F.col(doc).isNotNull(), F.struct(F.col(doc).alias("doc"), "h"))).alias("first")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min_by("sketch", doc).alias("sketch"), first).where("first IS NOT NULL")
    keyed = nodes.select("node", "first", F.explode("sketch").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # (key, node, first, n) of nodes that share a bucket; all later steps work on this.
    shared = cut(keyed.join(buckets, "key").select("key", "node", "first", "n"))
    if not shared.limit(1).count():
        return classed(rows, None, doc)
    # A node is central if its buckets are full: copies with many edits share few.
    members = cut(shared.groupBy("node").agg(F.sum("n").alias("score"), F.min("first").alias("first")))
    # Rows may have one id and several texts: the hash picks the right one.
    source = docs.select(F.col(doc).alias("d"), F.xxhash64(text).alias("h"), F.col(text).cast("binary").alias("body"))
    wanted = members.select("node", F.col("first.doc").alias("d"), F.col("first.h").alias("h"))
    texts = stored(source.join(wanted, ["d", "h"]).select("node", "body").dropDuplicates(["node"]))
    placed = shared.select("key", "node").join(members.select("node", "score"), "node")
    centres = placed.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("centre"))
    starred = cut(placed.select("key", "node").join(centres, "key"))
    seen = stored(against_centre(starred.where("node <> centre").select("node", "centre").distinct(), texts, similarity, words))
    links = seen.where("similar").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    root = components(links)
    rooted = lambda df: df.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    at = rooted(starred)
    divided = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = cut(at.join(divided, "key", "left_semi").where("node <> centre").select("node", "centre", "root").distinct())
    if open_.limit(1).count():
        # Buckets that hold several components: nodes meet by what they have more or less than the centre.
        met_again = cut(seen.join(open_, ["node", "centre"]))
        marks = met_again.select("node", "marks").dropDuplicates(["node"])
        groups = meetings(met_again, texts, similarity, words)
        groups = cut(groups.join(marks, "node"))
        x, y = groups.where("asks").alias("x"), groups.where("answers").alias("y")
        most = (1 - similarity) / (1 + similarity) * (F.col("x.n") + F.col("y.n")) + 1e-6
        near = (F.abs(F.col("x.n") - F.col("y.n")) <= most) & (F.col("x.root") != F.col("y.root")) & (F.abs(F.col("x.d") - F.col("y.d")) <= most)
        # Two that both ask meet once.
        once = (F.col("x.node") < F.col("y.node")) | ~(F.col("y.asks") & F.col("x.answers"))
        same = (F.col("x.centre") == F.col("y.centre")) & (F.col("x.label") == F.col("y.label"))
        # Two sets meet at their first common label, if anywhere: that and what is left of them must be enough in common.
        enough = F.least(F.col("x.d") - F.col("x.place"), F.col("y.d") - F.col("y.place")) + 1 >= (F.col("x.d") + F.col("y.d") - most) / 2
        met = x.join(y, same & near & once & F.coalesce(enough, F.lit(True)) & agreeing()).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        found = cut(verified(met, texts, similarity, words))
        if found.limit(1).count():
            root = merged(root, found)
    return classed(rows, root, doc)


def classed(rows: DataFrame, root: DataFrame | None, doc: str) -> DataFrame:
    """Class of each row from its node's root (null without words)."""
    each = F.min(F.when(F.col(doc).isNotNull(), F.struct(F.col(doc).alias("doc"), "h"))).alias("first")
    # Roots and classes are found on nodes, of which equal texts are one.
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(each, F.count("*").alias("n"))
    if root is not None:
        joined = nodes.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = joined.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("linked"))
        # A node without links is its own class; the others' roots are salted.
        salted = least.where("linked > 1").select("root", F.col("first").alias("least"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
        nodes = joined.withColumn("salt", spread_key(SALTS)).join(salted, ["root", "salt"], "left").withColumn("first", F.coalesce("least", "first"))
    nodes = cut(nodes.select("node", "first", "n"))
    # At most 1,000 nodes have this many rows: they are broadcast, so that no node's rows meet in one task.
    heavy = F.greatest(F.lit(HEAVY_ROWS), F.lit(int((nodes.agg(F.sum("n")).first()[0] or 0) / 1_000)))
    many = F.broadcast(nodes.where(F.col("n") > heavy).select("node", F.col("first").alias("of_many")))
    source = rows.select(doc, "h", "node").join(many, "node", "left")
    few = nodes.where(F.col("n") <= heavy).select("node", F.col("first").alias("of_few"))
    light = source.where("of_many IS NULL").join(few, "node", "left").withColumn("first", F.col("of_few"))
    joined = light.select(doc, "h", "first").unionByName(source.where("of_many IS NOT NULL").select(doc, "h", F.col("of_many").alias("first")))
    alone = F.col("first").isNull()
    keeper = alone | ((F.col("first.doc") == F.col(doc)) & (F.col("first.h") == F.col("h")))
    return joined.select(doc, "h", F.when(alone, F.col(doc)).otherwise(F.col("first.doc")).alias("class_id"), F.coalesce(keeper, F.lit(False)).alias("keeper"))


@apart
def keep_one(docs: DataFrame, text: str = "text", doc: str = "doc_id", **options) -> DataFrame:
    """docs with one document of each class, the one with the smallest id. Rows without words all stay."""
    keepers = near_copies(docs, text, doc, **options).where("keeper").select(F.col(doc).alias("_d"), F.col("h").alias("_h")).distinct()
    hashed = docs.withColumn("_h", F.xxhash64(text)).withColumn("_words", F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    same = F.col(f"`{doc}`").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_k"))
    found = hashed.where("_words").join(keepers.withColumnRenamed("_h", "_k"), same, "left_semi").dropDuplicates([doc, "_h"])
    return found.unionByName(hashed.where("NOT _words")).select(*docs.columns)
