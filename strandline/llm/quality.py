"""Quality rules by weak supervision.

Every rule looks at counts of one text and votes good (1), bad (-1) or abstains (0). How far a vote can be trusted is
estimated, not set: expectation-maximisation over the counts of all vote patterns of all documents finds, for each rule,
how often it approves of good texts and of each kind of bad texts (Dawid and Skene, 1979). Several rules look at the same
kind of evidence in different ways, so that one rule's objection can be outvoted by the others, and weak objections add
up. A document's posterior probability of being good decides, instead of "all rules must pass".

Defined cases: a null or blank text has no words and no lines, fails the base rule, and its rules abstain but
for the length rule. Equal rows get equal votes; nothing depends on the order of rows. Extra columns pass through;
the columns that the operator adds replace input columns of the same name. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import apart, small_batches

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = b"0123456789"
LETTERS_UP = UPPER + LOWER + bytes(range(0x80, 0x100))
MARKS = b"!?"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Kinds of bad texts, and the rules that look for each.
KINDS = {
    "shape": ["length", "word_length"],
    "symbols": ["symbols", "marked_words", "letters", "wordless"],
    "repetition": ["repeated_lines", "repeated_words", "top_word"],
    "shouting": ["capitals", "marks"],
}
RULES = [r for rules in KINDS.values() for r in rules]
N_COUNTS = 13
BLANKED = bytes(c if c in SPACES else 97 if c in LETTERS_UP else 35 if c in SYMBOLS else 46 for c in range(256))

@dataclass(frozen=True)
class Thresholds:
    """(bad beyond, good within) of each rule; between them it abstains."""

    words: tuple[int, int] = (10, 30)
    word_chars: tuple[float, float, float, float] = (2.0, 3.0, 12.0, 15.0)
    symbols: tuple[float, float] = (0.10, 0.02)
    dup_lines: tuple[float, float] = (0.30, 0.10)
    repeat_words: tuple[float, float] = (0.20, 0.05)
    capitals: tuple[float, float] = (0.50, 0.25)
    marks: tuple[float, float] = (0.20, 0.05)
    letters: tuple[float, float] = (0.75, 0.85)
    marked_words: tuple[float, float] = (0.10, 0.02)
    wordless: tuple[float, float] = (0.20, 0.05)
    top_word: tuple[float, float] = (0.30, 0.15)


def word_ids(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def repeated_words(ids: np.ndarray, width: int = 5) -> int:
    """How many words lie in a window of `width` words that occurs at least twice in the text."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    # Ids of ever longer windows: exact, as a pair of ids is one number below 2**63.
    code, have = ids, 1
    while have < width:
        step = min(have, width - have)
        left, right = code[: len(code) - step], code[step:]
        pairs = left * (int(code.max()) + 1) + right
        code, have = np.unique(pairs, return_inverse=True)[1], have + step
    twice = np.bincount(code)[code] > 1
    if not twice.any():
        return 0
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + width, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def counts_of(text: bytes | None) -> tuple[int, ...]:
    """COUNTS, then (lines with a word, letters, capitals, marks, cased letters, words with a symbol, words without a letter,
    places of the most frequent word) of one UTF-8 text."""
    if not text:
        return (0,) * N_COUNTS
    words = text.split()
    ids = word_ids(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = len(text.translate(None, CONTINUATION + SPACES))
    size = len(text)
    capitals = size - len(text.translate(None, UPPER))
    cased = capitals + size - len(text.translate(None, LOWER))
    letters = cased + size - len(text.translate(None, bytes(range(0xC0, 0x100))))
    symbols = size - len(text.translate(None, SYMBOLS))
    plain = text.translate(BLANKED).split()
    return (
        len(words), chars, symbols, len(lines) - len(set(lines)), repeated_words(ids),
        len(lines), letters, capitals, size - len(text.translate(None, MARKS)), cased,
        sum(b"#" in w for w in plain) if symbols else 0, sum(b"a" not in w for w in plain), int(np.bincount(ids).max()) if words else 0,
    )


def votes_of(c: np.ndarray, t: Thresholds) -> np.ndarray:
    """Votes (rows x RULES, int8) from the counts (rows x N_COUNTS)."""
    words, chars, symbols, dups, repeats, lines, letters, capitals, marks, cased, marked, wordless, top = c.T.astype(float)

    def upper(x, bad_good, asked):
        bad, good = bad_good
        return np.where(~asked, 0, np.where(x > bad, -1, np.where(x <= good, 1, 0)))

    per = lambda a, b: a / np.maximum(b, 1)
    some = words > 0
    mean = per(chars, words)
    low, fine_low, fine_high, high = t.word_chars
    votes = {
        "length": np.where(words < t.words[0], -1, np.where(words >= t.words[1], 1, 0)),
        "word_length": np.where(~some, 0, np.where((mean < low) | (mean > high), -1, np.where((mean >= fine_low) & (mean <= fine_high), 1, 0))),
        "symbols": upper(per(symbols, words), t.symbols, some),
        "marked_words": upper(per(marked, words), t.marked_words, some),
        "letters": np.where(~some, 0, np.where(per(letters, chars) < t.letters[0], -1, np.where(per(letters, chars) >= t.letters[1], 1, 0))),
        "wordless": upper(per(wordless, words), t.wordless, some),
        "repeated_lines": upper(per(dups, lines), t.dup_lines, lines > 1),
        "repeated_words": upper(per(repeats, words), t.repeat_words, words >= 10),
        "top_word": upper(per(top, words), t.top_word, words >= 10),
        "capitals": upper(per(capitals, cased), t.capitals, cased >= 20),
        "marks": upper(per(marks, words), t.marks, some),
    }
    return np.stack([votes[r] for r in RULES], axis=1).astype(np.int8)


def codes_of(votes: np.ndarray) -> np.ndarray:
    """One number below 3**len(RULES) for each vote pattern."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(len(RULES), dtype=np.int64))


def patterns(codes: np.ndarray) -> np.ndarray:
    """The votes (rows x RULES) of each code."""
    return (np.asarray(codes, dtype=np.int64)[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1).astype(np.int8)


def measured(batches: Iterator[pd.DataFrame], t: Thresholds) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for pdf in batches:
        rows = [counts_of(x) for x in pdf["_bytes"]]
        yield pdf, np.array(rows, dtype=np.int64).reshape(-1, N_COUNTS)


def pattern_counts(docs: DataFrame, text: str, t: Thresholds) -> DataFrame:
    """(code, n): how many documents have each vote pattern; one row a task and pattern is shuffled."""

    def count(batches):
        total = np.zeros(3 ** len(RULES), dtype=np.int64)
        for _, c in measured(batches, t):
            total += np.bincount(codes_of(votes_of(c, t)), minlength=len(total))
        found = np.flatnonzero(total)
        yield pd.DataFrame({"code": found, "n": total[found]})

    each = small_batches(docs).select(F.col(text).cast("binary").alias("_bytes")).mapInPandas(count, "code long, n long")
    return each.groupBy("code").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LabelModel:
    classes: np.ndarray  # share of each latent class; the first is the good one, then KINDS
    approve: np.ndarray  # classes x rules: P(vote is good | class, the rule votes)
    posterior: np.ndarray  # P(good) by pattern code
    accuracy: dict[str, float]  # P(a vote is right | the rule votes)


#: Where EM starts, and what stands in for documents where there are none: shares of the classes, and how often a rule
#: approves of a text of its own kind of bad texts and of all others. It weighs as many documents as this.
GOOD, OWN, OTHER, PSEUDO = 0.8, 0.3, 0.9, 5.0


def likelihoods(votes: np.ndarray, classes: np.ndarray, approve: np.ndarray) -> np.ndarray:
    """P(class | votes) for each row of votes; an abstention says nothing."""
    score = np.log(classes) + (votes == 1) @ np.log(approve).T + (votes == -1) @ np.log1p(-approve).T
    p = np.exp(score - score.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def fit(codes: np.ndarray, n: np.ndarray, rounds: int = 2_000) -> LabelModel:
    """EM over pattern counts. At most 3**len(RULES) patterns exist, whatever the number of documents.

    Bad texts are of several kinds that have little in common (shouting, symbol soup, repetition), so the bad side of the
    model is a mixture of KINDS. What tells the kinds apart is where EM starts: a rule objects to most texts of its own kind
    and to few others. That start counts as PSEUDO documents a class and is forgotten on any real corpus. Without documents
    every pattern keeps it.
    """
    every = patterns(np.arange(3 ** len(RULES)))
    votes, weight = patterns(codes), n.astype(float)
    start = np.array([GOOD] + [(1 - GOOD) / len(KINDS)] * len(KINDS))
    prior = np.array([[OWN if r in rules else OTHER for r in RULES] for rules in ([], *KINDS.values())])
    classes, approve, p = start, prior, None
    up, voted = (votes == 1).astype(float), (votes != 0).astype(float)
    for _ in range(rounds if weight.sum() else 0):
        new = likelihoods(votes, classes, approve)
        done = p is not None and np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
        w = weight[:, None] * p
        classes = (w.sum(axis=0) + PSEUDO * start) / (weight.sum() + PSEUDO)
        approve = (w.T @ up + PSEUDO * prior) / (w.T @ voted + PSEUDO)
    good = weight * (p[:, 0] if p is not None else 0)
    right = (good @ up + (weight - good) @ (voted - up)) / np.maximum(weight @ voted, 1e-9)
    return LabelModel(classes, approve, likelihoods(every, classes, approve)[:, 0], dict(zip(RULES, np.round(right, 4).tolist(), strict=True)))


def learn(docs: DataFrame, text: str = "text", thresholds: Thresholds = Thresholds()) -> LabelModel:
    """The label model of all documents. What reaches the driver is at most 3**len(RULES) small rows."""
    found = pattern_counts(docs, text, thresholds).toPandas().sort_values("code")
    return fit(found["code"].to_numpy(), found["n"].to_numpy())


@apart
def judge(docs: DataFrame, model: LabelModel, text: str = "text", thresholds: Thresholds = Thresholds(), keep_at: float = 0.5) -> DataFrame:
    """docs with COUNTS, base_failed, votes, quality (posterior) and kept. No shuffle."""
    posterior = model.posterior
    added = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, votes array<int>, quality double, kept boolean"
    names = [x.split()[0] for x in added.split(", ")]
    # The text goes to Python and back once, as bytes.
    left = [c for c in docs.columns if c not in names]
    source = small_batches(docs).select(*[F.col(f"`{c}`") for c in left if c != text], F.col(text).cast("binary").alias("_bytes"))
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in left if c != text) + "_bytes binary"

    def run(batches):
        for pdf, c in measured(batches, thresholds):
            votes = votes_of(c, thresholds)
            out = pdf.copy(deep=False)
            for k, name in enumerate(COUNTS):
                out[name] = c[:, k]
            out["base_failed"] = (c[:, 0] < 10) | (100 * c[:, 4] > 20 * c[:, 0])
            out["votes"] = list(votes.astype(np.int32))
            out["quality"] = posterior[codes_of(votes)]
            out["kept"] = ~out["base_failed"] & (out["quality"] >= keep_at)
            yield out

    judged = source.mapInPandas(run, f"{schema}, {added}")
    return judged.select(*[F.col("_bytes").cast("string").alias(text) if c == text else F.col(f"`{c}`") for c in left], *names)


def quality_filter(docs: DataFrame, text: str = "text", thresholds: Thresholds = Thresholds(), keep_at: float = 0.5) -> DataFrame:
    """Learn from all documents, then judge each."""
    return judge(docs, learn(docs, text, thresholds), text, thresholds, keep_at)
