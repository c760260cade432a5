"""Collocations and the sort that counts them, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import collocations


def pieces(text):
    lowered = (text or "").encode().lower().decode()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
        yield re.findall(r"[^\x20\x09]+", piece)


def expected(rows, least, best):
    """Rows of (lang, text) to the rows that `collocations` gives."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for size in range(1, 5):
                counts[lang].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, own in counts.items():
        ranked = []
        candidates = {p: f for p, f in own.items() if len(p) > 1 and f >= least}
        for phrase, a in candidates.items():
            inside = lambda longer: any(
                longer[i : i + len(phrase)] == phrase for i in range(len(longer) - len(phrase) + 1)
            )
            if any(len(p) > len(phrase) and 100 * f >= 80 * a and inside(p) for p, f in candidates.items()):
                continue
            cuts = [(2000000 * a // (own[phrase[:k]] + own[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def phrased():
    """Texts with a hot word, a hot pair, phrases inside phrases, ties, overlaps, and words of every kind."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünï", "ünï", "ÿ", "\x00", "a" * 500, "one-two", "π"]
    rows = []
    for i in range(300):
        words = [rng.choice(("is", "on", "IS", "is on", rng.choice(vocabulary))) for _ in range(rng.randint(0, 60))]
        if i % 2:
            words.insert(rng.randint(0, len(words)), "New York City hall")
        if i % 3 == 0:
            words.insert(0, "x x x x x x x")
        text = "".join(word + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", "; ")) for word in words)
        rows.append((("en", "de", None, "und")[i % 4], text))
    return rows + [("en", None), (None, None), ("fr", ""), ("fr", " . , "), ("it", "solo"), rows[5], rows[5]]


@pytest.mark.parametrize("hot, best", [(200_000, 2000), (60, 15)])
def test_collocations(spark, phrased, monkeypatch, hot, best):
    monkeypatch.setattr(collocations, "HOT", hot)
    monkeypatch.setattr(collocations, "SORTED", 700)
    monkeypatch.setattr(collocations, "BLOCK_TOKENS", 900)
    monkeypatch.setattr(collocations, "COUNTED", 50)
    df = spark.createDataFrame(phrased, "lang string, text string").repartition(4)
    df = df.selectExpr("*", "1 as a", "2 as rank", "'n' as phrase", "3 as id", "4 as f")
    rows = found(collocations.collocations(df, 12, best))
    want = expected(phrased, 12, best)
    assert rows == want and {r[0] for r in want} == {"en", "de", "und"} and len(want) > 60 / (1 + (best < 2000))


def test_corpus(docs, rows):
    assert found(collocations.collocations(docs, 5)) == expected([(r[2], r[1]) for r in rows], 5, 2000)


def test_nothing(nothing):
    assert collocations.collocations(nothing).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_quicksort(seed):
    """Partition sizes are the weighted counts of all prefixes; only prefixes of hot words alone go below the limit."""
    rng = np.random.default_rng(seed)
    suffixes = rng.zipf(1.6, (4, 4000)).astype(np.uint64) % np.uint64(50)
    for k in range(1, 4):
        suffixes[k][suffixes[k - 1] == 0] = 0
    weights = rng.integers(1, 4, 4000).astype(np.uint64)
    hot = np.array([1, 2], np.uint64) if seed % 2 else np.empty(0, np.uint64)
    counts = Counter()
    for suffix, weight in zip(suffixes.T.tolist(), weights.tolist()):
        for size in range(1, 5):
            if suffix[size - 1]:
                counts[tuple(suffix[:size])] += weight
    want = {p: f for p, f in counts.items() if f >= 25 or set(p) <= set(hot.tolist())}
    got = Counter()
    for depth, words, sizes in collocations.quicksorted(suffixes, weights, hot, 25):
        assert words.shape == (depth, len(sizes))
        for phrase, size in zip(words.T.tolist(), sizes.tolist()):
            assert tuple(phrase) not in got
            got[tuple(phrase)] = size
    assert got == want


def test_large_counts_are_exact(spark):
    phrases = spark.createDataFrame([([1, 2], 4 * 10**15)], "phrase array<long>, f long")
    words = spark.createDataFrame([(1, 5 * 10**15 + 1), (2, 4 * 10**15 + 7)], "id long, f long")
    (row,) = collocations._cuts(phrases, words).collect()
    assert row.score == 2000000 * 4 * 10**15 // (9 * 10**15 + 8)
