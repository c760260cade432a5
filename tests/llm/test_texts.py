"""Near duplicates, repeats, decontamination, language model, toxicity and personal data, against plain Python."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, jaccard, lm, pii, repeats, suffixes, toxicity

# --- near duplicates


def expected_components(rows, percent=90, width=3):
    sets, ids = [], []
    for row in rows:
        own = (row[1] or "").encode().lower().split()
        width_ = min(width, len(own))
        sets.append(frozenset(tuple(own[i : i + width_]) for i in range(len(own) - width_ + 1)) if own else frozenset())
        ids.append(row[0])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i in range(len(rows)):
        least[root(i)].append(ids[i])
    out = Counter()
    for i in range(len(rows)):
        own = [x for x in least[root(i)] if x is not None]
        component = (min(own) if own else None) if sets[i] else ids[i]
        out[ids[i], len(sets[i]), component] += 1
    return out


@pytest.mark.parametrize("percent", [90, 80])
def test_near_duplicates(docs, rows, percent):
    found = jaccard.near_duplicates(docs, percent)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in found.collect())
    assert got == expected_components(rows, percent)


def test_near_duplicates_in_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "CLUSTER_SETS", 3)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 1)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs).collect())
    assert got == expected_components(rows)


@pytest.mark.parametrize("percent", [90, 80])
def test_linked_sets_share_keys(percent):
    """Subsets and blocks: whenever two sets link, they share a key of each kind."""
    rng = np.random.default_rng(3)
    scheme = jaccard.Scheme(percent)
    for _ in range(400):
        n = int(rng.integers(1, 90))
        a = np.unique(jaccard.mix(rng.integers(0, 2**62, n).astype(np.uint64)))
        drop = int(rng.integers(0, max(1, n // 8) + 1))
        more = jaccard.mix(rng.integers(0, 2**62, int(rng.integers(0, 3))).astype(np.uint64))
        b = np.unique(np.concatenate((a[drop:], more)))
        both = len(np.intersect1d(a, b))
        if not len(b) or 100 * both < percent * (len(a) + len(b) - both):
            continue
        assert np.intersect1d(scheme.list_keys(a), scheme.list_keys(b)).size
        if percent == 90 and max(len(a), len(b)) <= jaccard.SMALL_MOST:
            assert np.intersect1d(scheme.subset_keys(a), scheme.subset_keys(b)).size


def test_long_near_copies(spark, monkeypatch):
    """At 80 % of five words: texts of up to 3000 words, edits around the limit, and a passage that many share."""
    import random

    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = []
    for n in (40, 300, 1000, 3000):
        original = [word() for _ in range(n)]
        for edits in (0.0, 0.01, 0.02, 0.024, 0.03, 0.06):
            copy = [word() if rng.random() < edits else w for w in original]
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(original[: int(0.85 * n)])))
    for _ in range(40):
        n = rng.randrange(100, 1500)
        rows.append((len(rows), " ".join([word() for _ in range(n)] + passage + [word() for _ in range(n // 3)])))
    monkeypatch.setattr(jaccard, "OWNED_SHINGLES", 4000)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 9000)
    monkeypatch.setattr(jaccard, "COUNTED_SETS", 25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = jaccard.stage(jaccard._sets(df, 5), "test-sets")
    members = jaccard.in_company(df, sets, 80, 5)
    assert members.count() < 4 * 7
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, 80, 5).collect())
    assert got == expected_components(rows, 80, 5)
    assert len({c for _, _, c in got}) < len(rows) - 10


def test_unrelated_sets_share_no_keys():
    rng = np.random.default_rng(5)
    scheme = jaccard.Scheme(80)
    for n in (100, 400, 1000, 3000):
        sets = [np.unique(jaccard.mix(rng.integers(0, 2**62, n).astype(np.uint64))) for _ in range(30)]
        keys = np.concatenate([scheme.list_keys(s) for s in sets])
        assert len(np.unique(keys)) == len(keys)
        assert len(keys) < 1.3 * 30 * n


# --- suffix arrays and repeats


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(150):
        lanes = []
        for _ in range(rng.integers(1, 6)):
            n, letters = int(rng.integers(0, 50)), int(rng.integers(1, 5))
            x = rng.integers(1, letters + 1, n)
            if n and rng.random() < 0.3:
                x = np.tile(x[: max(1, n // 6)], 8)[:n]
            lanes.append(np.append(x, 0).astype(np.uint16))
        sizes = np.array([len(x) for x in lanes])
        starts = np.cumsum(sizes) - sizes
        got = suffixes.suffix_arrays(np.concatenate(lanes), starts)
        naive = [s + np.array(sorted(range(len(x)), key=lambda i: x[i:].tolist())) for s, x in zip(starts, lanes)]
        assert (got == np.concatenate(naive)).all()


def expected_repeats(rows):
    seen, out = set(), Counter()
    for row in sorted(set((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0)):
        data = (row[1] or "").encode()
        inside = np.zeros(len(data), bool)
        for at in range(len(data) - 99):
            if data[at : at + 100] in seen:
                inside[at : at + 100] = True
            seen.add(data[at : at + 100])
        kept = bytes(b for b, gone in zip(data, inside) if not gone)
        edges = np.diff(np.concatenate(([0], inside.astype(int))))
        out[row] = (len(data), int(inside.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest())
    return Counter((r[0], *out[r[0], r[1]]) for r in rows)


def unambiguous(rows):
    """Rows without ids that stand for several texts: which of those is earlier is not given."""
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    return [r for r in rows if len(texts[r[0]]) == 1]


@pytest.mark.parametrize("parts", [False, True])
def test_repeats(spark, rows, monkeypatch, parts):
    if parts:
        for name, value in (("PIECES", 2), ("BROADCAST_ROWS", 1), ("REMEMBERED", 10)):
            monkeypatch.setattr(repeats, name, value)
        monkeypatch.setattr(repeats, "BATCH_BYTES", 5000)
    own = unambiguous(rows)
    df = spark.createDataFrame(own, "doc_id long, text string, h string, found string, n_chars long").repartition(4)
    got = Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()
    )
    assert got == expected_repeats(own)


def test_long_text_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 700)
    rng = np.random.default_rng(2)
    text = "".join(map(chr, rng.integers(97, 123, 5000)))
    own = [(1, text), (2, "q" * 30 + text[650:900] + "z" * 10 + text[1200:1320]), (3, text[100:300])]
    df = spark.createDataFrame(own, "doc_id long, text string")
    got = Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.without_repeats(df).collect()
    )
    assert got == expected_repeats(own)


def test_repeated_anchors_meet_by_shuffle_at_every_size(spark):
    for texts in (["ab" * 10], [chr(97 + n % 26) * 150 + str(n % 7) * 150 for n in range(300)]):
        df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "ord long, h long, text string")
        places = repeats._places(df)
        found = repeats._pieces(df, repeats._repeated(places))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and plan.count("SortMergeJoin") == 2
        anchors = Counter(r.anchor for r in places.collect())
        assert {r.anchor for r in found.collect()} == {a for a, n in anchors.items() if n > 1}


# --- decontamination


def test_decontaminate(spark, docs, rows):
    texts = [r[1] for r in rows if r[1]]
    items = [
        (1, " ".join(texts[30].split()[3:40])), (2, texts[62]), (3, "one two THREE"), (4, None), (5, "... !"),
        (6, "nothing like this is anywhere at all in these few texts here"), (7, "five"), (1, "eight, nine; ten"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = defaultdict(set)
    for item, text in items:
        for w in decontaminate.windows_of(decontaminate.words_of(text)):
            windows[tuple(w)].add(str(item))
    expected = Counter()
    for row in rows:
        own, hit, found = decontaminate.words_of(row[1]), set(), set()
        for size in {len(w) for w in windows}:
            for at in range(len(own) - size + 1):
                if tuple(own[at : at + size]) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[tuple(own[at : at + size])]
        expected[row[0], len(own), len(hit), ",".join(sorted(found)), bool(hit)] += 1
    got = Counter(
        (r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated)
        for r in decontaminate.decontaminate(docs, bench).collect()
    )
    assert got == expected


def test_words_of():
    assert decontaminate.words_of("A-b_C9 ÀÉ x\x7fy\u0000z") == [w.encode() for w in ("a", "b", "c9", "ÀÉ x", "y", "z")]


def test_proximity(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    changed = item.replace("delta", "delta so")
    df = spark.createDataFrame([(1, item), (2, changed), (3, "alpha beta"), (4, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    found = {r.doc_id: (r.n_hit, r.n_near) for r in decontaminate.decontaminate(df, bench).collect()}
    assert found[1] == found[4] == (10, 0)
    assert found[2] == (0, 1) and found[3] == (0, 0)


def expected_matches(texts, items):
    """All matches by trying every start of every text, (doc_id, item_id, start, exact)."""
    words = {key: decontaminate.words_of(text) for key, text in texts.items()}
    counts = Counter(w for own in words.values() for w in own)
    out = set()
    for item, text in items.items():
        for window in decontaminate.windows_of(decontaminate.words_of(text)):
            if any(w not in counts for w in window):
                continue
            probes = sorted((counts[w], at, w) for at, w in enumerate(window))[: decontaminate.PROBES]
            for key, own in words.items():
                size = len(window)
                exact = {at for at in range(len(own) - size + 1) if own[at : at + size] == window}
                out |= {(key, item, at, True) for at in exact}
                if exact:
                    continue
                for start in (at - probes[0][1] for at, w in enumerate(own) if w == probes[0][2]):
                    close = [
                        any(own[at : at + 1] == [w] for at in range(max(start + o - 3, 0), max(start + o + 4, 0)))
                        for _, o, w in probes[1:]
                    ]
                    if all(close):
                        out.add((key, item, start, False))
    return out


def test_matches_by_brute_force(spark):
    dice = np.random.default_rng(4)
    vocabulary = np.array([f"w{n}" for n in range(40)])
    items = {str(n): " ".join(dice.choice(vocabulary, 14)) for n in range(6)} | {"short": "w1 w2", "none": "", "void": None}
    texts = {n: " ".join(dice.choice(vocabulary, 30)) for n in range(20)} | {90: None, 91: "", 92: "w3"}
    for n in range(20, 50):
        own = items[str(n % 6)].split()
        for _ in range(n % 4):  # words put in, taken out or changed
            at = int(dice.integers(0, len(own)))
            own[at : at + int(dice.integers(0, 2))] = [str(dice.choice(vocabulary))] * int(dice.integers(0, 3))
        texts[n] = " ".join([*dice.choice(vocabulary, 5 * (n % 3)), *own])
    for n in range(6):  # the ends of items
        texts[100 + n] = " ".join(items[str(n)].split()[2:])
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    bench = spark.createDataFrame([*items.items(), (None, items["0"])], "item_id string, text string")
    expected = expected_matches(texts, items)
    got = {(r.doc_id, r.item_id, r.start, r.exact) for r in decontaminate.matches(docs, bench).collect()}
    assert got == expected
    assert {exact for *_, exact in expected} == {True, False} and any(start < 0 for _, _, start, _ in expected)
    near = Counter()
    for row in decontaminate.decontaminate(docs, bench).collect():
        near[row.doc_id] += row.n_near
    assert {key for key, n in near.items() if n} == {key for key, _, _, exact in expected if not exact}


# --- language model


def test_gradients():
    rng = np.random.default_rng(0)
    classes, within = lm.assign_classes(rng.integers(0, 50, 60), own=28, shared=4)
    streams = [np.append(rng.integers(1, 33, 40), 0).astype(np.int32)]
    model = lm.fit([], classes, within)
    model.group_follows, model.class_follows = (x.astype(np.float64) for x in (model.group_follows, model.class_follows))
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    inputs, targets, valid = lm.windows(streams[0])
    _, g = lm.gradients(model, inputs, targets, valid)
    for name, value in model.weights.items():
        at = tuple(int(rng.integers(0, n)) for n in value.shape)
        if name == "token":
            at = (int(inputs[0, 3]), 5)
        kept, found = value[at], []
        for step in (1e-4, -1e-4):
            value[at] = kept + step
            found.append(lm.gradients(model, inputs, targets, valid)[0])
        value[at] = kept
        assert g[name][at] == pytest.approx((found[0] - found[1]) / 2e-4, rel=0.05, abs=2e-5)


def test_each_token_is_scored_once(monkeypatch):
    """Scores in overlapping windows equal those of one window around each token, computed alone."""
    monkeypatch.setattr(lm, "STEPS", 5)
    rng = np.random.default_rng(4)
    classes, within = lm.assign_classes(rng.integers(0, 50, 60), own=28, shared=4)
    model = lm.fit([np.append(rng.integers(1, 33, 200), 0).astype(np.int32)], classes, within)
    texts = [np.append(rng.integers(1, 33, n), 0).astype(np.int32) for n in (0, 1, 31, 32, 33, 55, 56, 57, 200)]
    lengths = np.array([len(t) for t in texts])
    starts = np.cumsum(lengths) - lengths
    got = lm.score_streams(model, np.concatenate(texts), starts, lengths)
    w = model.weights
    for text, total in zip(texts, got):
        before, sum_ = np.concatenate(([0], text[:-1])), 0.0
        for at in range(len(text)):
            begin = 0 if at < lm.CONTEXT else -(-(at + 1 - lm.CONTEXT) // lm.STRIDE) * lm.STRIDE
            hidden = lm.forward(model.weights, before[None, begin : at + 1])["hidden"][0, -1]
            group, within_ = divmod(int(text[at]), lm.SPAN)
            for logits, own in (
                (hidden @ w["group"] + w["group_bias"] + model.group_follows[before[at]], group),
                (hidden @ w["out"][group] + w["bias"][group] + model.class_follows[group, before[at]], within_),
            ):
                sum_ += logits[own] - np.log(np.exp(logits).sum())
        assert total == pytest.approx(sum_ / math.log(10), rel=1e-4, abs=1e-4)


def test_lm_scores(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_DOCS", 20)
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    found = lm.score(docs, held).collect()
    counts, expected = Counter(), Counter()
    is_held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = [(r[0], (r[1] or "").encode().lower().split() + [None]) for r in rows]
    for i, own in tokens:
        if not is_held(i):
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    for i, own in tokens:
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        expected[i, is_held(i), len(own), sum(counts[t] > 0 for t in own), n, round(base, 6)] += 1
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert got == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)
    known = [r.score / r.n_tokens for r in found if r.n_tokens > 100 and not r.held_out]
    assert sum(known) / len(known) > -8


def test_windows_hold_one_text_each():
    texts = [np.append(np.arange(1, n + 1), 0).astype(np.int32) for n in (0, 1, 31, 32, 70)]
    got = list(zip(*(a.tolist() for a in lm.windows(np.concatenate(texts)))))
    expected = [w for t in texts for w in zip(*(a.tolist() for a in lm.windows(t)))]
    assert got == expected and len(got) == 8
    assert sum(sum(valid) for _, _, valid in got) == sum(map(len, texts))
    assert lm.windows(np.empty(0, np.int32))[0].shape == (0, lm.CONTEXT)


def test_attention_counts_all_documents(spark, docs, rows, monkeypatch):
    """What follows what is counted in every training document, and in every block."""
    monkeypatch.setattr(lm, "BLOCK_DOCS", 7)
    held = F.coalesce(F.col("doc_id") % 7 == 2, F.lit(False))
    blocks = lm._blocks(docs.select("doc_id", held.alias("held_out"), "text"))
    ranks = spark.sparkContext.broadcast(lm.read_vocabulary())
    subwords = lm.Subwords(ranks.value)
    classes, _ = lm.assign_classes(np.arange(subwords.size) % 1000)
    texts = blocks.select("block", "held_out", "lengths", "codes", F.col("vocabulary.word").alias("words"))
    n, expected = lm.padded(classes), Counter()
    for row in rows:
        if row[0] is None or row[0] % 7 != 2:
            ids = subwords.flat([w.decode() for w in (row[1] or "").encode().lower().split()])[0]
            own = [0, *classes[ids].tolist(), 0]
            expected.update(a * n + b for a, b in zip(own, own[1:]))
    pairs = lm._pair_counts(texts, classes, ranks)
    assert {int(i): int(pairs[i]) for i in np.nonzero(pairs)[0]} == expected


def test_all_blocks_train(spark, monkeypatch):
    """A round's weights are the mean, by places, of what its blocks learn alone."""
    monkeypatch.setattr(lm, "BLOCK_DOCS", 2)
    texts = [(i, f"alpha beta gamma w{i} " * (i + 5), i == 4) for i in range(9)]
    df = spark.createDataFrame(texts, "doc_id long, text string, held_out boolean").repartition(3)
    blocks = lm._blocks(df.select("doc_id", "held_out", "text")).localCheckpoint()
    ranks = spark.sparkContext.broadcast(lm.read_vocabulary())
    subwords = lm.Subwords(ranks.value)
    classes, within = lm.assign_classes(np.arange(subwords.size) % 1000)
    texts = blocks.select("block", "held_out", "lengths", "codes", F.col("vocabulary.word").alias("words"))
    model = lm.untrained(lm._pair_counts(texts, classes, ranks), classes, within)
    streams = dict(lm._streams(texts.toArrow().to_batches(), classes, subwords))
    assert len(streams) >= 4
    rounds = {row.block: row.r for row in texts.selectExpr("block", f"pmod(xxhash64(block), {lm.ROUNDS}) as r").collect()}
    for number in range(lm.ROUNDS):
        own = {b: s for b, s in streams.items() if rounds[b] == number}
        got = lm._round(texts, model, ranks, 1, number)
        alone = [
            (lm.learn(model, s, 1, b, number / lm.ROUNDS, (number + 1) / lm.ROUNDS), len(s)) for b, s in own.items()
        ]
        for name, value in model.weights.items():
            if own:
                value = sum(w[name] * k for w, k in alone) / sum(k for _, k in alone)
            assert np.allclose(got[name], value, atol=1e-4)


def test_attention_learns_from_the_ends_of_long_documents(spark):
    """Words past any prefix of a document, and documents past any number of them, are learned from."""
    long = "one two three four five six seven eight " * 600 + "lorem ipsum dolor sit amet " * 400
    texts = [(i, long) for i in range(2)] + [(9, "lorem ipsum dolor sit amet " * 30)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r.doc_id: r for r in lm.score(df, F.col("doc_id") == 9).collect()}
    assert found[9].score / found[9].n_subwords > -0.5


def test_subwords_cut_long_words():
    subwords = lm.Subwords(lm.read_vocabulary())
    flat, lengths = subwords.flat(["the", "x" * 100_000, "É"])
    assert lengths.sum() == len(flat) and lengths[1] < 100_000


def test_words_are_cut_once(spark, docs, rows, monkeypatch):
    """Blocks carry the subwords of their words, word by word as the vocabulary cuts them, and what follows what is
    counted from them alone: later steps have no vocabulary at hand."""
    monkeypatch.setattr(lm, "BLOCK_DOCS", 7)
    ranks = spark.sparkContext.broadcast(lm.read_vocabulary())
    subwords = lm.Subwords(ranks.value)
    blocks = lm._blocks(docs.select("doc_id", F.lit(False).alias("held_out"), "text"), ranks).localCheckpoint()
    met = 0
    for row in blocks.select("subwords", F.col("vocabulary.word").alias("words")).toArrow().to_pylist():
        cut = lm._unpacked(row["subwords"])
        alone = [subwords.flat([word])[0].tolist() for word in row["words"]]
        assert cut["sizes"].tolist() == [len(ids) for ids in alone]
        assert cut["flat"].tolist() == [i for ids in alone for i in ids]
        met += len(alone)
    assert met > 1000
    classes, _ = lm.assign_classes(np.arange(subwords.size) % 1000)
    texts = blocks.select("block", "held_out", "lengths", "codes", F.col("vocabulary.word").alias("words"))
    staged = blocks.select("block", "held_out", "lengths", "codes", "subwords")
    assert (lm._pair_counts(staged, classes, None) == lm._pair_counts(texts, classes, ranks)).all()


def test_scoring_a_block_takes_the_room_of_a_slice(monkeypatch):
    """A block's documents are scored in slices, with the same scores and in a fraction of the memory."""
    rng = np.random.default_rng(2)
    words, classes = 500, np.append(0, rng.integers(1, 40, 1999)).astype(np.int32)
    model = lm.untrained(np.zeros(48 * 48), np.append(classes, 47), np.zeros(2001))
    lengths = np.concatenate(([0, 0, 9000], rng.integers(0, 60, 1200), [0, 1])).astype(np.int32)
    codes = rng.integers(0, words, int(lengths.sum())).astype(np.int32)
    block = pa.table(
        {
            "doc_ids": [list(range(len(lengths)))], "held_out": [[False] * len(lengths)],
            "lengths": [lengths.tobytes()], "codes": [codes.tobytes()],
            "subwords": [lm._packed({"flat": rng.integers(1, 2000, 2 * words), "sizes": np.full(words, 2)})],
        }
    )
    counts = pa.table({"at": np.arange(0, words, 2), "c": np.arange(0, words, 2) + 1})
    found, peaks = [], []
    for size in (10**9, 1000):
        monkeypatch.setattr(lm, "LAID_OUT", size)
        monkeypatch.setattr(lm, "WINDOWS", 16)
        tracemalloc.start()
        found.append(lm._scored(block, counts, model, 10_000, words, 3).to_pandas())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert (found[0].n_tokens == lengths + 1).all() and (found[0].n_subwords == 2 * lengths + 1).all()
    for name in found[0]:
        assert np.allclose(found[0][name], found[1][name], rtol=1e-5, atol=1e-6)
    assert peaks[1] < 0.6 * peaks[0]


def test_learning_makes_windows_as_it_needs_them(monkeypatch):
    """A block's windows are never there all at once, nor the pairs of its places: memory per place stays small."""
    monkeypatch.setattr(lm, "BATCH", 4)
    monkeypatch.setattr(lm, "LAID_OUT", 1000)
    monkeypatch.setattr(lm, "gradients", lambda m, i, t, v: (0.0, {k: np.zeros_like(w) for k, w in m.weights.items()}))
    rng = np.random.default_rng(6)
    model = lm.fit([], *lm.assign_classes(rng.integers(0, 50, 60), own=28, shared=4))
    stream = np.where(np.arange(400_000) % 500 == 499, 0, rng.integers(1, 33, 400_000)).astype(np.int32)
    tracemalloc.start()
    lm.learn(model, stream)
    pairs = lm.pairs_of(stream, 48)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs.sum() == len(stream) and pairs[: 48].sum() == len(stream) // 500
    assert peak < 16 * len(stream)


def test_softmax_of_far_apart_logits():
    """Attention to one place only, whose exponential has no float, and no gradient that is not finite."""
    rng = np.random.default_rng(3)
    model = lm.fit([], *lm.assign_classes(rng.integers(0, 50, 60), own=28, shared=4))
    stream = np.append(rng.integers(1, 33, 90), 0).astype(np.int32)
    for name in ("q", "k"):
        model.weights[name] = np.eye(lm.WIDTH, dtype=np.float32) * 80
    found = lm.forward(model.weights, lm.windows(stream)[0])["weights"]
    assert np.allclose(found.sum(-1), 1, atol=1e-5) and (np.triu(found[0], 1) == 0).all()
    loss, g = lm.gradients(model, *lm.windows(stream))
    assert math.isfinite(loss) and all(np.isfinite(value).all() for value in g.values())


# --- toxicity


def test_toxicity_learns_from_documents(spark):
    rng = np.random.default_rng(6)
    fill = [f"word{i}" for i in range(300)]

    def text(bad):
        out = [" ".join(rng.choice(fill, 8)) for _ in range(rng.integers(3, 12))]
        if bad:
            out.insert(int(rng.integers(0, len(out))), f"you {rng.choice(['scumbag', 'scumlord', 'vermin'])} there")
        return ". ".join(out)

    rows = [(i, text(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    rows += [(1000, None, 0), (1001, "", 1), (1002, "!!! ...", 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    marks = [(r[0], 1, r[2]) for r in rows] + [(1, 1, 0), (7, 1, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") % 2 == 0)
    found = {r.doc_id: r.t for r in docs.select("doc_id", toxicity.toxicity(F.col("text"), model).alias("t")).collect()}
    assert all(0 <= t.score <= 1 for t in found.values())
    assert [found[i].score for i in (1000, 1001, 1002)] == [0, 0, 0]
    right = sum((found[i].score >= toxicity.THRESHOLD) == bool(label) for i, _, label in rows[:400])
    assert right >= 396
    for i, body, label in rows[:400]:
        if label and found[i].score >= toxicity.THRESHOLD:
            assert re.search("scum|vermin", body[found[i].worst_start : found[i].worst_end])


def test_toxicity_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    scores = docs.select(toxicity.toxicity(F.col("text"), model).alias("t")).select("t.score").collect()
    assert all(0 <= r.score < 0.3 for r in scores)
    assert nothing.select(toxicity.toxicity(F.col("text"), model)).count() == 0


# --- personal data

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 16 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans():
    rng = np.random.default_rng(8)
    parts = list("aZ09@.+-_ ()%\n") + ["@a.b", "1.2.3.4", "4111 1111 1111 1111", "+44 20 7946 0958", "x@y", "..", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 40))))
        got = [(s["kind"], s["start"], s["end"]) for s in pii.spans_of(text) if s["kind"] in pii.BASE_KINDS]
        assert got == base_spans(text), text


def test_further_spans_need_checks_and_context():
    def kinds(text):
        return [s["kind"] for s in pii.spans_of(text)]

    assert kinds("iban GB82 WEST 1234 5698 7654 32") == ["iban"]
    assert kinds("iban GB82 WEST 1234 5698 7654 33") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("see 123-45-6789") == []
    assert kinds("credit card 378282246310005") == ["short_card"]
    assert kinds("call 555-867-5309 now") == ["local_phone"] and kinds("part 555-867-5309") == []
    plain, near = pii.spans_of("4111111111111111")[0], pii.spans_of("visa card 4111111111111111")[0]
    assert near["score"] > plain["score"]
    assert pii.spans_of("a" * 200_000) == [] and pii.spans_of("1" * 100_000 + ".") == []


def test_pii_column(spark, docs, nothing):
    found = docs.select("doc_id", "text", pii.pii_spans(F.col("text")).alias("s")).collect()
    for r in found:
        got = [(s.kind, s.start, s.end) for s in r.s if s.kind in pii.BASE_KINDS]
        assert got == base_spans(r.text or "")
    assert nothing.select(pii.pii_spans(F.col("text"))).count() == 0


def test_empty(spark, nothing):
    assert jaccard.near_duplicates(nothing).count() == 0
    assert repeats.without_repeats(nothing).count() == 0
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontaminate.decontaminate(nothing, bench).count() == 0
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r)[2:4] for r in decontaminate.decontaminate(one, none).collect()] == [(3, 0)]
    assert lm.score(nothing, F.col("doc_id") < 0).count() == 0
    alone = lm.score(one, F.lit(True)).first()
    assert (alone.n_tokens, alone.n_known, alone.train_tokens, alone.base_score) == (4, 0, 0, 0.0)
