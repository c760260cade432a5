"""Mixing, sharding, quality, licences, and the pipeline, against plain Python."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import decontaminate, jaccard, licences, mixing, quality, sharding

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


# --- mixing


def expected_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = sum(weight[s] for s in sizes if s not in capped)
        level = (total - sum(3 * sizes[s] for s in capped)) / free if free else 0
        above = {s for s in sizes if s not in capped and weight[s] * level > 3 * sizes[s]}
        if not above:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * level for s in sizes}
        capped |= above


def test_mix(docs, rows):
    sizes = Counter()
    for _, text, _, source, _ in rows:
        sizes[source] += len(words(text))
    targets = expected_targets(sizes)
    found = mixing.mix(docs, mixing.size_of(F.col("text"))).collect()
    assert sum(r.n for r in found) == len(rows)
    taken = Counter()
    for r in found:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r["size"] * r.n
    for source, target in targets.items():
        largest = max(len(words(r[1])) for r in rows if r[3] == source)
        assert abs(taken[source] - target) <= max(0.5 * largest, 0.02 * target)
    again = mixing.mix(docs.repartition(3), mixing.size_of(F.col("text"))).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_capped_targets(spark):
    rows = [(i, "w " * 50, "big") for i in range(40)] + [(100, "w " * 3, "tiny"), (101, "", "void")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.source: r for r in mixing.mix(df, mixing.size_of(F.col("text"))).collect()}
    assert found["tiny"].target == 9.0 and found["tiny"].copies == 3
    assert found["void"].target == 0.0
    assert found["big"].target == pytest.approx(2003 - 9)


def test_many_parts(spark, monkeypatch):
    """A source in several parts is balanced as closely as one in a single part."""
    monkeypatch.setattr(mixing, "BLOCK", 50)
    df = spark.range(600).selectExpr(
        "id as doc_id", "if(id % 3 = 0, 'b', 'a') as source", "cast(1 + id * id % 97 as bigint) as n"
    )
    found = mixing.mix(df, F.col("n")).collect()
    for source in "ab":
        own = [r for r in found if r.source == source]
        assert abs(sum(r.copies * r["size"] for r in own) - own[0].target) <= 5


def test_flight_keeps_totals():
    import random

    sizes = [float(s) for s in (5, 9, 2, 7, 7, 1, 30, 4, 4, 8)]
    chances = [0.3] * 10
    out = mixing._flight(sizes, [1.0] * 10, list(chances), random.Random(1))
    assert sum(out) == pytest.approx(3.0)
    assert sum(s * p for s, p in zip(sizes, out)) == pytest.approx(0.3 * sum(sizes))
    assert sum(0 < p < 1 for p in out) <= 2


def test_mixed_rows(docs, rows):
    plan = Counter()
    for r in mixing.mix(docs, mixing.size_of(F.col("text"))).collect():
        plan[r.doc_id, r.source, r["size"]] = r.copies
    expected = Counter()
    for row in rows:
        expected[row] += plan[row[0], row[3], len(words(row[1]))]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(tuple(r)[:5] for r in out.collect()) == +expected


# --- sharding


def jump(key, shards):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_shard(docs, rows, shards):
    found = sharding.shard(docs, shards).collect()
    seen, slots = Counter(), defaultdict(list)
    for r in found:
        assert r.shard == jump(r.doc_id or 0, shards)
        assert r.grown_shard == jump(r.doc_id or 0, shards + 1)
        slots[r.shard].append(r.slot)
        seen[r.doc_id, r["size"], r.text_crc32] += 1
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    assert seen == Counter((i, len(t) + 16, zlib.crc32(t)) for i, t in texts)


def test_jump_of_extreme_keys(spark):
    keys = [0, -1, 1, 2**63 - 1, -(2**63), 123456789012345678, -987654321]
    df = spark.createDataFrame([(k, "") for k in keys], "doc_id long, text string")
    found = {r.doc_id: r.shard for r in sharding.shard(df, 1000).collect()}
    assert found == {k: jump(k, 1000) for k in keys}


# --- quality


def base(text):
    own = words(text)
    text = text or ""
    lines = [line for line in text.split("\n") if words(line)]
    windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return (
        len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
        len(own) < 50 or 100 * len(covered) > 50 * len(own),
    )


def divergence(counts, shares):
    total = sum(counts)
    if not total:
        return None
    terms = 0.0
    for count, q in zip(counts, shares):
        p = count / total
        m = (p + q) / 2
        terms += (p * math.log2(p / m) if p else 0) + q * math.log2(q / m)
    return math.sqrt(max(0.0, terms / 2))


def test_quality(docs, rows):
    rules = quality.Rules()
    narrow = docs.select("doc_id", "text", "lang", F.col("text").alias("body"))
    found = quality.quality(narrow, rules, ["body"]).collect()
    assert len(found) == len(rows)
    shares = {}
    for code, own in rules.languages.items():
        of = [r for r in found if r.lang == code]
        if of:
            shares[code] = {}
            for name in ("char_counts", "word_counts"):
                sums = [1.0 + sum(r[name][i] for r in of) for i in range(len(of[0][name]))]
                shares[code][name] = [s / sum(sums) for s in sums]
    for r in found:
        assert (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        ) == base(r.body)
        assert sum(r.char_counts) == len(r.body or "") and sum(r.word_counts) == r.n_words
        if r.lang in rules.languages:
            lowered = [w.lower() for w in words(r.body)]
            assert r.compared_with == r.lang
            assert r.word_counts[:-1] == [lowered.count(w) for w in rules.languages[r.lang]]
        verdict = not r.base_failed
        if r.compared_with in shares:
            of = shares[r.compared_with]
            char, word = divergence(r.char_counts, of["char_counts"]), divergence(r.word_counts, of["word_counts"])
            assert (r.char_distance is None) == (char is None)
            if char is not None:
                assert r.char_distance == pytest.approx(char, abs=1e-9)
            if word is not None:
                assert r.word_distance == pytest.approx(word, abs=1e-9)
            if r.word_chars >= rules.min_chars and char > rules.max_char_distance:
                verdict = False
            if r.n_words >= rules.min_words and word > rules.max_word_distance:
                verdict = False
        assert r.kept == verdict
    assert any(r.kept for r in found) and any(not r.kept and not r.base_failed for r in found)


# --- licences


def test_licences(spark):
    texts = {
        0: "Foo bar.\nMIT License\n\nCopyright (c) 2020 Jane Doe\n\n" + ". ".join(
            t for t, name in licences.SENTENCES.items() if name in ("mit-grant-notice",)),
        1: "Released under the MIT License. Some text! Licensed under CC BY-NC 4.0.",
        2: "no terms here", 3: None, 4: "",
        5: "This work is   licensed under the GNU General Public License, VERSION 3.\nAll rights reserved.",
        6: "Licensed under the Apache License, Version 2.0. " * 3,
        7: "Some other license applies.",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, _ids string")
    found = {r.doc_id: r for r in licences.licences(df).collect()}
    assert found[0].sentence_ids.startswith("mit-title,copyright,mit-grant")
    assert found[0].licences == "MIT" and found[0].n_unmatched == 0
    assert found[1].licences == "MIT,CC-BY-NC-4.0" and found[1].sentence_ids == "mit-ref,cc-by-nc-4-ref"
    for i in (2, 3, 4):
        assert (found[i].n_signs, found[i].sentence_ids, found[i].licences) == (0, "", "")
    assert found[5].licences == "GPL-3.0-only" and found[5].n_unmatched == 1
    assert found[6].licences == "Apache-2.0" and found[6].sentence_ids == ",".join(["apache-2-ref"] * 3)
    assert (found[7].n_signs, found[7].licences) == (1, "")


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 Some One

Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense,
and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_licences_wrapped_over_lines(spark, mark):
    def marked(text):
        return "int a;\n" + "\n".join(mark + line for line in text.split("\n")) + "\nint b;\n"

    short = "notes\nReleased under the MIT License\nmore of it"
    early = 'Licensed under the Apache License, Version 2.0\n(the "License"); you may not use this file except\n' \
        "in compliance with the License.\n"
    part = "It is not licensed under the MIT\nLicense at all."
    texts = [*map(marked, (APACHE, MIT, GPL, short, early, part))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.sentence_ids, r.licences, r.n_unmatched) for r in licences.licences(df).collect()}
    assert found == {
        0: ("apache-2-grant,apache-2-copy,apache-as-is,apache-see", "Apache-2.0", 0),
        1: ("mit-title,copyright,mit-grant,mit-notice", "MIT", 0),
        2: ("gpl-3-later,gpl-no-warranty,gpl-see", "GPL-3.0-or-later", 0),
        3: ("mit-ref", "MIT", 0),
        4: ("apache-2-grant", "Apache-2.0", 0),
        5: ("", "", 0),
    }


def test_rules_apply_in_order(spark):
    df = spark.createDataFrame([(1, "license a. license b. license a.")], "doc_id long, text string")
    known = {"license a": "a", "license b": "b"}
    found = licences.licences(df, known, [(("a", "b"), "AB"), (("b", "a"), "BA"), (("a",), "A")]).first()
    assert found.licences == "AB,A" and found.n_unmatched == 0


# --- the pipeline


def test_pipeline(spark, docs, rows, tmp_path):
    narrow = docs.select("doc_id", "text", "lang", "source", "n_chars")
    narrow.write.parquet(str(tmp_path / "documents.parquet"))
    passage = next(r[1] for r in rows if r[0] == 30).split(". ")[0]
    spark.createDataFrame([(1, passage), (2, None), (3, "")], "item_id long, text string").write.parquet(
        str(tmp_path / "benchmark.parquet")
    )
    steps = dict(corpus_pipeline.STAGES)
    assert len(steps) == 5
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for at, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in now.collect()]
        now = step(spark, now, str(tmp_path))
        after = [tuple(r) for r in now.collect()]
        if at < 4:
            assert now.columns == narrow.columns
        if at == 0:
            kept = quality.quality(narrow, None, ["source", "n_chars"]).where("kept").count()
            assert 0 < len(after) == kept < len(before)
        if at == 1:
            sets = {}
            for row in before:
                own = [w.decode() for w in (row[1] or "").encode().lower().split()]
                sets[row[:2]] = {tuple(own[i : i + 3]) for i in range(max(1, len(own) - 2))}
            left = [row[:2] for row in after]
            assert len(left) == len(set(left))
            for a in left:
                for b in left:
                    union = len(sets[a] | sets[b])
                    if a[0] != b[0]:
                        assert 100 * len(sets[a] & sets[b]) < 90 * union
        if at == 2:
            gone = {r[:2] for r in before} - {r[:2] for r in after}
            cut = {b" ".join(w) for w in decontaminate.windows_of(decontaminate.words_of(passage))}
            for row in before:
                own = {b" ".join(w) for w in decontaminate.windows_of(decontaminate.words_of(row[1]))}
                assert (row[:2] in gone) == bool(cut & own)
        if at == 3:
            assert set(after) <= set(before)
        if at == 4:
            assert len(after) == len(before)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(after)


def linked_by_force(texts, percent, width):
    sets = []
    for text in texts:
        own = text.lower().split()
        sets.append({tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))})
    return [
        (a, b) for b in range(len(sets)) for a in range(b)
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]


def test_near_duplicate_stage_takes_five_words_and_80_percent(spark, tmp_path):
    rng = random.Random(2)
    texts = []
    for _ in range(12):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((40, 100, 200)))]
        texts.append(" ".join(words))
        for edits in (1, 2, 3, 4, 5, 6, 8):
            copy = list(words)
            for at in range(edits):
                copy[(2 * at + 1) * len(words) // (2 * edits)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    root = list(range(len(texts)))
    for a, b in linked_by_force(texts, 80, 5):
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    expected = {i for i, r in enumerate(root) if i == r}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    stage = dict(corpus_pipeline.STAGES)["n-gram Jaccard join"]
    assert {row.doc_id for row in stage(spark, df, str(tmp_path)).collect()} == expected
    # 200 words with 4 of them replaced: 0.815 of five words, 0.886 of three.
    words = [f"w{i}" for i in range(200)]
    copy = [f"x{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(words)]
    pair = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(copy))], "doc_id long, text string")
    assert [r.doc_id for r in stage(spark, pair, str(tmp_path)).collect()] == [1]
    assert jaccard.one_of_each(pair).count() == 2


def test_one_of_each_keeps_texts_without_words(spark):
    rows = [(1, ""), (1, ""), (2, None), (3, "a b c d"), (3, "a b c d"), (4, "a b c d"), (None, "a b c d")]
    out = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == [(1, ""), (1, ""), (2, None), (3, "a b c d")]


def test_empty(spark, nothing, tmp_path):
    assert mixing.mix(nothing, mixing.size_of(F.col("text"))).count() == 0
    assert mixing.mixed(nothing).count() == 0
    assert sharding.shard(nothing, 40).count() == 0
    assert quality.quality(nothing).count() == 0
    assert licences.licences(nothing).count() == 0
    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
