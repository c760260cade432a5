"""Exact duplicates, against plain Python."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import exact
from ledgerloom.sources.shared import stage


def lowered(text):
    return (text or "").encode().lower().decode()


def expected(rows):
    """The rows that `exact_groups` gives, as a multiset."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[lowered(text)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for i in ids:
            kept = left and i == keep
            left = left and not kept
            out[i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


def found(df):
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize(
    "hashed", [F.xxhash64, lambda text: F.xxhash64(text) % 7, lambda text: F.lit(-3).cast("bigint")],
    ids=["hash", "seven keys", "one key"],
)
@pytest.mark.parametrize("capacity", [4, 100_000])
def test_groups(docs, rows, hashed, capacity):
    assert found(exact.exact_groups(docs, hashed, capacity)) == expected([r[:2] for r in rows])


def test_large_group_and_case(spark):
    rows = [(i, ("Same Text É", "same text É", "same text é", None, "")[i % 5] if i % 3 else f"t{i}") for i in range(600)]
    rows += [(7, "Same Text É")] * 3 + [(None, "same text É"), (None, "solo"), (-5, "solo"), (1, "x" * 400_000), (2, "X" * 400_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(exact.exact_groups(df, capacity=25)) == expected(rows)


def test_directory(spark):
    """Buckets hold what they may, cover the keys, and split no further than they must."""
    keys = spark.range(3000).select(F.xxhash64("id").alias("key"), (2 + F.col("id") % 3).alias("n"))
    keys = stage(keys.unionByName(spark.createDataFrame([(5, 900), (6, 1)], "key long, n long")), "test-keys")
    slots, depth = exact.directory(keys, 9900, 64)
    by_slot = {r.slot: r for r in slots.collect()}
    assert max(r.local_depth for r in by_slot.values()) <= depth <= exact.DEPTH
    load, held = Counter(), Counter()
    for key, n in keys.where("n > 1").collect():
        own = by_slot[(key % 2**64) >> (64 - depth)]
        assert own.bucket == (key % 2**64) >> (64 - depth) >> (depth - own.local_depth) << (depth - own.local_depth)
        load[own.bucket, own.local_depth] += n
        held[own.bucket, own.local_depth] += 1
    pages = {(r.bucket, r.local_depth): r.pages for r in by_slot.values()}
    for (bucket, local), entries in load.items():
        assert entries <= 64 or local == depth
        assert pages[bucket, local] == -(-entries // 64)
        if local:
            parent = bucket >> (depth - local + 1) << (depth - local + 1)
            width = 1 << (depth - local + 1)
            assert sum(n for (b, _), n in load.items() if parent <= b < parent + width) > 64


def test_without_copies(docs, rows):
    out = exact.without_copies(docs)
    assert out.columns == docs.columns
    kept = defaultdict(set)
    for row in rows:
        kept[lowered(row[1])].add(row)
    kept = Counter(max(own, key=lambda r: (r[0] is not None, r[0] or 0))[0] for own in kept.values())
    assert Counter(r.doc_id for r in out.collect()) == kept
    texts = [lowered(r.text) for r in out.collect()]
    assert len(texts) == len(set(texts))


def test_nothing(nothing):
    assert exact.exact_groups(nothing).collect() == []
    assert exact.without_copies(nothing).collect() == []
