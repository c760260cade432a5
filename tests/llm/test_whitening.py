"""Whitening, against numpy over all rows at once."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, components, weights):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in kept), default=0)
    grid = [(i, tuple([math.floor(256 * float(np.float32(c))) for c in v] + [0] * (width - len(v)))) for i, v in kept]
    copies = Counter(x for _, x in grid)
    fit = np.array(list(copies), object).reshape(-1, width)
    weight = [c if weights == "counts" else 1 for c in copies.values()]
    n = sum(weight)
    sums = [sum(w * x[j] for w, x in zip(weight, fit)) for j in range(width)]
    mean = np.array([s / n for s in sums])
    centred = fit.astype(float) - mean
    cov = (centred * np.array(weight)[:, None]).T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[: min(components, width)]
    share = values[order] / values.sum()
    white = {x: (np.array(x, float) - mean) @ vectors[:, order] / np.sqrt(values[order]) for x in copies}
    deviation = {x: sum((n * c - s) ** 2 for c, s in zip(x, sums)) for x in copies}
    return [(i, n, deviation[x], white[x], share) for i, x in grid]


def vectors(width=6, count=150):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.1 * (j + 1)) for j in range(width)], i % 3) for i in range(count)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(400)] + [(2000 + i, rows[i % 5][1], 1) for i in range(40)]
    rows += [(None, rows[3][1], None), (7, rows[9][1], 1), (7, rows[9][1], 1), (None, rows[11][1], 2)]
    bad = [None, [None] * width, [float("nan")] + [0.0] * (width - 1), [0.0] * (width - 1) + [float("-inf")]]
    return rows + [(5000 + i, v, 1) for i, v in enumerate(bad)] + [(6000, [-0.0] * width, 1), (6001, [0.0] * width, 1)]


@pytest.mark.parametrize("weights", ["one", "counts"])
@pytest.mark.parametrize("components", [4, 9])
def test_whiten(spark, weights, components):
    rows = vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.selectExpr("*", "1 as x", "2 as n", "3 as pos", "4 as copies", "5 as whitened")
    found = whitening.whiten(df, components, weights).collect()
    want = expected(rows, components, weights)
    assert Counter((r.vec_id, r.n, r.deviation) for r in found) == Counter(r[:3] for r in want)
    assert max(r.identity_error for r in found) < 1e-9
    key = lambda i, w: (str(i), *(round(abs(c), 5) for c in w))
    by_key = lambda pairs: sorted(pairs, key=lambda p: key(*p))
    got = by_key([(r.vec_id, r.whitened) for r in found])
    signs = None
    for (i, own), (j, other) in zip(got, by_key([(r[0], list(r[3])) for r in want])):
        assert i == j and np.allclose(np.abs(own), np.abs(other), atol=1e-8)
        if signs is None and all(abs(c) > 1e-6 for c in own):
            signs = np.sign(own) * np.sign(other)
        if signs is not None:
            assert np.allclose(own, signs * other, atol=1e-8)
    assert signs is not None
    assert np.allclose(found[0].explained, want[0][4])


def test_ragged_and_flat(spark):
    rows = [(1, [0.5]), (2, [0.5, 0.0]), (3, []), (4, [1.5, 0.25]), (5, [2.5, 0.25])]
    found = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, SCHEMA.split(", label")[0])).collect()}
    assert found[1].deviation == found[2].deviation and found[1].whitened == found[2].whitened
    assert found[3].n == 4 and found[3].deviation == (128 + 384 + 640) ** 2 + 128**2
    # The second dimension adds nothing.
    rows = [(i, [0.5 * i, 0.0]) for i in range(3)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA.split(", label")[0])).collect()
    assert all(r.whitened[0] is not None and r.whitened[1] is None and r.identity_error < 1e-12 for r in found)
    # One vector.
    (row, _) = whitening.whiten(spark.createDataFrame([(1, [0.5]), (2, [0.5])], SCHEMA.split(", label")[0])).collect()
    assert (row.n, row.deviation, row.whitened, row.explained, row.identity_error) == (1, 0, [None], [None], None)


def test_large_entries(spark):
    rows = [(1, [1e14, 3e3]), (2, [-1e14, 0.0]), (3, [5.0, 1.0])]
    found = {r.vec_id: r for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found[1].deviation is None
    sums = (1280, 256 * 3001)
    assert found[3].deviation == (3 * 1280 - sums[0]) ** 2 + (3 * 256 - sums[1]) ** 2


def test_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1), (2, [float("nan")], 1)], SCHEMA)).collect() == []
