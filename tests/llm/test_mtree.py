"""Exact top-k: components of any finite size, repeated ids, pruning that spares products."""

import heapq
import math
import operator
import random

import numpy as np
import pytest

from tidewater.llm import mtree


def brute(rows, every=50, k=5):
    valid = [(i, [math.floor(256 * v) if abs(v) < 2.0**44 else int(v) * 256 for v in x]) for i, x in rows if x and None not in x and all(map(math.isfinite, x))]
    out = []
    for q, x in {(i, tuple(x)) for i, x in valid if i % every == 0}:
        best = heapq.nsmallest(k, [(-sum(map(operator.mul, x, y)), i) for i, y in valid if i != q and len(x) == len(y)])
        out += [(q, r + 1, i, max(min(-s, 2**63 - 1), -(2**63))) for r, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("kind, large", [("float", 1e18), ("float", 3e38), ("double", 1e200), ("double", 1e308)])
def test_any_finite_component(spark, kind, large):
    rnd = random.Random(9)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(160)]
    rows += [(200 + i, [rnd.choice((-1, 1, 0)) * large * rnd.choice((1, 0.5, 1e-30)) for _ in range(4)]) for i in range(12)] + [(250, [large, 0.25, 0.0, -large]), (300, [0.0, 0.5, 1.0, 0.0]), (7, [large / 2, large / 2, 1.0, 0.0])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(3)
    stored = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    assert sorted(map(tuple, mtree.top_k(df).collect())) == brute(stored)


def test_repeated_ids_and_rows(spark):
    rows = [(0, [1.0, 0.5]), (0, [1.0, 0.5]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.25, 2.0]), (50, [0.0, 0.0])]
    got = sorted(map(tuple, mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    assert got == brute(rows)


def test_texts_sort_as_numbers():
    rnd = random.Random(1)
    numbers = [rnd.choice((-1, 1)) * rnd.randrange(10 ** rnd.randint(0, 620)) for _ in range(500)] + [0, 9, 10, -9, -10]
    assert sorted(numbers) == sorted(numbers, key=mtree.sortable)


def test_clustered_vectors_spare_products(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = np.floor(256 * (np.repeat(centres, 100, axis=0) + 0.02 * rng.normal(size=(4000, 16)))) / 256
    monkeypatch.setattr(mtree, "LEAF", 64)
    tree = mtree.MTree(np.arange(4000), x)
    asked = np.arange(0, 4000, 50)
    found = [f for lo in range(0, len(asked), 8) for f in tree.search(x[asked[lo : lo + 8]], asked[lo : lo + 8], 5, 256)]
    assert tree.products < len(asked) * 4000 / 2
    whole = np.rint(x * 256).astype(np.int64)
    for q, best in zip(asked.tolist(), found, strict=True):
        s = whole @ whole[q]
        assert best == sorted([(int(s[i]), -i) for i in range(4000) if i != q], reverse=True)[:5]
