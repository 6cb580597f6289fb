"""Hard negatives against all pairs in plain Python, and the trees' bounds."""

import math
import random

import numpy as np
import pytest

from loomdex.llm import hardneg

SCHEMA = "vec_id bigint, label int, embedding array<double>, row string, part string, score string, positives string"


def plain(rows, positives=5, negatives=10):
    """The definition over all pairs; equal rows stay apart."""
    held = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(256 * x) for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if i is not None and i % 7 == 0 else label
        held.append((i, label, [math.floor(256 * x) for x in v]))
    out = []
    for k, (i, label, v) in enumerate(held):
        if i is None or i % 100:
            continue
        scored = []
        for j, (o, other, w) in enumerate(held):
            if j != k and len(w) == len(v):
                s = max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))
                scored.append((-s, o is None, o or 0, other, o))
        scored.sort(key=lambda x: x[:3])
        for p in [x for x in scored if x[3] == label][:positives]:
            fits = [x for x in scored if x[3] != label and 30 * -p[0] <= 100 * -x[0] <= 90 * -p[0]]
            out += [(i, p[4], n + 1, x[4], -p[0], -x[0]) for n, x in enumerate(fits[:negatives])]
    return sorted(out, key=lambda x: tuple((y is None, y or 0) for y in x))


def rows_of(n, seed, size=6, labels=4, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, spread) for _ in range(size)] for _ in range(5)]
    return [(r.randrange(0, 3000, 5) if r.random() < 0.5 else 100 * r.randrange(8), r.randrange(labels), [c + r.gauss(0, 0.3) for c in r.choice(centres)]) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "a", "b", "c", "d") for i, label, v in rows], SCHEMA).repartition(3)


def mined(spark, rows, **options):
    got = hardneg.mine(frame(spark, rows), **options).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    return sorted(map(tuple, got), key=lambda x: tuple((y is None, y or 0) for y in x))


@pytest.mark.parametrize("part_rows, block", [(1 << 15, 1 << 12), (40, 7)])
def test_all_pairs(spark, part_rows, block):
    rows = rows_of(300, 1)
    rows += rows[:10] + [(100, 1, [0.5] * 6)] * 30 + [(7, 2, [0.25] * 6)] * 5  # repeated rows, many ties
    want = plain(rows)
    assert len(want) > 500
    assert mined(spark, rows, part_rows=part_rows, block=block) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = rows_of(60, 2) + [(0, None, [0.1] * 6), (0, 1, None), (200, 1, [nan] * 6), (300, 1, [inf] + [0.0] * 5), (400, 2, [None] * 6), (None, 1, [0.4] * 6), (None, 2, [0.4] * 6), (500, 1, []), (501, 1, []), (502, 2, []), (600, 3, [0.5, 0.5]), (601, 3, [0.5, 0.25]), (602, 1, [0.25, 0.25]), (700, -3, [0.3] * 6), (7, -1, [0.3] * 6), (701, 1, [1e307] * 6), (-100, 1, [-0.5] * 6), (-7, 2, [0.5] * 6)]
    assert mined(spark, rows) == plain(rows)


def test_products_beyond_doubles(spark):
    big = [(i * 50, i % 2, [1e7 * (i % 5 + 1), 3e8 - i, float(i)]) for i in range(30)] + [(100, 0, [1e18, -1e18, 2.5]), (101, 0, [1e18, 1e3, 2.0]), (102, 1, [9e17, -1e3, 1.0])]
    assert mined(spark, big) == plain(big)


def test_empty(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [0.5])]) == []
    assert mined(spark, [(100, 1, [0.5])]) == []


def test_search_visits_few_rows_and_finds_the_best():
    r = np.random.default_rng(4)
    centres = r.normal(0, 4, (40, 8))
    x = np.floor(256 * (centres[r.integers(0, 40, 8000)] + r.normal(0, 0.05, (8000, 8))))
    labels = r.integers(0, 3, 8000)
    rows = hardneg.Rows(np.arange(8000), np.zeros(8000, bool), np.arange(8000), labels, x)
    forest = hardneg.plant(x, labels)
    for f in range(len(forest.radius)):
        own = x[forest.rows[forest.lo[f] : forest.hi[f]]]
        assert np.sqrt(((own - forest.centre[f]) ** 2).sum(1)).max() <= forest.radius[f] + 1e-6
    seen = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            seen.append(np.size(at))
            return np.asarray(super().__getitem__(at))

    counted = rows._replace(x=x.view(Counted))
    for k in range(20):
        q = x[k]
        score, at = hardneg.search(counted, forest, q, forest.roots[forest.root_label == labels[k]], 5, k)
        s = x @ q
        mine = np.flatnonzero((labels == labels[k]) & (np.arange(8000) != k))
        want = mine[np.lexsort((mine, -s[mine]))][:5]
        assert at.tolist() == want.tolist() and score.tolist() == s[want].tolist()
        low, high = 0.3 * s[k], 0.9 * s[k]
        score, at = hardneg.search(counted, forest, q, forest.roots, 10, k, low, high)
        mine = np.flatnonzero((s >= low) & (s <= high) & (np.arange(8000) != k))
        assert at.tolist() == mine[np.lexsort((mine, -s[mine]))][:10].tolist()
    assert sum(seen) < 40 * 8000 / 3
