"""Hard negatives (13) against plain loops over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chalkline.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, score string, row string, slot string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, g, "x", "x", "x") for i, v, g in rows], SCHEMA)


def plain(rows, every, positives, negatives, low, high):
    part = [(k, i, [math.floor(256 * x) for x in v], g) for k, (i, v, g) in enumerate(rows) if g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for k, i, v, g in part:
        if i is None or i % every:
            continue
        near = sorted((-sum(a * b for a, b in zip(v, w)), (j is None, j), m, h) for m, j, w, h in part if m != k)
        for s, (_, p), _, _ in [x for x in near if x[3] == g][:positives]:
            fit = [(t, q) for t, (_, q), _, h in near if h != g and low * -s <= 100 * -t <= high * -s]
            for rank, (t, q) in enumerate(fit[:negatives], 1):
                out[(i, p, rank, q, -s, -t)] += 1
    return out


def check(spark, rows, every=10, positives=5, negatives=10, low=30, high=90):
    got = hn.hard_negatives(table(spark, rows), F.col("id") % every == 0, positives, negatives, low, high)
    assert Counter(map(tuple, got.collect())) == plain(rows, every, positives, negatives, low, high)


def made(n, labels, dim=8, seed=3, step=0.0):
    rnd = random.Random(seed)
    return [(i, [round(rnd.gauss(0.3, 1), 1) if step == 0 else step * rnd.randint(0, 3) for _ in range(dim)], rnd.choice(labels)) for i in range(n)]


def test_rows_of_all_kinds(spark, monkeypatch):
    rows = made(500, [0, 0, 0, 1, 2])
    rows += [(None, [0.5] * 8, 1), (None, [0.5] * 8, 1), (900, None, 1), (910, [1.0] * 8, None), (920, [float("nan")] * 8, 1), (930, [float("inf")] + [0.0] * 7, 1),
             (940, [None] + [0.0] * 7, 1), (950, [], 1), (960, [1.0, 1.0], 2), (970, [0.2] * 20, 0), (980, [0.4] * 8, 77), (0, rows[0][1], rows[0][2]), (-20, [0.9] * 8, 1)]
    check(spark, rows)
    monkeypatch.setattr(hn, "LEAST_ROWS", 16)  # many blocks
    monkeypatch.setattr(hn, "COLUMNS", 7)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    check(spark, rows)
    check(spark, rows, positives=2, negatives=3, low=0, high=150)


def test_ties_and_copies(spark):
    """A third of the rows are one vector, scores repeat everywhere."""
    check(spark, made(200, [0, 1], dim=2, step=0.5) + [(1000 + i, [0.5, 0.5], i % 2) for i in range(100)])


def test_no_rows(spark):
    check(spark, [])
    check(spark, [(1, [1.0], 0)])
    check(spark, [(0, [1.0], 0), (1, [0.5], 1)])


def test_scores_are_exact():
    rnd = np.random.default_rng(1)
    for top in (200, 1 << 20, 1 << 27, 1 << 30):
        a, b = rnd.integers(-top, top, (5, 9)), rnd.integers(-top, top, (7, 9))
        assert (hn.scores(a, b) == (a.astype(object) @ b.astype(object).T)).all()
    assert hn.scores(np.array([[1 << 40, 1]]), np.array([[1 << 20, 5]]))[0, 0] == (1 << 60) + 5
    with pytest.raises(ValueError):
        hn.scores(np.array([[1 << 40]]), np.array([[1 << 30]]))
