"""The front of three measures against all pairs of points."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from quern.operators import skyline

POINTS = "id int, quality double, cost double, latency double, x string"


def brute(points):
    known = [p for p in points if all(v is not None and not math.isnan(v) for v in p[1:4])]
    beats = lambda q, p: q[1] >= p[1] and q[2] <= p[2] and q[3] <= p[3] and q[1:4] != p[1:4]
    return sorted(p[0] for p in known if not any(beats(q, p) for q in known))


def kinds(r, kind, n):
    for i in range(n):
        a = r.random()
        if kind == "ties":
            yield (i, *(float(r.randrange(4)) for _ in range(3)), "")
        elif kind == "opposed":
            yield (i, a, a + r.random() / 50, r.random(), "")
        elif kind == "all":  # no point dominates another
            b = r.random()
            yield (i, a + b, a, b, "")
        elif kind == "one":
            yield (i, 1.0, 2.0, 3.0, "")
        else:
            holes = [None, math.nan, -math.inf, math.inf, -0.0, 0.0]
            yield (i, *(r.choice(holes) if r.random() < 0.3 else float(r.randrange(30)) for _ in range(3)), "")


@pytest.mark.parametrize("kind", ["ties", "opposed", "all", "one", "holes"])
def test_front_is_that_of_all_pairs(spark, kind):
    points = list(kinds(random.Random(kind), kind, 400))
    df = spark.createDataFrame(points, POINTS)
    for rows, cells in ((df, 8), (df.repartition(5), 3)):
        got = skyline.pareto_front(rows, cells)
        assert got.columns == df.columns and sorted(r.id for r in got.collect()) == brute(points)


def test_empty_and_lone_points(spark):
    df = spark.createDataFrame([(1, 1.0, None, 2.0, "")], POINTS)
    assert skyline.pareto_front(df).count() == 0 and skyline.pareto_front(df.limit(0)).count() == 0
    assert skyline.pareto_front(df.fillna(3.0)).count() == 1


def test_a_large_front_takes_one_sweep():
    r = np.random.default_rng(1)
    a, b = r.random(100_000), r.random(100_000)
    assert len(skyline.swept(-(a + b), a, b)) == 100_000
