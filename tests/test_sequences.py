"""The kernels on pairs of sequences against plain dynamic programming and all pairs."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np

from quern.functions import sequences
from quern.operators import evaluation as ev


def plain(a, b):
    """(longest common subsequence, edit distance) by the table."""
    common = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            common[i][j] = common[i - 1][j - 1] + 1 if x == y else max(common[i - 1][j], common[i][j - 1])
            cost[i][j] = min(cost[i - 1][j] + 1, cost[i][j - 1] + 1, cost[i - 1][j - 1] + (x != y))
    return common[-1][-1], cost[-1][-1]


def test_kernels_are_the_plain_tables():
    r = random.Random(4)
    for _ in range(1500):
        k = r.choice([1, 2, 4, 30])
        a, b = ([r.randrange(k) for _ in range(r.choice([0, 1, 2, 9, 70]))] for _ in range(2))
        assert (sequences.common(a, b), sequences.distance(a, b)) == plain(a, b)


def test_pairs_are_counted_while_merging():
    r = random.Random(5)
    for n in (0, 1, 2, 50, 127, 128, 129, 400, 1000):
        x = [r.randrange(max(1, n // 2)) for _ in range(n)]
        assert sequences.ascending_pairs(np.array(x, np.int64)) == sum(a < b for a, b in combinations(x, 2))


def test_ten_thousand_tokens():
    a = [f"t{i % 97}" for i in range(10_000)]
    b = a[37:] + ["x"] * 20
    assert sequences.common(a, b) == 9963 and 57 <= sequences.distance(a, b) <= 74
    assert sequences.ascending_pairs(np.arange(200_000)) == 200_000 * 199_999 // 2


def test_token_similarity_shows_both_normalisations(spark):
    cases = [("same", ["a", "b"], ["a", "b"]), ("none", [], []), ("new", [], ["x"]), ("long", ["a"], ["x", "y", "z"]), ("null", None, ["a"]), ("holes", ["a", None, "b"], ["a", None, "c"])]
    df = spark.createDataFrame(cases, "case_id string, expected array<string>, actual array<string>")
    got = {r.case_id: (r.distance, r.over_longer, r.over_expected) for r in ev.token_edit_similarity(df).collect()}
    assert got["same"] == (0, 1.0, 1.0) and got["none"] == (0, 1.0, None) and got["new"] == (1, 0.0, None) and got["long"] == (3, 0.0, -2.0)
    assert got["null"] == (None, None, None) and got["holes"][0] == 1
    assert ev.token_edit_similarity(df.limit(0)).count() == 0
