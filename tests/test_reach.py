"""Components, reachability, ranks and shortest paths against plain Python on small random graphs."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quern.operators import graph as g
from quern.operators import reach

NODE = "id string, path string, lang string, loc int, types int, abstract int, unresolved int"


def table(spark, n, pairs):
    nodes = spark.createDataFrame([(f"n{i:03}", "a.py", "python", 1, 0, 0, 0) for i in range(n)], NODE)
    return nodes, spark.createDataFrame([(f"n{a:03}", f"n{z:03}", 1) for a, z in pairs], "src string, dst string, weight bigint")


def plain(n, pairs):
    """For each node the nodes that it reaches, itself among them."""
    out = {i: {z for a, z in pairs if a == i} for i in range(n)}
    found = {}
    for i in range(n):
        seen, todo = {i}, deque([i])
        while todo:
            for z in out[todo.popleft()] - seen:
                seen.add(z)
                todo.append(z)
        found[i] = seen
    return found


def union(*graphs):
    """The graphs side by side, as one with more nodes."""
    base, pairs = 0, set()
    for n, mine in graphs:
        pairs |= {(a + base, z + base) for a, z in mine}
        base += n
    return base, pairs


def mixed():
    """Random graphs, a ring with a tail and a way back, a chain both ways, lone nodes."""
    r = random.Random(3)
    return union(
        (42, {(r.randrange(40), r.randrange(40)) for _ in range(55)}),
        (20, {(r.randrange(20), r.randrange(20)) for _ in range(90)}),
        (30, {(i, (i + 1) % 12) for i in range(12)} | {(i, i + 1) for i in range(12, 18)} | {(5, 12), (17, 14), (29, 29)}),
        (20, {(i, i + 1) for i in range(15)} | {(i + 1, i) for i in range(15)} | {(16, 0), (15, 17)}),
        (3, set()),
    )


def test_components_and_counts_are_the_plain_ones(spark):
    n, pairs = mixed()
    nodes, edges = table(spark, n, pairs)
    far = plain(n, pairs)
    assert g.components(nodes.limit(3), edges.limit(0)).count() == 3
    want = {f"n{i:03}": f"n{min(j for j in far[i] if i in far[j]):03}" for i in range(n)}
    scc = g.step(g.components(nodes, edges))
    assert {r.id: r.scc for r in scc.collect()} == want
    seen = g.step(reach.visibility(nodes, edges, scc))
    assert {r.id: (r.vfi, r.vfo) for r in seen.collect()} == {f"n{i:03}": (sum(i in far[j] for j in range(n)), len(far[i])) for i in range(n)}
    cost = g.propagation_cost(nodes, edges).first().cost
    assert cost == pytest.approx((sum(map(len, far.values())) - n) / n**2, abs=6e-5)


def test_squaring_and_colours_agree(spark):
    n, pairs = mixed()
    rows = g.step(spark.createDataFrame([(a, z) for a, z in pairs], "a bigint, z bigint"))
    far = plain(n, pairs)
    for most in (reach.PAIRS, 0):
        label = {r.n: r.label for r in reach.strong(rows, most).collect()}
        for i in range(n):
            for j in range(i):
                assert (label.get(i, -i - 1) == label.get(j, -j - 1)) == (j in far[i] and i in far[j])


def test_core_split_states_its_cutoffs(spark):
    n, pairs = 8, {(0, 1), (1, 2), (2, 1), (2, 3), (3, 4), (0, 5), (6, 6)}
    nodes, edges = table(spark, n, pairs)
    rows = {r.id: r for r in reach.core_split(reach.visibility(nodes, edges)).collect()}
    assert {(r.vfi_cutoff, r.vfo_cutoff) for r in rows.values()} == {(3, 2)}
    assert [rows[f"n{i:03}"].part for i in range(8)] == ["control", "core", "core", "core", "shared", "peripheral", "peripheral", "peripheral"]
    assert reach.core_split(reach.visibility(nodes.limit(0), edges)).count() == 0
    alone = reach.core_split(reach.visibility(nodes, edges.limit(0)))
    assert [tuple(r) for r in alone.select("part").distinct().collect()] == [("peripheral",)]


@pytest.mark.parametrize("sinks", [True, False])
def test_ranks_and_betweenness_are_the_plain_ones(spark, monkeypatch, sinks):
    n, pairs = mixed()
    pairs |= set() if sinks else {(i, (i * 7 + 1) % n) for i in range(n)}
    nodes, edges = table(spark, n, pairs)
    out = {i: [z for a, z in pairs if a == i] or list(range(n)) for i in range(n)}
    rank = dict.fromkeys(range(n), 1 / n)
    for _ in range(40):
        new = dict.fromkeys(range(n), 0.15 / n)
        for i in range(n):
            for z in out[i]:
                new[z] += 0.85 * rank[i] / len(out[i])
        rank = new
    got = {r.id: r.pagerank for r in g.pagerank(nodes, edges).collect()}
    assert len(got) == n and all(got[f"n{i:03}"] == pytest.approx(rank[i] * n, abs=6e-4) for i in range(n))
    if sinks:
        assert {r.pagerank for r in g.pagerank(nodes.limit(9), edges.limit(0)).collect()} == {1.0} and g.pagerank(nodes.limit(0), edges).count() == 0
    raw = brandes(n, pairs)
    for sources in (64, 7):
        monkeypatch.setattr(g, "SOURCES", sources)
        rows, note = g.betweenness(nodes, edges.where(F.col("src") != F.col("dst")))
        assert note == "" and {r.id: r.betweenness for r in rows.collect()} == {f"n{i:03}": pytest.approx(raw[i] / ((n - 1) * (n - 2)), abs=6e-5) for i in range(n)}


def brandes(n, pairs):
    """Of all pairs of other nodes, the share of shortest paths through each node, by counting."""
    out = {i: {z for a, z in pairs if a == i and z != i} for i in range(n)}
    dist, ways = {}, {}
    for s in range(n):
        d, w, level = {s: 0}, {s: 1}, [s]
        while level:
            ahead: dict[int, int] = {}
            for i in level:
                for z in out[i]:
                    if z not in d:
                        ahead[z] = ahead.get(z, 0) + w[i]
            for z, x in ahead.items():
                d[z], w[z] = d[level[0]] + 1, x
            level = list(ahead)
        dist[s], ways[s] = d, w
    return [sum(ways[s][v] * ways[v][t] / ways[s][t] for s in range(n) for t in dist[s] if s != v != t and s != t and v in dist[s] and t in dist[v] and dist[s][v] + dist[v][t] == dist[s][t]) for v in range(n)]
