"""Back edges, covering groups, split commits and module pairs against plain Python on small random inputs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest

from quern.operators import feedback, graph, smells
from quern.operators import structure as s


def acyclic(edges: set[tuple[str, str]]) -> bool:
    left = set(edges)
    while left:
        fed = {z for _, z in left}
        free = {e for e in left if e[0] not in fed}
        if not free:
            return False
        left -= free
    return True


def random_edges(r: random.Random, n: int, m: int) -> set[tuple[str, str]]:
    return {(f"n{a:02}", f"n{z:02}") for a, z in ((r.randrange(n), r.randrange(n)) for _ in range(m))}


@pytest.mark.parametrize(("n", "m", "share"), [(12, 40, 0.25), (30, 70, 0.5), (25, 400, 0.25), (6, 60, 1.0)])
def test_without_back_edges_no_cycle_is_left_and_the_bound_holds(spark, n, m, share):
    r = random.Random(n)
    parts = [{(f"{k}{a}", f"{k}{z}") for a, z in random_edges(r, n, m)} for k in "abc"] + [{("x1", "x2"), ("x2", "x1")}, {("y1", "y2"), ("y2", "y3"), ("y3", "y1")}, {("z", "z")}]
    edges = set().union(*parts)
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e})], "id string")
    rows = spark.createDataFrame(sorted(edges), "src string, dst string")
    marked = graph.step(feedback.feedback_edges(graph.step(graph.components(nodes, rows)), rows, share))
    got = marked.collect()
    assert acyclic({(x.src, x.dst) for x in got if not x.back})
    assert all(x.scc != "z" for x in got) and Counter(x.back for x in got if x.scc == "x1") == {True: 1, False: 1} and sum(x.back for x in got if x.scc == "y1") == 1
    for x in feedback.feedback_check(marked).collect():
        inside = [(e.src, e.dst) for e in got if e.scc == x.scc]
        single = [e for e in inside if e[::-1] not in inside]
        bound = len(single) / 2 - len({v for e in single for v in e}) / 6 + (len(inside) - len(single)) / 2
        assert (x.edges, x.two_cycles, x.cyclic) == (len(inside), (len(inside) - len(single)) // 2, 0) and x.within and abs(x.bound - bound) < 1e-4 and x.back <= bound + 1e-9


def test_back_edges_of_graphs_without_tangles(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    for rows in ([("a", "b")], []):
        edges = spark.createDataFrame(rows, "src string, dst string")
        marked = feedback.feedback_edges(graph.components(nodes, edges), edges)
        assert marked.count() == 0 and feedback.feedback_check(marked).count() == 0


def test_an_order_shows_that_no_cycle_is_left_without_peeling_the_rest(spark, monkeypatch):
    r = random.Random(3)
    edges = random_edges(r, 8, 30) | {("x1", "x2"), ("x2", "x1")}
    nodes = spark.createDataFrame([(x,) for x in sorted({x for e in edges for x in e})], "id string")
    rows = spark.createDataFrame(sorted(edges), "src string, dst string")
    inside, order = feedback.ordered(graph.step(graph.components(nodes, rows)), rows)
    marked = graph.step(feedback.marked_edges(inside, order))
    slow = sorted(map(tuple, feedback.feedback_check(marked).collect()))
    # an edge too many in the rest: no order can have all rise, and the components find its cycle
    broken = graph.step(marked.select("scc", "src", "dst", (marked.back & (marked.scc != "x1")).alias("back")))
    assert not feedback.all_rise(broken.where("not back"), order)
    assert {x.scc: x.cyclic for x in feedback.feedback_check(broken, order).collect()}["x1"] == 2

    def never(*_):
        raise AssertionError("the rest was peeled")

    monkeypatch.setattr(feedback, "components", never)
    assert sorted(map(tuple, feedback.feedback_check(marked, order).collect())) == slow


def greedy(pairs: set[tuple[str, str]]) -> set[tuple[str, str]]:
    """(core, member), one core at a time."""
    left, out = set(pairs), set()
    while left:
        size = Counter(x for p in left for x in p)
        core = min(size, key=lambda x: (-size[x], x))
        mine = {p for p in left if core in p}
        out |= {(core, a if b == core else b) for a, b in mine}
        left -= mine
    return out


@pytest.mark.parametrize("m", [0, 1, 8, 40, 200])
def test_groups_are_those_of_one_core_at_a_time(spark, m):
    r = random.Random(m)
    pairs = {(min(e), max(e)) for e in random_edges(r, 30, m) if e[0] != e[1]}
    rows = spark.createDataFrame([(*p, 3) for p in sorted(pairs)], "a string, b string, shared bigint")
    got = smells.violation_groups(rows).collect()
    assert {(x.core, x.member) for x in got} == greedy(pairs)
    assert len(got) == len(pairs) and {tuple(sorted((x.core, x.member))) for x in got} == pairs


def test_pairs_of_split_commits_are_all_pairs_once(spark):
    r = random.Random(1)
    commits = {"big": range(90), "mid": range(0, 40, 3), "one": [5], "two": [5, 6]}
    rows = [(k, f"f{i}") for k, v in commits.items() for i in v]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "sha string, path string")
    want = sorted((k, *sorted(p)) for k, v in commits.items() for p in combinations([f"f{i}" for i in v], 2))
    for block in (4, 16, 512):
        assert sorted(map(tuple, s.commit_pairs(df, block).collect())) == want
    shared = Counter((a, b) for _, a, b in want)
    for least in (1, 2, 3):
        assert {(x.a, x.b): x.shared for x in s.co_change(df.union(df), least).collect()} == {p: n for p, n in shared.items() if n >= least}


def test_module_pairs_need_no_edge_between_any_files(spark):
    homes = spark.createDataFrame([("a1", "A", 1), ("a2", "A", 1), ("b1", "B", 1), ("b2", "B", 1), ("c1", "C", 1), ("d1", "D", 2), ("e1", "E", None), ("f1", "F", None)], "path string, module string, layer int")
    pairs = spark.createDataFrame([("a1", "b1", 9), ("a1", "c1", 5), ("a2", "c1", 7), ("b1", "c1", 4), ("a1", "a2", 50), ("a1", "d1", 9), ("e1", "f1", 9), ("a1", "gone", 9)], "a string, b string, shared bigint")
    edges = spark.createDataFrame([("b2", "a2"), ("c1", "c1"), ("d1", "c1")], "src string, dst string")
    assert [tuple(x) for x in s.independent_modules(pairs, edges, homes).collect()] == [("A", "C", 2, 7)]
    assert s.independent_modules(pairs, edges.limit(0), homes, 8).orderBy("m").select("m", "n", "pairs").collect() == [("A", "B", 1)]


def test_change_logs(spark, monkeypatch):
    text = "1\t1\tearly.py\nCa1\n3\t2\tx.py\n-\t-\tlogo.png\n0\t0\told.py => new.py\n0\t1\tsrc/{a => b}/f.py\n\nCb2 a1\n4\t0\tsrc/{ => in}/f.py\n5\t0\tsrc/{in => }/f.py\n6\t0\t{x => y}/f.py\n7\t0\ta\tb.py\nnot a line\nCc3 a1 b2\n9\t9\tx.py\nCd4\nCe5 d4\n8\t8\tx{y}.py"
    want = [("a1", "x.py", 3, 2), ("a1", "logo.png", None, None), ("a1", "new.py", 0, 0), ("a1", "src/b/f.py", 0, 1), ("b2", "src/in/f.py", 4, 0), ("b2", "src/f.py", 5, 0), ("b2", "y/f.py", 6, 0), ("b2", "a\tb.py", 7, 0), ("e5", "x{y}.py", 8, 8)]
    log = spark.createDataFrame([*enumerate(text.split("\n")), (None, "Cff"), (99, None)], "line int, text string")
    for bits in (0, 2, 16):
        monkeypatch.setattr(s, "LOG_BITS", bits)
        assert sorted(map(str, map(tuple, s.numstat(log).collect()))) == sorted(map(str, want))
    assert s.numstat(log.limit(0)).count() == 0


def test_liveness_finds_what_keeps_itself_alive(spark):
    from quern.operators import reach

    roles = {"m": "root", "g": "registry", "t": "test", "a": "service", "b": "service", "r": "resolver", "i": "service", "j": "service", "u": "service", "x": "service"}
    nodes = spark.createDataFrame([(i, f"{i}.py") for i in roles], "id string, path string")
    edges = spark.createDataFrame([("m", "a"), ("a", "b"), ("t", "x"), ("t", "b"), ("i", "j"), ("j", "i"), ("u", "i"), ("r", "b"), ("u", "u")], "src string, dst string")
    got = {x.id: (x.state, x.confidence, x.fan_in) for x in reach.liveness(nodes, edges, spark.createDataFrame(list(roles.items()), "id string, role string")).collect()}
    assert got == {
        "m": ("entry", None, 0), "g": ("entry", None, 0), "t": ("entry", None, 0), "a": ("live", None, 1), "b": ("live", None, 3), "r": ("orphan resolver", "high", 0),
        "i": ("island", "low", 2), "j": ("island", "low", 1), "u": ("unused", "low", 0), "x": ("tested", "low", 1),
    }
