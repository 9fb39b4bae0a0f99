"""The operators on small authored inputs whose results are known."""

from __future__ import annotations

import io
import math
import textwrap
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation as ev
from quern.operators import graph as g
from quern.operators import smells as sm
from quern.operators import statements as stm
from quern.operators import structure as st
from quern.sources import braces, pycode, scan

NODE = "id string, path string, lang string, loc bigint, types bigint, abstract bigint, unresolved bigint"


def graph(spark, pairs, extra=()):
    ids = sorted({x for p in pairs for x in p[:2]} | set(extra))
    nodes = spark.createDataFrame([(i, f"{i}.py", "python", 1, 0, 0, 0) for i in ids], NODE)
    return nodes, spark.createDataFrame([(*p, 1) if len(p) == 2 else p for p in pairs], "src string, dst string, weight bigint")


def one(df):
    (row,) = df.collect()
    return row


# -- evaluation


def test_ratios_and_matches(spark):
    calls = spark.createDataFrame([("c", "expected", x) for x in "abc"] + [("c", "actual", x) for x in "abx"], "case_id string, side string, name string")
    r = one(ev.tool_match(calls))
    assert (r.tp, r.fp, r.fn) == (2, 1, 1) and r.f1 == pytest.approx(2 / 3)
    twice = spark.createDataFrame([("c", "expected", "a"), ("c", "actual", "a"), ("c", "actual", "a")], calls.schema)
    assert (one(ev.tool_match(twice)).tp, one(ev.tool_match(twice)).fp) == (1, 1)
    none = spark.createDataFrame([("c", "actual", "a")], calls.schema)
    assert one(ev.tool_match(none)).recall is None and one(ev.tool_match(none)).f1 is None
    rows = [("c", "expected", "flight.date", "1"), ("c", "expected", "seat", "2"), ("c", "actual", "flight.date", "9")]
    f = one(ev.field_match(spark.createDataFrame(rows, "case_id string, side string, path string, value string")))
    assert (f.tp, f.wrong_value, f.omitted_optional, f.fp, f.fn) == (0, 1, 1, 1, 2)


def test_flatten_json(spark):
    doc = '{"a": {"b": [1, {"c": "x"}], "e": {}}, "f": [], "g": null, "h": 2.5}'
    rows = spark.createDataFrame([(1, doc), (2, "no json"), (3, None)], "id int, j string")
    got = {(r.id, r.path): r.value for r in ev.flatten_json(rows, "id", "j", 5).collect()}
    assert got == {(1, "a.b[0]"): "1", (1, "a.b[1].c"): '"x"', (1, "g"): "null", (1, "h"): "2.5"}


def test_rankings(spark):
    rank = spark.createDataFrame([("q", i + 1, r) for i, r in enumerate([3, 2, 3, 0, 1, 2])] + [("z", i, 0) for i in (1, 2, 3)], "query_id string, rank int, relevance int")
    got = {r.query_id: r for r in ev.dcg(rank, 6).collect()}
    dcg = lambda rel: sum((2**x - 1) / math.log2(i + 2) for i, x in enumerate(rel))
    assert got["q"].dcg == pytest.approx(dcg([3, 2, 3, 0, 1, 2])) and got["q"].idcg == pytest.approx(dcg([3, 3, 2, 2, 1, 0]))
    assert got["z"].ndcg is None and got["z"].excluded
    m = one(ev.mrr(spark.createDataFrame([("a", 1), ("b", 2), ("c", None), ("d", 4)], "query_id string, rank int")))
    assert m.mrr == pytest.approx(1.75 / 3) and (m.with_hit, m.without) == (3, 1)
    flags = spark.createDataFrame([("a", i, bool(x)) for i, x in enumerate([1, 0, 1])] + [("b", i, bool(x)) for i, x in enumerate([0, 1, 0])], "query_id string, rank int, relevant boolean")
    assert one(ev.mean_average_precision(flags, 3)).map_at_k == pytest.approx(2 / 3)


def test_sequences(spark):
    order = [("c", "actual", i, x) for i, x in enumerate("abc")] + [("c", "ideal", i, x) for i, x in enumerate("bac")]
    assert one(ev.kendall(spark.createDataFrame(order, "case_id string, side string, pos int, item string"))).tau == pytest.approx(1 / 3)
    cases = spark.createDataFrame([("c", list("abcd"), list("acd")), ("e", [], ["a"]), ("f", list("xaxbx"), list("ab"))], "case_id string, expected array<string>, actual array<string>")
    got = {r.case_id: r for r in ev.trajectory(cases).collect()}
    assert (got["c"].lcs, got["c"].over_expected) == (3, 0.75) and got["e"].lcs == 0 and got["e"].over_expected is None and got["f"].lcs == 2


def test_trials_and_scores(spark):
    trials = spark.createDataFrame([("a", True)] * 2 + [("a", True), ("b", True), ("b", True), ("b", False)] + [("c", False)] * 3, "case_id string, success boolean")
    r = one(ev.reliability_summary(trials))
    assert r.mean_rate == pytest.approx(5 / 9) and r.strict_rate == pytest.approx(1 / 3) and r.k == [3]
    c = one(ev.calibration(spark.createDataFrame([(1.0, 1), (0.0, 0), (0.5, 1), (0.5, 0)], "p double, outcome int"), 2))
    assert c.brier == 0.125 and c.ece == 0
    with pytest.raises(Exception, match="0 to 1"):
        ev.calibration(spark.createDataFrame([(1.5, 1)], "p double, outcome int")).collect()
    assert one(ev.calibration(spark.createDataFrame([], "p double, outcome int"))).brier is None
    scores = spark.createDataFrame([("x", float(v)) for v in (1, 1, 1, 0)] + [("y", 1.0), ("y", 0.0)], "scenario string, score double")
    m, t = one(ev.macro_micro(scores)), one(ev.lower_tail_mean(scores, 0.5))
    assert (m.macro, m.micro, m.worst_scenario) == (0.625, pytest.approx(4 / 6), "y") and (t.used, t.cvar) == (3, pytest.approx(1 / 3))
    w = one(ev.interval(spark.createDataFrame([(True,)] * 4 + [(False,)] * 2, "success boolean")))
    assert w.low < 4 / 6 < w.high
    assert one(ev.interval(spark.createDataFrame([], "success boolean"))).point is None
    many = spark.createDataFrame([("x", float(i)) for i in range(100)], "scenario string, score double")
    assert one(ev.lower_tail_mean(many, 0.07)).used == 8


# -- graphs


def test_ring_and_shapes(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x"), ("a", "x"), ("z", "a")]
    hub = [(f"k{i}", "hub") for i in range(5)] + [("hub", f"k{i}") for i in range(5)]
    full = [(f"f{i}", f"f{j}") for i in range(4) for j in range(4) if i != j]
    line = [(f"l{i}", f"l{i + 1}") for i in range(6)] + [(f"l{i + 1}", f"l{i}") for i in range(6)]
    nodes, edges = graph(spark, pairs + hub + full + line, ["lone"])
    scc = g.step(g.components(nodes, edges))
    assert {(r.scc, r.size) for r in g.tangles(scc).collect()} == {("a", 3), ("x", 2), ("hub", 6), ("f0", 4), ("l0", 7)}
    got = {r.scc: r.shape for r in g.shapes(scc, edges).collect()}
    assert got == {"a": "circle", "x": "tiny", "hub": "star", "f0": "clique", "l0": "chain"}
    cut = {r.scc: (r.cut_src, r.cut_dst) for r in g.weakest_edge(scc, edges).collect()}
    assert cut["a"] == ("a", "b") and g.hub_spread(scc, edges, cap=5).where("hub is null and hub_note <> ''").count() == 2


def test_ranks_and_reach(spark):
    nodes, edges = graph(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("d", "d")])
    rank = {r.id: r.pagerank for r in g.pagerank(nodes, edges.where("src <> dst")).collect()}
    ids, out = ["a", "b", "c", "d"], {"a": ["b", "c"], "b": ["c"]}
    plain = dict.fromkeys(ids, 0.25)
    for _ in range(40):
        new = dict.fromkeys(ids, 0.15 / 4)
        for i in ids:
            for t in out.get(i, ids):
                new[t] += 0.85 * plain[i] / len(out.get(i, ids))
        plain = new
    assert all(rank[i] == pytest.approx(plain[i] * 4, abs=6e-4) for i in ids)
    assert one(g.propagation_cost(nodes, edges)).cost == round(3 / 16, 4) and one(g.propagation_cost(nodes, edges, include_self=True)).cost == round(7 / 16, 4)
    over = one(g.propagation_cost(nodes, edges, cap=3))
    assert over.cost is None and "exceeds cap 3" in over.note
    path, steps = graph(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    assert {r.id: r.betweenness for r in g.betweenness(path, steps)[0].collect()} == {"a": 0.0, "b": round(2 / 6, 4), "c": round(2 / 6, 4), "d": 0.0}
    assert g.betweenness(path, steps, cap=3)[1] and g.pagerank(nodes.limit(0), edges).count() == 0


def test_node_metrics_and_hubs(spark):
    nodes = spark.createDataFrame([("a", "a.py", "python", 1, 4, 1, 0), ("b", "b.py", "python", 1, 0, 0, 0)], NODE)
    edges = spark.createDataFrame([("a", "x", 1), ("a", "y", 1), ("x", "a", 1)], "src string, dst string, weight bigint")
    got = {r.id: r for r in g.node_metrics(nodes, edges).collect()}
    assert (got["a"].instability, got["a"].abstractness, got["a"].distance) == (0.667, 0.25, 0.083)
    assert got["b"].instability is None and got["b"].abstractness is None and got["b"].distance is None
    values = spark.createDataFrame([(v,) for v in (0, 0, 1, 1, 4, 9)], "v int")
    assert one(g.distinct_median(values, "v")).median == 4 and one(g.distinct_median(values.where("v = 0"), "v")).median == 0.0


@pytest.mark.parametrize(
    ("path", "types", "abstract", "role"),
    [
        ("tests/a.py", 0, 0, "test"), ("src/test_x.py", 0, 0, "test"), ("src/main.py", 0, 0, "root"), ("src/utils/x.py", 0, 0, "util"), ("src/order_context.py", 2, 2, "context"),
        ("src/x.py", 2, 2, "port"), ("src/x_port.py", 0, 0, "port"), ("src/x/__init__.py", 0, 0, "registry"), ("src/io/x.py", 0, 0, "adapter"), ("src/x.py", 2, 1, "service"), ("src/utility/x.py", 0, 0, "service"),
    ],
)
def test_initial_roles(spark, path, types, abstract, role):
    row = spark.createDataFrame([(path, types, abstract)], "p string, t int, a int")
    assert one(row.select(g.initial_role(F.col("p"), F.col("t"), F.col("a")).alias("r"))).r == role


def test_every_legality_rule(spark):
    rows = {
        "u": "src/utils/u.py", "u2": "src/utils/u2.py", "r": "src/main.py", "t": "tests/t.py", "p": "src/a/price_port.py", "v1": "src/a/x/one.py", "v2": "src/a/x/two.py", "reg": "src/a/x/registry.py",
        "s": "src/a/svc.py", "s2": "src/a/svc2.py", "o": "src/b/other.py", "up": "src/a/x/y/deep.py",
    }
    nodes = spark.createDataFrame([(i, p, "python", 1, 0, 0, 0) for i, p in rows.items()], NODE)
    want = {
        ("u", "s"): g.UTIL_SINK, ("u", "u2"): "", ("s", "u"): "", ("r", "s"): "", ("s", "r"): g.IMPORTS_ROOT, ("t", "s"): "", ("s", "t"): g.IMPORTS_TEST, ("v1", "v2"): g.SIBLING_RESOLVER,
        ("v1", "reg"): g.OWN_REGISTRY, ("s", "s2"): "", ("s", "v1"): "", ("v1", "p"): "", ("v2", "p"): "", ("up", "s"): g.UPWARD[0] + "service" + g.UPWARD[1], ("s", "o"): g.SIDEWAYS,
    }
    edges = spark.createDataFrame([(*k, 1) for k in want], "src string, dst string, weight bigint")
    role = g.roles(nodes, edges)
    assert {r.id: r.role for r in role.collect()}["v1"] == "resolver"
    assert {(r.src, r.dst): r.reason for r in g.legality(edges, role).collect()} == want
    health = one(g.port_health(role, edges))
    assert (health.port, health.resolvers, health.has_absent_resolver, health.contract_suite, health.imported_outside_root) == ("p", 2, False, None, [])


def test_port_health_wants_a_contract_suite_and_names_who_reaches_past_the_root(spark):
    paths = {"p": "src/a/price_port.py", "t1": "tests/price.py", "t2": "tests/price_contract.py", "t3": "tests/contract_b.py", "o": "src/b/one.py", "n": "src/b/two.py", "m": "src/main.py"}
    nodes = spark.createDataFrame([(i, p, "python", 1, 0, 0, 0) for i, p in paths.items()], NODE)
    edges = spark.createDataFrame([(i, "p", 1) for i in paths if i != "p"], "src string, dst string, weight bigint")
    health = one(g.port_health(g.roles(nodes, edges), edges))
    assert health.contract_suite == "tests/price_contract.py" and health.imported_outside_root == ["n", "o"]


def test_verdict_by_the_stated_thresholds(spark):
    rows = [(0, 0, 4, 100, 0), (0, 0, 5, 100, 0), (0, 0, 0, 100, 1), (2, 2, 19, 100, 9), (3, 0, 0, 100, 0), (0, 3, 0, 100, 0), (0, 0, 20, 100, 0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int")
    got = [r.v for r in df.select(g.verdict(*map(F.col, "abcde")).alias("v")).collect()]
    assert got == ["SOUND", "DRIFTING", "DRIFTING", "DRIFTING", "ERODED", "ERODED", "ERODED"]


def test_names(spark):
    row = one(spark.createDataFrame([("a/NoopLogger.py", "a/nonexistent_price.py")], "x string, y string").select(g.name_words(F.col("x")).alias("w"), g.is_absent_resolver(F.col("x")).alias("a"), g.is_absent_resolver(F.col("y")).alias("b"), g.is_under(F.lit("src/billing2"), F.lit("src/billing")).alias("u")))
    assert row.w == ["noop", "logger"] and row.a and not row.b and not row.u


# -- limits, sets, history


def test_limits_and_exemptions(spark):
    texts = ["", "a", "a\n", "a\nb", "x\n" * 10]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(st.line_count(F.col("t")).alias("n"), st.lint_line_count(F.col("t")).alias("l"))
    assert [r.n for r in rows.collect()] == [0, 1, 1, 2, 10] and [r.l for r in rows.collect()] == [1, 1, 2, 2, 11]
    found = st.violations(spark.createDataFrame([("a", 250), ("b", 251), ("c", 201), ("d", 200)], "path string, value int"), "file_lines")
    assert {(r.path, r.severity, r.cap) for r in found.collect()} == {("a", "minor", 200), ("b", "major", 250), ("c", "minor", 200)}
    why = spark.createDataFrame([("b", "file_lines", "generated"), ("c", "file_lines", " ")], "path string, metric string, reason string")
    assert {(r.path, r.metric, r.severity) for r in st.exempted(found, why).collect()} == {("a", "file_lines", "minor"), ("b", "file_lines", "exempt"), ("c", "file_lines", "minor"), ("c", "exempt_without_reason", "major")}
    lines = ["# quern:exempt method_lines nesting, -- vendored", "", "# rows exempt from the check", "def f():", "    pass", "# quern:exempt params", "x = 1", "y = 2"]
    held = st.pragmas(spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "path string, line int, text string")).collect()
    assert {(r.line, r.metric, r.reason) for r in held} == {(4, "method_lines", "vendored"), (4, "nesting", "vendored"), (7, "params", "")}
    files = spark.createDataFrame([(f"wide/{i}.py",) for i in range(9)] + [("wide/0.py",), ("wide/deep/x.py",), ("infra/a.tf",), ("infra/b.h",)], "path string")
    assert {(r.folder, r.value) for r in st.folder_files(files).collect()} == {("wide", 9), ("wide/deep", 1)}


def test_imports_and_sets(spark):
    text = "from a.b import c\nimport os, sys as s, a.bc\nfrom . import x\n    import late  # why\nx = 1"
    found = st.lexical_imports(spark.createDataFrame([("f.py", text)], "path string, text string"))
    assert {(r.line, r.module) for r in found.collect()} == {(1, "a.b"), (2, "os"), (2, "sys"), (2, "a.bc"), (4, "late")}
    assert {(r.module, r.prefix) for r in st.prefix_violations(found, ["a.b", "os"]).collect()} == {("a.b", "a.b"), ("os", "os")}
    row = one(spark.createDataFrame([(" b, a,,b ", "  ", "Foo Bar!! (x)", "__A__ and __A_B__ __A__")], "x string, y string, n string, t string").select(
        st.ordered_distinct(F.col("x"), ["d"]).alias("x"), st.ordered_distinct(F.col("y"), ["d"]).alias("y"), st.slug(F.col("n")).alias("n"), st.tokens(F.col("t")).alias("t"), st.substituted(F.col("t"), {"__A__": "1", "__A_B__": "2"}).alias("s")))
    assert (row.x, row.y, row.n, row.t, row.s) == (["b", "a"], ["d"], "foo-bar-x", ["__A__", "__A_B__"], "1 and 2 1")
    with pytest.raises(Exception, match="HOST is missing"):
        spark.createDataFrame([(" ",)], "v string").select(st.required(F.col("v"), "HOST")).collect()
    docs = spark.createDataFrame([(None,), ("{",), ('{"a":1}',), ('{"Statement":[]}',)], "j string")
    assert [r.r.reason for r in docs.select(st.lenient_json(F.col("j"), "Statement").alias("r")).collect()] == ["empty", "not json", "no Statement", ""]
    live = spark.createDataFrame([("d", "Deny", "x"), ("d", "Allow", "y")], "doc string, effect string, action string")
    made = spark.createDataFrame([("d", "Allow", "x"), ("d", "Allow", "y")], live.schema)
    merged = {(r.effect, r.action, r.origin) for r in st.additive_merge(live, made, ["doc", "effect"], "action").collect()}
    assert merged == {("Deny", "x", "preserved"), ("Allow", "x", "generated"), ("Allow", "y", "both")}


def test_history(spark):
    rows = [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "a"), (4, "b"), (5, "c")]
    changes = spark.createDataFrame([(s, "2024-01-01", "me", p, None if p == "c" else 2, 1) for s, p in rows], "sha int, ts string, author string, path string, added bigint, deleted bigint")
    assert [(r.a, r.b, r.shared) for r in st.co_change(changes).collect()] == [("a", "b", 2)]
    assert one(st.temporal_coupling(changes, 2)).degree == round(200 * 2 / 6, 4)
    assert {r.path: r.churn for r in st.churn(changes, F.lit("2023")).collect()}["c"] == 1


# -- sources


def test_python_scan_and_relative_imports(spark):
    files = [
        ("lib/alpha.py", "import beta\nfrom ...too import far\nfrom . import beta as b"), ("lib/beta.py", "import json\nfrom typing import Protocol\nclass P(Protocol): ...\nclass Q: ..."),
        ("far/delta.py", "import beta, zeta"), ("a/b/c/d.py", "from ....root import x\nfrom .....past import y"), ("root.py", ""), ("bad.py", "def ("), ("a/__init__.py", "from . import b"),
    ]
    recs = scan.records(spark.createDataFrame(files, "path string, text string"))
    got = {r.path: r for r in recs.collect()}
    assert got["lib/beta.py"].types == 2 and got["lib/beta.py"].abstract == 1 and got["bad.py"].unparseable.startswith("line 1") and got["a/__init__.py"].id == "a"
    assert got["a/b/c/d.py"].raw == ["root"] and got["a/b/c/d.py"].raw_maybe == ["root.x"] and got["a/__init__.py"].raw_maybe == ["a.b"]
    pairs = {(r.src, r.dst) for r in scan.edges(scan.resolved(scan.nodes(recs))).collect()}
    assert pairs == {("lib.alpha", "lib.beta"), ("a.b.c.d", "root")}


def test_longest_tail_and_ambiguity(spark):
    names = ["src/pkg/x.py", "other/pkg/x.py", "src/only/y.py", "src/use.py"]
    files = [(n, "") for n in names[:3]] + [(names[3], "import pkg.x\nimport only.y\nimport lost.z")]
    found = scan.resolved(scan.nodes(scan.records(spark.createDataFrame(files, "path string, text string"))))
    assert {r.target: r.dst for r in found.collect()} == {"pkg.x": None, "only.y": "src.only.y", "lost.z": None}
    assert {r.src: r.unresolved for r in scan.unresolved(found).collect()} == {"src.use": 2}


def test_imports_past_the_root_are_counted(spark):
    files = [("a/b/c.py", "from .... import x\nfrom ...y import z\nfrom . import d\nfrom .e import f\nfrom .g import *\nimport os.path")]
    row = one(scan.records(spark.createDataFrame(files, "path string, text string")))
    assert row.raw == ["a.b", "a.b.e", "a.b.g", "os.path", "y"] and row.raw_maybe == ["a.b.d", "a.b.e.f", "y.z"] and row.too_deep == 1 and row.id == "a.b.c"


def test_other_languages(spark):
    files = [
        ("web/a.ts", "import x from './b'\nimport '../c/index.js'\nconst d = require('react')\nimport('@/e/f')\nexport interface I {}\nclass K {}"), ("web/b/index.ts", ""),
        ("j/A.java", "package p.q;\nimport static p.q.B;\nimport p.r.*;\npublic abstract class A {}\nclass C {}"), ("k/B.kt", "package p.q\nimport p.q.A"),
        ("g/x.go", 'package g\nimport "m/h"\nimport (\n  "m/i"\n  z "m/j"\n)\ntype S struct {}\ntype I interface {}'), ("n.txt", "import q"),
    ]
    got = {r.path: r for r in scan.records(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got["web/a.ts"].raw == ["c", "e/f", "web/b"] and (got["web/a.ts"].types, got["web/a.ts"].abstract) == (2, 1)
    assert got["j/A.java"].raw == ["p.q.B"] and got["j/A.java"].pkg == "p.q" and got["j/A.java"].types == 2 and got["k/B.kt"].raw == ["p.q.A"]
    assert got["g/x.go"].raw == ["m/h", "m/i", "m/j"] and (got["g/x.go"].types, got["g/x.go"].abstract) == (2, 1)
    assert (got["n.txt"].raw, got["n.txt"].types, got["n.txt"].lang, got["n.txt"].loc) == ([], None, None, 1)
    pairs = {(r.src, r.dst) for r in scan.edges(scan.resolved(scan.nodes(scan.records(spark.createDataFrame(files, "path string, text string"))))).collect()}
    assert pairs == {("web/a", "web/b"), ("p.q.A", "p.q.B"), ("p.q.B", "p.q.A")}


def test_admission_and_tree(spark, tmp_path):
    (tmp_path / "t/node_modules").mkdir(parents=True)
    for name in ("t/a.py", "t/node_modules/b.js", "t/c.min.js", "t/d.txt"):
        (tmp_path / name).write_text("x = 1\n")
    got = {r.path: r.refused for r in scan.admitted(scan.read_tree(spark, f"{tmp_path}/t")).collect()}
    assert got == {"a.py": None, "node_modules/b.js": "pruned", "c.min.js": "minified", "d.txt": "other language"}


def test_measures_of_functions(spark):
    body = textwrap.dedent('''
        class K(A, B):
            """Doc."""
            def public(self, a, b=1, *, c, **kw):
                """Doc."""
                for x in a:
                    if x:
                        while b:
                            pass
                    elif c:
                        pass
                else:
                    pass
                def inner(q):
                    return q
            def _hidden(self): ...
    ''')
    rows = {(r.metric, r.name): r.value for r in pycode.measures(spark.createDataFrame([("f.py", body), ("g.py", "def (")], "path string, text string")).collect()}
    assert rows["nesting", "K.public"] == 2 and rows["params", "K.public"] == 3 and rows["method_lines", "K.public"] == 10 and rows["public", "K"] == 1
    assert rows["multiple_inheritance", "K"] == 2 and rows["else_branch", "K.public (elif)"] == 1 and rows["odd_else", "K.public (loop/try else)"] == 1 and rows["params", "K.public.inner"] == 1
    assert ("unparseable", "invalid syntax") in rows or any(m == "unparseable" for m, _ in rows)


def test_lint(spark):
    long = "def run():\n" + "    x = 1\n" * 30
    enum = "from enum import Enum\nclass One(Enum):\n    A = 1\nclass Two(Enum):\n    A = 1\n    B = 2\nitems = []\nLIMITS = {}\n"
    files = spark.createDataFrame([("src/utils/helper.py", long), ("a.py", enum), ("b.txt", "x\n" * 300), ("c.py", "def (")], "path string, text string")
    got = {(r.path, r.rule) for r in pycode.lint(files).collect()}
    assert got == {("src/utils/helper.py", "method-too-long"), ("src/utils/helper.py", "vague-method-name"), ("src/utils/helper.py", "vague-file-name"), ("src/utils/helper.py", "vague-folder-name"), ("a.py", "single-member-enum"), ("a.py", "module-level-state"), ("b.txt", "file-too-long")}
    assert {r.path: r.failed for r in pycode.gate(pycode.lint(files)).collect()} == {"src/utils/helper.py": True, "a.py": False, "b.txt": True}


def deck(slides):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i, (layout, title, body) in enumerate(slides, 1):
            block = lambda kind, text: "" if text is None else f'<p:sp><p:ph type="{kind}"/><a:t>{text}</a:t></p:sp>'
            z.writestr(f"ppt/slides/slide{i}.xml", block("title", title) + block("body", body) + '<a:off x="5" y="5"/><a:ext cx="90" cy="200"/>')
            z.writestr(f"ppt/slides/_rels/slide{i}.xml.rels", f"x/slideLayout{layout}.xml" if layout else "none")
    return out.getvalue()


def test_deck_checks(spark):
    slides = [(13, "T", None), (12, "GOOD", "b"), (12, None, "b"), (12, "", None), (12, "SAME", "SAME"), (12, "Lower case", None), (15, "SECTION Growth", "Market expansion"), (15, "PART two", None), (None, "x", None)]
    rows = [("out", deck(slides)), ("src", deck([(15, "SECTION Growth", "Market margins")])), ("none", deck([(13, "T", None)]))]
    found = pycode.slides(spark.createDataFrame(rows, "deck string, content binary")).cache()
    faults = {(r.deck, r.slide): r.fault for r in pycode.title_faults(found, "slideLayout12.xml").collect()}
    assert faults == {("out", "slide3.xml"): "no title", ("out", "slide4.xml"): "empty title", ("out", "slide5.xml"): "title is subtitle", ("out", "slide6.xml"): "title not upper case", ("src", None): "nothing was checked", ("none", None): "nothing was checked"}
    assert [(r.deck, r.fault) for r in pycode.divider_faults(found, ["slideLayout15.xml"]).collect()] == [("out", "captions on some dividers only")]
    lost = pycode.lost_words(found.where("deck = 'src'"), found.where("deck = 'out'"))
    assert [(r.slide, r.word) for r in lost.collect()] == [("slide1.xml", "margins")]
    assert {(r.deck, r.layout) for r in pycode.missing_layouts(found, ["slideLayout13.xml", "slideLayout14.xml"]).collect()} == {("out", "slideLayout14.xml"), ("none", "slideLayout14.xml"), ("src", "slideLayout13.xml"), ("src", "slideLayout14.xml")}
    assert pycode.out_of_bounds(found, 100, 100).count() == 11 and pycode.out_of_bounds(found, 100, 100, 200).count() == 0


def test_whole_module_graph_keeps_every_pair(spark, tmp_path):
    from quern.catalog import QUERIES

    spark.createDataFrame([(o, n, 1, m) for o in range(30) for n, m in ((1, 1), (2, 2 + o % 6), (3, 1))], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, 1) for k in range(1, 8)], "s_suppkey bigint, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    pairs = {(f"s{a}", f"s{b}", 5) for k in range(2, 8) for a, b in ((1, k), (k, 1))}
    assert {tuple(x) for x in QUERIES["g_edges"](spark, str(tmp_path)).collect()} == pairs
    fans = {x.id: (x.fan_in, x.fan_out) for x in QUERIES["g_fans"](spark, str(tmp_path)).collect()}
    assert fans == {"s1": (6, 6)} | {f"s{k}": (1, 1) for k in range(2, 8)}
    assert [tuple(x) for x in QUERIES["h_crossing"](spark, str(tmp_path)).collect()] == [("s1", 6, 6)]
    assert QUERIES["h_unlinked_pairs"](spark, str(tmp_path)).count() == 0


def test_skipped_betweenness_says_why_as_its_twin_does(spark, tmp_path):
    import duckdb

    from quern.catalog import ORACLE_SQL, QUERIES

    spark.createDataFrame([(1, 1, 1, 1), (1, 2, 1, 2)], "l_orderkey bigint, l_linenumber int, l_partkey bigint, l_suppkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 1202).selectExpr("id AS s_suppkey", "1 AS s_nationkey").write.parquet(f"{tmp_path}/supplier.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "supplier"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = QUERIES["g_betweenness_noted"](spark, str(tmp_path)).select("betweenness", "note").distinct().collect()
    want = con.sql(f"SELECT DISTINCT betweenness, note FROM ({ORACLE_SQL['g_betweenness_noted']})").fetchall()
    assert [tuple(x) for x in got] == want == [(None, "betweenness skipped: 1201 nodes exceeds cap 1200")]


def test_brace_measures_by_language(spark):
    ts = """/* { a block
   over lines { */
export class Shop {
  open(a: string, b = "x, {") {
    for (let i = 0; i < 3; i++) {
      if (a) { b() } else if (b) { c() }
      else { d() }
    }
  }
  close() { return `}` }
  private hide() { }
  total(): number { return 1 } // } else {
}
const twice = (x) => {
  list.forEach(y => { if (y) { inner() } })
}
"""
    java = "interface Port {\n  public int a();\n  public int b();\n}\nclass C {\n  void f(Map<K, V> m,\n    int n) throws E {\n    while (a) {\n      x();\n    }\n  }\n"
    go = "# {\nfunc (r *T) Run(a int, b int) error {\n\tfor i := 0; i < 9; i++ {\n\t\tx()\n\t}\n}\ntype T struct {\n\tName string\n\thidden int\n}\n"
    rows = [("s.ts", ts), ("C.java", java), ("t.go", go), ("p.py", "{"), ("empty.go", ""), ("null.ts", None), ("open.js", "function f() {")]
    found = {}
    for r in braces.measures(spark.createDataFrame(rows, "path string, text string")).collect():
        found.setdefault((r.path, r.metric, r.name), []).append((r.line, r.value))
    assert found == {
        ("s.ts", "params", "open"): [(4, 2)], ("s.ts", "method_lines", "open"): [(4, 4)], ("s.ts", "nesting", "open"): [(6, 2)], ("s.ts", "loop_body", "open"): [(5, 3)],
        ("s.ts", "else_branch", "open (else if)"): [(6, 1)], ("s.ts", "else_branch", "open (else)"): [(7, 1)],
        ("s.ts", "params", "close"): [(10, 0)], ("s.ts", "method_lines", "close"): [(10, 0)], ("s.ts", "nesting", "close"): [(10, 0)],
        ("s.ts", "params", "hide"): [(11, 0)], ("s.ts", "method_lines", "hide"): [(11, 0)], ("s.ts", "nesting", "hide"): [(11, 0)],
        ("s.ts", "params", "total"): [(12, 0)], ("s.ts", "method_lines", "total"): [(12, 0)], ("s.ts", "nesting", "total"): [(12, 0)],
        ("s.ts", "public", "Shop"): [(3, 3)],
        ("s.ts", "params", "(anonymous)"): [(14, 1)], ("s.ts", "method_lines", "(anonymous)"): [(14, 1)], ("s.ts", "nesting", "(anonymous)"): [(15, 2)], ("s.ts", "loop_body", "(anonymous)"): [(15, 0)],
        ("C.java", "public", "Port"): [(1, 2)], ("C.java", "params", "f"): [(7, 2)], ("C.java", "loop_body", "f"): [(8, 2)], ("C.java", "method_lines", "f"): [(7, 3)], ("C.java", "nesting", "f"): [(8, 1)],
        ("C.java", "unbalanced_braces", "scan fidelity degraded for this file"): [(11, 1)],
        ("t.go", "params", "Run"): [(2, 1)], ("t.go", "loop_body", "Run"): [(3, 2)], ("t.go", "method_lines", "Run"): [(2, 3)], ("t.go", "nesting", "Run"): [(3, 1)], ("t.go", "public", "(anonymous)"): [(7, 1)],
        ("open.js", "params", "f"): [(1, 0)], ("open.js", "unbalanced_braces", "scan fidelity degraded for this file"): [(1, 1)],
    }


def test_brace_headers_restart_and_strings_end_with_their_line():
    assert braces.parameters("f(a: () => void, b)") == 1 and braces.parameters("f( )") == 0 and braces.parameters("f(a, [b, c], {d, e})") == 3
    assert braces.blanked('a = "\\"{" + \'x\' /* {\n{ */ b // {\nc\\{', "ts") == 'a = "" + \'\'  \n b \nc..'
    long = "function f(" + "a" * braces.HEADER + ",\nb) {\n}\n"
    assert braces.file_measures(long, "ts") == []
    assert braces.file_measures("if a" + ";" * 100_000, "go") == []


def test_brace_violations_follow_the_limits(spark):
    rows = [("a.ts", 1, "params", 5, "f"), ("a.ts", 1, "params", 4, "g"), ("a.ts", 1, "params", 3, "h"), ("a.ts", 2, "unbalanced_braces", 2, ""), ("a.ts", 3, "else_branch", 1, "f (else)")]
    found = braces.violations(spark.createDataFrame(rows, braces.MEASURE)).collect()
    assert sorted((r.metric, r.value, r.severity, r.cap) for r in found) == [("else_branch", 1, "major", 0), ("params", 4, "minor", 3), ("params", 5, "major", 4), ("unbalanced_braces", 2, "minor", 0)]


# -- measures stated as formulas alone, against their formulas on small inputs


def test_rates_without_a_base_are_null(spark):
    goals = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "case_id string, satisfied boolean")
    assert {(r.case_id, r.satisfied, r.applicable, r.rate) for r in ev.goal_match(goals).collect()} == {("a", 1, 2, 0.5), ("b", 0, 0, None)}
    chances = spark.createDataFrame([("a", True, False), ("a", True, True), ("a", False, False)], "case_id string, mutated boolean, expected boolean")
    assert one(ev.side_effect_rate(chances)).rate == pytest.approx(1 / 3)
    quiet = spark.createDataFrame([("s", 0, 0), ("s", 0, 2), ("s", 1, 0), ("t", 1, 1)], "slice string, needed int, made int")
    assert {(r.slice, r.accuracy) for r in ev.no_call_accuracy(quiet).collect()} == {("s", 0.5), ("t", None)}
    marks = spark.createDataFrame([("a", "m", False), ("a", "m", True), ("a", "n", None)], "case_id string, milestone string, reached boolean")
    assert one(ev.milestones(marks)).completion == 0.5
    safe = spark.createDataFrame([("s", False, True, False, False, "P0"), ("s", True, True, True, False, "P1"), ("s", False, False, False, False, "P2")], "slice string, followed boolean, attack boolean, preserved boolean, achieved boolean, severity string")
    r = one(ev.safety(safe))
    assert (r.attacks, r.resilience, r.attack_success, r.critical) == (2, 0.5, 0.0, 1) and r.compliance == pytest.approx(1 / 3)


def test_permutation_and_alpha_against_plain_python(spark):
    import hashlib

    pairs = [("c1", 3.0, 1.0), ("c2", 2.0, 2.0), ("c3", 5.0, 1.0), ("c4", 1.0, 2.0), ("c5", None, 2.0)]
    d = [(c, a - b) for c, a, b in pairs if a is not None]
    flips = [sum(x if hashlib.md5(f"1:{i}:{c}".encode()).hexdigest()[0] < "8" else -x for c, x in d) for i in range(50)]
    r = one(ev.paired_permutation(spark.createDataFrame(pairs, "case_id string, a double, b double"), 50))
    assert (r.cases, r.difference) == (4, 1.25) and r.p == pytest.approx((1 + sum(abs(x) >= 5 for x in flips)) / 51)
    none = one(ev.paired_permutation(spark.createDataFrame([], "case_id string, a double, b double"), 5))
    assert (none.cases, none.difference, none.p) == (0, None, None)
    # Items of pairs: by hand, the observed disagreement is 1/4 and the expected one 4/7.
    seen = [("a", "x"), ("a", "x"), ("b", "x"), ("b", "x"), ("c", "y"), ("c", "y"), ("d", "x"), ("d", "y"), ("e", "x"), (None, "x"), ("e", None)]
    r = one(ev.krippendorff_alpha(spark.createDataFrame(seen, "item string, label string")))
    assert (r.items, r.ratings) == (4, 8) and r.alpha == pytest.approx(1 - (2 / 8) / (2 * 5 * 3 / (8 * 7)))
    assert one(ev.krippendorff_alpha(spark.createDataFrame([("a", "x"), ("a", "x")], "item string, label string"))).alpha is None


def test_fields_are_read_by_their_kind(spark):
    fields = [("at", "time", "2024-01-01T02:00:00+02:00"), ("at", "time", "soon"), ("city", "alias", "NYC"), ("city", "alias", "LA"), ("tags", "set", '["b","a","b"]'), ("stops", "list", '["b","a"]'), ("id", "id", "7"), ("id", "id", "8"), ("x", "set", None)]
    got = ev.canonical_fields(spark.createDataFrame(fields, "path string, kind string, value string"), spark.createDataFrame([("city", "NYC", "New York")], "path string, alias string, meant string"), spark.createDataFrame([("id", "7"), ("id", "7")], "path string, value string"))
    assert sorted(r.value or "" for r in got.collect()) == sorted(["2024-01-01T00:00:00Z", "soon", "New York", "LA", '["a","b"]', '["b","a"]', "known", "unknown", ""])


def test_packages_and_history(spark):
    nodes = spark.createDataFrame([("a", "p", 10, 31), ("b", "q", 50, 1), ("c", "r", 20, 1), ("d", "r", 5, 0)], "id string, package string, loc bigint, types bigint")
    assert {(r.package, r.rule, r.severity) for r in sm.god_components(nodes).collect()} == {("p", "fixed", -15), ("q", "median", 25)}
    changes = spark.createDataFrame([(i, p) for i, ps in enumerate(["ab", "ab", "bc", "bc", "c", "c", "c"]) for p in ps], "sha int, path string")
    got = {(r.a, r.b): r.p for r in sm.conditional_co_change(changes).collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 0.5, ("b", "c"): 0.5, ("c", "b"): 0.4, ("a", "c"): 0.5}
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "b"), (2, "a"), (2, None), (3, "z")], "set_id int, member string")
    assert [(r.members, r.occurrences) for r in sm.recurring_sets(sets).collect()] == [(["a", "b"], 2)]
    files = lambda per, of: spark.createDataFrame([(f"f{i}", f"m{i // per}", 0) for i in range(of)], "id string, module string, layer int")
    none = spark.createDataFrame([], "src string, dst string")
    for per, level in ((4, 1.0), (25, 0.5), (100, 0.35)):
        assert sm.decoupling_level(files(per, 100), none).agg(F.sum("dl")).head()[0] == pytest.approx(level, abs=0.005)
    smells = spark.createDataFrame([("a", "k", 1, 2), ("b", "k", 5, 2), ("c", "k", 5, 4), ("d", "j", 9, 2)], "id string, kind string, measure int, dependencies int")
    debt = {r.id: (r.severity, r.debt) for r in sm.debt_index(smells, spark.createDataFrame([("b", 2.0), ("a", 1.0), ("d", 1.0)], "id string, pagerank double"), spark.createDataFrame([("k", 5.0), ("j", 1.0)], "kind string, weight double")).collect()}
    assert debt == {"a": (0.0, 0.0), "b": (0.5, 0.5), "c": (0.5, None), "d": (0.0, 0.0)}


def test_statements_gate_what_makes_roles(spark):
    files = spark.createDataFrame([(1, "a", 'resource "aws_iam_role" "r" {}\nresource  "aws_lb" "l" {}\nbackend "s3" {'), (1, "a", 'resource "aws_iam_role" "r" {}'), (2, "b", None)], "doc int, path string, text string")
    table = spark.createDataFrame([("resource", "aws_iam_role", [], True)], "kind string, type string, actions array<string>, creates boolean")
    made = stm.granted(stm.declarations(files), table)
    r = one(made)
    assert (r.doc, r.actions, r.unknown, r.creates) == (1, ["elasticloadbalancing:*"], ["aws_lb"], True)
    assert {x.doc: x.backend for x in stm.state_backends(files).collect()} == {1: True, 2: False}
    docs = made.join(stm.state_backends(files), "doc").withColumn("regions", stm.strings([])).withColumn("boundary", F.lit("arn"))
    got = {x.sid: x for x in stm.statements(docs, ["iam:CreateRole"], ["iam:GetRole"]).collect()}
    assert list(got) == ["TerraformManagedResources", "ReadDescribeLeeway", "IAMCreateOnlyWithBoundary", "TerraformStateBackend"]
    assert "iam:CreateRole" not in got["TerraformManagedResources"].actions and got["IAMCreateOnlyWithBoundary"].allowed == ["arn"]
    bare = {x.sid: x for x in stm.statements(docs.withColumn("boundary", F.lit(None).cast("string")), ["iam:CreateRole"], ["iam:GetRole"]).collect()}
    assert "iam:CreateRole" in bare["TerraformManagedResources"].actions and "IAMCreateOnlyWithBoundary" not in bare
    votes = spark.createDataFrame([(1, "x", 3, "BETA", "prod.sh"), (1, "y", 2, "-", "prod.sh"), (1, "z", 1, "-", None)], "doc int, name string, weight int, line string, file string")
    assert {(v.name, v.weight) for v in stm.stage_votes(votes, "prod").collect()} == {("y", 12), ("z", 1)}
    found = spark.createDataFrame([("r", None, "", "p"), ("r", "b", "B", "b"), ("r", "a", "A", "a"), ("s", "a", None, " ")], "repo string, path string, url string, region string")
    assert {tuple(x) for x in stm.first_settings(found, ["url", "region"]).collect()} == {("r", "A", "p"), ("s", None, None)}


def test_a_top_exempts_with_a_reason_alone(spark):
    lines = "x\n" * 260
    rows = [("a.py", lines), ("b.py", f"{st.MARK} file_lines -- a table\n" + lines), ("c.py", f"{st.MARK} file_lines --\n" + lines), ("d.py", "x\n" * 25 + f"{st.MARK} file_lines -- late\n" + lines), ("e.md", lines), ("f.min.js", lines), ("g.go", "x\n" * 201), ("h.go", None)]
    got = {r.path: (r.severity, r.cap) for r in st.file_lengths(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a.py": ("major", 250), "b.py": ("exempt", 250), "c.py": ("major", 250), "d.py": ("major", 250), "g.go": ("minor", 200)}


def test_records_are_read_back_and_go_folders_named(spark, tmp_path):
    files = spark.createDataFrame([("a/b/x.go", 'package b\nimport "os"\n'), ("main.go", "package main\n"), ("a/y.py", "import os\n")], "path string, text string")
    made = scan.records(files)
    made.write.json(f"{tmp_path}/records")
    (tmp_path / "lines.json").write_text('{"path": "p.py", "lang": "python", "loc": 3}\n\n')
    key = lambda df: sorted(map(str, df.collect()))
    assert key(scan.read_records(spark, f"{tmp_path}/records", made)) == key(made)
    r = one(scan.read_records(spark, f"{tmp_path}/lines.json", made))
    assert (r.path, r.loc, r.id) == ("p.py", 3, None)
    (tmp_path / "ids").write_text("/r/a/b\texample.com/old\n/r/a/b\texample.com/m/b\n/r\texample.com/m\n/r/c\t\nno tab\n")
    ids = scan.read_go_ids(spark, f"{tmp_path}/ids", "/r")
    assert {tuple(x) for x in ids.collect()} == {("a/b", "example.com/m/b"), (".", "example.com/m")}
    named = {r.path: r.id for r in scan.with_go_ids(made, ids).collect()}
    assert (named["a/b/x.go"], named["main.go"]) == ("example.com/m/b", "example.com/m") and not (named["a/y.py"] or "").startswith("example")
