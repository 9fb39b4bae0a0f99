"""Dependency graphs: degrees, ranks, tangles and their shapes, roles and legality.

Nodes are (id, path, lang, loc, types, abstract, unresolved), edges (src, dst, weight) with distinct pairs.  What can't
be measured within its budget is NULL with a note, never 0.  Loops hand each step's small state on as a Parquet table
in the shared folder (see `step`), so lineage stays short and a lost executor costs one step.
"""

from __future__ import annotations


from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ratios import half_even, ratio
from quern.operators import dense, reach
from quern.operators.shared import step

#: The largest graphs that get a closure, a betweenness, and a betweenness inside one tangle.
CLOSURE_NODES, BETWEENNESS_NODES, TANGLE_NODES = 3000, 1200, 400
DAMPING, SWEEPS = 0.85, 40
#: How the note on a propagation cost begins that wasn't measured.
SKIPPED = "transitive closure skipped"
#: Sources of shortest paths that one task follows.
SOURCES = 64
#: Equal nodes that hold the part of the ranks that all nodes have.
HUBS = 16


# -- degrees and simple ratios


def fans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with fan_in and fan_out over distinct pairs; ends outside the scan count for no node."""
    pairs = edges.select("src", "dst").distinct()
    fan_in = pairs.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("fan_in"))
    fan_out = pairs.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("fan_out"))
    return nodes.join(fan_in, "id", "left").join(fan_out, "id", "left").na.fill(0, ["fan_in", "fan_out"])


def instability(fan_in: Column, fan_out: Column) -> Column:
    return half_even(ratio(fan_out, fan_in + fan_out), 3)


def abstractness(abstract: Column, types: Column) -> Column:
    return half_even(ratio(abstract, types), 3)


def main_distance(a: Column, i: Column) -> Column:
    return half_even(F.abs(a + i - 1), 3)


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    rows = fans(nodes, edges).withColumn("instability", instability(F.col("fan_in"), F.col("fan_out"))).withColumn("abstractness", abstractness(F.col("abstract"), F.col("types")))
    return rows.withColumn("distance", main_distance(F.col("abstractness"), F.col("instability")))


def distinct_median(rows: DataFrame, column: str) -> DataFrame:
    """One row: the median of the distinct values that aren't 0; 0.0 without any."""
    values = rows.select(F.col(column).alias("v")).where("v <> 0").distinct()
    return values.agg(F.coalesce(F.percentile("v", 0.5), F.lit(0.0)).alias("median"))


def hub_like(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes whose two fans are both above their medians and differ by a quarter of their sum at most."""
    rows = fans(nodes, edges)
    m_in = distinct_median(rows, "fan_in").withColumnRenamed("median", "m_in")
    m_out = distinct_median(rows, "fan_out").withColumnRenamed("median", "m_out")
    rows = rows.crossJoin(F.broadcast(m_in)).crossJoin(F.broadcast(m_out))
    return rows.where("fan_in > m_in and fan_out > m_out and abs(fan_in - fan_out) <= (fan_in + fan_out) / 4D").select("id", "fan_in", "fan_out")


# -- ranks and reachability


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = DAMPING, sweeps: int = SWEEPS) -> DataFrame:
    """id, pagerank: `sweeps` sweeps over the distinct edges as given, a sink's mass dealt to all nodes; the mean is 1.

    A rank is a node's own part, which comes along its edges, and a part s that is the same for all: the teleport and what sinks
    give.  Both parts of the next sweep are sums over those of the last one, so a sweep is one join by integer keys and one sum:
    s is a node of its own (HUBS equal ones, so that no key holds all nodes) with a way to each node, of the weight of the node's
    edges in, and from each sink and from s itself.
    """
    named = reach.numbers(nodes)
    n = named.count()
    if not n:
        return nodes.select("id").withColumn("pagerank", F.lit(None).cast("double"))
    pairs = reach.numbered_edges(named, edges)
    ways = pairs.join(pairs.groupBy("a").agg((damping / F.count("*")).alias("share")), "a").select("a", "z", "share")
    hub = -1 - F.col("n") % HUBS
    given = ways.groupBy("z").agg(F.sum("share").alias("share")).select((-1 - F.col("z") % HUBS).alias("a"), "z", "share")
    sinks = step(named.select("n").join(pairs.select(F.col("a").alias("n")), "n", "left_anti"))
    hubs = nodes.sparkSession.range(HUBS).select((-1 - F.col("id")).alias("hub"))
    into = sinks.crossJoin(F.broadcast(hubs)).select(F.col("n").alias("a"), F.col("hub").alias("z"), F.lit(damping / n).alias("share"))
    stays = hubs.select(F.col("hub").alias("a"), F.col("hub").alias("z"), F.lit(damping * sinks.count() / n).alias("share"))
    ways = step(ways.unionByName(given).unionByName(into).unionByName(stays))
    rank = hubs.select(F.col("hub").alias("a"), F.lit(1.0 / n).alias("rank"))
    for i in range(sweeps):
        got = ways.join(rank, "a").groupBy(F.col("z").alias("a")).agg(F.sum(F.col("rank") * F.col("share")).alias("rank"))
        rank = got.select("a", (F.col("rank") + F.when(F.col("a") < 0, (1 - damping) / n).otherwise(0.0)).alias("rank"))
        if (i + 1) % 8 == 0 or i == sweeps - 1:
            rank = step(rank)
    all_ = rank.select(F.col("a").alias("hub"), F.col("rank").alias("all"))
    ranked = named.withColumn("hub", hub).join(all_, "hub").join(rank.withColumnRenamed("a", "n"), "n", "left")
    return nodes.select("id").join(ranked.select("id", half_even((F.col("all") + F.coalesce("rank", F.lit(0.0))) * n, 3).alias("pagerank")), "id")


def propagation_cost(nodes: DataFrame, edges: DataFrame, include_self: bool = False, cap: int = CLOSURE_NODES, scc: DataFrame | None = None) -> DataFrame:
    """One row: nodes, cost, note.  The start is left out of what it reaches unless include_self; scc may hold the components."""
    spark, n = nodes.sparkSession, nodes.count()
    if not n or n > cap:
        note = "no nodes" if not n else f"{SKIPPED}: {n} nodes exceeds cap {cap}"
        return spark.createDataFrame([(n, None, note)], "nodes bigint, cost double, note string")
    seen = reach.visibility(nodes, edges, scc).agg(F.sum("vfo").alias("pairs"))
    return seen.select(F.lit(n).cast("bigint").alias("nodes"), half_even((F.col("pairs") - (0 if include_self else n)) / float(n * n), 4).alias("cost"), F.lit("").alias("note"))


def betweenness(nodes: DataFrame, edges: DataFrame, cap: int = BETWEENNESS_NODES) -> tuple[DataFrame, str]:
    """(id, betweenness) and a note; directed and unweighted, over (n - 1)(n - 2), which is left out for up to two nodes.

    The paths from SOURCES nodes at a time are a task's, which holds the edges; the cap bounds those.
    """
    ids = nodes.select("id")
    n = ids.count()
    if n > cap:
        return ids.withColumn("betweenness", F.lit(None).cast("double")), f"betweenness skipped: {n} nodes exceeds cap {cap}"
    inside = edges.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    scale = float((n - 1) * (n - 2))
    score = half_even(F.col("score") / scale, 4) if scale > 0 else F.col("score")
    turns = -(-n // SOURCES)
    shared = inside.select("src", "dst", F.explode(F.sequence(F.lit(0), F.lit(max(turns - 1, 0)))).alias("turn"))

    def some(key: tuple, pairs: pa.Table) -> pa.Table:
        return dense.brandes(pairs, key[0].as_py(), turns)

    raw = shared.groupBy("turn").applyInArrow(some, "id string, score double").groupBy("id").agg(F.sum("score").alias("score"))
    return ids.join(raw, "id", "left").na.fill(0.0, ["score"]).select("id", score.alias("betweenness")), ""


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): the least id of each strongly connected component, singletons included; see `reach`."""
    return reach.components(nodes, edges)


# -- tangles


def tangles(scc: DataFrame) -> DataFrame:
    """scc, members (sorted), size of the components of two nodes or more."""
    return scc.groupBy("scc").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count("*").alias("size")).where("size >= 2")


def inner_edges(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """scc, src, dst, weight of the edges with both ends in one component."""
    a, b = scc.select(F.col("id").alias("src"), "scc"), scc.select(F.col("id").alias("dst"), F.col("scc").alias("other"))
    return edges.where("src <> dst").join(a, "src").join(b, "dst").where("scc = other").select("scc", "src", "dst", "weight")


def weakest_edge(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """The edge of least (weight, src, dst) in each tangle: where to cut first."""
    least = inner_edges(scc, edges).groupBy("scc").agg(F.min(F.struct("weight", "src", "dst")).alias("e"))
    return least.select("scc", F.col("e.src").alias("cut_src"), F.col("e.dst").alias("cut_dst"), F.col("e.weight").alias("cut_weight"))


def degrees(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """scc, id, degree, friends: undirected degrees and distinct neighbours inside the tangle."""
    inside = inner_edges(scc, edges).select("scc", "src", "dst").distinct()
    both = inside.select("scc", F.col("src").alias("id"), F.col("dst").alias("friend")).union(inside.select("scc", F.col("dst").alias("id"), F.col("src").alias("friend")))
    return both.groupBy("scc", "id").agg(F.count("*").alias("degree"), F.count_distinct("friend").alias("friends"))


def gini(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, gini of its non-negative values, 4 digits; 0 where they sum to 0."""
    x = F.col(value).cast("double")
    i = F.row_number().over(Window.partitionBy(group).orderBy(value))
    by = rows.where(F.col(value).isNotNull()).select(group, x.alias("x"), i.alias("i")).groupBy(group).agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("i")).alias("weighted"), F.count("*").alias("n"))
    g = (2.0 * F.col("weighted") - (F.col("n") + 1) * F.col("total")) / (F.col("n") * F.col("total"))
    return by.select(group, F.when(F.col("total") <= 0, 0.0).otherwise(half_even(g, 4)).alias("gini"))


def shape_ratios(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """scc, vertices, edges, ratio, dense, bckref, star, chain of each tangle, unrounded."""
    inside = inner_edges(scc, edges).select("scc", "src", "dst").distinct()
    back = inside.join(inside.select("scc", F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("back")), ["scc", "src", "dst"], "left")
    e = back.groupBy("scc").agg(F.count("*").alias("e"), F.count("back").alias("back"))
    d = degrees(scc, edges).groupBy("scc").agg(F.max("degree").alias("most"), F.count_if(F.col("friends") == 2).alias("twos"))
    v = scc.groupBy("scc").agg(F.count("*").alias("v")).where("v >= 2")
    rows = v.join(e, "scc", "left").join(d, "scc", "left").na.fill(0, ["e", "back", "most", "twos"])
    n = F.col("v")
    return rows.select(
        "scc", n.alias("vertices"), F.col("e").alias("edges"), ratio(n, F.col("e")).alias("ratio"),
        F.when(n * n - 2 * n > 0, ratio(F.col("e") - n, n * n - 2 * n)).alias("dense"), ratio(F.col("back"), F.col("e")).alias("bckref"),
        F.when((n >= 4) & (F.col("most") > 0), ratio(F.col("most"), F.col("e"))).alias("star"), F.when(n > 2, ratio(F.least(F.col("twos"), n - 2), n - 2)).alias("chain"),
    )


def hub_spread(scc: DataFrame, edges: DataFrame, cap: int = TANGLE_NODES) -> DataFrame:
    """scc, hub (gini of the betweenness inside), hub_note: NULL and a note above the cap.

    Each tangle up to the cap is a task's matrix; scores are scaled by the size of the tangle.
    """
    sizes = scc.groupBy("scc").agg(F.count("*").alias("size")).where("size >= 2")
    small = scc.join(sizes.where(F.col("size") <= cap), "scc")
    inside = inner_edges(scc, edges).join(sizes.where(F.col("size") <= cap), "scc")
    raw = inside.groupBy("scc").applyInArrow(lambda t: dense.brandes(t), "id string, score double")
    scale = ((F.col("size") - 1) * (F.col("size") - 2)).cast("double")
    scores = small.join(raw, "id").select("scc", F.when(scale > 0, half_even(F.col("score") / scale, 4)).otherwise(F.col("score")).alias("score"))
    note = F.concat(F.lit("cycle shape: betweenness skipped for a "), F.col("size").cast("string"), F.lit(f"-node tangle (cap {cap}); multi-hub was not tested"))
    return sizes.join(gini(scores, "scc", "score"), "scc", "left").select("scc", F.col("gini").alias("hub"), F.when(F.col("size") > cap, note).otherwise("").alias("hub_note"))


def classify() -> Column:
    """The shape by the fixed cut-offs, first match wins; a NULL ratio meets no test."""
    ge = lambda c, x: F.coalesce(F.col(c) >= x, F.lit(False))
    back = ge("bckref", 0.75)
    return (
        F.when(F.col("vertices") == 2, "tiny").when((F.col("edges") == 0) | (F.col("vertices") < 2), "unknown").when(ge("ratio", 0.75), "circle")
        .when(back & ge("dense", 0.75), "clique").when(back & ge("chain", 0.75), "chain").when(back & ge("star", 0.75), "star")
        .when(ge("hub", 0.5), "multi-hub").when(ge("dense", 0.45), "semi-clique").otherwise("unknown")
    )


def shapes(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """Each tangle's vertices, edges, shape, note, and its ratios to 4 digits (NULL for a tiny one)."""
    rows = shape_ratios(scc, edges).join(hub_spread(scc, edges), "scc", "left").withColumn("shape", classify())
    shown = [F.when(F.col("shape") != "tiny", half_even(F.col(c), 4)).alias(c) for c in ("ratio", "dense", "bckref", "star", "chain", "hub")]
    return rows.select("scc", "vertices", "edges", "shape", "hub_note", *shown)


# -- roles and legality.  Fixed values: the marks of each role, and the reasons' wording.

TEST_MARKS = ["test", "tests", "spec", "specs", "__tests__", "testdata", "fixtures"]
ROOT_MARKS = ["config_dependency_injection", "composition_root", "compositionroot", "di_container", "dicontainer", "wire_gen", "wire", "bootstrap", "main", "__main__"]
UTIL_DIRS = ["utils", "util", "utilities", "common", "commons", "shared", "helpers", "helper", "lib", "core", "misc"]
ADAPTER_DIRS = ["adapters", "adapter", "infrastructure", "infra", "io", "clients", "client", "gateways", "gateway", "repositories", "repository", "persistence", "transport"]
PORT_MARKS = ["_port", "_policy", "_strategy", "_interface", "_protocol", "_abc", "_contract"]
REGISTRY_MARKS = ["registry", "__init__", "index", "mod"]
CONTEXT_MARKS = ["_context", "context", "_request", "_command"]
ABSENT_MARKS = ["absent", "null", "noop", "none", "missing"]
UTIL_SINK = "utils must be a sink node: it may not import application code"
IMPORTS_ROOT = "nothing may import the composition root; the root wires, it is not a service"
IMPORTS_TEST = "production code imports a test"
SIBLING_RESOLVER = "a resolver may not import a sibling resolver: siblings are alternatives"
OWN_REGISTRY = "a resolver may not import its own registry: edges point one way"
UPWARD = ("upward edge to a ", ": only a port or a context may be imported upward")
SIDEWAYS = "sideways edge between sibling subtrees: route it through a port or a util"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))


def folder(path: Column) -> Column:
    parts = segments(path)
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), "/")


def layer(path: Column) -> Column:
    return F.greatest(F.size(segments(path)) - 1, F.lit(0))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(segments(path), -1), r"(?<=.)\.[^.]*$", "")


def name_words(path: Column) -> Column:
    """The distinct lower-cased words of a file's name; camel case is cut before it is lowered."""
    cut = F.regexp_replace(stem(path), "(?<=[a-z0-9])(?=[A-Z])", " ")
    return F.array_distinct(F.filter(F.split(F.lower(cut), "[^A-Za-z0-9]+"), lambda w: w != ""))


def is_absent_resolver(path: Column) -> Column:
    return F.arrays_overlap(name_words(path), F.array(*map(F.lit, ABSENT_MARKS)))


def is_under(child: Column, parent: Column) -> Column:
    return (parent == "") | (child == parent) | child.startswith(F.concat(parent, F.lit("/")))


def is_strictly_under(child: Column, parent: Column) -> Column:
    return (child != parent) & is_under(child, parent)


def any_of(marks: list[str], test) -> Column:
    return reduce(lambda a, b: a | b, [test(m) for m in marks])


def initial_role(path: Column, types: Column, abstract: Column) -> Column:
    parts = F.transform(segments(path), F.lower)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    name = F.lower(stem(path))
    in_dirs = lambda marks: F.arrays_overlap(dirs, F.array(*map(F.lit, marks)))
    holds = lambda marks: any_of(marks, name.contains)
    test = in_dirs(TEST_MARKS) | name.startswith("test_") | any_of(["_test", "_spec", ".test", ".spec"], name.endswith) | name.isin(TEST_MARKS)
    return (
        F.when(test, "test").when(name.isin(ROOT_MARKS) | holds(["dependency_injection", "composition_root"]), "root")
        .when(in_dirs(UTIL_DIRS) | name.isin(UTIL_DIRS), "util").when(holds(CONTEXT_MARKS), "context")
        .when((types > 0) & (abstract == types), "port").when(holds(PORT_MARKS), "port").when(name.isin(REGISTRY_MARKS) | name.contains("registry"), "registry")
        .when(in_dirs(ADAPTER_DIRS), "adapter").otherwise("service")
    )


def roles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, path, dir, layer, role: a service or adapter that imports a port declared strictly above it is a resolver."""
    first = nodes.select("id", "path", folder(F.col("path")).alias("dir"), layer(F.col("path")).alias("layer"), initial_role(F.col("path"), F.col("types"), F.col("abstract")).alias("role"))
    ports = first.where("role = 'port'").select(F.col("id").alias("dst"), F.col("dir").alias("port_dir"))
    takes = edges.select("src", "dst").join(ports, "dst").join(first.select(F.col("id").alias("src"), F.col("dir").alias("src_dir")), "src")
    answers = takes.where(is_strictly_under(F.col("src_dir"), F.col("port_dir"))).select(F.col("src").alias("id"), F.lit(True).alias("answers")).distinct()
    rows = first.join(answers, "id", "left")
    return rows.select("id", "path", "dir", "layer", F.when(F.col("role").isin("service", "adapter") & F.col("answers"), "resolver").otherwise(F.col("role")).alias("role"))


def legality(edges: DataFrame, role: DataFrame) -> DataFrame:
    """edges with src_role, dst_role, src_dir, dst_dir, legal, reason: the first rule with an opinion decides."""
    end = lambda side: role.select(F.col("id").alias(side), F.col("role").alias(f"{side}_role"), F.col("dir").alias(f"{side}_dir"))
    rows = edges.join(end("src"), "src", "left").join(end("dst"), "dst", "left").na.fill("unknown", ["src_role", "dst_role"]).na.fill("", ["src_dir", "dst_dir"])
    s, d, sd, dd = (F.col(c) for c in ("src_role", "dst_role", "src_dir", "dst_dir"))
    reason = (
        F.when(s == "util", F.when(d == "util", "").otherwise(UTIL_SINK)).when(d == "util", "").when(s == "root", "").when(d == "root", IMPORTS_ROOT)
        .when(s == "test", "").when(d == "test", IMPORTS_TEST).when((s == "resolver") & (d == "resolver") & (sd == dd), SIBLING_RESOLVER).when((s == "resolver") & (d == "registry"), OWN_REGISTRY)
        .when(sd == dd, "").when(is_strictly_under(dd, sd), "")
        .when(is_strictly_under(sd, dd), F.when(d.isin("port", "context"), "").otherwise(F.concat(F.lit(UPWARD[0]), d, F.lit(UPWARD[1])))).otherwise(SIDEWAYS)
    )
    return rows.withColumn("reason", reason).withColumn("legal", F.col("reason") == "")


def port_health(role: DataFrame, edges: DataFrame) -> DataFrame:
    """Each port's resolvers, whether one of them is an absent one, the path of its first contract suite (of the tests that
    import it and have the word `contract` in their name, the one with the least id), and the sorted services and
    adapters that import it past the root."""
    ports = role.where("role = 'port'").select(F.col("id").alias("port"))
    importers = edges.select(F.col("src").alias("importer"), F.col("dst").alias("port")).distinct().join(role.select(F.col("id").alias("importer"), "path", "role"), "importer")
    rows = ports.join(importers, "port", "left")
    resolver = F.col("role") == "resolver"
    suite = (F.col("role") == "test") & F.array_contains(name_words(F.col("path")), "contract")
    past = F.array_sort(F.collect_list(F.when(F.col("role").isin("service", "adapter"), F.col("importer"))))
    return rows.groupBy("port").agg(
        F.count_if(resolver).alias("resolvers"), F.coalesce(F.bool_or(resolver & is_absent_resolver(F.col("path"))), F.lit(False)).alias("has_absent_resolver"),
        F.min(F.when(suite, F.struct("importer", "path"))).alias("suite"), past.alias("imported_outside_root"),
    ).select("port", "resolvers", "has_absent_resolver", F.col("suite.path").alias("contract_suite"), "imported_outside_root")


def role_counts(role: DataFrame) -> DataFrame:
    return role.groupBy("role").agg(F.count("*").alias("nodes"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of headline numbers; the average degree is 2E / N, NULL without nodes."""
    n = nodes.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("loc"), F.lit(0)).alias("loc"), F.coalesce(F.sum("types"), F.lit(0)).alias("types"), F.coalesce(F.sum("unresolved"), F.lit(0)).alias("unresolved"))
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("imports"))
    return n.crossJoin(e).withColumn("avg_degree", half_even(ratio(2 * F.col("edges"), F.col("nodes")), 2))


def vacuous_acyclicity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A note where nodes have no edge at all but imports that stayed unresolved: then no cycle proves nothing."""
    note = F.when((F.col("nodes") > 0) & (F.col("edges") == 0) & (F.col("unresolved") > 0), "no edges were resolved: the absence of cycles proves nothing")
    return totals(nodes, edges).select("nodes", "edges", "unresolved", note.alias("note"))


def by_language(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("lang").agg(F.count("*").alias("nodes"), F.sum("loc").alias("loc"), F.sum("unresolved").alias("unresolved"), F.when(F.first("lang") == "python", "native").otherwise("lexical").alias("fidelity"))


def verdict(cycles: Column, blockers: Column, files_over: Column, files: Column, ports_without_suite: Column) -> Column:
    """SOUND, DRIFTING or ERODED from counts: cycles, blockers (illegal edges), files over any limit, ports without a suite."""
    sound = (cycles == 0) & (blockers == 0) & (files_over * 100 < files * 5) & (ports_without_suite == 0)
    return F.when(sound, "SOUND").when((cycles <= 2) & (blockers <= 2) & (files_over * 100 < files * 20), "DRIFTING").otherwise("ERODED")


def top_fan_in(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    return node_metrics(nodes, edges).select("id", "fan_in", "fan_out", "instability").orderBy(F.desc("fan_in"), "id").limit(n)

