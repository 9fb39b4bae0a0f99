"""Queries of the dependency-graph operators on the module graph of `bindings`, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce
from inspect import signature

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.ratios import half_even, ratio
from quern.operators import graph as g
from quern.operators import reach
from quern.plans import bindings as b
from quern.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


Edges = Callable[[SparkSession, str], DataFrame]


def both(spark: SparkSession, sf_dir: str, bound: Edges) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; the edges are a table of their own, as a loop reads them often."""
    return b.module_nodes(spark, sf_dir), g.step(bound(spark, sf_dir))


METRICS = """metrics AS (SELECT *, round_even(fan_out / nullif(fan_in + fan_out, 0)::DOUBLE, 3) AS instability, round_even(abstract / nullif(types, 0)::DOUBLE, 3) AS abstractness FROM fans)"""
DISTANCE = "round_even(abs(abstractness + instability - 1), 3)"
CLOSURE = "closure AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src)"
SCC = CLOSURE + """,
scc AS MATERIALIZED (SELECT n.id, least(n.id, coalesce((SELECT min(a.dst) FROM closure a JOIN closure z ON a.src = z.dst AND a.dst = z.src WHERE a.src = n.id), n.id)) AS scc FROM nodes n),
sizes AS (SELECT scc, count(*) AS v FROM scc GROUP BY 1 HAVING count(*) >= 2),
inside AS MATERIALIZED (SELECT x.scc, e.src, e.dst, e.weight FROM edges e JOIN scc x ON x.id = e.src JOIN scc y ON y.id = e.dst AND x.scc = y.scc WHERE e.src <> e.dst)"""
DEGREES = "degrees AS (SELECT scc, id, count(*) AS degree, count(DISTINCT friend) AS friends FROM (SELECT scc, src AS id, dst AS friend FROM inside UNION ALL SELECT scc, dst, src FROM inside) GROUP BY 1, 2)"
RATIOS = DEGREES + """,
ratios AS (SELECT s.scc, v AS vertices, e AS edges, v / e::DOUBLE AS ratio, CASE WHEN v > 2 THEN (e - v) / (v * v - 2 * v)::DOUBLE END AS dense, back / e::DOUBLE AS bckref,
  CASE WHEN v >= 4 THEN most / e::DOUBLE END AS star, CASE WHEN v > 2 THEN least(twos, v - 2) / (v - 2)::DOUBLE END AS chain
  FROM sizes s JOIN (SELECT scc, count(*) AS e, count(*) FILTER (EXISTS (SELECT 1 FROM inside r WHERE r.src = i.dst AND r.dst = i.src)) AS back FROM inside i GROUP BY 1) USING (scc)
  JOIN (SELECT scc, max(degree) AS most, count(*) FILTER (friends = 2) AS twos FROM degrees GROUP BY 1) USING (scc))"""


def between(edges: str, nodes: str) -> str:
    """Shortest-path counts by breadth, and the sums over pairs of the share of paths through each node."""
    return f"""
walk AS (SELECT id AS source, id AS node, 0 AS dist, 1.0::DOUBLE AS sigma FROM {nodes} UNION ALL
  SELECT source, node, dist, sigma FROM (SELECT w.source, e.dst AS node, w.dist + 1 AS dist, sum(w.sigma) AS sigma FROM walk w JOIN {edges} e ON e.src = w.node GROUP BY 1, 2, 3) x
  WHERE NOT EXISTS (SELECT 1 FROM recurring.walk r WHERE r.source = x.source AND r.node = x.node)),
paths AS MATERIALIZED (SELECT source, node, dist, sigma FROM walk),
through AS (SELECT a.node AS id, sum(a.sigma * z.sigma / t.sigma) AS score FROM paths a JOIN paths z ON z.source = a.node AND z.node <> a.node JOIN paths t ON t.source = a.source AND t.node = z.node AND t.dist = a.dist + z.dist WHERE a.source <> a.node GROUP BY 1)"""


@query(f"WITH {b.GRAPH_SQL}, {METRICS} SELECT id, fan_in, fan_out, instability FROM metrics ORDER BY fan_in DESC, id LIMIT 10")
def g_top_fan_in(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.top_fan_in(*both(spark, sf_dir, bound))


@query(f"WITH {b.GRAPH_SQL} SELECT src, dst, weight FROM edges")
def g_edges(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return bound(spark, sf_dir)


@query(f"WITH {b.GRAPH_SQL} SELECT id, fan_in, fan_out FROM fans")
def g_fans(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.fans(*both(spark, sf_dir, bound)).select("id", "fan_in", "fan_out")


@query(f"WITH {b.GRAPH_SQL}, {METRICS} SELECT id, fan_in, fan_out, instability, abstractness, {DISTANCE} AS distance FROM metrics")
def g_node_metrics(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.node_metrics(*both(spark, sf_dir, bound)).select("id", "fan_in", "fan_out", "instability", "abstractness", "distance")


MEDIANS = "med AS (SELECT (SELECT coalesce(quantile_cont(v, 0.5), 0) FROM (SELECT DISTINCT fan_in AS v FROM fans WHERE fan_in <> 0))::DOUBLE AS m_in, (SELECT coalesce(quantile_cont(v, 0.5), 0) FROM (SELECT DISTINCT fan_out AS v FROM fans WHERE fan_out <> 0))::DOUBLE AS m_out)"


@query(f"WITH {b.GRAPH_SQL}, {MEDIANS} SELECT m_in AS median FROM med")
def g_median_fan_in(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.distinct_median(g.fans(*both(spark, sf_dir, bound)), "fan_in")


@query(f"WITH {b.GRAPH_SQL}, {MEDIANS} SELECT id, fan_in, fan_out FROM fans, med WHERE fan_in > m_in AND fan_out > m_out AND abs(fan_in - fan_out) <= (fan_in + fan_out) / 4.0::DOUBLE")
def g_hub_like(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.hub_like(*both(spark, sf_dir, bound))


@query(f"""WITH RECURSIVE {b.GRAPH_SQL}, n AS (SELECT count(*) AS n FROM nodes), o AS (SELECT dst AS id, count(*) AS degree FROM edges GROUP BY 1),
r AS (SELECT id, 1.0::DOUBLE / n AS rank, 0 AS it FROM nodes, n UNION ALL
  SELECT x.id, 0.15::DOUBLE / n + 0.85::DOUBLE * coalesce(sum(s.rank / s.degree), 0) + 0.85::DOUBLE * any_value(lost) / any_value(n), any_value(x.it) + 1 AS it
  FROM (SELECT id, it, n, (SELECT coalesce(sum(q.rank), 0) FROM r q WHERE q.id NOT IN (SELECT id FROM o)) AS lost FROM r, n WHERE it < 40) x
  LEFT JOIN (SELECT e.src AS id, r.rank, o.degree FROM edges e JOIN r ON r.id = e.dst JOIN o ON o.id = e.dst) s ON s.id = x.id GROUP BY x.id, n)
SELECT id, round_even(rank * n, 3) AS pagerank FROM r, n WHERE it = 40""")
def g_pagerank(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    """Of the reversed graph: who is depended on."""
    nodes, edges = both(spark, sf_dir, bound)
    return g.pagerank(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {CLOSURE} SELECT src, count(*) FILTER (src <> dst) AS reached FROM closure GROUP BY 1")
def g_reachable(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    """Of the nodes with an edge out."""
    nodes, edges = both(spark, sf_dir, bound)
    seen = reach.visibility(nodes, edges).join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    return seen.select(F.col("id").alias("src"), (F.col("vfo") - 1).alias("reached"))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {CLOSURE}, n AS (SELECT count(*) AS n FROM nodes) SELECT n AS nodes, CASE WHEN n <= 3000 THEN round_even((SELECT count(*) FROM closure WHERE src <> dst) / (n * n)::DOUBLE, 4) END AS cost, CASE WHEN n <= 3000 THEN '' ELSE 'transitive closure skipped: ' || n || ' nodes exceeds cap 3000' END AS note FROM n")
def g_propagation_cost(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.propagation_cost(*both(spark, sf_dir, bound))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {between('edges', '(SELECT id FROM nodes WHERE (SELECT count(*) FROM nodes) <= 1200)')}, n AS (SELECT count(*) AS n FROM nodes) SELECT id, CASE WHEN n <= 1200 THEN round_even(coalesce(score, 0) / ((n - 1) * (n - 2))::DOUBLE, 4) END AS betweenness FROM nodes LEFT JOIN through USING (id), n")
def g_betweenness(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.betweenness(*both(spark, sf_dir, bound))[0]


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {between('edges', '(SELECT id FROM nodes WHERE (SELECT count(*) FROM nodes) <= 1200)')}, n AS (SELECT count(*) AS n FROM nodes) SELECT id, CASE WHEN n <= 1200 THEN round_even(coalesce(score, 0) / ((n - 1) * (n - 2))::DOUBLE, 4) END AS betweenness, CASE WHEN n <= 1200 THEN '' ELSE 'betweenness skipped: ' || n || ' nodes exceeds cap 1200' END AS note FROM nodes LEFT JOIN through USING (id), n")
def g_betweenness_noted(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    """With the reason where it is skipped."""
    rows, note = g.betweenness(*both(spark, sf_dir, bound))
    return rows.withColumn("note", F.lit(note))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC} SELECT id, scc FROM scc")
def g_components(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.components(*both(spark, sf_dir, bound))


def tangled(spark: SparkSession, sf_dir: str, bound: Edges) -> tuple[DataFrame, DataFrame]:
    nodes, edges = both(spark, sf_dir, bound)
    return g.step(g.components(nodes, edges)), edges


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC} SELECT scc, v AS size, (SELECT string_agg(id, ',' ORDER BY id) FROM scc x WHERE x.scc = sizes.scc) AS members FROM sizes")
def g_tangles(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.tangles(tangled(spark, sf_dir, bound)[0]).select("scc", "size", F.array_join("members", ",").alias("members"))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC} SELECT scc, src, dst, weight FROM inside")
def g_inner_edges(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.inner_edges(*tangled(spark, sf_dir, bound))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC} SELECT scc, arg_min(src, (weight, src, dst)) AS cut_src, arg_min(dst, (weight, src, dst)) AS cut_dst, min(weight) AS cut_weight FROM inside GROUP BY 1")
def g_weakest_edge(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.weakest_edge(*tangled(spark, sf_dir, bound))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC}, {DEGREES} SELECT scc, id, degree, friends FROM degrees")
def g_tangle_degrees(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.degrees(*tangled(spark, sf_dir, bound))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC}, {RATIOS} SELECT scc, vertices, edges, round_even(ratio, 9) AS ratio, round_even(dense, 9) AS dense, round_even(bckref, 9) AS bckref, round_even(star, 9) AS star, round_even(chain, 9) AS chain FROM ratios")
def g_shape_ratios(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    rows = g.shape_ratios(*tangled(spark, sf_dir, bound))
    return rows.select("scc", "vertices", "edges", *[half_even(F.col(c), 9).alias(c) for c in ("ratio", "dense", "bckref", "star", "chain")])


@query(f"WITH {b.GRAPH_SQL}, r AS (SELECT lang, fan_in::DOUBLE AS x, row_number() OVER (PARTITION BY lang ORDER BY fan_in) AS i FROM fans), s AS (SELECT lang, sum(x) AS t, sum(x * i) AS w, count(*) AS n FROM r GROUP BY 1) SELECT lang, CASE WHEN t <= 0 THEN 0 ELSE round_even((2 * w - (n + 1) * t) / (n * t), 4) END AS gini FROM s")
def g_gini(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.gini(g.fans(*both(spark, sf_dir, bound)), "lang", "fan_in")


@query(f"""WITH RECURSIVE {b.GRAPH_SQL}, {SCC}, {RATIOS}, {between('inside', "(SELECT id FROM scc WHERE scc IN (SELECT scc FROM sizes WHERE v <= 400))")},
scored AS (SELECT x.scc, CASE WHEN v > 2 THEN round_even(coalesce(score, 0) / ((v - 1) * (v - 2)), 4) ELSE coalesce(score, 0) END AS x FROM scc x JOIN sizes s ON s.scc = x.scc AND v <= 400 LEFT JOIN through t ON t.id = x.id),
ordered AS (SELECT scc, x, row_number() OVER (PARTITION BY scc ORDER BY x) AS i FROM scored),
hubs AS (SELECT scc, CASE WHEN sum(x) <= 0 THEN 0 ELSE round_even((2 * sum(x * i) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)), 4) END AS hub FROM ordered GROUP BY 1),
named AS (SELECT r.*, hub, CASE WHEN vertices = 2 THEN 'tiny' WHEN ratio >= 0.75 THEN 'circle' WHEN bckref >= 0.75 AND dense >= 0.75 THEN 'clique' WHEN bckref >= 0.75 AND chain >= 0.75 THEN 'chain'
  WHEN bckref >= 0.75 AND star >= 0.75 THEN 'star' WHEN hub >= 0.5 THEN 'multi-hub' WHEN dense >= 0.45 THEN 'semi-clique' ELSE 'unknown' END AS shape FROM ratios r LEFT JOIN hubs USING (scc))
SELECT scc, vertices, edges, shape, CASE WHEN vertices > 400 THEN 'cycle shape: betweenness skipped for a ' || vertices || '-node tangle (cap 400); multi-hub was not tested' ELSE '' END AS hub_note,
  {', '.join(f"CASE WHEN shape <> 'tiny' THEN round_even({c}, 4) END AS {c}" for c in ('ratio', 'dense', 'bckref', 'star', 'chain', 'hub'))} FROM named""")
def g_shapes(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.shapes(*tangled(spark, sf_dir, bound))


# -- roles.  The SQL states the same marks once more.

MARKS = {"test": g.TEST_MARKS, "root": g.ROOT_MARKS, "util": g.UTIL_DIRS, "adapter": g.ADAPTER_DIRS, "port": g.PORT_MARKS, "registry": g.REGISTRY_MARKS, "context": g.CONTEXT_MARKS}
ROLE_SQL = f"""
seg AS (SELECT id, path, types, abstract, string_split(path, '/') AS p FROM nodes),
named AS (SELECT *, lower(regexp_replace(p[-1], '[.][^.]*$', '')) AS name, p[:-2] AS dirs, array_to_string(p[:-2], '/') AS dir FROM seg),
first_role AS (SELECT *, CASE
  WHEN list_has_any(dirs, {MARKS['test']}) OR starts_with(name, 'test_') OR regexp_matches(name, '(_test|_spec|[.]test|[.]spec)$') OR list_contains({MARKS['test']}, name) THEN 'test'
  WHEN list_contains({MARKS['root']}, name) OR contains(name, 'dependency_injection') OR contains(name, 'composition_root') THEN 'root'
  WHEN list_has_any(dirs, {MARKS['util']}) OR list_contains({MARKS['util']}, name) THEN 'util'
  WHEN regexp_matches(name, '{'|'.join(MARKS['context'])}') THEN 'context' WHEN types > 0 AND abstract = types THEN 'port' WHEN regexp_matches(name, '{'|'.join(MARKS['port'])}') THEN 'port'
  WHEN list_contains({MARKS['registry']}, name) OR contains(name, 'registry') THEN 'registry' WHEN list_has_any(dirs, {MARKS['adapter']}) THEN 'adapter' ELSE 'service' END AS role0 FROM named),
roles AS MATERIALIZED (SELECT id, path, dir, len(dirs)::INTEGER AS layer, CASE WHEN role0 IN ('service', 'adapter') AND EXISTS (SELECT 1 FROM edges e JOIN first_role q ON q.id = e.dst AND q.role0 = 'port'
  WHERE e.src = r.id AND r.dir <> q.dir AND (q.dir = '' OR starts_with(r.dir, q.dir || '/'))) THEN 'resolver' ELSE role0 END AS role FROM first_role r)"""
LEGAL_SQL = ROLE_SQL + f""",
ends AS (SELECT e.*, a.role AS s, z.role AS d, a.dir AS sd, z.dir AS dd FROM edges e JOIN roles a ON a.id = e.src JOIN roles z ON z.id = e.dst),
judged AS (SELECT src, dst, weight, s AS src_role, d AS dst_role, sd AS src_dir, dd AS dst_dir, CASE
  WHEN s = 'util' THEN CASE WHEN d = 'util' THEN '' ELSE '{g.UTIL_SINK}' END WHEN d = 'util' THEN '' WHEN s = 'root' THEN '' WHEN d = 'root' THEN '{g.IMPORTS_ROOT}'
  WHEN s = 'test' THEN '' WHEN d = 'test' THEN '{g.IMPORTS_TEST}' WHEN s = 'resolver' AND d = 'resolver' AND sd = dd THEN '{g.SIBLING_RESOLVER}' WHEN s = 'resolver' AND d = 'registry' THEN '{g.OWN_REGISTRY}'
  WHEN sd = dd THEN '' WHEN sd = '' OR starts_with(dd, sd || '/') THEN '' WHEN dd = '' OR starts_with(sd, dd || '/') THEN CASE WHEN d IN ('port', 'context') THEN '' ELSE '{g.UPWARD[0]}' || d || '{g.UPWARD[1]}' END
  ELSE '{g.SIDEWAYS}' END AS reason FROM ends)"""


@query(f"WITH {b.GRAPH_SQL}, {ROLE_SQL} SELECT id, path, dir, layer, role FROM roles")
def g_roles(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.roles(*both(spark, sf_dir, bound))


@query(f"WITH {b.GRAPH_SQL}, {ROLE_SQL} SELECT role, count(*) AS nodes FROM roles GROUP BY 1")
def g_role_counts(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.role_counts(g.roles(*both(spark, sf_dir, bound)))


@query(f"WITH {b.GRAPH_SQL} SELECT id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_extract(path, '[^/]*$'), '[.][^.]*$', ''), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> ''))), ' ') AS words, regexp_matches(' ' || lower(regexp_replace(regexp_extract(path, '[^/]*$'), '[^A-Za-z0-9]+', ' ', 'g')) || ' ', ' (absent|null|noop|none|missing) ') AS absent FROM nodes")
def g_name_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.module_nodes(spark, sf_dir)
    return n.select("id", F.array_join(F.array_sort(g.name_words(F.col("path"))), " ").alias("words"), g.is_absent_resolver(F.col("path")).alias("absent"))


@query(f"WITH {b.GRAPH_SQL}, {LEGAL_SQL} SELECT src, dst, weight, src_role, dst_role, src_dir, dst_dir, reason, reason = '' AS legal FROM judged")
def g_legality(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    return g.legality(edges, g.roles(nodes, edges))


PORT_SQL = r"""health AS MATERIALIZED (SELECT p.id AS port, count(*) FILTER (i.role = 'resolver') AS resolvers,
  coalesce(bool_or(i.role = 'resolver' AND regexp_matches(i.path, '(^|[^A-Za-z])(absent|null|noop|none|missing)[^A-Za-z]')), false) AS has_absent_resolver,
  arg_min(i.path, i.id) FILTER (i.role = 'test' AND i.path LIKE '%/contract!_%' ESCAPE '!') AS contract_suite,
  coalesce(list_sort(list(i.id) FILTER (i.role IN ('service', 'adapter'))), []) AS imported_outside_root
  FROM roles p LEFT JOIN edges e ON e.dst = p.id LEFT JOIN roles i ON i.id = e.src WHERE p.role = 'port' GROUP BY 1)"""


@query(f"WITH {b.GRAPH_SQL}, {ROLE_SQL}, {PORT_SQL} SELECT port, resolvers, has_absent_resolver, contract_suite, array_to_string(imported_outside_root, ' ') AS imported_outside_root FROM health")
def g_port_health(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    return g.port_health(g.roles(nodes, edges), edges).withColumn("imported_outside_root", F.array_join("imported_outside_root", " "))


@query(f"WITH {b.GRAPH_SQL} SELECT count(*) AS nodes, sum(loc)::BIGINT AS loc, sum(types)::BIGINT AS types, sum(unresolved)::BIGINT AS unresolved, (SELECT count(*) FROM edges) AS edges, (SELECT sum(weight)::BIGINT FROM edges) AS imports, round_even(2 * (SELECT count(*) FROM edges) / count(*)::DOUBLE, 2) AS avg_degree FROM nodes")
def g_totals(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return g.totals(*both(spark, sf_dir, bound))


@query(f"WITH {b.GRAPH_SQL} SELECT lang, count(*) AS nodes, sum(loc)::BIGINT AS loc, sum(unresolved)::BIGINT AS unresolved, CASE WHEN lang = 'python' THEN 'native' ELSE 'lexical' END AS fidelity FROM nodes GROUP BY 1")
def g_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.by_language(b.module_nodes(spark, sf_dir))


@query("SELECT count(*) AS nodes, 0::BIGINT AS edges, count(*) AS unresolved, 'no edges were resolved: the absence of cycles proves nothing' AS note FROM pages")
def g_vacuous_acyclicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as modules whose links resolve to no page."""
    nodes = b.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("id"), F.lit(0).alias("loc"), F.lit(0).alias("types"), F.lit(1).alias("unresolved"))
    return g.vacuous_acyclicity(nodes, spark.createDataFrame([], "src string, dst string, weight bigint"))


@query(f"""WITH RECURSIVE {b.GRAPH_SQL}, {SCC}, {LEGAL_SQL}, {PORT_SQL}, n AS (SELECT (SELECT count(*) FROM sizes) AS cycles, (SELECT count(*) FROM judged WHERE reason <> '') AS blockers,
  (SELECT count(*) FROM nodes WHERE loc > 250) AS files_over, (SELECT count(*) FROM nodes) AS files, (SELECT count(*) FROM health WHERE contract_suite IS NULL) AS ports_without_suite)
  SELECT *, CASE WHEN cycles = 0 AND blockers = 0 AND files_over < 0.05 * files AND ports_without_suite = 0 THEN 'SOUND'
    WHEN cycles <= 2 AND blockers <= 2 AND files_over < 0.2 * files THEN 'DRIFTING' ELSE 'ERODED' END AS verdict FROM n""")
def g_verdict(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    role = g.roles(nodes, edges)
    counts = [
        g.tangles(g.components(nodes, edges)).agg(F.count("*").alias("cycles")),
        g.legality(edges, role).agg(F.count_if(~F.col("legal")).alias("blockers")),
        nodes.agg(F.count_if(F.col("loc") > 250).alias("files_over"), F.count("*").alias("files")),
        g.port_health(role, edges).agg(F.count_if(F.col("contract_suite").isNull()).alias("ports_without_suite")),
    ]
    rows = reduce(DataFrame.crossJoin, counts)
    return rows.withColumn("verdict", g.verdict(*map(F.col, ("cycles", "blockers", "files_over", "files", "ports_without_suite"))))


# -- our readings of measures that are stated as formulas alone


@query(f"WITH {b.GRAPH_SQL}, {LEGAL_SQL}, f AS (SELECT src_dir, dst_dir, count(*) AS illegal FROM judged WHERE reason <> '' GROUP BY 1, 2) SELECT src_dir, dst_dir, illegal, round_even(illegal / (sum(illegal) OVER ())::DOUBLE, 4) AS share FROM f ORDER BY illegal DESC, src_dir, dst_dir LIMIT 5")
def h_illegal_folders(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    by = g.legality(edges, g.roles(nodes, edges)).where(~F.col("legal")).groupBy("src_dir", "dst_dir").agg(F.count("*").alias("illegal"))
    total = by.agg(F.sum("illegal").alias("total"))
    rows = by.crossJoin(F.broadcast(total)).select("src_dir", "dst_dir", "illegal", half_even(ratio(F.col("illegal"), F.col("total")), 4).alias("share"))
    return rows.orderBy(F.desc("illegal"), "src_dir", "dst_dir").limit(5)


@query(f"WITH {b.GRAPH_SQL}, {METRICS} SELECT e.src AS id, count(*) FILTER (d.instability > s.instability) AS worse, count(*) AS total, round_even(count(*) FILTER (d.instability > s.instability) / count(*)::DOUBLE, 4) AS doud FROM edges e JOIN metrics s ON s.id = e.src JOIN metrics d ON d.id = e.dst GROUP BY 1")
def h_unstable_dependency(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    m = g.node_metrics(nodes, edges)
    rows = edges.join(m.select(F.col("id").alias("src"), F.col("instability").alias("si")), "src").join(m.select(F.col("id").alias("dst"), F.col("instability").alias("di")), "dst")
    worse = F.count_if(F.col("di") > F.col("si"))
    return rows.groupBy(F.col("src").alias("id")).agg(worse.alias("worse"), F.count("*").alias("total"), half_even(ratio(worse, F.count("*")), 4).alias("doud"))


@query(f"WITH {b.GRAPH_SQL}, {METRICS} SELECT src, dst, round_even(d.instability - s.instability, 3) AS gap, round_even((d.instability - s.instability) * s.fan_in, 3) AS score FROM edges e JOIN metrics s ON s.id = e.src JOIN metrics d ON d.id = e.dst WHERE d.instability - s.instability > 0")
def h_stability_gap(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    m = g.node_metrics(nodes, edges)
    rows = edges.join(m.select(F.col("id").alias("src"), F.col("instability").alias("si"), "fan_in"), "src").join(m.select(F.col("id").alias("dst"), F.col("instability").alias("di")), "dst")
    gap = F.col("di") - F.col("si")
    return rows.where(gap > 0).select("src", "dst", half_even(gap, 3).alias("gap"), half_even(gap * F.col("fan_in"), 3).alias("score"))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {CLOSURE}, n AS (SELECT count(*) AS n FROM nodes), c AS (SELECT n + (SELECT count(*) FROM closure WHERE src <> dst) AS ccd, n FROM n) SELECT ccd, round_even(ccd / n::DOUBLE, 4) AS acd, round_even(ccd / (n * n)::DOUBLE, 4) AS racd, round_even(ccd / ((n + 1) * log2(n + 1) - n), 4) AS nccd FROM c")
def h_cumulative_dependency(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    """CCD counts each node as its own dependency; NCCD holds it against a balanced binary tree of as many nodes."""
    nodes, edges = both(spark, sf_dir, bound)
    n = F.col("n")
    rows = reach.visibility(nodes, edges).agg(F.count("*").alias("n"), F.sum("vfo").alias("ccd"))
    return rows.select("ccd", half_even(ratio(F.col("ccd"), n), 4).alias("acd"), half_even(ratio(F.col("ccd"), n * n), 4).alias("racd"), half_even(ratio(F.col("ccd"), (n + 1) * F.log2(n + 1) - n), 4).alias("nccd"))


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {CLOSURE} SELECT id, (SELECT count(*) FROM closure WHERE dst = n.id AND src <> dst) AS vfi, (SELECT count(*) FROM closure WHERE src = n.id AND src <> dst) AS vfo FROM nodes n")
def h_visibility(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    return reach.visibility(nodes, edges).select("id", (F.col("vfi") - 1).alias("vfi"), (F.col("vfo") - 1).alias("vfo"))


@query(f"""WITH RECURSIVE {b.GRAPH_SQL}, {SCC}, seen AS MATERIALIZED (SELECT id, scc, 1 + (SELECT count(*) FROM closure WHERE dst = x.id AND src <> dst) AS vfi, 1 + (SELECT count(*) FROM closure WHERE src = x.id AND src <> dst) AS vfo FROM scc x),
cut AS (SELECT greatest(2, percentile_disc(0.5) WITHIN GROUP (ORDER BY vfi DESC)) AS vfi_cutoff, greatest(2, percentile_disc(0.5) WITHIN GROUP (ORDER BY vfo DESC)) AS vfo_cutoff FROM seen)
SELECT id, scc, vfi, vfo, CASE WHEN vfi >= vfi_cutoff AND vfo >= vfo_cutoff THEN 'core' WHEN vfi >= vfi_cutoff THEN 'shared' WHEN vfo >= vfo_cutoff THEN 'control' ELSE 'peripheral' END AS part, vfi_cutoff, vfo_cutoff FROM seen, cut""")
def h_core_split(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    return reach.core_split(reach.visibility(*both(spark, sf_dir, bound)))


@query(f"WITH {b.GRAPH_SQL}, s AS (SELECT avg(fan_in + fan_out) + 1.5::DOUBLE * stddev_pop(fan_in + fan_out) AS cut FROM fans) SELECT id, fan_in + fan_out AS degree FROM fans, s WHERE fan_in + fan_out > cut")
def h_link_overload(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    """Degrees above the mean by more than 1.5 population standard deviations."""
    rows = g.fans(*both(spark, sf_dir, bound)).select("id", (F.col("fan_in") + F.col("fan_out")).alias("degree"))
    cut = rows.agg((F.avg("degree") + 1.5 * F.stddev_pop("degree")).alias("cut"))
    return rows.crossJoin(F.broadcast(cut)).where("degree > cut").select("id", "degree")


@query(f"WITH {b.GRAPH_SQL} SELECT id, loc * (fan_in * fan_out) * (fan_in * fan_out) AS flow FROM fans")
def h_information_flow(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    rows = g.fans(*both(spark, sf_dir, bound))
    return rows.select("id", (F.col("loc") * F.col("fan_in") * F.col("fan_out") * F.col("fan_in") * F.col("fan_out")).alias("flow"))


@query(f"WITH {b.GRAPH_SQL}, {METRICS}, d AS (SELECT id, abstractness AS a, instability AS i, {DISTANCE} AS distance FROM metrics) SELECT id, distance, CASE WHEN a + i < 0.5 THEN 'pain' WHEN a + i > 1.5 THEN 'useless' ELSE 'between' END AS zone FROM d WHERE distance > 0.5")
def h_zones(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    s = F.col("abstractness") + F.col("instability")
    return g.node_metrics(*both(spark, sf_dir, bound)).where("distance > 0.5").select("id", "distance", F.when(s < 0.5, "pain").when(s > 1.5, "useless").otherwise("between").alias("zone"))


@query(f"WITH {b.GRAPH_SQL} SELECT id, path FROM fans WHERE fan_in = 0")
def h_dead_code(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    """Candidates only: nothing in the scan imports them."""
    nodes, edges = both(spark, sf_dir, bound)
    return nodes.join(edges.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "path")


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC} SELECT coalesce(sum(v * v), 0)::BIGINT AS cyclicity, round_even(100 * sqrt(coalesce(sum(v * v), 0)) / (SELECT count(*) FROM nodes), 4) AS relative FROM sizes")
def h_cyclicity(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    s = g.tangles(g.components(nodes, edges)).agg(F.coalesce(F.sum(F.col("size") * F.col("size")), F.lit(0)).alias("cyclicity"))
    return s.crossJoin(nodes.agg(F.count("*").alias("n"))).select("cyclicity", half_even(100 * F.sqrt("cyclicity") / F.col("n"), 4).alias("relative"))


@query(f"WITH {b.GRAPH_SQL}, p AS (SELECT DISTINCT regexp_replace(a.path, '/[^/]*$', '') AS x, regexp_replace(z.path, '/[^/]*$', '') AS y FROM edges e JOIN nodes a ON a.id = e.src JOIN nodes z ON z.id = e.dst) SELECT x AS one, y AS other FROM p WHERE x < y AND EXISTS (SELECT 1 FROM p q WHERE q.x = p.y AND q.y = p.x)")
def h_package_cycles(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    d = nodes.select("id", g.folder(F.col("path")).alias("dir"))
    p = edges.join(d.select(F.col("id").alias("src"), F.col("dir").alias("one")), "src").join(d.select(F.col("id").alias("dst"), F.col("dir").alias("other")), "dst").select("one", "other").distinct()
    return p.where("one < other").join(p.select(F.col("other").alias("one"), F.col("one").alias("other")), ["one", "other"], "left_semi")


@query(f"WITH {b.GRAPH_SQL}, r AS (SELECT id, fan_in, ntile(10) OVER (ORDER BY fan_in DESC, id) AS decile FROM fans) SELECT id, fan_in FROM r WHERE decile = 1")
def h_top_decile(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    """Of this graph's nodes alone."""
    rows = g.fans(*both(spark, sf_dir, bound)).select("id", "fan_in", F.ntile(10).over(Window.orderBy(F.desc("fan_in"), "id")).alias("decile"))
    return rows.where("decile = 1").select("id", "fan_in")


@query(f"WITH {b.GRAPH_SQL} SELECT count(*) AS nodes, (SELECT count(*) FROM edges) AS edges, round_even(2 * (SELECT count(*) FROM edges) / count(*)::DOUBLE, 4) AS density, 2 * (SELECT count(*) FROM edges) / count(*)::DOUBLE > 5 AS dense FROM nodes")
def h_dense_structure(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    d = ratio(2 * F.col("edges"), F.col("nodes"))
    return g.totals(*both(spark, sf_dir, bound)).select("nodes", "edges", half_even(d, 4).alias("density"), (d > 5).alias("dense"))


@query(f"""WITH RECURSIVE {b.GRAPH_SQL}, {ROLE_SQL}, seen AS (SELECT id, CASE WHEN role = 'test' THEN 1 ELSE 0 END AS label FROM roles WHERE role IN ('root', 'registry', 'test') UNION SELECT e.dst, label FROM seen JOIN edges e ON e.src = seen.id),
best AS (SELECT id, min(label) AS label FROM seen GROUP BY 1),
r AS (SELECT f.id, f.path, role, (SELECT count(*) FROM edges e WHERE e.dst = f.id AND e.src <> e.dst) AS fan_in, CASE WHEN role IN ('root', 'registry', 'test') THEN 'entry' WHEN label = 0 THEN 'live' WHEN role = 'resolver' THEN 'orphan resolver' WHEN label = 1 THEN 'tested' WHEN f.fan_in = 0 THEN 'unused' ELSE 'island' END AS state
  FROM fans f JOIN (SELECT id, role FROM roles) USING (id) LEFT JOIN best USING (id))
SELECT id, path, role, fan_in, state, CASE WHEN state = 'orphan resolver' THEN 'high' WHEN state NOT IN ('entry', 'live') THEN 'low' END AS confidence FROM r""")
def h_liveness(spark: SparkSession, sf_dir: str, bound: Edges = b.module_edges) -> DataFrame:
    nodes, edges = both(spark, sf_dir, bound)
    return reach.liveness(nodes, edges, g.roles(nodes, edges))


# -- the same queries on the sparse graph


for _name, _f in list(QUERIES.items()):
    if "bound" in signature(_f).parameters:
        QUERIES[f"{_name}_sparse"] = partial(_f, bound=b.sparse_edges)
        ORACLE_SQL[f"{_name}_sparse"] = ORACLE_SQL[_name].replace(b.GRAPH_SQL, b.SPARSE_GRAPH_SQL)
