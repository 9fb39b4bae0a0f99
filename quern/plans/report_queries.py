"""Queries of the assembled report on the sparse module graph, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import report
from quern.plans import bindings as b
from quern.plans.graph_queries import LEGAL_SQL, PORT_SQL, SCC
from quern.plans.graph_queries import ORACLE_SQL as GRAPH_TWINS
from quern.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()

#: Files that the scan is said not to have read, and what it noted.
HOLES, SCAN_NOTES = 2, ("3 paths were refused",)

ALL = f"{b.SPARSE_GRAPH_SQL}, {SCC}, {LEGAL_SQL}, {PORT_SQL}"
SHAPES = f"shaped AS MATERIALIZED ({GRAPH_TWINS['g_shapes_sparse']}), cuts AS MATERIALIZED ({GRAPH_TWINS['g_weakest_edge_sparse']})"
TOTALS = """totals AS MATERIALIZED (SELECT (SELECT count(*) FROM nodes) AS files, (SELECT sum(loc)::BIGINT FROM nodes) AS loc, (SELECT count(*) FROM nodes) AS nodes, (SELECT sum(unresolved)::BIGINT FROM nodes) AS unresolved_imports,
  (SELECT count(*) FROM edges) AS edges, (SELECT count(*) FROM judged WHERE reason <> '') AS illegal_edges, (SELECT count(*) FROM sizes) AS cycles,
  (SELECT count(*) FROM roles WHERE role = 'port') AS ports, (SELECT count(*) FROM roles WHERE role = 'resolver') AS resolvers, (SELECT count(*) FROM roles WHERE role = 'root') AS composition_roots, (SELECT count(*) FROM roles WHERE role = 'util') AS utils,
  (SELECT count(contract_suite) FROM health) AS contract_suites, (SELECT count(*) FROM health WHERE contract_suite IS NULL) AS ports_without_suite, (SELECT count(*) FROM health WHERE NOT has_absent_resolver) AS ports_without_absent,
  CASE WHEN (SELECT count(*) FROM nodes) <= 3000 THEN (SELECT round_even(count(*) / ((SELECT count(*) FROM nodes) * (SELECT count(*) FROM nodes))::DOUBLE, 4) FROM closure WHERE src <> dst) END AS propagation_cost,
  round_even(2 * (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes)::DOUBLE, 2) AS avg_degree)"""
LANGUAGES = """langs AS (SELECT lang AS name, count(*) AS files, count(*) AS nodes, sum(loc)::BIGINT AS loc, CASE lang WHEN 'python' THEN 'ast' WHEN 'go' THEN 'source imports, directory ids' WHEN 'ts' THEN 'lexical' WHEN 'java' THEN 'lexical' ELSE 'unknown' END AS tooling,
  CASE lang WHEN 'python' THEN 'native' ELSE 'lexical' END AS fidelity FROM nodes GROUP BY 1)"""


def parts(spark: SparkSession, sf_dir: str) -> report.Parts:
    return report.Parts(b.module_nodes(spark, sf_dir), b.sparse_edges(spark, sf_dir))


@query(f"WITH RECURSIVE {ALL}, {TOTALS} SELECT * FROM totals")
def r_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.totals(parts(spark, sf_dir))


@query(f"WITH {b.SPARSE_GRAPH_SQL}, {LANGUAGES} SELECT * FROM langs")
def r_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.languages(b.module_nodes(spark, sf_dir))


@query(f"""WITH RECURSIVE {ALL}, {SHAPES}, {TOTALS}, {LANGUAGES}, told AS (
  SELECT 0 AS o, 0 AS p, 'fidelity=degraded: read by their words: ' || string_agg(name, ', ' ORDER BY name) || '; no absence of cycles may be claimed' AS note FROM langs WHERE fidelity = 'lexical'
  UNION ALL SELECT 1, 0, 'fidelity=degraded: {HOLES} files were not read; the edges are a lower bound'
  UNION ALL SELECT 2, row_number() OVER (ORDER BY hub_note), hub_note FROM (SELECT DISTINCT hub_note FROM shaped WHERE hub_note <> '')
  UNION ALL SELECT 3, 0, 'transitive closure skipped: ' || nodes || ' nodes exceeds cap 3000' FROM totals WHERE nodes > 3000
  UNION ALL SELECT 4, 0, unresolved_imports || ' imports could not be resolved to a node' FROM totals WHERE unresolved_imports > 0
  UNION ALL SELECT 5, 0, '{SCAN_NOTES[0]}')
SELECT 'degraded' AS fidelity, (row_number() OVER (ORDER BY o, p) - 1)::INTEGER AS place, note FROM told""")
def r_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.notes(parts(spark, sf_dir), HOLES, SCAN_NOTES)
    return rows.select("fidelity", F.posexplode("degraded").alias("place", "note"))


@query(f"""WITH RECURSIVE {ALL}, {SHAPES}, ranked AS MATERIALIZED ({GRAPH_TWINS['g_pagerank_sparse']}),
top AS (SELECT s.*, c.cut_src, c.cut_dst, c.cut_weight, row_number() OVER (ORDER BY vertices DESC, s.scc)::INTEGER AS block FROM shaped s LEFT JOIN cuts c ON c.scc = s.scc QUALIFY block <= 8),
kinds AS (SELECT reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, reason)::INTEGER AS block FROM judged WHERE reason <> '' GROUP BY 1)
SELECT 'cycles' AS view, block, 0 AS line, '[' || vertices || '] ' || shape || ': ' || (SELECT string_agg(id, ', ' ORDER BY id) FROM (SELECT id FROM scc x WHERE x.scc = top.scc ORDER BY id LIMIT 8)) || CASE WHEN vertices > 8 THEN ' (+' || (vertices - 8) || ' more)' ELSE '' END AS text FROM top
UNION ALL SELECT 'cycles', block, 1, t FROM (SELECT block, concat_ws('  ', 'ratio=' || printf('%.4f', ratio), 'bckref=' || printf('%.4f', bckref), 'dense=' || printf('%.4f', dense), 'star=' || printf('%.4f', star), 'chain=' || printf('%.4f', chain), 'hub=' || printf('%.4f', hub)) AS t FROM top) WHERE t <> ''
UNION ALL SELECT 'cycles', block, 2, 'cut: ' || cut_src || ' -> ' || cut_dst || ' (' || cut_weight || ')' FROM top
UNION ALL SELECT 'illegal', block, 0, n || '  ' || reason FROM kinds
UNION ALL SELECT 'illegal', block, place, src || ' -> ' || dst FROM (SELECT reason, src, dst, row_number() OVER (PARTITION BY reason ORDER BY src, dst)::INTEGER AS place FROM judged WHERE reason <> '') JOIN kinds USING (reason) WHERE place <= 3
UNION ALL SELECT 'illegal', block, 4, '+' || (n - 3) || ' more' FROM kinds WHERE n > 3
UNION ALL SELECT 'ranks', place, 0, printf('%.3f', pagerank) || '  ' || fan_in || '  ' || fan_out || '  ' || role || '/' || id FROM (SELECT id, pagerank, f.fan_in, f.fan_out, role, row_number() OVER (ORDER BY pagerank DESC, id)::INTEGER AS place FROM ranked JOIN fans f USING (id) JOIN (SELECT id, role FROM roles) USING (id)) WHERE place <= 10
UNION ALL SELECT 'ports', 0, 0, resolvers || ' resolvers  ' || port || '  [' || CASE WHEN contract_suite IS NOT NULL AND has_absent_resolver AND len(imported_outside_root) = 0 THEN 'ok' ELSE concat_ws('; ', CASE WHEN contract_suite IS NULL THEN 'no contract suite' END, CASE WHEN NOT has_absent_resolver THEN 'no absent resolver' END, CASE WHEN len(imported_outside_root) > 0 THEN len(imported_outside_root) || ' importers past the root' END) END || ']' FROM health""")
def r_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.text(parts(spark, sf_dir))


METRICS_JSON = "'{' || concat_ws(',', " + ", ".join(f"'\"{c}\":' || {c}" for c in ("ratio", "bckref", "dense", "star", "chain", "hub")) + ") || '}'"


@query(f"""WITH RECURSIVE {ALL}, {SHAPES}, {TOTALS}, {LANGUAGES},
one AS (SELECT vertices, s.scc, '{{"scc":"' || s.scc || '","size":' || vertices || ',"shape":"' || shape || '","shape_metrics":' || {METRICS_JSON} || ',"weakest_edge":{{"from":"' || cut_src || '","to":"' || cut_dst || '","weight":' || cut_weight
  || '}},"break_with":"invert ' || cut_src || ' -> ' || cut_dst || ' behind a port; a candidate, not called minimal"}}' AS j FROM shaped s JOIN cuts c ON c.scc = s.scc)
SELECT '{{"schema":"quern-graph/1","fidelity":"degraded","degraded":["fidelity=degraded: read by their words: ' || (SELECT string_agg(name, ', ' ORDER BY name) FROM langs WHERE fidelity = 'lexical') || '; no absence of cycles may be claimed","' || unresolved_imports || ' imports could not be resolved to a node"],"languages":['
  || (SELECT string_agg('{{"name":"' || name || '","files":' || files || ',"nodes":' || nodes || ',"loc":' || loc || ',"tooling":"' || tooling || '","fidelity":"' || fidelity || '"}}', ',' ORDER BY name) FROM langs) || '],"cycles":[' || coalesce((SELECT string_agg(j, ',' ORDER BY vertices DESC, scc) FROM one), '')
  || '],"totals":{{"cycles":' || cycles || ',"edges":' || edges || ',"illegal_edges":' || illegal_edges || ',"nodes":' || nodes || '}}}}' AS json FROM totals""")
def r_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.cycles_only(parts(spark, sf_dir))


def r_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.lines(parts(spark, sf_dir), HOLES, SCAN_NOTES)


QUERIES["r_lines"] = r_lines
