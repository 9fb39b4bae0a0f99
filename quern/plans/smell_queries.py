"""Queries of the package and history smells, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import graph as g
from quern.operators import smells as sm
from quern.plans import bindings as b
from quern.plans.evaluation_queries import shown
from quern.plans.graph_queries import ORACLE_SQL as GRAPH_TWINS
from quern.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.module_nodes(spark, sf_dir).withColumn("package", g.folder(F.col("path")))


PACKAGES = "homes AS MATERIALIZED (SELECT *, regexp_replace(path, '/[^/]*$', '') AS package FROM nodes)"


@query(f"WITH {b.GRAPH_SQL}, {PACKAGES}, p AS (SELECT package, sum(loc)::BIGINT AS loc, sum(types)::BIGINT AS types FROM homes GROUP BY 1), m AS (SELECT quantile_cont(loc, 0.5) AS median FROM p) SELECT package, loc, types, CASE WHEN loc > 27000 OR types > 30 THEN 'fixed' ELSE 'median' END AS rule, loc - median AS severity FROM p, m WHERE loc > 27000 OR types > 30 OR loc > median")
def h_god_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sm.god_components(packages(spark, sf_dir))


@query(f"""WITH RECURSIVE {b.SPARSE_GRAPH_SQL}, {PACKAGES}, inner_ways AS (SELECT e.src, e.dst FROM edges e JOIN homes x ON x.id = e.src JOIN homes y ON y.id = e.dst WHERE x.package = y.package),
ways AS (SELECT src, dst FROM inner_ways UNION SELECT dst, src FROM inner_ways), reach AS (SELECT src, dst FROM ways UNION SELECT r.src, w.dst FROM reach r JOIN ways w ON r.dst = w.src),
part_of AS (SELECT id, package, least(id, coalesce((SELECT min(dst) FROM reach WHERE src = id), id)) AS part FROM homes),
c AS (SELECT package, count(DISTINCT part) AS parts, count(*) AS classes FROM part_of GROUP BY 1) SELECT package, parts, classes, round_even(parts / classes::DOUBLE, 9) AS lcc, parts / classes::DOUBLE > 0.2 AS found FROM c""")
def h_feature_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the sparse graph; folders are the packages."""
    return shown(sm.feature_concentration(packages(spark, sf_dir), b.sparse_edges(spark, sf_dir)))


@query(f"""WITH RECURSIVE {b.TRIALS_SQL}, d AS (SELECT DISTINCT case_id AS sha, name AS path FROM trials), n AS (SELECT path, count(*) AS n FROM d GROUP BY 1),
links AS MATERIALIZED (SELECT x.path AS a, y.path AS b, count(*) / any_value(n.n)::DOUBLE AS p FROM d x JOIN d y ON x.sha = y.sha AND x.path <> y.path JOIN n ON n.path = x.path GROUP BY 1, 2 HAVING count(*) / any_value(n.n)::DOUBLE >= 0.3),
walks AS (SELECT a, b, p, [a, b] AS seen FROM links UNION ALL SELECT w.a, l.b, w.p * l.p, list_append(seen, l.b) FROM walks w JOIN links l ON l.a = w.b WHERE NOT list_contains(seen, l.b) AND w.p * l.p >= 0.3)
SELECT a, b, round_even(max(p), 9) AS p FROM walks GROUP BY 1, 2""")
def h_conditional_co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's day is a commit of its event types, few of which are ever apart."""
    return shown(sm.conditional_co_change(b.trials(spark, sf_dir).select(F.col("case_id").alias("sha"), F.col("name").alias("path"))))


@query(f"WITH {b.TRIALS_SQL}, s AS (SELECT case_id, list_sort(list_distinct(list(name))) AS members FROM trials GROUP BY 1), k AS (SELECT members, count(*) AS n FROM s GROUP BY 1) SELECT array_to_string(x.members, ',') AS members, len(x.members)::INTEGER AS size, sum(y.n)::BIGINT AS occurrences FROM k x JOIN k y ON list_has_all(y.members, x.members) GROUP BY x.members HAVING sum(y.n) >= 2")
def h_recurring_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = b.trials(spark, sf_dir).select(F.col("case_id").alias("set_id"), F.col("name").alias("member"))
    return sm.recurring_sets(sets).withColumn("members", F.array_join("members", ","))


@query(f"""WITH {b.SPARSE_GRAPH_SQL}, pr AS ({GRAPH_TWINS["g_pagerank_sparse"]}), d AS (SELECT id, fan_in + fan_out AS degree, fan_in FROM fans),
smells AS (SELECT id, 'hub' AS kind, degree AS measure, degree AS dependencies, 2.0::DOUBLE AS weight FROM d WHERE degree > 2 UNION ALL SELECT id, 'sink', fan_in, degree, 0.5 FROM d WHERE fan_in > 1),
r AS (SELECT s.*, pagerank, coalesce((SELECT count(*) FROM smells o WHERE o.kind = s.kind AND o.measure < s.measure) / nullif(count(*) OVER (PARTITION BY kind) - 1, 0)::DOUBLE, 0) AS severity, (SELECT sum(dependencies) FROM smells) AS w FROM smells s LEFT JOIN pr USING (id))
SELECT id, kind, round_even(severity, 9) AS severity, round_even(severity * pagerank, 9) AS asis, round_even(severity * pagerank * weight / w, 9) AS debt FROM r""")
def h_debt_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """On the sparse graph: degrees above 2, and fans above 1, as two kinds of smells."""
    nodes, edges = b.module_nodes(spark, sf_dir), g.step(b.sparse_edges(spark, sf_dir))
    d = g.fans(nodes, edges).withColumn("degree", F.col("fan_in") + F.col("fan_out"))
    hub = d.where("degree > 2").select("id", F.lit("hub").alias("kind"), F.col("degree").alias("measure"), F.col("degree").alias("dependencies"))
    sink = d.where("fan_in > 1").select("id", F.lit("sink").alias("kind"), F.col("fan_in").alias("measure"), F.col("degree").alias("dependencies"))
    rank = g.pagerank(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return shown(sm.debt_index(hub.unionByName(sink), rank, spark.createDataFrame([("hub", 2.0), ("sink", 0.5)], "kind string, weight double")))


@query(f"""WITH {b.GRAPH_SQL}, home AS MATERIALIZED (SELECT 's' || s_suppkey AS id, s_nationkey AS module, s_nationkey % 3 AS layer FROM supplier),
size AS (SELECT module, layer, count(*) AS files FROM home GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM home),
r AS (SELECT s.*, n, (SELECT count(*) FROM home h WHERE h.layer > s.layer) AS below, (SELECT count(DISTINCT e.src) FROM edges e JOIN home z ON z.id = e.dst JOIN home a ON a.id = e.src WHERE z.module = s.module AND a.layer > s.layer) AS deps FROM size s, n)
SELECT layer, count(*) AS modules, round_even(sum(CASE WHEN below > 0 THEN files / n::DOUBLE * (1 - deps / below::DOUBLE) WHEN files <= 5 THEN files / n::DOUBLE ELSE files / n::DOUBLE / (ln(files) / ln(5)) END), 9) AS dl FROM r GROUP BY 1""")
def h_decoupling_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations are the modules, in three layers."""
    files = b.table(spark, sf_dir, "supplier").select(b.module_name(F.col("s_suppkey")).alias("id"), F.col("s_nationkey").alias("module"), (F.col("s_nationkey") % 3).alias("layer"))
    return shown(sm.decoupling_level(files, b.module_edges(spark, sf_dir)))
