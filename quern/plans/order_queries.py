"""Queries of back edges, of the groups that cover modularity violations and of module pairs, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import feedback, smells
from quern.operators import structure as s
from quern.plans import bindings as b
from quern.plans.graph_queries import SCC, Edges, tangled
from quern.plans.registry import registry
from quern.plans.structure_queries import supplier_changes

QUERIES, ORACLE_SQL, query = registry()

#: The rounds of the peeling: rows of kind e are the edges that are left, rows of kind v the nodes that a round takes (id in src, side in dst).
PEELING = """
single AS MATERIALIZED (SELECT scc, src, dst FROM inside i WHERE NOT EXISTS (SELECT 1 FROM inside r WHERE r.src = i.dst AND r.dst = i.src)),
rounds AS (SELECT 0 AS r, 'e' AS kind, scc, src, dst, 0::BIGINT AS surplus, false AS flip FROM single UNION ALL SELECT * FROM (
  WITH e AS (SELECT * FROM rounds WHERE kind = 'e'),
  degree AS (SELECT scc, id, sum(o)::BIGINT AS o, sum(i)::BIGINT AS i FROM (SELECT scc, src AS id, 1 AS o, 0 AS i FROM e UNION ALL SELECT scc, dst, 0, 1 FROM e) GROUP BY 1, 2),
  whole AS (SELECT scc, bool_or(o = 0 OR i = 0) AS open, max(o - i) AS most, arg_min(id, (-o, id)) AS first FROM degree GROUP BY 1),
  gone AS (SELECT scc, id, CASE WHEN open AND o = 0 THEN 'right' ELSE 'left' END AS side, o - i AS surplus, open FROM degree JOIN whole USING (scc)
    WHERE CASE WHEN open THEN o = 0 OR i = 0 WHEN most > 0 THEN o - i >= greatest(1, ceil(most * 0.25::DOUBLE)) ELSE id = first END),
  flips AS (SELECT e.scc, 2 * count(*) FILTER ((-x.surplus, e.src) < (-y.surplus, e.dst)) < count(*) AS flip FROM e JOIN gone x ON x.id = e.src AND NOT x.open JOIN gone y ON y.id = e.dst AND NOT y.open GROUP BY 1)
  SELECT r + 1, 'e', scc, src, dst, 0::BIGINT, false FROM e WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)
  UNION ALL SELECT (SELECT max(r) FROM e) + 1, 'v', gone.scc, id, side, surplus, coalesce(flip, false) FROM gone LEFT JOIN flips ON flips.scc = gone.scc)),
taken AS MATERIALIZED (SELECT src AS id, dst AS side, r, surplus, flip FROM rounds WHERE kind = 'v' UNION ALL SELECT id, 'left', 1000000, 0, false FROM scc WHERE id NOT IN (SELECT src FROM rounds WHERE kind = 'v')),
marked AS MATERIALIZED (SELECT i.scc, i.src, i.dst, CASE WHEN a.side = z.side AND a.r = z.r THEN CASE WHEN a.flip THEN (-a.surplus, i.src) < (-z.surplus, i.dst) ELSE (-a.surplus, i.src) > (-z.surplus, i.dst) END
  ELSE (a.side = 'right', CASE a.side WHEN 'right' THEN -a.r ELSE a.r END) > (z.side = 'right', CASE z.side WHEN 'right' THEN -z.r ELSE z.r END) END AS back
  FROM inside i JOIN taken a ON a.id = i.src JOIN taken z ON z.id = i.dst)"""

#: That the rest has no cycle is shown by the closure of the edges that are left.
CHECK = PEELING + """,
further AS (SELECT src, dst FROM marked WHERE NOT back UNION SELECT f.src, m.dst FROM further f JOIN marked m ON m.src = f.dst AND NOT m.back),
counts AS (SELECT scc, count(*) AS edges, count(*) FILTER (back) AS back FROM marked GROUP BY 1),
nodes_of AS (SELECT scc, count(*) AS nodes FROM scc GROUP BY 1 HAVING count(*) >= 2),
few AS (SELECT x.scc, (SELECT count(*) FROM single s WHERE s.scc = x.scc) AS m, (SELECT count(*) FROM (SELECT src FROM single s WHERE s.scc = x.scc UNION SELECT dst FROM single s WHERE s.scc = x.scc)) AS n FROM nodes_of x),
cyclic AS (SELECT scc.scc, count(*) AS cyclic FROM further JOIN scc ON scc.id = further.src WHERE further.src = further.dst GROUP BY 1)"""
CHECKED = """SELECT scc, nodes, edges, (edges - m) // 2 AS two_cycles, back, round_even((3 * m - n + 6 * ((edges - m) // 2)) / 6.0::DOUBLE, 4) AS bound, 6 * back <= 3 * m - n + 6 * ((edges - m) // 2) AS within, coalesce(cyclic, 0) AS cyclic
FROM nodes_of JOIN counts USING (scc) JOIN few USING (scc) LEFT JOIN cyclic USING (scc)"""


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC}, {PEELING} SELECT scc, src, dst, back FROM marked")
def h_feedback_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_edges(*tangled(spark, sf_dir, b.module_edges))


@query(f"WITH RECURSIVE {b.SPARSE_GRAPH_SQL}, {SCC}, {PEELING} SELECT scc, src, dst, back FROM marked")
def h_feedback_edges_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feedback.feedback_edges(*tangled(spark, sf_dir, b.sparse_edges))


def checked(spark: SparkSession, sf_dir: str, bound: Edges) -> DataFrame:
    inside, order = feedback.ordered(*tangled(spark, sf_dir, bound))
    return feedback.feedback_check(feedback.marked_edges(inside, order), order)


@query(f"WITH RECURSIVE {b.GRAPH_SQL}, {SCC}, {CHECK} {CHECKED}")
def h_feedback_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir, b.module_edges)


@query(f"WITH RECURSIVE {b.SPARSE_GRAPH_SQL}, {SCC}, {CHECK} {CHECKED}")
def h_feedback_check_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checked(spark, sf_dir, b.sparse_edges)


def yearly_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, path: a customer's year is a commit of the parts ordered in it."""
    rows = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.concat_ws("/", "o_custkey", F.year("o_orderdate")).alias("sha"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: of two parts ordered together that were both returned, the first line's needs the second's."""
    back = b.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    a = back.select("l_orderkey", F.col("l_linenumber").alias("i"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"))
    z = back.select("l_orderkey", F.col("l_linenumber").alias("j"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return a.join(z, "l_orderkey").where("i < j and src <> dst").select("src", "dst").distinct()


GROUPS = """yearly AS (SELECT DISTINCT o_custkey || '/' || year(o_orderdate) AS sha, 'p' || l_partkey AS path FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
near AS (SELECT x.path AS a, y.path AS b, count(*) AS shared FROM yearly x JOIN yearly y ON x.sha = y.sha AND x.path < y.path GROUP BY 1, 2 HAVING count(*) > 2),
linked AS (SELECT DISTINCT 'p' || x.l_partkey AS src, 'p' || y.l_partkey AS dst FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber AND x.l_returnflag = 'R' AND y.l_returnflag = 'R'),
loose AS MATERIALIZED (SELECT * FROM near WHERE NOT EXISTS (SELECT 1 FROM linked WHERE least(src, dst) = a AND greatest(src, dst) = b)),
ways AS (SELECT 1 AS r, 'e' AS kind, a AS core, b AS member, shared FROM loose UNION ALL SELECT 1, 'e', b, a, shared FROM loose UNION ALL SELECT * FROM (
  WITH e AS (SELECT * FROM ways WHERE kind = 'e'), size AS (SELECT core, count(*) AS n FROM e GROUP BY 1),
  cores AS (SELECT core FROM size x WHERE NOT EXISTS (SELECT 1 FROM e JOIN size y ON y.core = e.member WHERE e.core = x.core AND (-y.n, y.core) < (-x.n, x.core)))
  SELECT r, 'v' AS kind, core, member, shared FROM e WHERE core IN (SELECT core FROM cores)
  UNION ALL SELECT r + 1, 'e', core, member, shared FROM e WHERE core NOT IN (SELECT core FROM cores) AND member NOT IN (SELECT core FROM cores)))"""


@query(f"WITH RECURSIVE {GROUPS} SELECT core, member, shared, r::INTEGER AS round FROM ways WHERE kind = 'v'")
def h_violation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that a customer orders in one year, above the co-change limit of 2, and that were never returned together."""
    pairs = s.unlinked_pairs(s.co_change(yearly_changes(spark, sf_dir), 3), part_edges(spark, sf_dir))
    return smells.violation_groups(pairs)


@query(f"""WITH {b.SPARSE_GRAPH_SQL}, home AS MATERIALIZED (SELECT 's' || s_suppkey AS path, s_nationkey || '/' || s_suppkey % 7 AS module, s_nationkey % 3 AS layer FROM supplier),
d AS (SELECT DISTINCT l_orderkey AS sha, 's' || l_suppkey AS path FROM lineitem), pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS shared FROM d x JOIN d y ON x.sha = y.sha AND x.path < y.path GROUP BY 1, 2 HAVING count(*) > 4),
linked AS (SELECT least(x.module, y.module) AS m, greatest(x.module, y.module) AS n FROM edges JOIN home x ON x.path = src JOIN home y ON y.path = dst)
SELECT least(x.module, y.module) AS m, greatest(x.module, y.module) AS n, count(*) AS pairs, max(shared) AS most FROM pairs JOIN home x ON x.path = a JOIN home y ON y.path = b
WHERE x.layer = y.layer AND x.module <> y.module AND (least(x.module, y.module), greatest(x.module, y.module)) NOT IN (SELECT (m, n) FROM linked) GROUP BY 1, 2""")
def h_independent_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are files, a nation's suppliers of equal remainder a module; the structure is the sparse graph's."""
    k = F.col("s_suppkey")
    homes = b.table(spark, sf_dir, "supplier").select(b.module_name(k).alias("path"), F.concat_ws("/", "s_nationkey", k % 7).alias("module"), (F.col("s_nationkey") % 3).alias("layer"))
    return s.independent_modules(s.co_change(supplier_changes(spark, sf_dir), 5), b.sparse_edges(spark, sf_dir), homes)


@query("""WITH f AS (SELECT l_orderkey, l_partkey AS k, l_quantity::BIGINT AS q, l_linenumber AS n FROM lineitem WHERE l_orderkey % 9 <> 0)
SELECT printf('%08x', l_orderkey) AS sha, CASE k % 6 WHEN 0 THEN 'src/new/f' || k || '.py' WHEN 1 THEN 'src/f' || k || '.py' WHEN 2 THEN 'lib/sub/f' || k || '.py' WHEN 3 THEN 'b' || k || '.py' ELSE 'src/f' || k || '.py' END AS path,
  CASE WHEN k % 6 <> 4 THEN q END AS added, CASE WHEN k % 6 <> 4 THEN n::BIGINT END AS deleted FROM f""")
def h_numstat_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits of a log, every ninth a merge; parts as files, some renamed in each way, some binary."""
    k, tab = F.col("l_partkey"), F.lit("\t")
    name = F.concat(F.lit("f"), k.cast("string"), F.lit(".py"))
    kind = k % 6
    path = (
        F.when(kind == 0, F.concat(F.lit("src/{old => new}/"), name)).when(kind == 1, F.concat(F.lit("src/{gone => }/"), name)).when(kind == 2, F.concat(F.lit("lib/{ => sub}/"), name))
        .when(kind == 3, F.concat(F.lit("a => b"), k.cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("src/"), name))
    )
    dash = kind == 4
    cells = [F.when(dash, "-").otherwise(F.col(c).cast("bigint").cast("string")) for c in ("l_quantity", "l_linenumber")]
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = b.table(spark, sf_dir, "lineitem")
    files = rows.select((F.col("l_orderkey") * 64 + F.row_number().over(by)).alias("line"), F.concat(cells[0], tab, cells[1], tab, path).alias("text"))
    sha = F.format_string("%08x", F.col("l_orderkey"))
    heads = rows.select("l_orderkey").distinct().select((F.col("l_orderkey") * 64).alias("line"), F.concat(F.lit("C"), sha, F.when(F.col("l_orderkey") % 9 == 0, " aa01 bb02").when(F.col("l_orderkey") % 2 == 0, " aa01").otherwise("")).alias("text"))
    return s.numstat(files.unionByName(heads))
