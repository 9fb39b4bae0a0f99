"""How the driver's tables stand in for the operators' inputs, once as DataFrames and once as SQL.

Every binding reads its whole tables.  The module graph's nodes are the suppliers; a module imports every supplier that
comes right after it within an order, as often as it does.  That graph is dense, so there is a sparse one as well, whose
edges follow from the suppliers' numbers: blocks of eight are rings, chains and stars by turns, and the blocks' heads a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The folders and name stems of the modules' made-up paths; they reach every role and every legality rule.
FOLDERS = ["src/billing", "src/billing/rules", "src/billing/rules/tax", "src/shipping", "src/shipping/adapters", "src/utils", "src", "tests/billing"]
STEMS = ["price_port", "FixedPrice", "order_service", "noop_price", "rule_registry", "request_context", "composition_root", "ledger", "tax_policy", "carrier", "test_price", "contract_price"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def chosen_sql(values: list[str], at: str) -> str:
    return f"list_extract([{', '.join(repr(v) for v in values)}], CAST({at} AS INTEGER) + 1)"


def module_name(key: Column) -> Column:
    return F.concat(F.lit("s"), key.cast("string"))


def module_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight: all suppliers that come right after a supplier within an order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = table(spark, sf_dir, "lineitem").select(module_name(F.col("l_suppkey")).alias("src"), module_name(F.lead("l_suppkey").over(by)).alias("dst"))
    return steps.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


#: The sparse graph's edges of supplier k, by its block k div 8 and its place k % 8; those to no supplier fall away.
SPARSE = [
    ("k div 8 % 3 = 0", "k - k % 8 + (k + 1) % 8"),
    ("k div 8 % 3 = 1 and k % 8 < 7", "k + 1"),
    ("k div 8 % 3 = 1 and k % 8 > 0", "k - 1"),
    ("k div 8 % 3 = 2 and k % 8 > 0", "k - k % 8"),
    ("k div 8 % 3 = 2 and k % 8 > 0", "-k"),
    ("k % 8 = 0 and k >= 8", "(k div 16) * 8"),
]


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, weight of the sparse graph; an end of `-k` is the edge from the block's head to k."""
    keys = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).distinct()
    ends = F.array_compact(F.array(*[F.when(F.expr(when), F.expr(to)) for when, to in SPARSE]))
    rows = keys.select("k", F.explode(ends).alias("to"))
    rows = rows.select(F.when(F.col("to") < 0, F.expr("k - k % 8")).otherwise(F.col("k")).alias("a"), F.abs("to").alias("z"))
    rows = rows.join(keys.select(F.col("k").alias("a")), "a", "left_semi").join(keys.select(F.col("k").alias("z")), "z", "left_semi")
    return rows.select(module_name(F.col("a")).alias("src"), module_name(F.col("z")).alias("dst"), (1 + (F.col("a") * 3 + F.col("z")) % 5).alias("weight"))


def module_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, path, lang, loc, types, abstract, unresolved."""
    k = F.col("s_suppkey")
    path = F.concat(chosen(FOLDERS, (k * 7 + F.col("s_nationkey")) % len(FOLDERS)), F.lit("/"), chosen(STEMS, k % len(STEMS)), F.when(k % len(STEMS) == 10, F.lit("_")).otherwise(""), k.cast("string"), F.lit(".py"))
    lang = chosen(["python", "typescript", "java", "go"], k % 4)
    types = (k % 4).cast("long")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), k.cast("string")).alias("id"), path.alias("path"), lang.alias("lang"), (10 + (k * 37) % 400).alias("loc"), types.alias("types"),
        F.when(k % 5 == 0, types).otherwise(F.least(types, k % 2)).alias("abstract"), (k % 3).alias("unresolved"),
    )


GRAPH_SQL = f"""
steps AS (SELECT 's' || l_suppkey AS src, 's' || lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS weight FROM steps WHERE src <> dst GROUP BY src, dst),
nodes AS MATERIALIZED (SELECT 's' || s_suppkey AS id,
  {chosen_sql(FOLDERS, f"(s_suppkey * 7 + s_nationkey) % {len(FOLDERS)}")} || '/' || {chosen_sql(STEMS, f"s_suppkey % {len(STEMS)}")} || CASE WHEN s_suppkey % {len(STEMS)} = 10 THEN '_' ELSE '' END || s_suppkey || '.py' AS path,
  {chosen_sql(["python", "typescript", "java", "go"], "s_suppkey % 4")} AS lang,
  10 + (s_suppkey * 37) % 400 AS loc, s_suppkey % 4 AS types,
  CASE WHEN s_suppkey % 5 = 0 THEN s_suppkey % 4 ELSE least(s_suppkey % 4, s_suppkey % 2) END AS abstract, s_suppkey % 3 AS unresolved FROM supplier),
fans AS MATERIALIZED (SELECT id, path, lang, loc, types, abstract, unresolved,
  (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS fan_in, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS fan_out FROM nodes n)
"""

#: The same on the sparse graph.
SPARSE_GRAPH_SQL = f"""
keys AS (SELECT DISTINCT s_suppkey AS k FROM supplier),
steps AS ({" UNION ALL ".join(f"SELECT k, {to.replace(' div ', ' // ')} AS z FROM keys WHERE {when.replace(' div ', ' // ')}" for when, to in SPARSE)}),
sparse_ends AS (SELECT CASE WHEN z < 0 THEN k - k % 8 ELSE k END AS a, abs(z) AS z FROM steps),
edges AS MATERIALIZED (SELECT 's' || a AS src, 's' || z AS dst, 1 + (a * 3 + z) % 5 AS weight FROM sparse_ends WHERE a IN (SELECT k FROM keys) AND z IN (SELECT k FROM keys)),
nodes{GRAPH_SQL.split("nodes", 1)[1]}"""


def ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, relevance: the labelled documents of a source and language, longest first."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = d.join(labels, "doc_id").select(F.concat_ws("/", "lang", "source").alias("query_id"), "n_chars", "doc_id", F.greatest(2 * F.col("quality") - F.col("toxic"), F.lit(0)).alias("relevance"))
    return rows.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), "relevance")


RANKING_SQL = """
ranking AS (SELECT lang || '/' || source AS query_id, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank,
  greatest(2 * quality - toxic, 0) AS relevance FROM documents JOIN labels USING (doc_id))
"""


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scenario, case_id, pos, name, success, value: a case is a user's day, its scenario the day's first event type."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    by = Window.partitionBy("user_id", "day")
    order = by.orderBy("ts", "event_id")
    return e.select(
        F.first("event_type").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("scenario"),
        F.concat_ws("/", "user_id", "day").alias("case_id"), F.row_number().over(order).alias("pos"), F.col("event_type").alias("name"), (F.col("event_type") != "error").alias("success"), "value", "props",
    )


TRIALS_SQL = """
trials AS (SELECT first_value(event_type) OVER w AS scenario, user_id || '/' || strftime(ts, '%Y-%m-%d') AS case_id,
  row_number() OVER w AS pos, event_type AS name, event_type <> 'error' AS success, value, props
  FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id))
"""

#: The funnel that a user's events are held against.
FUNNEL = ["view", "click", "purchase"]


def calibration_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select(F.least(F.lit(1.0), F.col("n_chars") / F.lit(20000.0)).alias("p"), F.col("quality").alias("outcome"))


PAIRS_SQL = "pairs AS (SELECT least(1.0::DOUBLE, n_chars / 20000.0::DOUBLE) AS p, quality::DOUBLE AS outcome FROM documents JOIN labels USING (doc_id))"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, ts, author, path, added, deleted: a commit is an order, its files are the parts."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("l_orderkey").alias("sha"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("author"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity").cast("long")).alias("added"), F.when(F.col("l_returnflag") != "R", F.col("l_linenumber").cast("long")).alias("deleted"),
    )


CHANGES_SQL = """
changes AS (SELECT l_orderkey AS sha, o_orderdate AS ts, o_orderpriority AS author, 'p' || l_partkey AS path,
  CASE WHEN l_returnflag <> 'R' THEN l_quantity::BIGINT END AS added, CASE WHEN l_returnflag <> 'R' THEN l_linenumber::BIGINT END AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, folder, text: a document is a file in the folder of its language and source."""
    return table(spark, sf_dir, "documents").select(F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat_ws("/", "lang", "source").alias("folder"), F.col("text"))


FILES_SQL = "files AS (SELECT lang || '/' || source || '/d' || doc_id || '.py' AS path, lang || '/' || source AS folder, text FROM documents)"
