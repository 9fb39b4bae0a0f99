"""Queries of source scans on the driver's tables: documents as files, their words as the code.

Parsing of Python has no SQL twin; the tests hold these against authored sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import bindings as b
from quern.plans.registry import registry
from quern.sources import braces, ignores, pycode, scan

QUERIES, ORACLE_SQL, query = registry()


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a Python module of its nation's package that imports the modules of the graph binding."""
    node = b.table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("pkg"))
    e = b.module_edges(spark, sf_dir).join(node.select(F.col("id").alias("dst"), F.col("pkg").alias("dst_pkg")), "dst")
    line = F.concat(F.lit("from "), F.col("dst_pkg"), F.lit(" import "), F.col("dst"))
    head = e.groupBy(F.col("src").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("head"))
    body = F.concat(F.lit("\nimport os, sys as system\n\nclass C(Protocol):\n    def run(self, a, b):\n        for x in a:\n            if x:\n                return b\n"), F.when(F.col("id").endswith("7"), "broken(\n").otherwise(""))
    rows = node.join(head, "id", "left")
    return rows.select(F.concat("pkg", F.lit("/"), "id", F.lit(".py")).alias("path"), F.concat(F.coalesce("head", F.lit("")), body).alias("text"))


@query()
def s_python_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.records(python_files(spark, sf_dir)).select("path", "id", "loc", "types", "abstract", F.array_join("raw", ",").alias("raw"), F.array_join("raw_maybe", ",").alias("raw_maybe"), "unparseable")


@query(f"WITH {b.GRAPH_SQL}, m AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey || '.s' || s_suppkey AS name FROM supplier) SELECT a.name AS src, z.name AS dst, 1::BIGINT AS weight FROM edges e JOIN m a ON a.id = e.src JOIN m z ON z.id = e.dst WHERE NOT ends_with(e.src, '7')")
def s_import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imports of the modules, scanned and resolved, give the graph again; modules that can't be parsed have none."""
    return scan.edges(scan.resolved(scan.nodes(scan.records(python_files(spark, sf_dir)))))


@query()
def s_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pycode.measures(python_files(spark, sf_dir))


@query()
def l_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pycode.lint(python_files(spark, sf_dir))


@query("SELECT CASE WHEN regexp_matches(p_name, 'e') THEN 'ts' WHEN regexp_matches(p_name, 'a') THEN 'go' END AS lang, count(*) AS n FROM part GROUP BY 1")
def s_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_name").contains("e"), "x/y.tsx").when(F.col("p_name").contains("a"), "x.go").otherwise("x.txt")
    return b.table(spark, sf_dir, "part").select(scan.language(name).alias("lang")).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN n_chars > 5000 THEN 'too large' WHEN lang = 'fr' THEN 'other language' END AS refused, count(*) AS n FROM documents GROUP BY 1")
def s_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document counts a thousand bytes for each character; French ones have no known extension."""
    d = b.table(spark, sf_dir, "documents").select(F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.when(F.col("lang") == "fr", ".txt").otherwise(".py")).alias("path"), F.when(F.col("n_chars") > 5000, scan.MOST_BYTES + 1).otherwise(F.col("n_chars")).alias("length"))
    return scan.admitted(d).groupBy("refused").agg(F.count("*").alias("n"))


def brace_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier is a file with one function, whose parameters, lines, branches and loop follow from its key."""
    k, z = F.col("s_suppkey"), F.col("s_nationkey") % 4
    by_lang = lambda ts, java, go: F.when(k % 3 == 0, ts).when(k % 3 == 1, java).otherwise(go)
    some = lambda n, line: F.repeat(F.lit(line + "\n"), n.cast("int"))
    each = F.when(k % 6 == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest((k % 6).cast("int"), F.lit(1))), lambda i: by_lang(F.concat(F.lit("p"), i, F.lit(": Map<string, number>")), F.concat(F.lit("Map<K, V> p"), i), F.concat(F.lit("p"), i, F.lit(" int")))))
    given = F.array_join(each, ",\n")
    opens = F.concat(by_lang(F.lit("/* { */ export function f("), F.concat(F.lit("class C {\n"), some(k % 9, "public int a;"), F.lit("public void f(")), F.lit("func f(")), given, F.lit(") {\n"))
    loop = F.when(k % 5 == 0, F.concat(by_lang(F.lit("for (i = 0; i < 9; i++) {\n"), F.lit("while (a) {\n"), F.lit("for i := 0; i < 9; i++ {\n")), some(k % 12, "y();"), F.lit("}\n"))).otherwise("")
    other = F.when(k % 7 == 0, "if (a) {\n} else {\n}\n").otherwise("")
    body = F.concat(some(k % 30, "x = \"{\"; // }"), some(z, "if (a) {"), some(z, "}"), loop, other, F.lit("}\n"), by_lang(F.lit(""), F.lit("}\n"), F.lit("")))
    path = F.concat(F.lit("s"), k.cast("string"), by_lang(F.lit(".ts"), F.lit(".java"), F.lit(".go")))
    return b.table(spark, sf_dir, "supplier").select(path.alias("path"), F.concat(opens, body, F.when(k % 11 == 0, "{\n").otherwise("")).alias("text"))


BRACES_SQL = """WITH k AS (SELECT s_suppkey AS k, s_nationkey % 4 AS z, 's' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.java' ELSE '.go' END AS path FROM supplier),
m AS (SELECT path, 'params' AS metric, k % 6 AS value, 3 AS warn, 4 AS hard FROM k
UNION ALL SELECT path, 'method_lines', k % 30 + 2 * z + CASE WHEN k % 7 = 0 THEN 3 ELSE 0 END + CASE WHEN k % 5 = 0 THEN k % 12 + 2 ELSE 0 END, 15, 25 FROM k
UNION ALL SELECT path, 'nesting', greatest(z, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 1 ELSE 0 END), NULL, 1 FROM k
UNION ALL SELECT path, 'loop_body', k % 12 + 1, NULL, 8 FROM k WHERE k % 5 = 0
UNION ALL SELECT path, 'else_branch', 1, NULL, 0 FROM k WHERE k % 7 = 0
UNION ALL SELECT path, 'public', k % 9 + CASE WHEN k % 6 > 1 THEN 1 ELSE 0 END, 5, 7 FROM k WHERE k % 3 = 1
UNION ALL SELECT path, 'unbalanced_braces', 1, 0, 999 FROM k WHERE k % 11 = 0)
SELECT path, metric, value::BIGINT AS value, CASE WHEN value > hard THEN 'major' ELSE 'minor' END AS severity, CASE WHEN value > hard THEN hard ELSE warn END AS cap FROM m WHERE value > hard OR value > warn"""


@query(BRACES_SQL)
def c_brace_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of the words finds above the limits is what the files were made with.

    A method whose parameters stand on several lines counts as a public member, as its first line ends within its type;
    one that opens on its own line doesn't.
    """
    return braces.violations(braces.measures(brace_files(spark, sf_dir))).select("path", "metric", F.col("value").cast("long").alias("value"), "severity", "cap")


#: Ignore files of the listing, at the root and in one folder.
IGNORES = [(".gitignore", "# made by tools\n*.log\n/en/*/d1*\n!d12*.log\nbuild/\n"), ("de/.gitignore", "!*.log\n*.tmp\n")]


@query("""WITH f AS (SELECT lang, doc_id, 'd' || doc_id AS name, list_extract(['.py', '.log', '.tmp', '.md'], (doc_id % 4 + 1)::INTEGER) AS ext, lang || '/' || source || CASE WHEN doc_id % 9 = 0 THEN '/build' ELSE '' END AS folder FROM documents)
SELECT folder || '/' || name || ext AS path, CASE WHEN doc_id % 11 = 0 THEN false WHEN doc_id % 9 = 0 THEN true WHEN lang = 'de' THEN ext = '.tmp' WHEN name LIKE 'd12%' AND ext = '.log' THEN false WHEN lang = 'en' AND name LIKE 'd1%' THEN true ELSE ext = '.log' END AS ignored FROM f""")
def s_ignored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of four kinds, some in a build folder, every eleventh tracked."""
    k = F.col("doc_id")
    ext = b.chosen([".py", ".log", ".tmp", ".md"], k % 4)
    path = F.concat("lang", F.lit("/"), "source", F.when(k % 9 == 0, "/build").otherwise(""), F.lit("/d"), k.cast("string"), ext)
    files = b.table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    rules = spark.createDataFrame(IGNORES, "path string, text string")
    return ignores.listed(files, rules, files.where("doc_id % 11 = 0")).select("path", "ignored")
