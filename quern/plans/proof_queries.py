"""Queries of parsers, linters and import resolution on sources that are made from the suppliers, so that SQL knows what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import structure as s
from quern.plans import bindings as b
from quern.plans.registry import registry
from quern.plans.source_queries import python_files
from quern.sources import pycode, scan

QUERIES, ORACLE_SQL, query = registry()


def key() -> tuple[Column, Column]:
    """A supplier's number, and the name of its module."""
    k = F.col("s_suppkey")
    return k, F.concat(F.lit("s"), k.cast("string"))


def lines(n: Column | int, line: str) -> Column:
    return F.repeat(F.lit(line + "\n"), n if isinstance(n, Column) else F.lit(n))


def where(test: Column, text: Column | str) -> Column:
    return F.when(test, text if isinstance(text, Column) else F.lit(text)).otherwise("")


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each supplier with a class of two methods; parameters, lines, branches and loops follow from its key."""
    K, NAME = key()  # noqa: N806
    given = F.array_join(F.concat(F.array(F.lit("self")), F.when(K % 6 > 0, F.transform(F.sequence(F.lit(1), F.greatest(K % 6, F.lit(1))), lambda i: F.concat(F.lit("p"), i))).otherwise(F.array().cast("array<string>"))), ", ")
    pad = lambda depth: F.repeat(F.lit("    "), depth + 2)
    z = (K % 4).cast("int")
    nested = F.when(z > 0, F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(z, F.lit(1)) - 1), lambda i: F.concat(pad(i), F.lit("if a:\n"))), ""), pad(z), F.lit("pass\n"))).otherwise("")
    head = F.concat(F.lit("class C"), K.cast("string"), F.when(K % 4 == 0, F.lit("(A, B)")).when(K % 2 == 0, F.lit("(Protocol)")).otherwise(""), F.lit(":\n    def m("), given, F.lit("):\n"))
    loop = where(K % 5 == 0, F.concat(F.lit("        for i in a:\n"), lines((K % 7 + 1).cast("int"), "            x = 2")))
    other = where(K % 7 == 0, "        if a:\n            pass\n        else:\n            pass\n")
    text = F.concat(head, where(K % 3 == 0, '        """What it does."""\n'), lines((K % 20 + 1).cast("int"), "        x = 1"), nested, loop, other, F.lit("\n    def _hidden(self):\n        pass\n"), where(K % 13 == 0, "broken(\n"))
    return b.table(spark, sf_dir, "supplier").select(F.concat(NAME, F.lit(".py")).alias("path"), text.alias("text"))


MADE = "k AS (SELECT s_suppkey AS k, s_nationkey AS z, 's' || s_suppkey || '.py' AS path FROM supplier)"


@query(f"""WITH {MADE}, good AS (SELECT *, 'C' || k AS c FROM k WHERE k % 13 <> 0), m AS (
SELECT path, 'public' AS metric, 1 AS value, c AS name FROM good UNION ALL SELECT path, 'multiple_inheritance', 2, c FROM good WHERE k % 4 = 0
UNION ALL SELECT path, 'method_lines', k % 20 + 1 + CASE WHEN k % 4 > 0 THEN k % 4 + 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN k % 7 + 2 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 4 ELSE 0 END, c || '.m' FROM good
UNION ALL SELECT path, 'params', k % 6, c || '.m' FROM good UNION ALL SELECT path, 'nesting', greatest(k % 4 - 1, 0), c || '.m' FROM good
UNION ALL SELECT path, 'loop_body', k % 7 + 1, c || '.m' FROM good WHERE k % 5 = 0 UNION ALL SELECT path, 'else_branch', 1, c || '.m (else)' FROM good WHERE k % 7 = 0
UNION ALL SELECT path, unnest(['method_lines', 'params', 'nesting']), unnest([1, 0, 0]), c || '._hidden' FROM good
UNION ALL SELECT path, 'unparseable', 1, '' FROM k WHERE k % 13 = 0)
SELECT path, metric, value::INTEGER AS value, name FROM m""")
def s_made_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans, parameters, nesting, loops, else branches and class checks of parsed files."""
    rows = pycode.measures(class_files(spark, sf_dir))
    return rows.select("path", "metric", "value", F.when(F.col("metric") == "unparseable", "").otherwise(F.col("name")).alias("name"))


LOC = "3 + k % 20 + 1 + 3 - 1 + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 4 > 0 THEN k % 4 + 1 ELSE 0 END + CASE WHEN k % 5 = 0 THEN k % 7 + 2 ELSE 0 END + CASE WHEN k % 7 = 0 THEN 4 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END"


def typed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four languages with some abstract and some plain types each."""
    K, NAME = key()  # noqa: N806
    by_lang = lambda ts, java, go: F.when(K % 3 == 0, F.lit(ts)).when(K % 3 == 1, F.lit(java)).otherwise(F.lit(go))
    abstract = by_lang("export interface I {}\n", "public interface I {}\n", "type I interface {}\n")
    plain = by_lang("export class C {}\n", "public final class C {}\n", "type S struct {}\n")
    text = F.concat(F.repeat(abstract, (K % 4).cast("int")), F.repeat(plain, (K % 5).cast("int")), F.lit("// end"))
    rows = b.table(spark, sf_dir, "supplier").select(F.concat(NAME, by_lang(".ts", ".java", ".go")).alias("path"), text.alias("text"))
    return rows.unionByName(class_files(spark, sf_dir))


@query(f"""WITH {MADE} SELECT path, 'python' AS lang, ({LOC})::INTEGER AS loc, CASE WHEN k % 13 <> 0 THEN 1 END AS types, CASE WHEN k % 13 <> 0 THEN CASE WHEN k % 2 = 0 AND k % 4 <> 0 THEN 1 ELSE 0 END END AS abstract, k % 13 = 0 AS unparseable FROM k
UNION ALL SELECT 's' || k || CASE k % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.java' ELSE '.go' END, CASE k % 3 WHEN 0 THEN 'ts' WHEN 1 THEN 'java' ELSE 'go' END, (k % 4 + k % 5 + 1)::INTEGER, (k % 4 + k % 5)::INTEGER, (k % 4)::INTEGER, false FROM k""")
def s_made_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and types of each language's reader, and which files can't be parsed."""
    rows = scan.records(typed_files(spark, sf_dir))
    return rows.select("path", "lang", "loc", "types", "abstract", F.col("unparseable").isNotNull().alias("unparseable"))


def linted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that break some of the linter's rules, by their key."""
    K, NAME = key()  # noqa: N806
    path = F.concat(F.lit("m"), K.cast("string"), F.lit("/"), where(K % 8 == 0, "utils/"), F.when(K % 9 == 0, "helpers").otherwise(NAME), F.lit(".py"))
    method = F.concat(F.lit("def "), F.when(K % 5 == 0, "run").otherwise("total"), F.lit("(a):\n"), lines(F.when(K % 6 == 0, 26).otherwise(25), "    x = 1"))
    loop = F.concat(F.lit("for i in ITEMS:\n"), lines(F.when(K % 7 == 0, 9).otherwise(8), "    x = 1"))
    enum = F.concat(F.lit("class E(Enum):\n    A = 1\n"), where(K % 4 != 0, "    B = 2\n"))
    state = F.when(K % 3 == 0, "items = []\n").otherwise("ITEMS = []\n")
    return b.table(spark, sf_dir, "supplier").select(path.alias("path"), F.concat(state, method, enum, loop, where(K % 10 == 0, lines(250, "#"))).alias("text"))


LINTED = """f AS (SELECT s_suppkey AS k, 'm' || s_suppkey || '/' || CASE WHEN s_suppkey % 8 = 0 THEN 'utils/' ELSE '' END || CASE WHEN s_suppkey % 9 = 0 THEN 'helpers' ELSE 's' || s_suppkey END || '.py' AS path FROM supplier),
found AS (SELECT path, 'file-too-long' AS rule, 'warning' AS severity, '' AS name FROM f WHERE k % 10 = 0 UNION ALL SELECT path, 'vague-file-name', 'info', 'helpers' FROM f WHERE k % 9 = 0 UNION ALL SELECT path, 'vague-folder-name', 'info', 'utils' FROM f WHERE k % 8 = 0
UNION ALL SELECT path, 'method-too-long', 'warning', CASE WHEN k % 5 = 0 THEN 'run' ELSE 'total' END FROM f WHERE k % 6 = 0 UNION ALL SELECT path, 'vague-method-name', 'info', 'run' FROM f WHERE k % 5 = 0 UNION ALL SELECT path, 'loop-body-too-long', 'info', '' FROM f WHERE k % 7 = 0
UNION ALL SELECT path, 'single-member-enum', 'info', 'E' FROM f WHERE k % 4 = 0 UNION ALL SELECT path, 'module-level-state', 'info', '' FROM f WHERE k % 3 = 0)"""


@query(f"WITH {LINTED} SELECT * FROM found")
def l_made_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pycode.lint(linted_files(spark, sf_dir))
    return rows.select("path", "rule", "severity", F.when(F.col("rule") == "file-too-long", "").otherwise(F.col("name")).alias("name"))


@query(f"WITH {LINTED} SELECT path, count(*) AS n, bool_or(severity = 'warning') AS failed FROM found GROUP BY 1")
def l_made_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pycode.gate(pycode.lint(linted_files(spark, sf_dir)))


def importing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modules root/n<nation>/s<key> that import others by a tail, beside them, relatively, or by a name that several have.

    Every fifth is TypeScript and imports the one five further, by a relative or an aliased path.
    """
    K, NAME = key()  # noqa: N806
    keys = b.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("z"))
    ahead = lambda by: keys.select((K - by).alias("s_suppkey"), F.col("z").alias(f"z{by}"))
    rows = keys.join(ahead(1), "s_suppkey", "left").join(ahead(5), "s_suppkey", "left")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    one = F.coalesce("z1", "z")
    python = (
        F.when(K % 4 == 0, text("import n", one, ".s", K + 1)).when(K % 4 == 1, text("from . import s", K + 1)).when(K % 4 == 2, text("import s", K + 1, "\nimport dup.same"))
        .otherwise(text("from ..n", one, " import s", K + 1, "\nfrom ....far import s1"))
    )
    five = F.coalesce("z5", "z")
    ts = F.when(K % 10 == 0, text("import { a } from '@/root/n", five, "/s", K + 5, "'")).otherwise(text("const a = require('../n", five, "/s", K + 5, ".js')"))
    folder = text("root/n", F.col("z"), "/")
    files = rows.select(F.concat(folder, NAME, F.when(K % 5 == 0, ".ts").otherwise(".py")).alias("path"), F.when(K % 5 == 0, ts).otherwise(python).alias("text"))
    dup = keys.select("z").distinct().select(text("root/n", F.col("z"), "/dup/same.py").alias("path"), F.lit("x = 1\n").alias("text"))
    return files.unionByName(dup)


@query("""WITH k AS (SELECT s_suppkey AS k, s_nationkey AS z, CASE WHEN s_suppkey % 5 = 0 THEN 'root/n' || s_nationkey || '/s' || s_suppkey ELSE 'root.n' || s_nationkey || '.s' || s_suppkey END AS id FROM supplier)
SELECT a.id AS src, t.id AS dst, 1::BIGINT AS weight FROM k a JOIN k t ON t.k = a.k + 1 WHERE a.k % 5 <> 0 AND t.k % 5 <> 0 AND (a.k % 4 IN (0, 3) OR a.z = t.z)
UNION ALL SELECT a.id, t.id, 1 FROM k a JOIN k t ON t.k = a.k + 1 WHERE a.k % 5 <> 0 AND t.k % 5 = 0 AND a.z = t.z AND a.k % 4 IN (1, 2)
UNION ALL SELECT a.id, t.id, 1 FROM k a JOIN k t ON t.k = a.k + 5 WHERE a.k % 5 = 0""")
def s_made_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports by a tail, beside, relative, aliased, past the root and by a name that several modules have.

    A neighbour is bound by a bare name or by one dot alone, as the twin says: not by a longer name whose last part it has.
    """
    return scan.edges(scan.resolved(scan.nodes(scan.records(importing_files(spark, sf_dir))), strict_tail=True))


@query(f"WITH {b.GRAPH_SQL}, m AS (SELECT 's' || s_suppkey AS id, 'n' || s_nationkey AS pkg FROM supplier), i AS (SELECT e.src, z.pkg AS module FROM edges e JOIN m z ON z.id = e.dst UNION ALL SELECT id, unnest(['os', 'sys']) FROM m) SELECT m.pkg || '/' || m.id || '.py' AS path, module, count(*) AS lines FROM i JOIN m ON m.id = i.src GROUP BY 1, 2")
def i_made_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The import lines as text, of files that can't be parsed too."""
    return s.lexical_imports(python_files(spark, sf_dir)).groupBy("path", "module").agg(F.count("*").alias("lines"))


@query("SELECT p_partkey, p_name AS name FROM part WHERE trim(p_name) <> ''")
def p_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "part").where(F.trim("p_name") != "").select("p_partkey", s.required(F.col("p_name"), "p_name").alias("name"))
