"""Queries of limits, lint, inventories, sets and history on the driver's tables, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.ratios import half_even
from quern.operators import structure as s
from quern.plans import bindings as b
from quern.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


LINES = "(len(text) - len(replace(text, chr(10), '')) + CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END)"


@query(f"WITH {b.FILES_SQL} SELECT path, {LINES}::INTEGER AS lines, (len(text) - len(replace(text, chr(10), '')) + 1)::INTEGER AS lint_lines FROM files")
def c_line_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.files(spark, sf_dir).select("path", s.line_count(F.col("text")).alias("lines"), s.lint_line_count(F.col("text")).alias("lint_lines"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by their lines, ten times over so that some pass the limits; and folders by their files."""
    f = b.files(spark, sf_dir)
    lines = f.select("path", (10 * s.line_count(F.col("text"))).alias("value"))
    folders = s.folder_files(f).select(F.col("folder").alias("path"), "value")
    return s.violations(lines, "file_lines").unionByName(s.violations(folders, "folder_files"))


FOUND = f"""{b.FILES_SQL},
measured AS (SELECT path, 'file_lines' AS metric, 10 * {LINES} AS value, 200 AS warn, 250 AS hard FROM files UNION ALL SELECT folder, 'folder_files', count(DISTINCT path), 5, 7 FROM files GROUP BY 1),
found AS (SELECT path, metric, value::BIGINT AS value, CASE WHEN value > hard THEN 'major' ELSE 'minor' END AS severity, CASE WHEN value > hard THEN hard ELSE warn END AS cap FROM measured WHERE value > warn),
exemptions AS (SELECT path, 'file_lines' AS metric, CASE WHEN ends_with(path, '7.py') THEN 'generated' END AS reason FROM files WHERE regexp_matches(path, '[37][.]py$')),
judged AS (SELECT path, metric, CASE WHEN EXISTS (SELECT 1 FROM exemptions x WHERE x.path = f.path AND x.metric = f.metric AND x.reason IS NOT NULL) THEN 'exempt' ELSE severity END AS severity, value, cap FROM found f
  UNION ALL SELECT path, 'exempt_without_reason', 'major', 1, 0 FROM exemptions WHERE reason IS NULL)"""


def exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = b.files(spark, sf_dir).where(F.regexp_like("path", F.lit("[37][.]py$")))
    return f.select("path", F.lit("file_lines").alias("metric"), F.when(F.col("path").endswith("7.py"), "generated").alias("reason"))


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.exempted(found(spark, sf_dir), exemptions(spark, sf_dir))


@query(f"WITH {FOUND} SELECT path, metric, value, severity, cap FROM found")
def c_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("path", "metric", F.col("value").cast("long").alias("value"), "severity", "cap")


@query(f"WITH {FOUND} SELECT path, metric, severity, value, cap FROM judged")
def c_exemptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(spark, sf_dir)


@query("""WITH f AS (SELECT doc_id, doc_id * 37 % 400 + (doc_id % 6 < 2)::INT AS value FROM documents WHERE doc_id % 4 IN (0, 3))
SELECT 'd' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' ELSE '.go' END AS path, 'file_lines' AS metric, CASE WHEN doc_id % 6 = 0 THEN 'exempt' WHEN value > 250 THEN 'major' ELSE 'minor' END AS severity, value, CASE WHEN doc_id % 6 = 0 OR value > 250 THEN 250 ELSE 200 END AS cap FROM f WHERE value > 200""")
def c_file_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's number says its ending and lines; some tops exempt, and some do without a reason."""
    k = F.col("doc_id")
    top = F.when(k % 6 == 0, f"{s.MARK} params, file_lines {s.REASON} a table\n").when(k % 6 == 1, f"{s.MARK} file_lines {s.REASON}\n").otherwise("")
    path = F.concat(F.lit("d"), k.cast("string"), b.chosen([".py", ".md", ".min.js", ".go"], k % 4))
    files = b.table(spark, sf_dir, "documents").select(path.alias("path"), F.concat(top, F.repeat(F.lit("x\n"), (k * 37 % 400).cast("int"))).alias("text"))
    return s.file_lengths(files).withColumn("value", F.col("value").cast("long"))


@query(f"WITH {b.FILES_SQL} SELECT folder, count(DISTINCT path) AS value FROM files GROUP BY 1")
def c_folder_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.folder_files(b.files(spark, sf_dir))


@query(f"WITH {FOUND} SELECT metric, severity, count(*) AS n, max(value) AS worst FROM judged GROUP BY 1, 2")
def c_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.roll_up(judged(spark, sf_dir))


@query(f"WITH {FOUND} SELECT path, metric, severity, value, cap FROM judged ORDER BY value DESC, path, metric LIMIT 20")
def c_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.worst(judged(spark, sf_dir))


@query(f"WITH {b.FILES_SQL} SELECT folder, count(*) AS files, count(*) FILTER ({LINES} = 0) AS empty, sum({LINES})::BIGINT AS lines FROM files GROUP BY 1")
def c_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = s.line_count(F.col("text"))
    return b.files(spark, sf_dir).groupBy("folder").agg(F.count("*").alias("files"), F.count_if(n == 0).alias("empty"), F.sum(n).alias("lines"))


@query("WITH m AS (SELECT lang AS key, count(*) AS value FROM documents GROUP BY 1), g AS (SELECT DISTINCT lang AS key, 250 AS budget FROM documents WHERE lang <> 'es') SELECT key, value, budget, value <= budget AS passes, least(value, coalesce(budget, value)) AS next_budget FROM m LEFT JOIN g USING (key)")
def c_ratchet(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents")
    return s.ratchet(d.groupBy(F.col("lang").alias("key")).agg(F.count("*").alias("value")), d.where("lang <> 'es'").select(F.col("lang").alias("key"), F.lit(250).alias("value")).distinct())


@query("WITH v AS (SELECT p_partkey, lower(p_name) AS name FROM part) SELECT p_partkey, name, regexp_extract(name, '^[^ ]*') AS stem FROM v WHERE regexp_matches(name, '(^| )(red|blue|misc|helper|data)( |$)')")
def l_vague_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    rows = b.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), F.regexp_extract(name, "^[^ ]*", 0).alias("stem"))
    return rows.where(F.arrays_overlap(F.split("name", " "), F.array(*map(F.lit, ["red", "blue", "misc", "helper", "data"]))))


@query(f"WITH {b.FILES_SQL} SELECT path, (len(text) - len(replace(text, chr(10), '')) + 1)::INTEGER AS lines, 'file-too-long' AS rule, 'warning' AS severity FROM files WHERE len(text) - len(replace(text, chr(10), '')) + 1 > 25")
def l_file_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a limit of 25 lines, which the texts reach."""
    n = s.lint_line_count(F.col("text"))
    return b.files(spark, sf_dir).select("path", n.alias("lines"), F.lit("file-too-long").alias("rule"), F.lit("warning").alias("severity")).where("lines > 25")


@query("WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) SELECT target AS module, count(*) AS occurrences, count(DISTINCT page_id) AS files FROM a GROUP BY 1")
def i_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of pages as imports."""
    links = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("module"))
    return s.inventory(links)


@query("WITH a AS (SELECT page_id, replace(substr(target, 2), '/', '.') AS module FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"(/[^\"]*)\"', 1)) AS target FROM pages)) SELECT page_id AS path, module, CASE WHEN module = 'The' OR starts_with(module, 'The.') THEN 'The' ELSE 'that' END AS prefix FROM a WHERE module IN ('The', 'that') OR starts_with(module, 'The.') OR starts_with(module, 'that.')")
def i_prefix_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = b.table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), 1)).alias("target"))
    return s.prefix_violations(links.select("path", F.replace(F.substring("target", 2, 100000), F.lit("/"), F.lit(".")).alias("module")), ["The", "that"])


def sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A supplier's parts that went out before 1995-06-17 as the live set, and from then on as the generated one; the return flag is the effect."""
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc"), F.when(F.col("l_returnflag") == "R", "Deny").otherwise("Allow").alias("effect"), F.col("l_partkey").alias("action"), (F.col("l_shipdate") < F.lit("1995-06-17").cast("timestamp")).alias("early"))
    return rows.where("early"), rows.where("not early")


SETS = "i AS (SELECT l_suppkey AS doc, CASE WHEN l_returnflag = 'R' THEN 'Deny' ELSE 'Allow' END AS effect, l_partkey AS action, l_shipdate < TIMESTAMP '1995-06-17' AS early FROM lineitem), live AS (SELECT DISTINCT doc, effect, action FROM i WHERE early), made AS (SELECT DISTINCT doc, effect, action FROM i WHERE NOT early)"


@query(f"WITH {SETS} SELECT doc, 'added' AS change, action FROM (SELECT doc, action FROM made EXCEPT SELECT doc, action FROM live) UNION ALL SELECT doc, 'removed', action FROM (SELECT doc, action FROM live EXCEPT SELECT doc, action FROM made)")
def p_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.diff_sets(*sets(spark, sf_dir), "doc", "action")


@query(f"WITH {SETS} SELECT coalesce(m.doc, l.doc) AS doc, coalesce(m.effect, l.effect) AS effect, coalesce(m.action, l.action) AS action, CASE WHEN l.doc IS NULL THEN 'generated' WHEN m.doc IS NULL THEN 'preserved' ELSE 'both' END AS origin FROM made m FULL JOIN live l ON m.doc = l.doc AND m.effect = l.effect AND m.action = l.action")
def p_additive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.additive_merge(*sets(spark, sf_dir), ["doc", "effect"], "action")


@query(f"WITH {SETS} SELECT doc, effect, action, 'kept' AS state FROM made UNION ALL SELECT *, 'removed' FROM (SELECT * FROM live EXCEPT SELECT * FROM made)")
def p_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.replaced(*sets(spark, sf_dir), ["doc", "effect"], "action")


@query("WITH v AS (SELECT s_nationkey AS g, l_returnflag || l_linestatus AS name, sum(CASE WHEN l_linenumber = 1 THEN 3 ELSE 2 END)::BIGINT AS score FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2) SELECT g, name, score, row_number() OVER (PARTITION BY g ORDER BY score DESC, name)::INTEGER AS place FROM v")
def p_vote_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    votes = rows.select(F.col("s_nationkey").alias("g"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.when(F.col("l_linenumber") == 1, 3).otherwise(2).alias("w"))
    return s.vote_ranking(votes, "g", "name", "w")


@query("WITH e AS (SELECT user_id, event_id, CASE WHEN value > 90 THEN 1 WHEN value > 50 THEN 2 ELSE 3 END AS layer FROM events) SELECT user_id, event_id, layer FROM e WHERE layer = (SELECT min(layer) FROM e x WHERE x.user_id = e.user_id)")
def p_first_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 90, 1).when(F.col("value") > 50, 2).otherwise(3).alias("layer"))
    return s.first_layer(e, "user_id", "layer").select("user_id", "event_id", "layer")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events")
def p_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").withColumn("seen", F.when(F.col("event_type") == "view", F.col("event_id")))
    return s.carried_forward(e, "user_id", ["ts", "event_id"], "seen").select("event_id", "carried")


@query("SELECT p_partkey, lower(trim(regexp_replace(p_type || ' (' || p_brand || ')', '[^A-Za-z0-9_]+', '-', 'g'), '-')) AS slug FROM part")
def p_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "part").select("p_partkey", s.slug(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'name x of n' || s_nationkey WHEN 1 THEN 'z and z' WHEN 2 THEN '__lower__ __B1_' ELSE '__OTHER__ x' END AS text,
CASE s_suppkey % 4 WHEN 0 THEN '__NAME_PLACE__,__NAME__' WHEN 1 THEN '__A__' WHEN 2 THEN '' ELSE '__NAME__,__OTHER__' END AS tokens FROM supplier""")
def p_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a token inside a longer one, a repeated one, none, and one without a value."""
    text = b.chosen(["name __NAME__ of n__NAME_PLACE__", "__A__ and __A__", "__lower__ __B1_", "__OTHER__ __NAME__"], F.col("s_suppkey") % 4)
    rows = b.table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", text.alias("said"))
    text = s.substituted(F.col("said"), {"__NAME__": "x", "__NAME_PLACE__": "@", "__A__": "z"})
    return rows.select("s_suppkey", F.replace(text, F.lit("@"), F.col("s_nationkey").cast("string")).alias("text"), F.array_join(F.array_sort(s.tokens(F.col("said"))), ",").alias("tokens"))


@query("WITH v AS (SELECT o_orderkey, split_part(o_orderpriority, '-', 1) AS p, o_orderstatus AS s FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'none' WHEN p = s THEN p ELSE p || '|' || s END AS names FROM v")
def p_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repeated name with blanks around it and empty ones between; every fifth list is of blanks alone."""
    first = F.split_part("o_orderpriority", F.lit("-"), F.lit(1))
    text = F.when(F.col("o_orderkey") % 5 == 0, " , ").otherwise(F.concat(F.lit(" "), first, F.lit(",, "), "o_orderstatus", F.lit(" ,"), first))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(s.ordered_distinct(text, ["none"]), "|").alias("names"))


@query("SELECT event_id, CASE WHEN json_extract(props, '$.k') IS NULL THEN 'no k' ELSE '' END AS reason FROM events")
def p_lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").select("event_id", s.lenient_json(F.col("props"), "k")["reason"].alias("reason"))


@query("SELECT l_suppkey AS supplier, strftime(l_shipdate, '%Y-%m') AS month, round_even(sum(l_extendedprice), 2) AS spent, sum(l_extendedprice) >= 100000 AS tripped FROM lineitem GROUP BY 1, 2")
def p_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spend of each supplier and month against a limit of 100,000."""
    by = b.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supplier"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.sum("l_extendedprice").alias("sum"))
    return by.select("supplier", "month", half_even(F.col("sum"), 2).alias("spent"), (F.col("sum") >= 100000).alias("tripped"))


# -- history


@query(f"WITH {b.CHANGES_SQL} SELECT path, count(DISTINCT sha) AS revisions FROM changes GROUP BY 1")
def h_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.revisions(b.changes(spark, sf_dir))


@query(f"WITH {b.CHANGES_SQL} SELECT path, sum(coalesce(added, 0) + coalesce(deleted, 0))::BIGINT AS churn FROM changes WHERE ts >= (SELECT max(ts) FROM changes) - INTERVAL 90 DAY GROUP BY 1")
def h_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the 90 days before the last commit."""
    c = b.changes(spark, sf_dir)
    last = c.agg((F.max("ts") - F.expr("INTERVAL 90 DAYS")).alias("since"))
    return s.churn(c.crossJoin(F.broadcast(last)), F.col("since"))


@query(f"WITH {b.CHANGES_SQL}, c AS (SELECT path, author, count(DISTINCT sha) AS commits FROM changes GROUP BY 1, 2), s AS (SELECT *, commits / (sum(commits) OVER (PARTITION BY path))::DOUBLE AS share FROM c) SELECT path, author, commits, round_even(share, 4) AS share, share < 0.15 AS minor FROM s")
def h_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.ownership(b.changes(spark, sf_dir), 0.15)


CO_CHANGE = f"{b.CHANGES_SQL}, d AS (SELECT DISTINCT sha, path FROM changes), pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS shared FROM d x JOIN d y ON x.sha = y.sha AND x.path < y.path GROUP BY 1, 2)"


@query(f"WITH {CO_CHANGE} SELECT a, b, shared FROM pairs WHERE shared >= 2")
def h_co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.co_change(b.changes(spark, sf_dir), 2)


@query(f"WITH {CO_CHANGE}, r AS (SELECT path, count(*) AS r FROM d GROUP BY 1) SELECT a, b, shared, round_even(200.0::DOUBLE * shared / (x.r + y.r), 4) AS degree FROM pairs JOIN r x ON x.path = a AND x.r >= 5 JOIN r y ON y.path = b AND y.r >= 5 WHERE shared >= 2")
def h_temporal_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.temporal_coupling(b.changes(spark, sf_dir), 5, 2)


@query(f"WITH {b.CHANGES_SQL}, r AS (SELECT path, count(DISTINCT sha) AS revisions, sum(coalesce(added, 0))::BIGINT AS size FROM changes GROUP BY 1) SELECT path, revisions, size, revisions * size AS hotspot FROM r")
def h_hotspot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits times a size proxy: all lines ever added."""
    c = b.changes(spark, sf_dir).groupBy("path").agg(F.count_distinct("sha").alias("revisions"), F.sum(F.coalesce("added", F.lit(0))).alias("size"))
    return c.select("path", "revisions", "size", (F.col("revisions") * F.col("size")).alias("hotspot"))


@query("WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, last_value(CASE WHEN l_linenumber = 1 THEN l_orderkey END IGNORE NULLS) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING) AS sha FROM lineitem) SELECT sha, count(*) AS lines FROM n GROUP BY 1")
def h_numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines belong to the last commit header above them; headers are the first lines of orders.

    The log is cut by order ranges: what carries over is the last header of the ranges before.
    """
    rows = b.table(spark, sf_dir, "lineitem").withColumn("header", F.when(F.col("l_linenumber") == 1, F.col("l_orderkey"))).withColumn("part", F.floor(F.col("l_orderkey") / 4096))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    here = s.carried_forward(rows, "part", order, "header")
    ends = rows.groupBy("part").agg(F.max("header").alias("end"))
    before = ends.select("part", F.last("end", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    return here.join(before, "part").groupBy(F.coalesce("carried", "before").alias("sha")).agg(F.count("*").alias("lines"))


def supplier_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sha, path: an order changes its suppliers' modules, the nodes of the graph binding."""
    return b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("path"))


MODULE_PAIRS = f"{b.GRAPH_SQL}, d AS (SELECT DISTINCT l_orderkey AS sha, 's' || l_suppkey AS path FROM lineitem), pairs AS (SELECT x.path AS a, y.path AS b, count(*) AS shared FROM d x JOIN d y ON x.sha = y.sha AND x.path < y.path GROUP BY 1, 2)"
MET = "one AS (SELECT e.src, e.dst, p.shared FROM edges e LEFT JOIN pairs p ON p.a = least(e.src, e.dst) AND p.b = greatest(e.src, e.dst) AND p.shared >= 3)"


@query(f"WITH {CO_CHANGE}, ends AS (SELECT a AS path, shared FROM pairs UNION ALL SELECT b, shared FROM pairs), t AS (SELECT path, sum(shared) AS total, p_brand FROM ends JOIN part ON path = 'p' || p_partkey GROUP BY 1, 3) SELECT a, b, shared FROM pairs JOIN t x ON x.path = a JOIN t y ON y.path = b WHERE shared >= 1 AND x.p_brand <> y.p_brand AND shared > 0.02::DOUBLE * x.total AND shared > 0.02::DOUBLE * y.total")
def h_implicit_dependency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands are the packages; the limits are low, as parts are bought together at random."""
    package = b.table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_brand").alias("package"))
    return s.implicit_dependencies(s.co_change(b.changes(spark, sf_dir)), package, 1, 0.02)


@query(f"WITH {MODULE_PAIRS} SELECT a, b, shared FROM pairs WHERE shared >= 3 AND NOT EXISTS (SELECT 1 FROM edges WHERE least(src, dst) = a AND greatest(src, dst) = b)")
def h_unlinked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.unlinked_pairs(s.co_change(supplier_changes(spark, sf_dir)), b.module_edges(spark, sf_dir))


@query(f"WITH {MODULE_PAIRS}, {MET}, f AS (SELECT dst AS path, count(*) AS dependents, count(shared) AS overlap FROM one GROUP BY 1) SELECT * FROM f WHERE dependents > 10 AND overlap > 10")
def h_unstable_interface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.unstable_interfaces(s.co_change(supplier_changes(spark, sf_dir)), b.module_edges(spark, sf_dir))


@query(f"WITH {MODULE_PAIRS}, {MET}, i AS (SELECT dst AS path, count(*) AS fan_in, count(shared) AS mi FROM one GROUP BY 1), o AS (SELECT src AS path, count(*) AS fan_out, count(shared) AS mo FROM one GROUP BY 1) SELECT path, fan_in, fan_out FROM i JOIN o USING (path) WHERE fan_in >= 4 AND fan_out >= 4 AND mi > 0 AND mo > 0")
def h_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.crossings(s.co_change(supplier_changes(spark, sf_dir)), b.module_edges(spark, sf_dir))
