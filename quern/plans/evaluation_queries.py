"""Queries of the evaluation metrics on the driver's tables, and their DuckDB twins.

Floats that the metric itself doesn't round are shown to 9 digits, so that the order of a sum doesn't show.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.ratios import half_even, ratio
from quern.operators import evaluation as ev
from quern.operators import skyline
from quern.plans import bindings as b
from quern.plans.registry import registry

QUERIES, ORACLE_SQL, query = registry()


def shown(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[half_even(F.col(c), digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each case is expected to make the funnel's calls, and makes those of its events."""
    t = b.trials(spark, sf_dir)
    made = t.select("case_id", F.lit("actual").alias("side"), "name")
    want = t.select("case_id").distinct().select("case_id", F.lit("expected").alias("side"), F.explode(F.array(*map(F.lit, b.FUNNEL))).alias("name"))
    return made.unionByName(want)


PRF = "tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, CASE WHEN tp > 0 THEN 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1"
FUNNEL_LIST = "['view', 'click', 'purchase']"


@query(f"""WITH {b.TRIALS_SQL},
n AS (SELECT case_id, name, sum(e) AS e, sum(a) AS a FROM (
  SELECT case_id, name, 0 AS e, 1 AS a FROM trials UNION ALL
  SELECT case_id, unnest({FUNNEL_LIST}), 1, 0 FROM (SELECT DISTINCT case_id FROM trials)) GROUP BY 1, 2),
t AS (SELECT case_id, sum(least(e, a))::BIGINT AS tp, sum(greatest(a - e, 0))::BIGINT AS fp, sum(greatest(e - a, 0))::BIGINT AS fn FROM n GROUP BY 1),
r AS (SELECT *, {PRF} FROM t)
SELECT case_id, tp, fp, fn, round_even(precision, 9) AS precision, round_even(recall, 9) AS recall, round_even(f1, 9) AS f1 FROM r""")
def m_tool_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.tool_match(tool_calls(spark, sf_dir)))


@query("SELECT event_id, '{\"props\":' || props || ',\"type\":\"' || event_type || '\"}' AS doc, 'props.k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL UNION ALL SELECT event_id, '{\"props\":' || props || ',\"type\":\"' || event_type || '\"}', 'type', '\"' || event_type || '\"' FROM events")
def m_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"props":'), "props", F.lit(',"type":"'), "event_type", F.lit('"}')).alias("doc"))
    return ev.flatten_json(e, "event_id", "doc", depth=3).join(e, "event_id").select("event_id", "doc", "path", "value")


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's first event is expected to look like the last one: type, props and value band."""
    e = b.table(spark, sf_dir, "events")
    by = Window.partitionBy("user_id")
    ends = lambda order, side: e.withColumn("r", F.row_number().over(by.orderBy(*order))).where("r = 1").select(F.col("user_id").alias("case_id"), F.lit(side).alias("side"), F.explode(F.create_map(F.lit("type"), "event_type", F.lit("props.k"), F.get_json_object("props", "$.k"), F.concat(F.lit("extra."), "event_type"), F.floor("value").cast("string"))).alias("path", "value"))
    return ends([F.asc("ts"), F.asc("event_id")], "expected").unionByName(ends([F.desc("ts"), F.desc("event_id")], "actual"))


@query(f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events),
f AS (SELECT user_id AS case_id, side, unnest(['type', 'props.k', 'extra.' || event_type]) AS path, unnest([event_type, json_extract_string(props, '$.k'), floor(value)::BIGINT::VARCHAR]) AS value
  FROM (SELECT *, 'expected' AS side FROM o WHERE a = 1 UNION ALL SELECT *, 'actual' FROM o WHERE z = 1)),
j AS (SELECT coalesce(e.case_id, a.case_id) AS case_id, e.path AS ep, a.path AS ap, e.value AS ev, a.value AS av FROM (SELECT * FROM f WHERE side = 'expected') e FULL JOIN (SELECT * FROM f WHERE side = 'actual') a ON e.case_id = a.case_id AND e.path = a.path),
n AS (SELECT case_id, count(*) FILTER (ep IS NOT NULL AND ap IS NOT NULL AND ev IS NOT DISTINCT FROM av) AS tp, count(*) FILTER (ep IS NOT NULL AND ap IS NOT NULL AND ev IS DISTINCT FROM av) AS wrong_value,
  count(*) FILTER (ap IS NULL) AS omitted_optional, count(*) FILTER (ep IS NULL) AS unexpected_path FROM j GROUP BY 1),
t AS (SELECT *, wrong_value + unexpected_path AS fp, wrong_value + omitted_optional AS fn FROM n), r AS (SELECT *, {PRF} FROM t)
SELECT case_id, tp, wrong_value, omitted_optional, unexpected_path, fp, fn, CASE WHEN fp = 0 AND fn = 0 THEN 1 ELSE 0 END AS json_exact_match,
  round_even(precision, 9) AS precision, round_even(recall, 9) AS recall, round_even(f1, 9) AS f1 FROM r""")
def m_field_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.field_match(fields(spark, sf_dir)))


@query(f"""WITH {b.RANKING_SQL}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, rank) AS i FROM ranking),
d AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2.0::DOUBLE, relevance) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN (pow(2.0::DOUBLE, relevance) - 1) / log2(i + 1) ELSE 0 END) AS idcg FROM i GROUP BY 1)
SELECT query_id, round_even(dcg, 9) AS dcg, round_even(idcg, 9) AS idcg, round_even(dcg / nullif(idcg, 0), 9) AS ndcg, idcg = 0 AS excluded FROM d""")
def m_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.dcg(b.ranking(spark, sf_dir), 10))


@query(f"""WITH {b.RANKING_SQL}, f AS (SELECT query_id, min(CASE WHEN relevance >= 2 THEN rank END) AS rank FROM ranking GROUP BY 1)
SELECT count(*) AS queries, count(rank) AS with_hit, count(*) - count(rank) AS without, round_even(avg(1.0::DOUBLE / rank), 9) AS mrr FROM f""")
def m_mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = b.ranking(spark, sf_dir).groupBy("query_id").agg(F.min(F.when(F.col("relevance") >= 2, F.col("rank"))).alias("rank"))
    return shown(ev.mrr(first))


AP_SQL = f"""WITH {b.RANKING_SQL}, r AS (SELECT *, sum(CASE WHEN relevance >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM ranking),
ap AS (SELECT query_id, avg(CASE WHEN relevance >= 2 AND rank <= 10 THEN seen::DOUBLE / rank END) AS ap FROM r GROUP BY 1) """


@query(AP_SQL + "SELECT query_id, round_even(ap, 9) AS ap FROM ap")
def m_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.average_precision(b.ranking(spark, sf_dir).withColumn("relevant", F.col("relevance") >= 2), 10))


@query(AP_SQL + "SELECT count(*) FILTER (ap IS NULL) AS without, round_even(avg(ap), 9) AS map_at_k FROM ap")
def m_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.mean_average_precision(b.ranking(spark, sf_dir).withColumn("relevant", F.col("relevance") >= 2), 10))


@query("""WITH f AS (SELECT user_id AS case_id, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY min(ts), event_type) AS a FROM events GROUP BY 1, 2),
i AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY item) AS i FROM f),
p AS (SELECT x.case_id, count(*) FILTER (x.i < y.i) AS concordant, count(*) AS pairs FROM i x JOIN i y ON x.case_id = y.case_id AND x.a < y.a GROUP BY 1)
SELECT c.case_id, c.n::INTEGER AS shared, coalesce(concordant, 0)::INTEGER AS concordant, coalesce(pairs, 0) AS pairs, coalesce(pairs - concordant, 0) AS discordant,
  round_even((2 * concordant - pairs) / nullif(pairs, 0)::DOUBLE, 9) AS tau FROM (SELECT case_id, count(*) AS n FROM i GROUP BY 1) c LEFT JOIN p USING (case_id)""")
def m_kendall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which a user first meets the event types, against their order by name."""
    first = b.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("item")).agg(F.min("ts").alias("ts"))
    by = Window.partitionBy("case_id")
    a = first.select("case_id", F.lit("actual").alias("side"), F.row_number().over(by.orderBy("ts", "item")).alias("pos"), "item")
    i = first.select("case_id", F.lit("ideal").alias("side"), F.row_number().over(by.orderBy("item")).alias("pos"), "item")
    return shown(ev.kendall(a.unionByName(i)))


@query(f"""WITH RECURSIVE {b.TRIALS_SQL}, c AS (SELECT case_id, list(name ORDER BY pos) AS a FROM trials GROUP BY 1),
s AS (SELECT case_id, a, 0 AS k, 0 AS x0, 0 AS x1, 0 AS x2, 0 AS x3 FROM c UNION ALL
  SELECT case_id, a, k + 1, 0, n1, n2, CASE WHEN a[k + 1] = 'purchase' THEN x2 + 1 ELSE greatest(x3, n2) END FROM (
    SELECT *, CASE WHEN a[k + 1] = 'click' THEN x1 + 1 ELSE greatest(x2, n1) END AS n2 FROM (
      SELECT *, CASE WHEN a[k + 1] = 'view' THEN x0 + 1 ELSE greatest(x1, 0) END AS n1 FROM s WHERE k < len(a))))
SELECT case_id, x3::INTEGER AS lcs, 3 AS len_expected, len(a)::INTEGER AS len_actual, round_even(x3 / 3.0::DOUBLE, 9) AS over_expected, round_even(x3 / greatest(3, len(a))::DOUBLE, 9) AS over_longer FROM s WHERE k = len(a)""")
def m_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = b.trials(spark, sf_dir).groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("actual"))
    return shown(ev.trajectory(t.withColumn("expected", F.array(*map(F.lit, b.FUNNEL)))))


RELIABLE = f"WITH {b.TRIALS_SQL}, c AS (SELECT case_id, count(*) AS k, avg(success::INT)::DOUBLE AS rate, min(success::INT)::INTEGER AS strict FROM trials GROUP BY 1) "


@query(RELIABLE + "SELECT case_id, k, round_even(rate, 9) AS rate, strict FROM c")
def m_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.reliability(b.trials(spark, sf_dir)))


@query(RELIABLE + "SELECT array_to_string(list_sort(list(DISTINCT k)), ',') AS k, round_even(avg(rate), 9) AS mean_rate, round_even(avg(strict), 9) AS strict_rate FROM c")
def m_reliability_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.reliability_summary(b.trials(spark, sf_dir)).withColumn("k", F.array_join(F.transform("k", lambda x: x.cast("string")), ",")))


BINS = f"WITH {b.PAIRS_SQL}, n AS (SELECT least(9, floor(p * 10)::INTEGER) AS bin, count(*) AS n, avg(p) AS confidence, avg(outcome) AS accuracy, sum(pow(p - outcome, 2)) AS squares FROM pairs GROUP BY 1) "


@query(BINS + "SELECT bin, n, round_even(confidence, 9) AS confidence, round_even(accuracy, 9) AS accuracy, round_even(squares, 6) AS squares FROM n")
def m_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.calibration_bins(b.calibration_pairs(spark, sf_dir))).withColumn("squares", half_even(F.col("squares"), 6))


@query(BINS + "SELECT sum(n)::BIGINT AS n, round_even(sum(squares) / sum(n), 9) AS brier, round_even(sum(n * abs(confidence - accuracy)) / sum(n), 9) AS ece FROM n")
def m_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.calibration(b.calibration_pairs(spark, sf_dir)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.trials(spark, sf_dir).groupBy("scenario", "case_id").agg(F.avg(F.col("success").cast("int")).alias("score"))


SCORES = f"WITH {b.TRIALS_SQL}, s AS (SELECT scenario, case_id, avg(success::INT) AS score FROM trials GROUP BY 1, 2) "


@query(SCORES + "SELECT scenario, count(*) AS n, round_even(avg(score), 9) AS mean FROM s GROUP BY 1")
def m_scenario_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.scenario_means(scores(spark, sf_dir)))


@query(SCORES + ", m AS (SELECT scenario, count(*) AS n, sum(score) AS s, avg(score) AS mean FROM s GROUP BY 1) SELECT round_even(avg(mean), 9) AS macro, round_even(sum(s) / sum(n), 9) AS micro, round_even(min(mean), 9) AS worst_mean, min_by(scenario, (mean, scenario)) AS worst_scenario FROM m")
def m_macro_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.macro_micro(scores(spark, sf_dir)))


@query(SCORES + ", r AS (SELECT score, row_number() OVER (ORDER BY score) AS r, count(*) OVER () AS n FROM s), t AS (SELECT *, greatest(1, ceil(n * 0.1::DOUBLE)) AS used FROM r) SELECT max(used)::BIGINT AS used, round_even(avg(score) FILTER (r <= used), 9) AS cvar FROM t")
def m_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.lower_tail_mean(scores(spark, sf_dir), 0.1))


@query(f"WITH {b.TRIALS_SQL}, n AS (SELECT count(*) FILTER (success) AS s, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM trials), w AS (SELECT *, s / n::DOUBLE AS p, 1 + z * z / n AS d FROM n) SELECT s AS successes, n AS trials, round_even(p, 9) AS point, round_even((p + z * z / (2 * n)) / d - z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / d, 9) AS low, round_even((p + z * z / (2 * n)) / d + z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / d, 9) AS high FROM w")
def m_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.interval(b.trials(spark, sf_dir)))


# -- our readings of measures that are stated as formulas alone


@query(f"WITH {b.TRIALS_SQL} SELECT case_id, count(*) FILTER (success) AS successful, count(*) AS attempted, round_even(count(*) FILTER (success) / count(*)::DOUBLE, 9) AS rate FROM trials GROUP BY 1")
def e_execution_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.execution_success(b.trials(spark, sf_dir).withColumn("ok", F.col("success"))))


@query(f"WITH {b.TRIALS_SQL}, g AS (SELECT case_id, name = lag(name) OVER w AND props IS NOT DISTINCT FROM lag(props) OVER w AS again FROM trials WINDOW w AS (PARTITION BY case_id ORDER BY pos)) SELECT case_id, count(*) FILTER (again) AS redundant, count(*) AS calls, round_even(count(*) FILTER (again) / count(*)::DOUBLE, 9) AS rate FROM g GROUP BY 1")
def e_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.redundancy(b.trials(spark, sf_dir).withColumn("args", F.col("props"))))


@query(f"WITH {b.TRIALS_SQL}, f AS (SELECT case_id, min(pos) AS fault FROM trials WHERE NOT success GROUP BY 1) SELECT f.case_id, fault::INTEGER AS fault, (SELECT min(pos) FROM trials t WHERE t.case_id = f.case_id AND t.success AND t.pos > fault)::INTEGER - fault::INTEGER AS steps FROM f")
def e_recovery_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.recovery_steps(b.trials(spark, sf_dir).withColumn("ok", F.col("success")))


@query("SELECT event_type AS slice, round_even(sum(value), 4) AS cost, count(*) FILTER (value >= 50) AS successes, round_even(sum(value) / nullif(count(*) FILTER (value >= 50), 0), 6) AS per_success FROM events GROUP BY 1")
def e_cost_per_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("slice"), (F.col("value") >= 50).alias("ok"), F.col("value").alias("cost"))
    return ev.cost_per_success(runs).select("slice", half_even(F.col("cost"), 4).alias("cost"), "successes", half_even(F.col("per_success"), 6).alias("per_success"))


@query("SELECT o_orderkey AS case_id, count(*) - 1 AS retries, round_even(1.0::DOUBLE / count(*), 9) AS efficiency FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def e_retry_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderkey").alias("case_id")).agg((F.count("*") - 1).alias("retries"))
    return shown(ev.retry_efficiency(n))


@query("SELECT event_type AS slice, count(*) AS n, round_even(quantile_cont(value, 0.95), 9) AS p95 FROM events WHERE user_id % 7 <> 0 GROUP BY 1")
def e_p95_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A call is a success unless its user's number is a multiple of seven: the failures stay out of the percentile."""
    runs = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("slice"), (F.col("user_id") % 7 != 0).alias("ok"), F.col("value").alias("latency"))
    return shown(ev.p95_of_successes(runs))


OFFERS = """offers AS (SELECT l_partkey AS id, sum(l_quantity) AS quality, round_even(avg(l_extendedprice), 2) AS cost, CASE WHEN l_partkey % 50 <> 0 THEN sum(date_diff('day', o_orderdate, l_shipdate)) / count(*)::DOUBLE END AS latency
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


@query(f"""WITH {OFFERS}, p AS (SELECT DISTINCT quality, cost, latency FROM offers WHERE quality IS NOT NULL AND cost IS NOT NULL AND latency IS NOT NULL),
front AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.quality >= p.quality AND q.cost <= p.cost AND q.latency <= p.latency AND (q.quality > p.quality OR q.cost < p.cost OR q.latency < p.latency)))
SELECT id, quality, cost, latency FROM offers JOIN front USING (quality, cost, latency)""")
def e_pareto_front_of_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by quantity, mean price and mean days to shipping; every fiftieth has no latency and so can't be compared."""
    lines = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    days = F.sum(F.datediff("l_shipdate", "o_orderdate")) / F.count("*")
    by = lines.groupBy(F.col("l_partkey").alias("id")).agg(F.sum("l_quantity").alias("quality"), half_even(F.avg("l_extendedprice"), 2).alias("cost"), days.alias("latency"))
    return skyline.pareto_front(by.withColumn("latency", F.when(F.col("id") % 50 != 0, F.col("latency"))))


@query("WITH p AS (SELECT s_suppkey AS id, sum(l_quantity) AS quality, round_even(avg(l_extendedprice), 2) AS cost FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1) SELECT cost, quality, id FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.quality >= p.quality AND q.cost <= p.cost AND (q.quality > p.quality OR q.cost < p.cost))")
def e_pareto_front(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = b.table(spark, sf_dir, "lineitem").join(b.table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("id")).agg(F.sum("l_quantity").alias("quality"), half_even(F.avg("l_extendedprice"), 2).alias("cost"))
    return ev.pareto_front(points)


@query("WITH n AS (SELECT count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b FROM labels) SELECT only_a, only_b, round_even(pow(only_a - only_b, 2) / nullif(only_a + only_b, 0), 9) AS chi_square FROM n")
def e_mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.mcnemar(b.table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 1).alias("b"))))


@query("WITH n AS (SELECT count(*) AS total, avg((quality = toxic)::INT) AS observed, avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS expected FROM labels) SELECT total, round_even(observed, 9) AS observed, round_even(expected, 9) AS expected, round_even((observed - expected) / nullif(1 - expected, 0), 9) AS kappa FROM n")
def e_cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.cohen_kappa(b.table(spark, sf_dir, "labels").select(F.col("quality").alias("a"), F.col("toxic").alias("b"))))


@query("SELECT doc_id, CASE WHEN toxic = 1 THEN 'is_toxic' WHEN n_chars < 100 THEN 'too_short' END AS tripped, NOT (toxic = 1 OR n_chars < 100) AS passed, CASE WHEN NOT (toxic = 1 OR n_chars < 100) THEN quality END AS score FROM labels JOIN documents USING (doc_id)")
def e_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "labels").join(b.table(spark, sf_dir, "documents"), "doc_id").select("doc_id", (F.col("toxic") == 1).alias("is_toxic"), (F.col("n_chars") < 100).alias("too_short"), F.col("quality").alias("score"))
    return ev.gated(rows, ["is_toxic", "too_short"], "score").select("doc_id", "tripped", "passed", "score")


@query("SELECT doc_id, round_even((0.5::DOUBLE * coalesce(quality, 0) + 0.3::DOUBLE * coalesce(1 - toxic, 0) + 0.2::DOUBLE * least(n_chars / 1000.0::DOUBLE, 1.0)) / (CASE WHEN quality IS NULL THEN 0 ELSE 0.5::DOUBLE END + CASE WHEN toxic IS NULL THEN 0 ELSE 0.3::DOUBLE END + 0.2::DOUBLE), 9) AS composite FROM documents LEFT JOIN labels USING (doc_id)")
def e_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "quality", (1 - F.col("toxic")).alias("clean"), F.least(F.col("n_chars") / F.lit(1000.0), F.lit(1.0)).alias("long"))
    return shown(ev.composite(rows, {"quality": 0.5, "clean": 0.3, "long": 0.2}).select("doc_id", "composite"))


@query(f"WITH {b.TRIALS_SQL} SELECT case_id, arg_min(name, (pos, name)) AS class, min(pos)::INTEGER AS pos FROM trials WHERE NOT success OR value < 5 GROUP BY 1")
def e_failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.failure_class(b.trials(spark, sf_dir).where(~F.col("success") | (F.col("value") < 5)).withColumn("class", F.col("name")))


@query("SELECT p_partkey AS case_id, levenshtein(p_name, p_type)::INTEGER AS distance, round_even(1 - levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type))::DOUBLE, 9) AS similarity FROM part")
def e_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.edit_similarity(b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("expected"), F.col("p_type").alias("actual"))))


@query("""WITH c AS (SELECT user_id AS case_id, coalesce(string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) FILTER (day(ts) < 16), '') AS e, coalesce(string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) FILTER (day(ts) >= 16), '') AS a FROM events GROUP BY 1)
SELECT case_id, levenshtein(e, a)::INTEGER AS distance, CASE WHEN e = '' AND a = '' THEN 1.0 ELSE round_even(1 - levenshtein(e, a) / greatest(length(e), length(a))::DOUBLE, 9) END AS over_longer, round_even(1 - levenshtein(e, a) / nullif(length(e), 0)::DOUBLE, 9) AS over_expected FROM c""")
def e_token_edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types of the month's first half against those of the second; the twin writes each as its first letter."""
    early = F.day("ts") < 16
    rows = b.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"))
    parts = {k: F.array_sort(F.collect_list(F.when(half, F.struct("ts", "event_id", "event_type")))) for k, half in (("expected", early), ("actual", ~early))}
    return shown(ev.token_edit_similarity(rows.agg(*[F.transform(c, lambda x: x["event_type"]).alias(k) for k, c in parts.items()])))


@query("""WITH c AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, quality AS score FROM labels), n AS (SELECT count(*) AS n FROM c),
d AS (SELECT c.i AS draw, r.replica, n FROM c, n, (SELECT unnest(range(20)) AS replica) r),
p AS (SELECT replica, ('0x' || substr(md5('1:' || replica || ':' || draw), 1, 8))::BIGINT % n AS i FROM d)
SELECT replica::INTEGER AS replica, round_even(avg(score), 9) AS mean FROM p JOIN c USING (i) GROUP BY 1""")
def e_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = b.table(spark, sf_dir, "labels").select((F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("i"), F.col("quality").alias("score"))
    return shown(ev.bootstrap_means(cases, 20))


@query("WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id::VARCHAR), doc_id) AS r FROM documents) SELECT doc_id, lang FROM r WHERE r <= 25")
def e_stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.stratified_sample(b.table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 25)


@query("SELECT event_type AS slice, count(*) FILTER (value < 10) AS violations, count(*) AS attempts, round_even(1 - count(*) FILTER (value < 10) / count(*)::DOUBLE, 9) AS compliance FROM events GROUP BY 1")
def e_safety_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.count_if(F.col("value") < 10)
    return shown(b.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("slice")).agg(bad.alias("violations"), F.count("*").alias("attempts"), (1 - ratio(bad, F.count("*"))).alias("compliance")))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), i AS (SELECT user_id, sum(n) AS m, sum(n * (n - 1)) AS g FROM c GROUP BY 1 HAVING sum(n) > 1), l AS (SELECT event_type, sum(n) AS n FROM c WHERE user_id IN (SELECT user_id FROM i) GROUP BY 1), e AS (SELECT sum(n * n)::DOUBLE / (sum(n) * sum(n)) AS expected FROM l), o AS (SELECT count(*) AS items, avg(g::DOUBLE / (m * (m - 1))) AS observed FROM i) SELECT items, round_even(observed, 9) AS observed, round_even(expected, 9) AS expected, round_even((observed - expected) / nullif(1 - expected, 0), 9) AS kappa FROM o, e")
def e_fleiss_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are rated by the types of their events."""
    return shown(ev.fleiss_kappa(b.table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("label"))))


@query("WITH m AS (SELECT event_type AS metric, avg(value) AS value FROM events GROUP BY 1), t(metric, target, at_most) AS (VALUES ('view', 40.0::DOUBLE, false), ('click', 60.0::DOUBLE, true), ('error', NULL, true), ('unseen', 1.0::DOUBLE, false)) SELECT metric, round_even(value, 9) AS value, target, CASE WHEN at_most THEN value <= target ELSE value >= target END AS met FROM t LEFT JOIN m USING (metric)")
def e_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values of event types against targets; one has no number, one is never measured."""
    targets = spark.createDataFrame([("view", 40.0, False), ("click", 60.0, True), ("error", None, True), ("unseen", 1.0, False)], "metric string, target double, at_most boolean")
    measured = b.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"))
    return shown(ev.against_targets(measured, targets))


@query("WITH c AS (SELECT user_id AS case_id, value > 30 AS supported, event_type <> 'error' AS cited, event_type = 'view' AS worthy FROM events) SELECT case_id, round_even(count_if(supported) / nullif(count(*), 0)::DOUBLE, 9) AS faithfulness, round_even(count_if(supported AND cited) / nullif(count_if(cited), 0)::DOUBLE, 9) AS citation_precision, round_even(count_if(supported AND cited AND worthy) / nullif(count_if(worthy), 0)::DOUBLE, 9) AS citation_recall FROM c GROUP BY 1")
def e_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stand for a user's claims."""
    kind = F.col("event_type")
    claims = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), (F.col("value") > 30).alias("supported"), (kind != "error").alias("cited"), (kind == "view").alias("worthy"))
    return shown(ev.grounding(claims))


@query("SELECT o_custkey AS case_id, count(*) FILTER (o_orderstatus = 'F') AS satisfied, count(*) FILTER (o_orderstatus <> 'P') AS applicable, round_even(count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0)::DOUBLE, 9) AS rate FROM orders GROUP BY 1")
def e_goal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders are to be filled; pending ones don't apply yet."""
    status = F.col("o_orderstatus")
    return shown(ev.goal_match(b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("case_id"), F.when(status != "P", status == "F").alias("satisfied"))))


@query("SELECT l_suppkey AS case_id, count(*) FILTER (l_returnflag = 'R' AND l_discount <= 0.05) AS unexpected, count(*) AS opportunities, round_even(count(*) FILTER (l_returnflag = 'R' AND l_discount <= 0.05) / count(*)::DOUBLE, 9) AS rate FROM lineitem GROUP BY 1")
def e_side_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns are mutations, expected of goods with a discount."""
    return shown(ev.side_effect_rate(b.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("case_id"), (F.col("l_returnflag") == "R").alias("mutated"), (F.col("l_discount") > 0.05).alias("expected"))))


@query("WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS needed, count(*) FILTER (event_type = 'error') AS made FROM events GROUP BY 1) SELECT user_id % 10 AS slice, count(*) FILTER (needed = 0) AS without_need, count(*) FILTER (needed = 0 AND made = 0) AS abstained, round_even(count(*) FILTER (needed = 0 AND made = 0) / nullif(count(*) FILTER (needed = 0), 0)::DOUBLE, 9) AS accuracy FROM c GROUP BY 1")
def e_no_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    cases = b.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("needed"), F.count_if(kind == "error").alias("made"))
    return shown(ev.no_call_accuracy(cases.withColumn("slice", F.col("user_id") % 10)))


@query("WITH m AS (SELECT user_id AS case_id, event_type, bool_or(value > 50) AS reached FROM events GROUP BY 1, 2) SELECT case_id, count(*) FILTER (reached) AS reached, count(*) AS milestones, round_even(count(*) FILTER (reached) / count(*)::DOUBLE, 9) AS completion FROM m GROUP BY 1")
def e_milestones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.milestones(b.table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("milestone"), (F.col("value") > 50).alias("reached"))))


@query(f"WITH {b.RANKING_SQL} SELECT query_id, count(*) FILTER (rank <= 10 AND relevance > 0) AS hits, round_even(count(*) FILTER (rank <= 10 AND relevance > 0) / nullif(count(*) FILTER (rank <= 10), 0)::DOUBLE, 9) AS precision, round_even(count(*) FILTER (rank <= 10 AND relevance > 0) / nullif(count(*) FILTER (relevance > 0), 0)::DOUBLE, 9) AS recall FROM ranking GROUP BY 1")
def e_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten of a ranking are retrieved."""
    return shown(ev.context_match(b.ranking(spark, sf_dir).select("query_id", (F.col("rank") <= 10).alias("retrieved"), (F.col("relevance") > 0).alias("relevant"))))


@query("WITH c AS (SELECT event_type AS slice, value >= 10 AS followed, user_id % 3 = 0 AS attack, value >= 20 AS preserved, value < 5 AS achieved, 'P' || event_id % 4 AS severity FROM events) SELECT slice, round_even(count(*) FILTER (followed) / nullif(count(followed), 0)::DOUBLE, 9) AS compliance, count(*) FILTER (attack) AS attacks, round_even(count(*) FILTER (attack AND preserved) / nullif(count(*) FILTER (attack), 0)::DOUBLE, 9) AS resilience, round_even(count(*) FILTER (attack AND achieved) / nullif(count(*) FILTER (attack), 0)::DOUBLE, 9) AS attack_success, count(*) FILTER (NOT followed AND severity IN ('P0', 'P1')) AS critical FROM c GROUP BY 1")
def e_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    cases = b.table(spark, sf_dir, "events").select(F.col("event_type").alias("slice"), (v >= 10).alias("followed"), (F.col("user_id") % 3 == 0).alias("attack"), (v >= 20).alias("preserved"), (v < 5).alias("achieved"), F.concat(F.lit("P"), (F.col("event_id") % 4).cast("string")).alias("severity"))
    return shown(ev.safety(cases))


@query(f"WITH m AS ({ORACLE_SQL['e_bootstrap'].replace('range(20)', 'range(200)').replace('round_even(avg(score), 9)', 'avg(score)')}) SELECT count(*) AS replicas, round_even(quantile_cont(mean, 0.025), 9) AS low, round_even(quantile_cont(mean, 0.975), 9) AS high FROM m")
def e_bootstrap_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = b.table(spark, sf_dir, "labels").select((F.row_number().over(Window.orderBy("doc_id")) - 1).cast("long").alias("i"), F.col("quality").alias("score"))
    return shown(ev.bootstrap_interval(ev.bootstrap_means(cases, 200)))


@query("""WITH d AS (SELECT doc_id, quality - toxic AS d FROM labels), t AS (SELECT count(*) AS cases, sum(d) AS total FROM d),
s AS (SELECT replica, sum(CASE WHEN substr(md5('1:' || replica || ':' || doc_id), 1, 1) < '8' THEN d ELSE -d END) AS flipped FROM d, (SELECT unnest(range(100)) AS replica) GROUP BY 1)
SELECT cases, round_even(total / cases::DOUBLE, 9) AS difference, round_even((1 + (SELECT count(*) FROM s WHERE abs(flipped) >= abs(total))) / 101.0::DOUBLE, 9) AS p FROM t""")
def e_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(ev.paired_permutation(b.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("case_id"), F.col("quality").alias("a"), F.col("toxic").alias("b")), 100))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), i AS (SELECT user_id, sum(n) AS m, sum(n * n) AS q FROM c GROUP BY 1 HAVING sum(n) > 1), l AS (SELECT event_type, sum(n) AS n FROM c WHERE user_id IN (SELECT user_id FROM i) GROUP BY 1), o AS (SELECT count(*) AS items, sum(m)::BIGINT AS ratings, sum((m * m - q)::DOUBLE / (m - 1)) AS apart FROM i) SELECT items, ratings, round_even(1 - (ratings - 1) * apart / nullif(ratings * ratings - (SELECT sum(n * n) FROM l), 0)::DOUBLE, 9) AS alpha FROM o")
def e_krippendorff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users are rated by the types of their events."""
    return shown(ev.krippendorff_alpha(b.table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("label"))))


@query("""SELECT event_id, 'at' AS path, 'time' AS kind, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS value FROM events
UNION ALL SELECT event_id, 'type', 'alias', CASE event_type WHEN 'view' THEN 'see' WHEN 'click' THEN 'press' ELSE event_type END FROM events
UNION ALL SELECT event_id, 'tags', 'set', '["' || least(event_type, 'm') || CASE WHEN event_type <> 'm' THEN '","' || greatest(event_type, 'm') ELSE '' END || '"]' FROM events
UNION ALL SELECT event_id, 'user', 'id', CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id) THEN 'known' ELSE 'unknown' END FROM events
UNION ALL SELECT event_id, 'note', 'text', props FROM events""")
def e_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's time two hours ahead of UTC, its type by the aliases, its tags with a repeat, and its user."""
    e = b.table(spark, sf_dir, "events")
    part = lambda path, kind, value: F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind"), value.cast("string").alias("value"))
    kind, utc = F.col("event_type"), F.to_utc_timestamp(F.col("ts").cast("timestamp"), F.current_timezone())
    at = F.concat(F.date_format(utc + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00"))
    tags = F.to_json(F.array(kind, F.lit("m"), kind))
    fields = e.select("event_id", F.inline(F.array(part("at", "time", at), part("type", "alias", kind), part("tags", "set", tags), part("user", "id", F.col("user_id")), part("note", "text", F.col("props")))))
    aliases = spark.createDataFrame([("type", "view", "see"), ("type", "click", "press")], "path string, alias string, meant string")
    known = b.table(spark, sf_dir, "customer").select(F.lit("user").alias("path"), F.col("c_custkey").cast("string").alias("value"))
    return ev.canonical_fields(fields, aliases, known).select("event_id", "path", "kind", "value")
