"""Queries of the permission documents, and their DuckDB twins: every supplier declares what its number says."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import statements as st
from quern.operators import structure as s
from quern.plans import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
CREATE, OTHER, DENIED = ["iam:CreateRole", "iam:PutRolePolicy"], ["iam:DeleteRole", "iam:GetRole"], ["iam:DeleteRolePermissionsBoundary"]


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def declared_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, path, text: a file a supplier."""
    k = F.col("s_suppkey")
    said = lambda kind, type_, when: F.when(when, f'{kind} "aws_{type_}" "x" {{}}\n').otherwise("")
    text = F.concat(F.repeat(F.lit('resource "aws_s3_bucket" "a" {}\n'), (k % 3).cast("int")), said("resource", "lb_listener", k % 2 == 1), said("data", "kms_key", k % 7 == 0), said("resource", "iam_role", k % 4 == 0), said("resource", "cloudfront_distribution", k % 5 == 0), F.when(k % 6 == 0, 'backend  "s3" {}').otherwise(""))
    return b.table(spark, sf_dir, "supplier").select(k.alias("doc"), F.lit("main.tf").alias("path"), text.alias("text"))


def granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = [("resource", "aws_s3_bucket", ["s3:PutObject", "s3:CreateBucket"], False), ("data", "aws_kms_key", ["kms:DescribeKey"], False), ("resource", "aws_iam_role", [], True), ("resource", "aws_cloudfront_distribution", ["cloudfront:CreateDistribution"], False)]
    return st.granted(st.declarations(declared_files(spark, sf_dir)), spark.createDataFrame(table, "kind string, type string, actions array<string>, creates boolean"))


DECLARED = """d AS (SELECT s_suppkey AS doc, unnest([
  {'kind': 'resource', 'type': 'aws_s3_bucket', 'n': s_suppkey % 3}, {'kind': 'resource', 'type': 'aws_lb_listener', 'n': (s_suppkey % 2 = 1)::INT}, {'kind': 'data', 'type': 'aws_kms_key', 'n': (s_suppkey % 7 = 0)::INT},
  {'kind': 'resource', 'type': 'aws_iam_role', 'n': (s_suppkey % 4 = 0)::INT}, {'kind': 'resource', 'type': 'aws_cloudfront_distribution', 'n': (s_suppkey % 5 = 0)::INT}], recursive := true) FROM supplier)"""
GRANTED = """k AS (SELECT s_suppkey AS doc, s_suppkey AS k FROM supplier WHERE s_suppkey % 3 > 0 OR s_suppkey % 2 = 1 OR s_suppkey % 7 = 0 OR s_suppkey % 4 = 0 OR s_suppkey % 5 = 0),
granted AS (SELECT doc, k, list_concat(CASE WHEN k % 5 = 0 THEN ['cloudfront:CreateDistribution'] ELSE [] END, CASE WHEN k % 2 = 1 THEN ['elasticloadbalancing:*'] ELSE [] END,
  CASE WHEN k % 7 = 0 THEN ['kms:DescribeKey'] ELSE [] END, CASE WHEN k % 3 > 0 THEN ['s3:CreateBucket', 's3:PutObject'] ELSE [] END) AS actions FROM k)"""


@query(f"WITH {DECLARED} SELECT doc, kind, type, n::BIGINT AS n FROM d WHERE n > 0")
def p_declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.declarations(declared_files(spark, sf_dir))


@query(f"WITH {GRANTED} SELECT doc, array_to_string(actions, ' ') AS actions, CASE WHEN k % 2 = 1 THEN 'aws_lb_listener' ELSE '' END AS unknown, k % 4 = 0 AS creates FROM granted")
def p_granted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return granted(spark, sf_dir).select("doc", F.array_join("actions", " ").alias("actions"), F.array_join("unknown", " ").alias("unknown"), "creates")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third supplier gives a boundary, every fourth one no regions."""
    k = F.col("doc")
    rows = granted(spark, sf_dir).join(st.state_backends(declared_files(spark, sf_dir)), "doc")
    return rows.withColumn("regions", F.when(k % 4 == 3, st.strings([])).otherwise(st.strings(["eu-west-1"]))).withColumn("boundary", F.when(k % 3 == 0, F.concat(F.lit("b"), k.cast("string"))))


def flat(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "pos", "sid", "effect", F.array_join("actions", " ").alias("actions"), F.array_join("not_actions", " ").alias("not_actions"), "key", "operator", F.array_join("allowed", " ").alias("allowed"))


FULL = """whole AS (SELECT doc, k, CASE WHEN k % 3 = 0 THEN 'b' || k END AS boundary, list_sort(list_concat(actions, CASE WHEN k % 4 = 0 THEN ['iam:DeleteRole', 'iam:GetRole'] ELSE [] END, CASE WHEN k % 12 IN (4, 8) THEN ['iam:CreateRole', 'iam:PutRolePolicy'] ELSE [] END)) AS a FROM granted),
used AS (SELECT *, list_sort(list_distinct(list_transform(a, lambda x: split_part(x, ':', 1)))) AS sv FROM whole),
read AS (SELECT *, list_sort(flatten(list_transform(sv, lambda x: [x || ':Describe*', x || ':List*', x || ':Get*']))) AS rd, list_filter(sv, lambda x: x IN ('cloudfront', 'iam')) AS gl FROM used),
parts AS (SELECT doc, 1 AS o, 'TerraformManagedResources' AS sid, 'Allow' AS effect, array_to_string(a, ' ') AS actions, NULL AS not_actions, NULL AS key, NULL AS operator, NULL AS allowed FROM read WHERE len(a) > 0
 UNION ALL SELECT doc, 2, 'ReadDescribeLeeway', 'Allow', array_to_string(rd, ' '), NULL, NULL, NULL, NULL FROM read WHERE len(sv) > 0
 UNION ALL SELECT doc, 3, 'IAMCreateOnlyWithBoundary', 'Allow', 'iam:CreateRole iam:PutRolePolicy', NULL, 'iam:PermissionsBoundary', 'StringEquals', boundary FROM read WHERE k % 12 = 0
 UNION ALL SELECT doc, 4, 'TerraformStateBackend', 'Allow', 's3:ListBucket s3:GetObject s3:PutObject s3:DeleteObject dynamodb:GetItem dynamodb:PutItem dynamodb:DeleteItem dynamodb:DescribeTable', NULL, NULL, NULL, NULL FROM read WHERE k % 6 = 0
 UNION ALL SELECT doc, 5, 'DenyOutsideAllowedRegions', 'Deny', CASE WHEN len(gl) = 0 THEN '*' END, CASE WHEN len(gl) > 0 THEN array_to_string(list_transform(gl, lambda x: x || ':*'), ' ') END, 'aws:RequestedRegion', 'StringNotEquals', CASE WHEN k % 5 = 0 THEN 'eu-west-1 us-east-1' ELSE 'eu-west-1' END FROM read WHERE k % 4 <> 3)"""


@query(f"WITH {GRANTED}, {FULL} SELECT doc, (row_number() OVER (PARTITION BY doc ORDER BY o) - 1)::INTEGER AS pos, sid, effect, actions, not_actions, key, operator, allowed FROM parts")
def p_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(st.statements(documents(spark, sf_dir), CREATE, OTHER))


@query(f"""WITH {GRANTED}, c AS (SELECT doc, list_sort(list_concat(['dynamodb:*', 'logs:*', 's3:*'], CASE WHEN k % 5 = 0 THEN ['cloudfront:*'] ELSE [] END, CASE WHEN k % 2 = 1 THEN ['elasticloadbalancing:*'] ELSE [] END, CASE WHEN k % 7 = 0 THEN ['kms:*'] ELSE [] END)) AS sv FROM granted)
SELECT doc, x.pos, x.sid, x.effect, CASE x.pos WHEN 0 THEN array_to_string(sv, ' ') ELSE x.actions END AS actions, NULL AS not_actions, x.key, x.operator, CASE x.pos WHEN 2 THEN 'b' || doc END AS allowed FROM c, (VALUES (0, 'BoundaryAllowedServices', 'Allow', NULL, NULL, NULL),
 (1, 'BoundaryReadEverywhere', 'Allow', 'ec2:Describe* ec2:Get* ec2:List* s3:Describe* s3:Get* s3:List*', NULL, NULL), (2, 'BoundarySelfPropagatingIAM', 'Allow', 'iam:CreateRole iam:PutRolePolicy', 'iam:PermissionsBoundary', 'StringEquals'),
 (3, 'BoundaryReadIAM', 'Allow', 'iam:GetRole', NULL, NULL), (4, 'BoundaryDenyEscalation', 'Deny', 'iam:DeleteRolePermissionsBoundary', NULL, NULL)) x(pos, sid, effect, actions, key, operator)""")
def p_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = st.statements(documents(spark, sf_dir).withColumn("boundary", F.lit(None).cast("string")), CREATE, OTHER).withColumn("boundary", F.concat(F.lit("b"), F.col("doc").cast("string")))
    return flat(st.ceiling(made, CREATE, OTHER, ["s3", "ec2"], DENIED))


@query("""WITH h AS (SELECT o_custkey AS doc, o_orderstatus AS name, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END AS weight, CASE WHEN o_orderkey % 5 IN (0, 3) THEN 'prod' WHEN o_orderkey % 5 = 1 OR o_orderkey % 5 = 4 AND o_orderkey % 3 = 0 THEN 'beta' END AS stage FROM orders),
v AS (SELECT doc, name, sum(weight + CASE WHEN stage = 'prod' THEN 10 ELSE 0 END)::BIGINT AS score FROM h WHERE coalesce(stage, 'prod') = 'prod' GROUP BY 1, 2) SELECT doc, name, score, row_number() OVER (PARTITION BY doc ORDER BY score DESC, name)::INTEGER AS place FROM v""")
def p_stage_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line that names a stage decides; files named qa belong to beta where the line says nothing."""
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, "PROD_REGION=x").when(k % 5 == 1, "staging: x").when(k % 5 == 3, "go Live").otherwise("region = x")
    file = F.when((k % 5 == 4) & (k % 3 == 0), "qa.sh").when(k % 5 == 3, "beta.sh").otherwise("run.sh")
    hits = b.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderstatus").alias("name"), F.when(k % 2 == 0, 3).otherwise(2).alias("weight"), line.alias("line"), file.alias("file"))
    return s.vote_ranking(st.stage_votes(hits, "prod"), "doc", "name", "weight")


@query("""WITH c AS (SELECT c_custkey AS k, lpad(c_custkey::VARCHAR, 12, '0') AS acct FROM customer) SELECT k, 'arn:aws:iam::' || acct || ':user/ci' || CASE k % 3 WHEN 0 THEN ' arn:aws:iam::' || acct || ':role/r' || k WHEN 1 THEN ' arn:aws:iam::' || acct || ':role/aws-reserved/sso.amazonaws.com/AWSReservedSSO_x' ELSE '' END
|| CASE WHEN k % 2 = 0 THEN ' arn:aws:iam::' || acct || ':root' ELSE '' END AS principals FROM c""")
def p_principals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    acct = F.lpad(k.cast("string"), 12, "0")
    role = F.when(k % 3 == 0, F.concat(F.lit("r"), k.cast("string"))).otherwise("AWSReservedSSO_x")
    caller = F.when(k % 3 == 2, F.concat(F.lit("arn:aws:iam::"), acct, F.lit(":user/me"))).otherwise(F.concat(F.lit("arn:aws:sts::"), acct, F.lit(":assumed-role/"), role, F.lit("/s")))
    return b.table(spark, sf_dir, "customer").select(k.alias("k"), F.array_join(st.trusted_principals(acct, F.lit("ci"), caller, k % 2 == 0), " ").alias("principals"))


@query("""WITH f AS (SELECT user_id AS repo, CASE WHEN event_type <> 'view' THEN 'f' || event_id END AS path, event_id, CASE WHEN value > 60 THEN 'u' || event_id END AS url, CASE WHEN value < 40 THEN 'r' || event_id END AS region FROM events),
u AS (SELECT repo, arg_min(url, (path IS NOT NULL, path, event_id)) AS url FROM f WHERE url IS NOT NULL AND (path IS NOT NULL OR event_id = (SELECT min(event_id) FROM f g WHERE g.repo = f.repo AND g.path IS NULL AND g.url IS NOT NULL)) GROUP BY 1),
r AS (SELECT repo, arg_min(region, (path IS NOT NULL, path, event_id)) AS region FROM f WHERE region IS NOT NULL AND (path IS NOT NULL OR event_id = (SELECT min(event_id) FROM f g WHERE g.repo = f.repo AND g.path IS NULL AND g.region IS NOT NULL)) GROUP BY 1)
SELECT DISTINCT f.repo, u.url, r.region FROM f LEFT JOIN u USING (repo) LEFT JOIN r USING (repo)""")
def p_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first view is the profile; other events are files."""
    e, v = b.table(spark, sf_dir, "events"), F.col("value")
    id_ = F.col("event_id").cast("string")
    found = e.select(F.col("user_id").alias("repo"), "event_id", F.when(F.col("event_type") != "view", F.concat(F.lit("f"), id_)).alias("path"), F.when(v > 60, F.concat(F.lit("u"), id_)).alias("url"), F.when(v < 40, F.concat(F.lit("r"), id_)).alias("region"))
    views = found.where("path is null").groupBy("repo").agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("event_id"))).alias(c) for c in ("url", "region")]).withColumn("path", F.lit(None).cast("string"))
    return st.first_settings(found.where("path is not null").select("repo", "path", "url", "region").unionByName(views), ["url", "region"])


@query("SELECT p_name || p_partkey AS name FROM part WHERE p_size % 4 <> 0")
def p_attachable(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 4
    return st.attachable(b.table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), F.when(size == 0, "/aws-service-role/x").when(size == 1, "/").alias("path")))
