"""Permission documents: declarations to actions, actions to statements, and the look-ups around them.

The table of actions a type needs is data, so it is a parameter; a document is a group of rows (doc, …) all along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values.
READ_VERBS = ["Describe*", "List*", "Get*"]
GLOBAL_SERVICES = ["cloudfront", "route53", "acm", "iam", "sts"]
STATE_ACTIONS = ["s3:ListBucket", "s3:GetObject", "s3:PutObject", "s3:DeleteObject", "dynamodb:GetItem", "dynamodb:PutItem", "dynamodb:DeleteItem", "dynamodb:DescribeTable"]
CEILING_SERVICES = ["s3", "dynamodb", "logs"]
STAGE_WORDS = {"beta": ["beta", "stage", "staging", "dev", "development", "test", "qa"], "prod": ["prod", "production", "prd", "live"]}
BALANCERS = ["elb", "lb"]
SERVICE_LINKED = "/aws-service-role/"
OWN_STAGE = 10
STATEMENT = "struct<sid string, effect string, actions array<string>, not_actions array<string>, key string, operator string, allowed array<string>>"


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def declarations(files: DataFrame) -> DataFrame:
    """files(doc, path, text) -> doc, kind (resource or data), type, n; a path given twice counts once, a NULL text not at all."""
    text = files.groupBy("doc", "path").agg(F.max("text").alias("text"))
    found = F.regexp_extract_all("text", F.lit(r'((?:resource|data)\s+"aws_[a-z0-9_]+")'), 1)
    rows = text.select("doc", F.explode(found).alias("said"))
    return rows.groupBy("doc", F.regexp_extract("said", "^[a-z]+", 0).alias("kind"), F.regexp_extract("said", '"(.*)"', 1).alias("type")).agg(F.count("*").alias("n"))


def state_backends(files: DataFrame) -> DataFrame:
    """files(doc, text) -> doc, backend: whether any declares that its state is kept in a bucket."""
    return files.groupBy("doc").agg(F.coalesce(F.bool_or(F.regexp_like("text", F.lit(r'backend\s+"s3"'))), F.lit(False)).alias("backend"))


def service_of(type_: Column) -> Column:
    """The service by the type's first word; the two names of balancers are one service."""
    first = F.element_at(F.split(F.regexp_replace(type_, "^aws_", ""), "_"), 1)
    return F.when(first.isin(BALANCERS), "elasticloadbalancing").otherwise(first)


def granted(declared: DataFrame, table: DataFrame) -> DataFrame:
    """declared(doc, kind, type), table(kind, type, actions, creates) -> doc, actions (sorted), unknown (types), creates, types.

    A type that the table lacks, or a resource without actions there, gets all of its service and is named in `unknown`; a
    type marked `creates` manages roles, and its actions are for `statements` to gate.
    """
    rows = declared.join(table.withColumn("__known", F.lit(True)), ["kind", "type"], "left")
    creates = F.coalesce("creates", F.lit(False))
    lost = ~creates & (F.col("__known").isNull() | F.coalesce(F.size("actions") == 0, F.lit(True)) & (F.col("kind") == "resource"))
    rows = rows.withColumn("given", F.when(creates, F.array().cast("array<string>")).when(lost, F.array(F.concat(service_of(F.col("type")), F.lit(":*")))).otherwise(F.col("actions")))
    by = rows.groupBy("doc").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("given")))).alias("actions"), F.array_sort(F.collect_set(F.when(lost, F.col("type")))).alias("unknown"), F.bool_or(creates).alias("creates"), F.array_sort(F.collect_set(F.when(F.col("kind") == "resource", F.col("type")))).alias("types"))
    return by


def services(actions: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(actions, lambda a: F.substring_index(a, ":", 1))))


def reads(of: Column) -> Column:
    return F.array_sort(F.flatten(F.transform(of, lambda s: F.transform(strings(READ_VERBS), lambda v: F.concat(s, F.lit(":"), v)))))


def statement(when: Column, sid: str, effect: str, actions: Column, not_actions: Column | None = None, key: str | None = None, operator: str | None = None, allowed: Column | None = None) -> Column:
    none = F.lit(None)
    whole = F.struct(F.lit(sid).alias("sid"), F.lit(effect).alias("effect"), actions.alias("actions"), (none if not_actions is None else not_actions).alias("not_actions"), F.lit(key).alias("key"), F.lit(operator).alias("operator"), (none if allowed is None else allowed).alias("allowed"))
    return F.when(when, whole.cast(STATEMENT))


def listed(docs: DataFrame, parts: list[Column]) -> DataFrame:
    return docs.select("doc", F.posexplode(F.array_compact(F.array(*parts))).alias("pos", "s")).select("doc", "pos", "s.*")


def statements(docs: DataFrame, create_actions: list[str], other_actions: list[str]) -> DataFrame:
    """docs(doc, actions, creates, types, backend, regions, boundary) -> a row a statement, in order.

    Role creation is allowed under the boundary alone, or plainly where none is given; the region guard spares the global
    services in use, and denies all else where there are none; a distribution needs us-east-1 among the regions.
    """
    empty = F.array().cast("array<string>")
    bare = F.col("creates") & F.col("boundary").isNull()
    actions = F.array_sort(F.array_union("actions", F.when(F.col("creates"), strings(other_actions)).otherwise(empty)))
    rows = docs.withColumn("actions", F.array_sort(F.array_union(actions, F.when(bare, strings(create_actions)).otherwise(empty))))
    rows = rows.withColumn("services", services(F.col("actions"))).withColumn("spared", F.array_intersect("services", strings(GLOBAL_SERVICES)))
    east = strings(["us-east-1"])
    rows = rows.withColumn("allowed", F.when(F.array_contains("types", "aws_cloudfront_distribution"), F.array_union("regions", east)).otherwise(F.col("regions")))
    read, spared, guard = F.array_except("services", strings(["sts"])), F.transform("spared", lambda s: F.concat(s, F.lit(":*"))), F.size("regions") > 0
    return listed(
        rows,
        [
            statement(F.size("actions") > 0, "TerraformManagedResources", "Allow", F.col("actions")),
            statement(F.size(read) > 0, "ReadDescribeLeeway", "Allow", reads(read)),
            statement(F.col("creates") & F.col("boundary").isNotNull(), "IAMCreateOnlyWithBoundary", "Allow", strings(create_actions), None, "iam:PermissionsBoundary", "StringEquals", F.array("boundary")),
            statement(F.col("backend"), "TerraformStateBackend", "Allow", strings(STATE_ACTIONS)),
            statement(guard & (F.size("spared") > 0), "DenyOutsideAllowedRegions", "Deny", F.lit(None), spared, "aws:RequestedRegion", "StringNotEquals", F.col("allowed")),
            statement(guard & (F.size("spared") == 0), "DenyOutsideAllowedRegions", "Deny", strings(["*"]), None, "aws:RequestedRegion", "StringNotEquals", F.col("allowed")),
        ],
    )


def ceiling(made: DataFrame, create_actions: list[str], other_actions: list[str], read_services: list[str], denied: list[str]) -> DataFrame:
    """made(doc, effect, actions, boundary), the statements without a gate -> the boundary document's statements.

    Its services are those of the allowed actions and the fixed ones, without iam, which has statements of its own.
    """
    allowed = F.collect_list(F.when(F.col("effect") == "Allow", F.col("actions")))
    rows = made.groupBy("doc").agg(F.max("boundary").alias("boundary"), services(F.flatten(allowed)).alias("services"))
    of = F.array_sort(F.array_except(F.array_union("services", strings(CEILING_SERVICES)), strings(["iam"])))
    always = F.lit(True)
    return listed(
        rows,
        [
            statement(always, "BoundaryAllowedServices", "Allow", F.transform(of, lambda s: F.concat(s, F.lit(":*")))),
            statement(always, "BoundaryReadEverywhere", "Allow", reads(strings(sorted(read_services)))),
            statement(always, "BoundarySelfPropagatingIAM", "Allow", strings(create_actions), None, "iam:PermissionsBoundary", "StringEquals", F.array("boundary")),
            statement(always, "BoundaryReadIAM", "Allow", strings([a for a in other_actions if not a.startswith("iam:Delete")])),
            statement(always, "BoundaryDenyEscalation", "Deny", strings(denied)),
        ],
    )


def stage_of(text: Column) -> Column:
    """The first stage any of whose words the text holds, in any case; NULL without."""
    low = F.lower(text)
    has = {s: F.exists(strings(words), lambda w: F.contains(low, w)) for s, words in STAGE_WORDS.items()}
    return F.coalesce(*[F.when(c, s) for s, c in has.items()])


def stage_votes(hits: DataFrame, stage: str) -> DataFrame:
    """hits(doc, name, weight, line, file) -> doc, name, weight: hits of another stage go, those of this one weigh 10 more.

    The line's own word decides before the file's; hits of no stage stay as they are.
    """
    of = F.coalesce(stage_of(F.col("line")), stage_of(F.col("file")))
    rows = hits.withColumn("__of", of).where(F.col("__of").isNull() | (F.col("__of") == stage))
    return rows.select("doc", "name", (F.col("weight") + F.when(F.col("__of") == stage, OWN_STAGE).otherwise(0)).alias("weight"))


def session_role(arn: Column) -> Column:
    """The role behind an assumed-role session, with the reserved path for single sign-on roles; NULL for any other caller."""
    part = lambda i: F.regexp_extract(arn, r"^arn:aws:sts::(\d{12}):assumed-role/([^/]+)/", i)
    path = F.when(part(2).startswith("AWSReservedSSO_"), "role/aws-reserved/sso.amazonaws.com/").otherwise("role/")
    return F.when(part(2) != "", F.concat(F.lit("arn:aws:iam::"), part(1), F.lit(":"), path, part(2)))


def trusted_principals(account: Column, user: Column, caller: Column, root: Column) -> Column:
    """The user always, the caller's role if it is one, the root if asked for; in that order, without repeats."""
    at = lambda tail: F.concat(F.lit("arn:aws:iam::"), account, F.lit(":"), tail)
    return F.array_distinct(F.array_compact(F.array(at(F.concat(F.lit("user/"), user)), session_role(caller), F.when(root, at(F.lit("root"))))))


def first_settings(found: DataFrame, keys: list[str]) -> DataFrame:
    """found(repo, path, key…) with a NULL path for the profile -> the profile's value of each key, else that of the first path; blanks are none."""
    order = F.struct(F.col("path").isNotNull().alias("file"), "path")
    rows = found.groupBy("repo").agg(*[F.min_by(k, F.when(F.trim(k) != "", order)).alias(k) for k in keys])
    return rows.select("repo", *keys)


def attachable(roles: DataFrame) -> DataFrame:
    """roles(name, path) -> those that aren't linked to a service, by name; a NULL path is the top."""
    return roles.where(~F.coalesce("path", F.lit("/")).startswith(SERVICE_LINKED)).select("name").orderBy("name")
