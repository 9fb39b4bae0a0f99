"""Evaluation metrics over normalised tables; each function takes and returns DataFrames.

A metric that can't be measured is NULL and leaves the means, and what was left out is counted beside them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ratios import prf, ratio, wilson
from quern.functions.sequences import ascents, of_pairs


def tool_match(calls: DataFrame) -> DataFrame:
    """calls(case_id, side expected|actual, name) -> tp, fp, fn, precision, recall, f1: names match as multisets."""
    n = calls.groupBy("case_id", "name").agg(F.count_if(F.col("side") == "expected").alias("e"), F.count_if(F.col("side") == "actual").alias("a"))
    by = n.groupBy("case_id").agg(F.sum(F.least("e", "a")).alias("tp"), F.sum(F.greatest(F.col("a") - F.col("e"), F.lit(0))).alias("fp"), F.sum(F.greatest(F.col("e") - F.col("a"), F.lit(0))).alias("fn"))
    return by.select("*", *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def field_match(fields: DataFrame) -> DataFrame:
    """fields(case_id, side, path, value) -> matches, wrong, omitted and extra paths; a wrong value is both fp and fn."""
    e = fields.where("side = 'expected'").select("case_id", "path", F.col("value").alias("e"), F.lit(True).alias("in_e"))
    a = fields.where("side = 'actual'").select("case_id", "path", F.col("value").alias("a"), F.lit(True).alias("in_a"))
    both = e.join(a, ["case_id", "path"], "full_outer")
    same = F.col("e").eqNullSafe(F.col("a"))
    by = both.groupBy("case_id").agg(
        F.count_if(F.col("in_e") & F.col("in_a") & same).alias("tp"),
        F.count_if(F.col("in_e") & F.col("in_a") & ~same).alias("wrong_value"),
        F.count_if(F.col("in_a").isNull()).alias("omitted_optional"),
        F.count_if(F.col("in_e").isNull()).alias("unexpected_path"),
    )
    by = by.withColumn("fp", F.col("wrong_value") + F.col("unexpected_path")).withColumn("fn", F.col("wrong_value") + F.col("omitted_optional"))
    by = by.withColumn("json_exact_match", F.when((F.col("fp") == 0) & (F.col("fn") == 0), 1).otherwise(0))
    return by.select("*", *[c.alias(k) for k, c in prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def flatten_json(rows: DataFrame, id_: str, json: str, depth: int = 16) -> DataFrame:
    """id, path, value (JSON text) of every leaf; empty objects and arrays vanish, and levels below `depth` are an error.

    Objects and arrays are exploded level by level; a level of plain values ends it.
    """
    level = rows.select(F.col(id_).alias(id_), F.lit("").alias("path"), F.expr(f"try_parse_json({json})").alias("v"))
    out = None
    for _ in range(depth):
        kind = F.expr("schema_of_variant(v)")
        nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
        leaf = level.where(F.col("v").isNotNull() & ~nested).select(id_, "path", F.expr("to_json(v)").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        level = level.where(nested)
        level.createOrReplaceTempView("__quern_level")
        level = rows.sparkSession.sql(
            f"SELECT t.`{id_}`, CASE WHEN x.key IS NULL THEN concat(t.path, '[', x.pos, ']') WHEN t.path = '' THEN x.key ELSE concat(t.path, '.', x.key) END AS path, x.value AS v "
            "FROM __quern_level t, LATERAL variant_explode(t.v) x"
        )
    return out


def dcg(ranking: DataFrame, k: int | None = None) -> DataFrame:
    """ranking(query_id, rank, relevance) -> dcg, idcg and ndcg at k; the ideal order is that of the whole list."""
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1
    by = Window.partitionBy("query_id")
    rows = ranking.withColumn("r", F.row_number().over(by.orderBy("rank"))).withColumn("i", F.row_number().over(by.orderBy(F.desc("relevance"), "rank")))
    kept = lambda at: F.col(at) <= (F.lit(k) if k is not None else F.lit(1 << 62))
    out = rows.groupBy("query_id").agg(
        F.sum(F.when(kept("r"), gain / F.log2(F.col("r") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(F.when(kept("i"), gain / F.log2(F.col("i") + 1)).otherwise(0.0)).alias("idcg"),
    )
    return out.withColumn("ndcg", F.when(F.col("idcg") != 0, F.col("dcg") / F.col("idcg"))).withColumn("excluded", F.col("idcg") == 0)


def mrr(first: DataFrame) -> DataFrame:
    """first(query_id, rank) -> the mean of 1 / rank over queries with a hit; rank NULL or 0 is a miss and counted apart."""
    hit = F.col("rank") > 0
    return first.agg(F.count("*").alias("queries"), F.count_if(hit).alias("with_hit"), F.count_if(~F.coalesce(hit, F.lit(False))).alias("without"), F.avg(F.when(hit, 1.0 / F.col("rank"))).alias("mrr"))


def average_precision(flags: DataFrame, k: int) -> DataFrame:
    """flags(query_id, rank, relevant) -> the mean precision at the relevant ranks up to k; NULL where there is none."""
    by = Window.partitionBy("query_id").orderBy("rank")
    rows = flags.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k)
    seen = F.sum(F.when(F.col("relevant"), 1).otherwise(0)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("p", F.when(F.col("relevant"), seen / F.col("r")))
    return flags.select("query_id").distinct().join(rows.groupBy("query_id").agg(F.avg("p").alias("ap")), "query_id", "left")


def mean_average_precision(flags: DataFrame, k: int) -> DataFrame:
    return average_precision(flags, k).agg(F.count_if(F.col("ap").isNull()).alias("without"), F.avg("ap").alias("map_at_k"))


def kendall(orders: DataFrame) -> DataFrame:
    """orders(case_id, side actual|ideal, pos, item) -> the pairs of shared items in and against the ideal order, and tau.

    Items are distinct within a side.  A case's shared items in actual order are one array of ideal places, whose ascending pairs
    are counted while its halves are merged.
    """
    a = orders.where("side = 'actual'").select("case_id", "item", F.col("pos").alias("a"))
    i = orders.where("side = 'ideal'").select("case_id", "item", F.col("pos").alias("i"))
    shared = a.join(i, ["case_id", "item"]).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("a", "i"))).alias("all"))
    n = F.size("all")
    out = shared.select("case_id", n.alias("shared"), ascents(F.transform("all", lambda x: x["i"])).cast("int").alias("concordant"), (n * (n - 1) / 2).cast("long").alias("pairs"))
    out = out.withColumn("discordant", F.col("pairs") - F.col("concordant"))
    return out.withColumn("tau", ratio(F.col("concordant") - F.col("discordant"), F.col("pairs")))


def lcs_length(a: Column, b: Column) -> Column:
    """The length of the longest common subsequence of two arrays; items are compared as strings."""
    return of_pairs("common", a, b).cast("int")


def trajectory(cases: DataFrame) -> DataFrame:
    """cases(case_id, expected array, actual array) -> the LCS length and both of its normalisations."""
    n = lcs_length(F.col("expected"), F.col("actual"))
    out = cases.select("case_id", n.alias("lcs"), F.size("expected").alias("len_expected"), F.size("actual").alias("len_actual"))
    return out.select("*", ratio(F.col("lcs"), F.col("len_expected")).alias("over_expected"), ratio(F.col("lcs"), F.greatest("len_expected", "len_actual")).alias("over_longer"))


def reliability(trials: DataFrame) -> DataFrame:
    """trials(case_id, success) -> k, the share of successes, and whether all succeeded, of each case."""
    ok = F.col("success")
    return trials.groupBy("case_id").agg(F.count("success").alias("k"), ratio(F.count_if(ok), F.count("success")).alias("rate"), F.when(F.count("success") > 0, F.when(F.bool_and(ok), 1).otherwise(0)).alias("strict"))


def reliability_summary(trials: DataFrame) -> DataFrame:
    by = reliability(trials)
    return by.agg(F.array_sort(F.collect_set("k")).alias("k"), F.avg("rate").alias("mean_rate"), F.avg("strict").alias("strict_rate"))


def calibration_bins(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """pairs(p, outcome) -> bin, n, mean confidence and accuracy; p outside 0 to 1 is an error, empty bins have no row."""
    p = F.when(F.col("p").between(0, 1), F.col("p").cast("double")).otherwise(F.raise_error(F.lit("p must lie in 0 to 1")).cast("double"))
    rows = pairs.where("p is not null and outcome is not null").select(p.alias("p"), F.col("outcome").cast("double").alias("o"))
    return rows.groupBy(F.least(F.lit(bins - 1), F.floor(F.col("p") * bins).cast("int")).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("confidence"), F.avg("o").alias("accuracy"), F.sum(F.pow(F.col("p") - F.col("o"), 2)).alias("squares"))


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """The Brier score and the expected calibration error; NULL without pairs."""
    by = calibration_bins(pairs, bins)
    gap = F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))
    return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), ratio(F.sum("squares"), F.sum("n")).alias("brier"), ratio(F.sum(gap), F.sum("n")).alias("ece"))


def scenario_means(scores: DataFrame) -> DataFrame:
    """scores(scenario, score) -> the mean of each scenario; NULL scores leave it."""
    return scores.groupBy("scenario").agg(F.count("score").alias("n"), F.avg("score").alias("mean"))


def macro_micro(scores: DataFrame) -> DataFrame:
    """The mean of the scenarios' means, the mean of all cases, and the worst scenario (of equal ones the first by name)."""
    by = scores.groupBy("scenario").agg(F.count("score").alias("n"), F.sum("score").alias("s"), F.avg("score").alias("mean"))
    worst = F.min(F.when(F.col("mean").isNotNull(), F.struct("mean", "scenario")))
    return by.agg(F.avg("mean").alias("macro"), ratio(F.sum("s"), F.sum("n")).alias("micro"), worst["mean"].alias("worst_mean"), worst["scenario"].alias("worst_scenario"))


def lower_tail_mean(scores: DataFrame, tail: float = 0.1) -> DataFrame:
    """The mean of the worst max(1, ceil(n * tail)) scores, with n * tail as a double.

    The scores are counted by value first and the values ranked by running counts, so no task sorts all scores.
    """
    by = scores.where("score is not null").groupBy(F.col("score").cast("double").alias("score")).agg(F.count("*").alias("n"))
    total = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    take = F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(float(tail))))
    before = F.coalesce(F.sum("n").over(Window.orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = by.withColumn("before", before).crossJoin(F.broadcast(total)).withColumn("take", take)
    used = F.greatest(F.lit(0), F.least(F.col("n"), F.col("take") - F.col("before")))
    return rows.agg(F.max("take").cast("long").alias("used"), ratio(F.sum(F.col("score") * used), F.sum(used)).alias("cvar"))


def interval(trials: DataFrame) -> DataFrame:
    """trials(success) -> successes, trials and the Wilson interval."""
    n = trials.agg(F.count_if("success").alias("successes"), F.count("success").alias("trials"))
    return n.select("*", *[c.alias(k) for k, c in wilson(F.col("successes"), F.col("trials")).items()])


# -- metrics that are stated but for which no code is shipped: our own readings of them


def execution_success(steps: DataFrame) -> DataFrame:
    """steps(case_id, ok) -> successful over attempted calls of each case."""
    return steps.groupBy("case_id").agg(F.count_if("ok").alias("successful"), F.count("ok").alias("attempted"), ratio(F.count_if("ok"), F.count("ok")).alias("rate"))


def redundancy(calls: DataFrame) -> DataFrame:
    """calls(case_id, pos, name, args) -> the share of calls that repeat the one right before with the same arguments."""
    by = Window.partitionBy("case_id").orderBy("pos")
    again = (F.lag("name").over(by) == F.col("name")) & F.lag("args").over(by).eqNullSafe(F.col("args"))
    rows = calls.select("case_id", F.coalesce(again, F.lit(False)).alias("again"))
    return rows.groupBy("case_id").agg(F.count_if("again").alias("redundant"), F.count("*").alias("calls"), ratio(F.count_if("again"), F.count("*")).alias("rate"))


def recovery_steps(steps: DataFrame) -> DataFrame:
    """steps(case_id, pos, ok) -> for each case with a fault, the steps from its first fault to the first good step after it (NULL if none)."""
    fault = steps.where(~F.col("ok")).groupBy("case_id").agg(F.min("pos").alias("fault"))
    after = steps.join(fault, "case_id").where(F.col("ok") & (F.col("pos") > F.col("fault"))).groupBy("case_id").agg(F.min("pos").alias("good"))
    return fault.join(after, "case_id", "left").select("case_id", "fault", (F.col("good") - F.col("fault")).alias("steps"))


def cost_per_success(runs: DataFrame) -> DataFrame:
    """runs(slice, ok, cost) -> all cost, failures included, over the successes."""
    return runs.groupBy("slice").agg(F.sum("cost").alias("cost"), F.count_if("ok").alias("successes"), ratio(F.sum("cost"), F.count_if("ok")).alias("per_success"))


def retry_efficiency(calls: DataFrame) -> DataFrame:
    """calls(case_id, retries) -> 1 / (1 + retries)."""
    return calls.select("case_id", "retries", (1.0 / (1 + F.col("retries"))).alias("efficiency"))


def p95_of_successes(runs: DataFrame) -> DataFrame:
    """runs(slice, ok, latency) -> the exact 95th percentile of the successes' latency."""
    return runs.where("ok").groupBy("slice").agg(F.count("*").alias("n"), F.percentile("latency", 0.95).alias("p95"))


def pareto_front(points: DataFrame) -> DataFrame:
    """points(id, quality, cost) -> those that no other beats in one measure without losing in the other; ties stay.

    Only distinct points are compared: a point stands if its quality is the best of its cost and above all of less cost.
    """
    best = points.groupBy("cost").agg(F.max("quality").alias("top"))
    before = F.max("top").over(Window.orderBy("cost").rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("before", before).where("before is null or top > before").select("cost", F.col("top").alias("quality"))
    return points.join(front, ["cost", "quality"], "left_semi")


def mcnemar(pairs: DataFrame) -> DataFrame:
    """pairs(case_id, a, b) -> the discordant counts and the uncorrected chi-square; NULL without any."""
    n = pairs.agg(F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(~F.col("a") & F.col("b")).alias("only_b"))
    return n.withColumn("chi_square", ratio(F.pow(F.col("only_a") - F.col("only_b"), 2), F.col("only_a") + F.col("only_b")))


def cohen_kappa(pairs: DataFrame) -> DataFrame:
    """pairs(a, b) -> observed and expected agreement, and kappa (Cohen 1960); NULL where all agree by chance."""
    cells = pairs.groupBy("a", "b").agg(F.count("*").alias("n"))
    total = cells.agg(F.sum("n").alias("total"), ratio(F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)), F.sum("n")).alias("observed"))
    a, b = (cells.groupBy(F.col(x).alias("label")).agg(F.sum("n").alias(f"n_{x}")) for x in ("a", "b"))
    chance = a.join(b, "label").agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("products"))
    out = total.crossJoin(chance).withColumn("expected", ratio(F.col("products"), F.col("total") * F.col("total")))
    return out.select("total", "observed", "expected", ratio(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def gated(cases: DataFrame, gates: list[str], score: str) -> DataFrame:
    """A tripped gate fails the whole case before its score counts: the score becomes NULL and the first gate is named."""
    first = F.coalesce(*[F.when(F.col(g), F.lit(g)) for g in gates])
    return cases.withColumn("tripped", first).withColumn("passed", first.isNull()).withColumn(score, F.when(first.isNull(), F.col(score)))


def composite(cases: DataFrame, weights: dict[str, float]) -> DataFrame:
    """The weighted mean of the groups that apply; NULL groups leave the denominator."""
    num = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    den = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in weights.items()), F.lit(0.0))
    return cases.withColumn("composite", ratio(num, den))


def failure_class(events: DataFrame) -> DataFrame:
    """events(case_id, pos, class) -> the class that fired first in each case."""
    return events.groupBy("case_id").agg(F.min_by("class", F.struct("pos", "class")).alias("class"), F.min("pos").alias("pos"))


def edit_similarity(cases: DataFrame) -> DataFrame:
    """cases(case_id, expected, actual) strings -> 1 - edit distance / the longer length; two empty ones are alike."""
    longer = F.greatest(F.length("expected"), F.length("actual"))
    return cases.select("case_id", F.levenshtein("expected", "actual").alias("distance"), F.coalesce(1 - ratio(F.levenshtein("expected", "actual"), longer), F.lit(1.0)).alias("similarity"))


def token_edit_similarity(cases: DataFrame) -> DataFrame:
    """cases(case_id, expected array, actual array) -> distance, over_longer, over_expected: the token form of `edit_similarity`.

    Both normalisations are shown, as the measure names none: 1 - distance / the longer length (two empty ones are alike) and
    1 - distance / the expected length, which may be negative and is NULL without expected tokens.
    """
    d = cases.select("case_id", of_pairs("distance", F.col("expected"), F.col("actual")).cast("int").alias("distance"), F.size("expected").alias("e"), F.size("actual").alias("a"))
    longer = F.when(F.greatest("e", "a") == 0, 1.0).otherwise(1 - ratio(F.col("distance"), F.greatest("e", "a")))
    return d.select("case_id", "distance", longer.alias("over_longer"), (1 - ratio(F.col("distance"), F.col("e"))).alias("over_expected"))


def bootstrap_means(cases: DataFrame, replicas: int, seed: int = 1) -> DataFrame:
    """cases(i from 0, score) -> replica, mean: each replica draws as many cases with replacement, by a fixed hash.

    Each replica is drawn by its own rows (replica, draw), hashed to a case, so no replica is gathered in one place.
    """
    n = cases.agg(F.count("*").alias("n"))
    draws = cases.select(F.col("i").alias("draw")).crossJoin(F.broadcast(n)).select("draw", "n", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replica", "draw")), 1, 8), 16, 10).cast("long"), F.col("n"))
    return draws.select("replica", pick.alias("i")).join(cases, "i").groupBy("replica").agg(F.avg("score").alias("mean"))


def stratified_sample(rows: DataFrame, stratum: str, id_: str, each: int) -> DataFrame:
    """The first `each` rows of every stratum by a hash of their id."""
    key = F.md5(F.col(id_).cast("string"))
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy(key, id_))).where(F.col("__r") <= each).drop("__r")


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """ratings(item, label), a row a rating -> items, observed, expected, kappa (Fleiss 1971), over items rated twice or more.

    Items may have different numbers of ratings; each counts the same in `observed`.  NULL where chance agrees fully.
    """
    cells = ratings.where("item is not null and label is not null").groupBy("item", "label").agg(F.count("*").alias("n"))
    by = cells.groupBy("item").agg(F.sum("n").alias("of"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agreeing")).where("of > 1")
    seen = by.agg(F.count("*").alias("items"), F.avg(F.col("agreeing") / (F.col("of") * (F.col("of") - 1))).alias("observed"))
    labels = cells.join(by.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("n").alias("n"))
    chance = labels.agg(ratio(F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")).alias("expected"))
    return seen.crossJoin(chance).select("items", "observed", "expected", ratio(F.col("observed") - F.col("expected"), 1 - F.col("expected")).alias("kappa"))


def against_targets(measured: DataFrame, targets: DataFrame) -> DataFrame:
    """measured(metric, value) against targets(metric, target, at_most): `met` is NULL without a value or a target."""
    rows = targets.join(measured, "metric", "left")
    return rows.select("metric", "value", "target", F.when(F.col("at_most"), F.col("value") <= F.col("target")).otherwise(F.col("value") >= F.col("target")).alias("met"))


def grounding(claims: DataFrame) -> DataFrame:
    """claims(case_id, supported, cited, worthy) -> case_id, faithfulness, citation_precision, citation_recall over its claims.

    A claim is supported by the sources, cites one, or is worth a citation; a citation supports where both hold.
    """
    share = lambda hit, base: ratio(F.count_if(hit), F.count_if(base))
    good = F.col("supported") & F.col("cited")
    return claims.groupBy("case_id").agg(
        ratio(F.count_if("supported"), F.count("*")).alias("faithfulness"), share(good, F.col("cited")).alias("citation_precision"), share(good & F.col("worthy"), F.col("worthy")).alias("citation_recall")
    )


def goal_match(predicates: DataFrame) -> DataFrame:
    """predicates(case_id, satisfied) -> satisfied over applicable ones; NULL is not applicable, and a case of such alone has no rate."""
    return predicates.groupBy("case_id").agg(F.count_if("satisfied").alias("satisfied"), F.count("satisfied").alias("applicable"), ratio(F.count_if("satisfied"), F.count("satisfied")).alias("rate"))


def side_effect_rate(chances: DataFrame) -> DataFrame:
    """chances(case_id, mutated, expected), a row an opportunity to change state -> unexpected changes over opportunities, not over calls."""
    bad = F.count_if(F.col("mutated") & ~F.col("expected"))
    return chances.groupBy("case_id").agg(bad.alias("unexpected"), F.count("*").alias("opportunities"), ratio(bad, F.count("*")).alias("rate"))


def no_call_accuracy(cases: DataFrame) -> DataFrame:
    """cases(slice, needed, made) numbers of calls -> of the cases that need none, the share that makes none; our reading."""
    none = F.col("needed") == 0
    right = F.count_if(none & (F.col("made") == 0))
    return cases.groupBy("slice").agg(F.count_if(none).alias("without_need"), right.alias("abstained"), ratio(right, F.count_if(none)).alias("accuracy"))


def milestones(rows: DataFrame) -> DataFrame:
    """rows(case_id, milestone, reached) -> the share of distinct milestones reached, however often each was; our reading."""
    each = rows.groupBy("case_id", "milestone").agg(F.coalesce(F.bool_or("reached"), F.lit(False)).alias("reached"))
    return each.groupBy("case_id").agg(F.count_if("reached").alias("reached"), F.count("*").alias("milestones"), ratio(F.count_if("reached"), F.count("*")).alias("completion"))


def context_match(chunks: DataFrame) -> DataFrame:
    """chunks(query_id, retrieved, relevant) -> precision over the retrieved and recall over the relevant chunks; our reading."""
    hit = F.count_if(F.col("retrieved") & F.col("relevant"))
    return chunks.groupBy("query_id").agg(hit.alias("hits"), ratio(hit, F.count_if("retrieved")).alias("precision"), ratio(hit, F.count_if("relevant")).alias("recall"))


def safety(cases: DataFrame) -> DataFrame:
    """cases(slice, followed, attack, preserved, achieved, severity) -> compliance, resilience, attack success, critical violations.

    Resilience and attack success are measured apart over the attacks, as an attack may fail and still break the protected
    behaviour; P0 and P1 violations are counted, never averaged.
    """
    attack = F.count_if("attack")
    return cases.groupBy("slice").agg(
        ratio(F.count_if("followed"), F.count("followed")).alias("compliance"), attack.alias("attacks"), ratio(F.count_if(F.col("attack") & F.col("preserved")), attack).alias("resilience"),
        ratio(F.count_if(F.col("attack") & F.col("achieved")), attack).alias("attack_success"), F.count_if(~F.col("followed") & F.col("severity").isin("P0", "P1")).alias("critical"),
    )


def bootstrap_interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    """means(replica, mean) of `bootstrap_means` -> replicas, low, high: the percentile interval."""
    tail = (1 - level) / 2
    return means.agg(F.count("*").alias("replicas"), F.percentile("mean", tail).alias("low"), F.percentile("mean", 1 - tail).alias("high"))


def paired_permutation(pairs: DataFrame, replicas: int, seed: int = 1) -> DataFrame:
    """pairs(case_id, a, b) -> cases, mean difference, and the two-sided p by sign flips that a hash of (seed, replica, case) draws.

    The data's own signs count as one of the draws, so p is never 0; pairs with a NULL are no pairs.
    """
    d = pairs.select("case_id", (F.col("a") - F.col("b")).alias("d")).where("d is not null")
    seen = d.agg(F.count("*").alias("cases"), F.sum("d").alias("total"))
    flips = d.select("case_id", "d", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))).alias("replica"))
    up = F.substring(F.md5(F.concat_ws(":", F.lit(seed), "replica", "case_id")), 1, 1) < "8"
    sums = flips.groupBy("replica").agg(F.sum(F.when(up, F.col("d")).otherwise(-F.col("d"))).alias("flipped"))
    far = sums.crossJoin(F.broadcast(seen)).agg(F.count_if(F.abs("flipped") >= F.abs("total")).alias("as_far"))
    return seen.crossJoin(far).select("cases", ratio(F.col("total"), F.col("cases")).alias("difference"), F.when(F.col("cases") > 0, (1 + F.col("as_far")) / F.lit(1.0 + replicas)).alias("p"))


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """ratings(item, label), a row a rating -> items, ratings and alpha of nominal labels (Krippendorff 2004) over items rated twice or more.

    NULL where all ratings are of one label, as no disagreement can be expected then.
    """
    cells = ratings.where("item is not null and label is not null").groupBy("item", "label").agg(F.count("*").alias("n"))
    by = cells.groupBy("item").agg(F.sum("n").alias("of"), F.sum(F.col("n") * F.col("n")).alias("squares")).where("of > 1")
    seen = by.agg(F.count("*").alias("items"), F.sum("of").alias("ratings"), F.sum((F.col("of") * F.col("of") - F.col("squares")) / (F.col("of") - 1)).alias("apart"))
    chance = cells.join(by.select("item"), "item", "left_semi").groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(F.col("n") * F.col("n")).alias("alike"))
    n = F.col("ratings")
    return seen.crossJoin(chance).select("items", "ratings", (1 - ratio((n - 1) * F.col("apart"), n * n - F.col("alike"))).alias("alpha"))


def canonical_fields(fields: DataFrame, aliases: DataFrame, known: DataFrame) -> DataFrame:
    """fields(path, kind, value, …) with `value` as it is to be compared.

    Kinds: `time` to UTC seconds; `alias` by aliases(path, alias, meant) alone, which the tool's contract states; `set`, a JSON
    array of strings whose order means nothing, sorted without repeats; `id` to `known` or `unknown`, by known(path, value);
    other values stay, and so do times and sets that can't be read.
    """
    rows = fields.join(aliases.select("path", F.col("alias").alias("value"), "meant"), ["path", "value"], "left")
    rows = rows.join(known.select("path", "value", F.lit(True).alias("__known")).distinct(), ["path", "value"], "left")
    value, kind = F.col("value"), F.col("kind")
    time = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(value), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    members = F.to_json(F.array_sort(F.array_distinct(F.from_json(value, "array<string>"))))
    plain = F.when(kind == "time", time).when(kind == "alias", F.col("meant")).when(kind == "set", members)
    read = F.when(kind == "id", F.when(F.col("__known"), "known").otherwise("unknown")).otherwise(F.coalesce(plain, value))
    return rows.withColumn("value", F.when(value.isNotNull(), read)).select(*fields.columns)
