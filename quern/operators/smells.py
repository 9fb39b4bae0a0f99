"""Smells of packages and history that are stated as rules alone; the readings are ours."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.ratios import ratio
from quern.operators.graph import components, step
from quern.operators.structure import commit_pairs

#: The fallback limits of a package's lines and classes.
MOST_LINES, MOST_CLASSES = 27000, 30


def god_components(nodes: DataFrame, lines: int = MOST_LINES, classes: int = MOST_CLASSES) -> DataFrame:
    """nodes(package, loc, types) -> package, loc, types, rule, severity of packages above a fixed limit or, failing that,
    above the median package; the severity is the lines above that median."""
    by = nodes.groupBy("package").agg(F.sum("loc").alias("loc"), F.sum("types").alias("types"))
    rows = by.crossJoin(F.broadcast(by.agg(F.percentile("loc", 0.5).alias("median"))))
    rule = F.when((F.col("loc") > lines) | (F.col("types") > classes), "fixed").when(F.col("loc") > F.col("median"), "median")
    return rows.select("package", "loc", "types", rule.alias("rule"), (F.col("loc") - F.col("median")).alias("severity")).where("rule is not null")


def feature_concentration(nodes: DataFrame, edges: DataFrame, most: float = 0.2) -> DataFrame:
    """nodes(id, package) -> package, parts, classes, lcc, found: the parts that no edge within the package joins, over its classes."""
    home = nodes.select("id", "package")
    inner = edges.join(home.select(F.col("id").alias("src"), F.col("package").alias("p")), "src").join(home.select(F.col("id").alias("dst"), F.col("package").alias("q")), "dst").where("p = q and src <> dst")
    ways = inner.select("src", "dst").union(inner.select("dst", "src")).distinct().withColumn("weight", F.lit(1).cast("bigint"))
    parts = components(nodes, step(ways)).join(home, "id").groupBy("package").agg(F.count_distinct("scc").alias("parts"), F.count("*").alias("classes"))
    return parts.withColumn("lcc", ratio(F.col("parts"), F.col("classes"))).withColumn("found", F.col("lcc") > most)


def conditional_co_change(changes: DataFrame, least: float = 0.3) -> DataFrame:
    """changes(sha, path) -> a, b, p: the share of a's commits that change b too, or the highest product of such shares along a path.

    Links below `least` are dropped, as the measure says; a product never rises, so paths below it end there, and only pairs
    that got better go on to the next round.
    """
    rows = changes.select("sha", "path").distinct()
    size = rows.groupBy("path").agg(F.count("*").alias("of"))
    # A link a -> b of p >= least needs this many shared commits; files that b's own number rules out still count for others.
    pairs = commit_pairs(rows).groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    links = step(pairs.join(size.withColumnRenamed("path", "a"), "a").select("a", "b", ratio(F.col("shared"), F.col("of")).alias("p")).where(F.col("p") >= least))
    best = new = links
    ahead = links.select(F.col("a").alias("b"), F.col("b").alias("far"), F.col("p").alias("q"))
    while new.limit(1).count():
        longer = new.join(ahead, "b").where("a <> far").select("a", F.col("far").alias("b"), (F.col("p") * F.col("q")).alias("p")).where(F.col("p") >= least)
        longer = longer.groupBy("a", "b").agg(F.max("p").alias("p"))
        # A gain below 1e-12 is the rounding of the same product in another order.
        new = step(longer.join(best.withColumnRenamed("p", "had"), ["a", "b"], "left").where(F.col("had").isNull() | (F.col("p") > F.col("had") + 1e-12)).select("a", "b", "p"))
        best = step(best.unionByName(new).groupBy("a", "b").agg(F.max("p").alias("p")))
    return best


def violation_groups(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, shared) of co-changing files that nothing links -> core, member, shared, round: each pair once, in its group.

    The groups are those of the greedy cover that takes the file with most uncovered pairs again and again (of equal ones the first
    by name) with all its partners.  A file that comes before all its partners in that order keeps its pairs until it is
    taken, as no partner gains any; so each round takes all such files at once, and the groups are the same.
    """
    both = step(pairs.select(F.col("a").alias("core"), F.col("b").alias("member"), "shared").unionByName(pairs.select(F.col("b").alias("core"), F.col("a").alias("member"), "shared")))
    found: list[DataFrame] = []
    while both.limit(1).count():
        size = both.groupBy("core").agg(F.count("*").alias("n"))
        place = F.struct((-F.col("n")).alias("n"), F.col("core").alias("name"))
        rival = both.join(size.select(F.col("core").alias("member"), F.struct((-F.col("n")).alias("n"), F.col("core").alias("name")).alias("place")), "member").groupBy("core").agg(F.min("place").alias("rival"))
        cores = step(size.join(rival, "core").where(place < F.col("rival")).select("core"))
        found.append(step(both.join(cores, "core").select("core", "member", "shared", F.lit(len(found) + 1).alias("round"))))
        both = step(both.join(cores, "core", "left_anti").join(cores.withColumnRenamed("core", "member"), "member", "left_anti").select("core", "member", "shared"))
    return reduce(DataFrame.unionByName, found) if found else both.withColumn("round", F.lit(1))


def recurring_sets(sets: DataFrame, least: int = 2) -> DataFrame:
    """sets(set_id, member) of discrepancies -> members, size, occurrences: how often each distinct set stands in a set, itself included.

    Equal sets are counted together first.  A set's wider ones hold its rarest member too, so it is only held against those.
    """
    whole = sets.where("member is not null").groupBy("set_id").agg(F.array_sort(F.collect_set("member")).alias("members"))
    kinds = step(whole.groupBy("members").agg(F.count("*").alias("n")).withColumn("size", F.size("members")))
    each = kinds.select("members", "n", "size", F.explode("members").alias("member"))
    often = each.groupBy("member").agg(F.count("*").alias("in"))
    rarest = each.join(often, "member").groupBy("members", "size").agg(F.min_by("member", F.struct("in", "member")).alias("member"))
    wider = each.select("member", F.col("members").alias("wide"), F.col("n"), F.col("size").alias("wide_size"))
    met = rarest.join(wider, "member").where((F.col("wide_size") >= F.col("size")) & (F.size(F.array_except("members", "wide")) == 0))
    return met.groupBy("members", "size").agg(F.sum("n").alias("occurrences")).where(F.col("occurrences") >= least)


def debt_index(smells: DataFrame, rank: DataFrame, weights: DataFrame) -> DataFrame:
    """smells(id, kind, measure, dependencies), rank(id, pagerank), weights(kind, weight) -> id, kind, severity, asis, debt.

    The severity is the share of the kind's other instances that measure less, among this system's own instances alone; asis
    is severity times rank, and debt its weighted part of the index: over all dependencies in a smell.  An unranked node has NULL.
    """
    by = Window.partitionBy("kind").orderBy("measure").rowsBetween(Window.unboundedPreceding, -1)
    values = smells.groupBy("kind", "measure").agg(F.count("*").alias("n")).withColumn("less", F.coalesce(F.sum("n").over(by), F.lit(0)))
    kinds = smells.groupBy("kind").agg(F.count("*").alias("of"))
    total = smells.agg(F.sum("dependencies").alias("w"))
    rows = smells.join(values.drop("n"), ["kind", "measure"]).join(kinds, "kind").join(weights, "kind").join(rank, "id", "left").crossJoin(F.broadcast(total))
    severity = F.coalesce(ratio(F.col("less"), F.col("of") - 1), F.lit(0.0))
    asis = severity * F.col("pagerank")
    return rows.select("id", "kind", severity.alias("severity"), asis.alias("asis"), ratio(asis * F.col("weight"), F.col("w")).alias("debt"))


def decoupling_level(files: DataFrame, edges: DataFrame, few: int = 5) -> DataFrame:
    """files(id, module, layer from 0) of a declared hierarchy -> layer, modules, dl; the level is the sum over layers.

    Above the last layer a module counts its share of files times the share of the files in lower layers that don't depend
    on it; in the last one its share, over log5 of its files if it has more than `few`.
    """
    home = files.select("id", "module", "layer")
    size = home.groupBy("module", "layer").agg(F.count("*").alias("files"))
    layers = home.groupBy("layer").agg(F.count("*").alias("here"))
    below = layers.select("layer", F.coalesce(F.sum("here").over(Window.orderBy(F.desc("layer")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"))
    into = edges.select("src", "dst").distinct().join(home.select(F.col("id").alias("dst"), "module", "layer"), "dst").join(home.select(F.col("id").alias("src"), F.col("layer").alias("from")), "src")
    deps = into.where(F.col("from") > F.col("layer")).groupBy("module", "layer").agg(F.count_distinct("src").alias("deps"))
    rows = size.join(deps, ["module", "layer"], "left").join(F.broadcast(below), "layer").crossJoin(F.broadcast(home.agg(F.count("*").alias("all"))))
    share = ratio(F.col("files"), F.col("all"))
    last = F.when(F.col("files") <= few, share).otherwise(share / (F.log(F.col("files")) / F.log(F.lit(5.0))))
    level = F.when(F.col("below") == 0, last).otherwise(share * (1 - ratio(F.coalesce("deps", F.lit(0)), F.col("below"))))
    return rows.groupBy("layer").agg(F.count("*").alias("modules"), F.sum(level).alias("dl"))
