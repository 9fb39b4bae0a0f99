"""Which edges of a tangle point backwards in a good order of its nodes: a heuristic, so never called minimal.

Sources and sinks are peeled off, all that there are in a round; where there are none, the nodes that give much more than
they take go first.  With one node at a time the edges that point back are at most m / 2 - n / 6 of a tangle without
two-cycles; here whole buckets go at once, and the bound is checked on the result (`feedback_check`).  Of the two edges of
a two-cycle exactly one points back in any order, so they are left out of the peeling and counted beside the bound.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.ratios import half_even
from quern.operators.graph import components, inner_edges, step

#: A bucket holds the nodes whose surplus is at least this share of the tangle's largest one.
BUCKET = 0.25


def one_way(inside: DataFrame) -> DataFrame:
    """scc, src, dst of inside without those whose reverse is there too."""
    return inside.join(inside.select("scc", F.col("dst").alias("src"), F.col("src").alias("dst")), ["scc", "src", "dst"], "left_anti")


def peeled(left: DataFrame, share: float = BUCKET) -> DataFrame:
    """scc, id, side, surplus, flip of the nodes that the next round takes from the edges left (scc, src, dst).

    Sources go to the left side and sinks to the right one.  A tangle with neither gives its bucket of largest surpluses (edges out
    less edges in) to the left, or, where none is positive, its node of most edges (of equal ones the first by id).  Nodes of a bucket
    stand by falling surplus and id, or the other way round (`flip`) if more of their own edges then point ahead.
    """
    ends = left.select("scc", F.col("src").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(left.select("scc", "dst", F.lit(0), F.lit(1)))
    degree = ends.groupBy("scc", "id").agg(F.sum("out").alias("out"), F.sum("into").alias("into")).withColumn("surplus", F.col("out") - F.col("into"))
    whole = degree.groupBy("scc").agg(F.bool_or((F.col("out") == 0) | (F.col("into") == 0)).alias("open"), F.max("surplus").alias("most"), F.min(F.struct((-F.col("out")).alias("o"), "id"))["id"].alias("first"))
    taken = F.when(F.col("open"), (F.col("out") == 0) | (F.col("into") == 0)).when(F.col("most") > 0, F.col("surplus") >= F.greatest(F.lit(1), F.ceil(F.col("most") * F.lit(share)))).otherwise(F.col("id") == F.col("first"))
    gone = degree.join(whole, "scc").where(taken).select("scc", "id", F.when(F.col("open") & (F.col("out") == 0), "right").otherwise("left").alias("side"), "surplus", "open")
    # edges within a bucket; between sources or sinks there are none
    bucket = gone.where(~F.col("open"))
    a, z = (bucket.select("scc", F.col("id").alias(end), F.col("surplus").alias(f"{end}_surplus")) for end in ("src", "dst"))
    ahead = F.struct(-F.col("src_surplus"), "src") < F.struct(-F.col("dst_surplus"), "dst")
    flips = left.join(a, ["scc", "src"]).join(z, ["scc", "dst"]).groupBy("scc").agg((2 * F.count_if(ahead) < F.count("*")).alias("flip"))
    return gone.join(flips, "scc", "left").select("scc", "id", "side", "surplus", F.coalesce("flip", F.lit(False)).alias("flip"))


def feedback_order(inside: DataFrame, share: float = BUCKET) -> DataFrame:
    """inside(scc, src, dst): distinct edges within tangles -> scc, id, side, round, surplus, flip; see `points_back`.

    Each round hands the edges that are left on as a table.  Nodes that lost all their edges before they were taken stand in the
    middle, between the left side and the right one: their neighbours are all further out.
    """
    left = step(one_way(inside))
    nodes = inside.select("scc", F.col("src").alias("id")).union(inside.select("scc", "dst")).distinct()
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        gone = step(peeled(left, share).withColumn("round", F.lit(len(rounds))))
        rounds.append(gone)
        ids = gone.select("scc", "id")
        left = step(left.join(ids.withColumnRenamed("id", "src"), ["scc", "src"], "left_anti").join(ids.withColumnRenamed("id", "dst"), ["scc", "dst"], "left_anti"))
    middle = nodes
    if rounds:
        middle = nodes.join(reduce(DataFrame.unionByName, rounds).select("scc", "id"), ["scc", "id"], "left_anti")
    middle = middle.select("scc", "id", F.lit("left").alias("side"), F.lit(0).cast("bigint").alias("surplus"), F.lit(False).alias("flip"), F.lit(len(rounds)).alias("round"))
    return reduce(DataFrame.unionByName, rounds, middle)


def points_back() -> Column:
    """Whether an edge with the places of both ends (a_, z_) leads from the later to the earlier."""

    def key(end: str) -> Column:
        right = F.col(f"{end}_side") == "right"
        return F.struct(right, F.when(right, -F.col(f"{end}_round")).otherwise(F.col(f"{end}_round")))

    within = F.struct(-F.col("a_surplus"), "src") > F.struct(-F.col("z_surplus"), "dst")
    return F.when(key("a") == key("z"), F.when(F.col("a_flip"), ~within).otherwise(within)).otherwise(key("a") > key("z"))


def ordered(scc: DataFrame, edges: DataFrame, share: float = BUCKET) -> tuple[DataFrame, DataFrame]:
    """The distinct edges within tangles (scc, src, dst) and the `feedback_order` of their nodes."""
    inside = step(inner_edges(scc, edges.withColumn("weight", F.lit(1))).select("scc", "src", "dst").distinct())
    return inside, step(feedback_order(inside, share))


def feedback_edges(scc: DataFrame, edges: DataFrame, share: float = BUCKET) -> DataFrame:
    """scc, src, dst, back of the edges within tangles: without those that point back no cycle is left."""
    return marked_edges(*ordered(scc, edges, share))


def marked_edges(inside: DataFrame, order: DataFrame) -> DataFrame:
    a, z = (order.select("scc", F.col("id").alias(end), *[F.col(c).alias(f"{name}_{c}") for c in ("side", "round", "surplus", "flip")]) for end, name in (("src", "a"), ("dst", "z")))
    return inside.join(a, ["scc", "src"]).join(z, ["scc", "dst"]).select("scc", "src", "dst", points_back().alias("back"))


def places(order: DataFrame) -> DataFrame:
    """scc, id, place of a `feedback_order`: places compare as its nodes stand; written, as the numbers depend on the partitions."""
    right = F.col("side") == "right"
    rows = order.select("scc", "id", right.alias("right"), F.when(right, -F.col("round")).otherwise(F.col("round")).alias("turn"), (-F.col("surplus")).alias("less"), "flip")
    keys = ["scc", "right", "turn", "less", "id"]
    n = F.monotonically_increasing_id()
    return step(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("scc", "id", F.struct("right", "turn", F.when(F.col("flip"), -n).otherwise(n).alias("n")).alias("place")))


def all_rise(rest: DataFrame, order: DataFrame) -> bool:
    """Whether each edge of rest (scc, src, dst) leads from a lower place to a higher one; then no cycle can be in rest."""
    at = places(order)
    a, z = (at.select("scc", F.col("id").alias(end), F.col("place").alias(f"{end}_place")) for end in ("src", "dst"))
    rows = rest.join(a, ["scc", "src"], "left").join(z, ["scc", "dst"], "left")
    return not rows.where(~F.coalesce(F.col("src_place") < F.col("dst_place"), F.lit(False))).limit(1).count()


def still_cyclic(marked: DataFrame) -> DataFrame:
    """scc, cyclic: how many nodes of a tangle are on a cycle of the edges that don't point back; tangles without any have no row."""
    ends = marked.select("scc", F.col("src").alias("id")).union(marked.select("scc", "dst")).distinct()
    again = components(ends.select("id").distinct(), marked.where(~F.col("back")).select("src", "dst"))
    caught = again.join(again.groupBy("scc").agg(F.count("*").alias("k")).where("k > 1"), "scc").select("id").join(ends.select(F.col("scc").alias("tangle"), "id"), "id")
    return caught.groupBy(F.col("tangle").alias("scc")).agg(F.count("*").alias("cyclic"))


def feedback_check(marked: DataFrame, order: DataFrame | None = None) -> DataFrame:
    """The edges of `feedback_edges` -> scc, nodes, edges, two_cycles, back, bound, within, cyclic: a row a tangle.

    The bound is m / 2 - n / 6 of the edges outside two-cycles and their nodes, and one for each two-cycle; `cyclic` counts the
    nodes that are still on a cycle when the back edges are gone, which is 0.  An order in which all other edges rise shows
    that at once; without one, or where an edge doesn't rise, the components of the rest tell, and as these peel the rest layer by
    layer, a dense tangle takes about as many rounds as its longest path has nodes.
    """
    marked = step(marked)
    single = one_way(marked.select("scc", "src", "dst"))
    ends = lambda rows: rows.select("scc", F.col("src").alias("id")).union(rows.select("scc", "dst"))
    size = ends(marked).groupBy("scc").agg(F.count_distinct("id").alias("nodes"))
    few = ends(single).groupBy("scc").agg((F.count("*") / 2).cast("bigint").alias("m"), F.count_distinct("id").alias("n"))
    counts = marked.groupBy("scc").agg(F.count("*").alias("edges"), F.count_if("back").alias("back"))
    if order is not None and all_rise(marked.where(~F.col("back")), order):
        cyclic = marked.groupBy("scc").agg(F.lit(0).cast("bigint").alias("cyclic"))
    else:
        cyclic = still_cyclic(marked)
    rows = size.join(counts, "scc").join(few, "scc", "left").join(cyclic, "scc", "left").na.fill(0, ["m", "n", "cyclic"])
    pairs = ((F.col("edges") - F.col("m")) / 2).cast("bigint")
    # in sixths, so that the comparison is exact
    sixths = 3 * F.col("m") - F.col("n") + 6 * pairs
    return rows.select("scc", "nodes", "edges", pairs.alias("two_cycles"), "back", half_even(sixths / 6, 4).alias("bound"), (6 * F.col("back") <= sixths).alias("within"), "cyclic")
