"""Strong components and reachability of graphs of any size, as rounds of joins.

Nodes get numbers in the order of a hash, so joins are on integers and a number is as good as a random priority.  Components:
nodes of two-cycles are merged first, again and again, and nodes without an edge in or out go.  Of what is left the closure is
taken by squaring, as rows of 64 bits, while it holds no more than PAIRS pairs.  Where it holds more, each node takes the
least number that reaches it, edges between nodes of different such colours are no cycle's and go, and what reaches a
colour's own node is its component; all colours are worked at once, a few hops a job.  Both ways give the same.

Reachability is kept for components alone: the set of nodes that a component reaches is a bit for each node, 64 to a row
of (component, word, bits).  Sets are carried along the condensed graph from its sinks on, each once, and united by
`bit_or`; counts are sums of `bit_count`.  So a tangle of any size is one set, and no pairs of its nodes are made.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.shared import step

#: Hops of a job; more make fewer jobs with longer plans.
HOPS = 4
#: So many pairs the closure of what is left by merging and trimming may hold to be taken by squaring.
PAIRS = 1 << 26


def numbers(ids: DataFrame) -> DataFrame:
    """id, n: distinct ids with numbers that rise with a hash of the id; written, as the numbers depend on the partitions."""
    rows = ids.select("id").distinct().withColumn("h", F.xxhash64("id"))
    return step(rows.repartitionByRange("h", "id").sortWithinPartitions("h", "id").select("id", F.monotonically_increasing_id().alias("n")))


def spread(labels: DataFrame, pairs: DataFrame, hops: int = HOPS) -> DataFrame:
    """labels (n, label) after each node has the least label of all that reach it along pairs (a, z); NULL gives nothing."""
    while True:
        now = labels.withColumn("old", F.col("label"))
        for _ in range(hops):
            came = pairs.join(now.where("label is not null").select(F.col("n").alias("a"), "label"), "a").groupBy(F.col("z").alias("n")).agg(F.min("label").alias("came"))
            now = now.join(came, "n", "left").select("n", "old", F.least("label", "came").alias("label"))
        now = step(now)
        labels = now.select("n", "label")
        if not now.where("not old <=> label").limit(1).count():
            return labels


def joined(pairs: DataFrame) -> DataFrame:
    """n, label: the least number of each connected component of pairs (a, z), which hold both directions.

    Each round takes the least label of the neighbours, then that label's own label, so far ends meet in few rounds.
    """
    labels = pairs.select(F.col("a").alias("n")).distinct().withColumn("label", F.col("n"))
    while True:
        came = pairs.join(labels.select(F.col("n").alias("a"), "label"), "a").groupBy(F.col("z").alias("n")).agg(F.min("label").alias("came"))
        near = labels.join(came, "n").select("n", F.col("label").alias("old"), F.least("label", "came").alias("label"))
        far = near.select(F.col("n").alias("label"), F.col("label").alias("further"))
        now = step(near.join(far, "label").select("n", "old", F.least("label", "further").alias("label")))
        labels = now.select("n", "label")
        if not now.where("old <> label").limit(1).count():
            return labels


def bit_of(n: str) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col(n) % 64).cast("int"))


def unpacked(sets: DataFrame) -> DataFrame:
    """c, m: a row for each node in a set (c, word, bits)."""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    return sets.select("c", F.explode(places).alias("i"), "word").select("c", (F.shiftleft("word", 6) + F.col("i")).alias("m"))


def squared(pairs: DataFrame, most: int) -> DataFrame | None:
    """c, word, bits: the nodes that each node of pairs (a, z) reaches, itself among them; None as soon as there are more than `most`."""
    ends = pairs.select(F.col("a").alias("c"), F.col("z").alias("m"))
    ends = ends.union(ends.select("c", "c")).union(ends.select("m", "m"))
    sets = ends.select("c", F.shiftright("m", 6).alias("word"), bit_of("m").alias("bits")).groupBy("c", "word").agg(F.bit_or("bits").alias("bits"))
    before = 0
    while True:
        sets = step(sets)
        total = sets.agg(F.sum(F.bit_count("bits"))).first()[0] or 0
        if total > most:
            return None
        if total == before:
            return sets
        before = total
        further = unpacked(sets).join(sets.withColumnRenamed("c", "m"), "m").select("c", "word", "bits")
        sets = further.groupBy("c", "word").agg(F.bit_or("bits").alias("bits"))


def mutual(sets: DataFrame) -> DataFrame:
    """n, label: the least node among those that a node reaches and that reach it."""
    ways = unpacked(sets)
    both = ways.join(ways.select(F.col("m").alias("c"), F.col("c").alias("m")), ["c", "m"], "left_semi")
    return both.groupBy(F.col("c").alias("n")).agg(F.min("m").alias("label"))


def renamed(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct pairs (a, z) of different nodes, after n became label for those in names."""
    for end in ("a", "z"):
        pairs = pairs.join(names.select(F.col("n").alias(end), "label"), end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    return pairs.where("a <> z").select("a", "z").distinct()


def trimmed(pairs: DataFrame) -> DataFrame:
    """The pairs that are left when nodes without an edge in, or without one out, go with their edges, a few rounds to a job."""
    size = pairs.count()
    while size:
        for _ in range(HOPS // 2):
            pairs = pairs.join(pairs.select(F.col("z").alias("a")).distinct(), "a", "left_semi").join(pairs.select(F.col("a").alias("z")).distinct(), "z", "left_semi")
        pairs = step(pairs.select("a", "z"))
        now = pairs.count()
        if now == size:
            break
        size = now
    return pairs


def coloured(left: DataFrame) -> DataFrame:
    """n, label of the nodes of trimmed pairs (a, z) that are on a cycle, by colours."""
    found = [left.select(F.col("a").alias("n"), F.col("a").alias("label")).limit(0)]
    while left.limit(1).count():
        inside = left.select(F.col("a").alias("n")).union(left.select("z")).distinct()
        colour = spread(inside.withColumn("label", F.col("n")), left)
        same = left.join(colour.select(F.col("n").alias("a"), "label"), "a").join(colour.select(F.col("n").alias("z"), F.col("label").alias("other")), "z")
        same = step(same.where("label = other").select("a", "z"))
        # backwards, only a colour's own node has a label to give, and no edge leads out of a colour
        back = spread(colour.select("n", F.when(F.col("n") == F.col("label"), F.col("label")).alias("label")), same.select(F.col("z").alias("a"), F.col("a").alias("z"))).where("label is not null")
        found.append(back)
        gone = back.select("n")
        left = trimmed(step(same.join(gone.withColumnRenamed("n", "a"), "a", "left_anti").join(gone.withColumnRenamed("n", "z"), "z", "left_anti")))
    return reduce(DataFrame.unionByName, found)


def strong(pairs: DataFrame, most: int = PAIRS) -> DataFrame:
    """n, label: one label for each component of pairs (a, z), for the nodes that share theirs with another at least."""
    left = step(pairs.where("a <> z").select("a", "z").distinct())
    merges: list[DataFrame] = []
    while True:
        both = step(left.join(left.select(F.col("z").alias("a"), F.col("a").alias("z")), ["a", "z"], "left_semi"))
        if not both.limit(1).count():
            break
        merges.append(joined(both))
        left = step(renamed(left, merges[-1]))
    left = trimmed(left)
    sets = squared(left, most)
    last = step(mutual(sets) if sets is not None else coloured(left))
    # a node's last label: merged, perhaps again, then that of the rest
    for m in reversed(merges):
        moved = m.join(last.select(F.col("n").alias("label"), F.col("label").alias("further")), "label", "left").select("n", F.coalesce("further", "label").alias("label"))
        last = moved.unionByName(last.join(m.select("n"), "n", "left_anti"))
    return step(last)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, scc): the least id of each strongly connected component, singletons included; ends outside nodes are left out."""
    named = numbers(nodes)
    labels = strong(numbered_edges(named, edges))
    rows = named.join(labels, "n", "left").select("id", F.coalesce("label", "n").alias("label"))
    least = rows.groupBy("label").agg(F.min("id").alias("scc"))
    return rows.join(least, "label").select("id", "scc")


def numbered_edges(named: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select("src", "dst").distinct()
    ends = ends.join(named.select(F.col("id").alias("src"), F.col("n").alias("a")), "src").join(named.select(F.col("id").alias("dst"), F.col("n").alias("z")), "dst")
    return ends.select("a", "z")


def reached(members: DataFrame, links: DataFrame) -> DataFrame:
    """members(c, n), links(a, z) between components without a cycle -> c, word, bits: the nodes that each reaches, its own among them.

    Rounds take the components whose successors are all done, as many rounds as the longest path has components; each set
    goes to each predecessor once.  Links and sets of a round are one table, so a round is one job.
    """
    own = members.select("c", F.shiftright("n", 6).alias("word"), bit_of("n").alias("bits")).groupBy("c", "word").agg(F.bit_or("bits").alias("bits"))
    left = links.select(F.col("a").alias("c"), F.col("z").alias("word")).where("c <> word").distinct()
    done: list[DataFrame] = []
    waiting = own
    while True:
        ahead = left.select("c").distinct().withColumn("open", F.lit(True))
        sets = waiting.join(ahead, "c", "left").select("c", "word", "bits", F.coalesce("open", F.lit(False)).alias("open"))
        state = step(sets.unionByName(left.select("c", "word", F.lit(None).cast("bigint").alias("bits"), F.lit(None).cast("boolean").alias("open"))))
        ready = state.where("not open").select("c", "word", "bits")
        done.append(ready)
        if not state.where("open is null").limit(1).count():
            return reduce(DataFrame.unionByName, done)
        links_ = state.where("open is null").select("c", F.col("word").alias("z"))
        now = ready.select(F.col("c").alias("z")).distinct()
        sent = links_.join(ready.select(F.col("c").alias("z"), "word", "bits"), "z").select("c", "word", "bits")
        waiting = state.where("open").select("c", "word", "bits").unionByName(sent).groupBy("c", "word").agg(F.bit_or("bits").alias("bits"))
        left = links_.join(now, "z", "left_anti").select("c", F.col("z").alias("word"))


def visibility(nodes: DataFrame, edges: DataFrame, scc: DataFrame | None = None) -> DataFrame:
    """id, scc, vfi, vfo: how many nodes reach a node and how many it reaches, itself among both."""
    scc = step(scc if scc is not None else components(nodes, edges))
    named = numbers(nodes)
    heads = named.select(F.col("id").alias("scc"), F.col("n").alias("c"))
    members = step(scc.join(named, "id").join(heads, "scc").select("id", "scc", "c", "n"))
    of = members.select("n", "c")
    links = numbered_edges(named, edges).join(of.select(F.col("n").alias("a"), F.col("c").alias("from")), "a").join(of.select(F.col("n").alias("z"), F.col("c").alias("to")), "z")
    links = step(links.select(F.col("from").alias("a"), F.col("to").alias("z")).where("a <> z").distinct())

    # both ways at once: component c as 2 * c along the links, as 2 * c + 1 against them
    twice = members.select((2 * F.col("c")).alias("c"), "n").union(members.select(2 * F.col("c") + 1, "n"))
    ways = links.select((2 * F.col("a")).alias("a"), (2 * F.col("z")).alias("z")).union(links.select(2 * F.col("z") + 1, 2 * F.col("a") + 1))
    seen = reached(twice, ways).groupBy("c").agg(F.sum(F.bit_count("bits")).alias("seen"))
    seen = seen.groupBy(F.shiftright("c", 1).alias("c")).agg(F.sum(F.when(F.col("c") % 2 == 1, F.col("seen"))).alias("vfi"), F.sum(F.when(F.col("c") % 2 == 0, F.col("seen"))).alias("vfo"))
    return members.join(seen, "c").select("id", "scc", "vfi", "vfo")


def core_split(seen: DataFrame, share: float = 0.5) -> DataFrame:
    """id, scc, vfi, vfo, part, vfi_cutoff, vfo_cutoff: core, shared, control or peripheral.

    A count is high if it is that of the node at rank ceil(n * share) from the top or above, and more than 1, a node's sight of
    itself; the cutoffs stand in each row.  Nodes of one tangle always fall in one part.
    """
    top = lambda c: F.expr(f"percentile_disc({share!r}D) WITHIN GROUP (ORDER BY {c} DESC)")
    cut = seen.agg(F.greatest(top("vfi"), F.lit(2)).cast("bigint").alias("vfi_cutoff"), F.greatest(top("vfo"), F.lit(2)).cast("bigint").alias("vfo_cutoff"))
    rows = seen.crossJoin(F.broadcast(cut))
    wide_in, wide_out = F.col("vfi") >= F.col("vfi_cutoff"), F.col("vfo") >= F.col("vfo_cutoff")
    part = F.when(wide_in & wide_out, "core").when(wide_in, "shared").when(wide_out, "control").otherwise("peripheral")
    return rows.select("id", "scc", "vfi", "vfo", part.alias("part"), "vfi_cutoff", "vfo_cutoff")


def liveness(nodes: DataFrame, edges: DataFrame, roles: DataFrame) -> DataFrame:
    """id, path, role, fan_in, state, confidence of each node: what no composition root or registry reaches may be dead.

    States: entry (a root, a registry or a test), live (reached from a root or a registry), tested (from tests alone), orphan
    resolver (reached from neither), unused (nothing imports it) and island (only what isn't live imports it, perhaps itself).  An
    orphan resolver is dead with high confidence; the others with low, as names may be used where no scan sees it; entries and live nodes have NULL.
    """
    named = numbers(nodes)
    pairs = step(numbered_edges(named, edges))
    known = named.join(roles.select("id", "role"), "id")
    label = F.when(F.col("role").isin("root", "registry"), 0).when(F.col("role") == "test", 1)
    reached_ = spread(known.select("n", label.cast("bigint").alias("label")), pairs)
    fan_in = pairs.where("a <> z").groupBy(F.col("z").alias("n")).agg(F.count("*").alias("fan_in"))
    rows = known.join(reached_, "n").join(fan_in, "n", "left").na.fill(0, ["fan_in"]).join(nodes.select("id", "path"), "id")
    state = (
        F.when(F.col("role").isin("root", "registry", "test"), "entry").when(F.col("label") == 0, "live").when(F.col("role") == "resolver", "orphan resolver")
        .when(F.col("label") == 1, "tested").when(F.col("fan_in") == 0, "unused").otherwise("island")
    )
    rows = rows.withColumn("state", state)
    return rows.select("id", "path", "role", "fan_in", "state", F.when(F.col("state") == "orphan resolver", "high").when(~F.col("state").isin("entry", "live"), "low").alias("confidence"))
