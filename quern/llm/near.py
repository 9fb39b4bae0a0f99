"""Near-duplicate classes: ProbMinHash signatures, banding, and verification.

Words are the runs of letters, digits and underscores of the lower-cased text; shingles are five words in a row (all
words where there are fewer).  A shingle that occurs n times weighs 1 + ln n.  ProbMinHash lets each shingle arrive
as a Poisson process whose rate is its weight, each arrival at a random one of REGISTERS registers; a register keeps
the shingle that came first, and a shingle stops arriving once its time is past the latest register.  Two texts'
registers agree with the probability Jaccard similarity of their weighted shingles.  Texts whose registers agree in a
whole band are compared; a link is a Jaccard similarity of the distinct shingles of at least LEAST, and a class is a
connected component of links.

Repeated lines can make the weighted similarity of a link far less than LEAST, so each text also has the bands of its
shingles with weight 1 each, whose registers agree with the very similarity of the rule.  Without a repeated shingle
both signatures are the same, so only texts with one have more than BANDS keys.

Copies (equal word sequences, null and wordless texts as the empty sequence) fall in one class before any banding, so
that a group of copies costs no comparison.  In a band's bucket of up to SMALL texts all pairs are compared.  In a
larger one every text is compared with a hub, in ROUNDS rounds with other hubs (the shortest text first), so that large
groups fall in one class early at n comparisons a round.  The texts of larger buckets that still hold several classes
go through `rest_pairs`, which loses no link between two of them and yet makes no square of a common passage:

* Two texts that share a shingle of at most RARE of these texts meet there, if it is among the rarest that each may
  not share (the prefix of a set join): groups of RARE texts at most.
* Two linked texts that share none have few such shingles each, and what they share are frequent ones alone.  Call a
  text's frequent shingles its profile, and the text with the fewest others the hub of its profile.  Then i and j of
  the profiles P and Q are linked only if the hubs of P and Q are, i and the hub of Q, j and the hub of P: a hub has no
  more other shingles than any text of its profile, so it is no less alike.  So it is enough to compare each text with
  the hub of its profile, hubs of similar profiles with each other, and texts that differ in class from their own hub
  with hubs of similar profiles.  Texts that share a passage and little else have one profile, so they cost one
  comparison each.

Ids are cast to bigint; rows whose id is null or no number get a null class and match nothing.  Rows that share an id
count as one document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import Tables, arrow_map, blocks, give_back, table, written

REGISTERS, ROWS = 96, 4
BANDS = REGISTERS // ROWS
SHINGLE, LEAST = 5, 0.8
#: Texts in a bucket of which all pairs are compared.
SMALL = 8
#: Bands whose hubs are compared first; the links found there spare most other comparisons.
FIRST_BANDS = 4
#: Rounds with other hubs; they spare comparisons, and `rest_pairs` loses nothing that they leave.
ROUNDS = 3
#: Texts that share a rare shingle at most.
RARE = 16
#: Words whose hashes a worker remembers.
KNOWN_WORDS = 200_000
WORD = re.compile(r"\w+")
#: A broadcast set of hashed ids has this many values at most.
ID_BUCKETS = 1 << 18


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    words = WORD.findall((text or "").lower())
    if len(known) > KNOWN_WORDS:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash of each run of SHINGLE words, in order."""
    if not len(words):
        return words
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = mixed(out + words[i : i + n] * np.uint64(0x9E3779B97F4A7C15))
    return out


def prob_min_hash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, docs: int, registers: int = REGISTERS) -> np.ndarray:
    """The registers [docs, registers] of the distinct shingles of many documents at once (0 where a document has none)."""
    least, kept = np.full(docs * registers, np.inf), np.zeros(docs * registers, np.uint64)
    at, who, what, rate = np.zeros(len(doc)), doc, shingle, weight
    turn = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(who):
            turn += np.uint64(1)
            seed = mixed(what + turn * np.uint64(0xD1342543DE82EF95))
            at = at - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
            alive = at < least.reshape(docs, registers).max(axis=1)[who]
            at, who, what, rate, seed = at[alive], who[alive], what[alive], rate[alive], seed[alive]
            slot = who * registers + (mixed(seed) % np.uint64(registers)).astype(np.int64)
            np.minimum.at(least, slot, at)
            won = least[slot] == at
            kept[slot[won]] = what[won]
    return kept.reshape(docs, registers)


def band_keys(kept: np.ndarray) -> np.ndarray:
    """[documents, bands] as signed integers."""
    with np.errstate(over="ignore"):
        parts = kept.reshape(len(kept), -1, ROWS)
        key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2])
        for i in range(ROWS):
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return key.view(np.int64)


def sign_task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    known = WordHashes()
    for ids, texts in blocks(batches):
        words = [word_hashes(t, known) for t in texts]
        with np.errstate(over="ignore"):
            found = [np.unique(shingles(w), return_counts=True) for w in words]
        doc = np.repeat(np.arange(len(ids)), [len(s) for s, _ in found])
        shingle, count = (np.concatenate([x[i] for x in found]) for i in (0, 1))
        plain = band_keys(prob_min_hash(doc, shingle, np.ones(len(doc)), len(ids)))
        bands = [b if len(s) else [] for b, (s, _) in zip(plain, found, strict=True)]
        again = np.unique(doc[count > 1])
        if len(again):
            those = np.isin(doc, again)
            weighted = band_keys(prob_min_hash(np.searchsorted(again, doc[those]), shingle[those], 1 + np.log(count[those]), len(again)))
            for i, w in zip(again.tolist(), weighted, strict=True):
                bands[i] = np.concatenate((plain[i], w[w != plain[i]]))
        yield {"id": ids, "copy": [xxhash.xxh3_128_digest(w.tobytes()) for w in words], "size": [len(s) for s, _ in found], "bands": bands}


def shingle_task(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The sorted distinct shingles, cut to 32 bits: within a pair of texts chance matches are below one in a million."""
    known = WordHashes()
    for ids, texts in blocks(batches):
        with np.errstate(over="ignore"):
            found = [np.unique((shingles(word_hashes(t, known)) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for t in texts]
        yield {"id": ids, "shingles": found}


def number(id_: str) -> Column:
    """An id as bigint, as the classes have it."""
    return F.col(id_).try_cast("bigint")


def bucket(id_: Column) -> Column:
    return F.pmod(F.xxhash64(id_.try_cast("bigint")), F.lit(ID_BUCKETS))


def split_by(rows: DataFrame, id_: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be among ids, the others), told by a broadcast set of ID_BUCKETS values at most.

    It only spares a shuffle: where the set is full, all rows are in the first part.
    """
    marks = F.broadcast(ids.select(bucket(F.col("id")).alias("__quern_bucket")).distinct())
    on = bucket(F.col(id_)) == F.col("__quern_bucket")
    return rows.join(marks, on, "left_semi"), rows.join(marks, on, "left_anti")


def alike(a: str, b: str, least: float = LEAST) -> Column:
    """Whether sets of these sizes can have the similarity `least`."""
    return F.least(a, b) >= least * F.greatest(a, b)


def all_pairs(rows: DataFrame, key: str) -> DataFrame:
    """The pairs (a < b) with different labels that share a key, from rows (key, node, size, label) with few rows a key."""
    met = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("node", "size", "label"))).alias("all"), F.min("label").alias("l"), F.max("label").alias("h"))
    met = met.where("l <> h").select("all").distinct()
    met = met.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y")).where("x.node < y.node and x.label <> y.label")
    return met.where(alike("x.size", "y.size")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))


def pairs_of(rows: DataFrame, turn: int) -> DataFrame:
    """The pairs (a < b) to compare in a round, from rows (key, n, node, size, label)."""
    many = rows.where(F.col("n") > SMALL)
    order = F.struct("size", "node", "label") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "size", "node", "label")
    hubs = many.groupBy("key").agg(F.min(order).alias("hub"), F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    hubs = hubs.select("key", F.col("hub.node").alias("hub"), F.col("hub.size").alias("hub_size"), F.col("hub.label").alias("hub_label"))
    many = many.join(hubs, "key").where("node <> hub and label <> hub_label").where(alike("size", "hub_size"))
    many = many.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    return (many.unionByName(all_pairs(rows.where(F.col("n") <= SMALL), "key")) if turn == 1 else many).distinct()


def linked(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose shingle sets have a Jaccard similarity of at least `least`."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= least * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def mixed_nodes(met: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label) of the texts of large buckets that hold more than one class."""
    rows = met.where(F.col("n") > SMALL).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    keys = rows.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("key")
    return rows.join(keys, "key", "left_semi").select("node", "label").distinct()


def prefix(size: Column, need: Column) -> Column:
    """How many of a set's first members hold one of any `need` members."""
    return F.greatest(F.lit(0), size - F.ceil(need - 1e-9).cast("int") + 1)


def rest_pairs(nodes: DataFrame, sets: DataFrame, least: float = LEAST, rare: int = RARE, written: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """Pairs (a < b) of nodes (node, label) with different labels; their links join all nodes that any links join."""
    own = sets.join(nodes, F.col("id") == F.col("node")).select("node", "label", F.size("shingles").alias("size"), "shingles")
    each = own.select("node", "label", "size", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    ranked = each.join(often, "shingle").groupBy("node", "label", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("all"))
    ranked = written(ranked, "ranked")
    alone = F.col("size") - F.size("all")
    first = F.slice("all", F.lit(1), F.greatest(F.lit(0), prefix(F.col("size"), least * F.col("size")) - alone))
    few = ranked.select("node", "label", "size", F.explode(first).alias("x")).where(F.col("x.n") <= rare).withColumn("shingle", F.col("x.shingle"))
    # the texts that may be linked without a rare shingle in common
    often = F.transform(F.filter("all", lambda x: x["n"] > rare), lambda x: x["shingle"])
    plain = ranked.select("node", "label", "size", often.alias("profile")).withColumn("others", F.col("size") - F.size("profile"))
    plain = plain.where(F.col("others") <= (1 - least) / least * F.size("profile") + 1e-9)
    plain = written(plain.withColumn("key", F.struct(F.xxhash64("profile"), F.xxhash64(F.lit(1), "profile"))), "plain")
    hubs = plain.groupBy("key").agg(F.min(F.struct("others", "node", "label", "profile")).alias("hub")).select("key", "hub.*")
    members = plain.join(hubs.select("key", F.col("node").alias("hub"), F.col("label").alias("hub_label")), "key").where("label <> hub_label")
    owns = members.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))

    def starts(rows: DataFrame) -> DataFrame:
        held = F.slice("profile", F.lit(1), prefix(F.size("profile"), least * (F.size("profile") + F.col("others"))))
        rows = rows.select("key", "node", "label", F.col("others"), F.size("profile").alias("size"), held.alias("held"))
        return rows.withColumn("shingle", F.explode("held"))

    every = starts(hubs)
    mixed_ = every.groupBy("shingle").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h").select("shingle")
    every = every.join(mixed_, "shingle", "left_semi")
    strays = starts(members.select("key", "node", "label", "others", "profile"))
    one, two = strays.withColumn("stray", F.lit(True)).unionByName(every.withColumn("stray", F.lit(False))).alias("x"), starts(hubs).alias("y")
    differ = (F.col("x.label") != F.col("y.label")) & (F.col("x.key") != F.col("y.key")) & (F.col("x.stray") | (F.col("x.node") < F.col("y.node")))
    small, large = F.least("x.size", "y.size"), F.greatest("x.size", "y.size") + F.col("x.others") + F.col("y.others")
    # each pair once: at the first shingle that both hold
    here = F.element_at(F.array_intersect("x.held", "y.held"), 1) == F.col("x.shingle")
    met = one.join(two, (F.col("x.shingle") == F.col("y.shingle")) & differ & (small >= least * large) & here)
    across = met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))
    return all_pairs(few, "shingle").unionByName(owns).unionByName(across).distinct()


def components(edges: DataFrame, written: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, label) of all ends of edges (a, b): the label is the least node of the connected component.

    Each step takes the least label of the neighbours and then the label's own label, so that long chains halve.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = step.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = written(step.join(own, "label").select("node", "old", F.col("up").alias("label")), "labels")
        if not new.where("old <> label").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def classes(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, class): a row for each row of docs; the class is its least id, and null where the id is."""
    with Tables(docs.sparkSession) as tables:
        return tables.kept(found_classes(docs.select(number(id_).alias("id"), F.col(text).alias("text")), tables.written), "classes")


def found_classes(docs: DataFrame, written: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    rows = docs.where("id is not null")
    signed = written(arrow_map(rows, sign_task, "id bigint, copy binary, size int, bands array<bigint>"), "signed")
    nodes = written(signed.groupBy("copy").agg(F.min("id").alias("node")), "nodes")
    banded = signed.join(nodes, (F.col("id") == F.col("node")) & (signed["copy"] == nodes["copy"])).select("node", "size", "bands").dropDuplicates(["node"])
    keyed = banded.select("node", "size", F.posexplode("bands").alias("band", "key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = written(keyed.join(shared, "key"), "met")
    ids = written(met.select(F.col("node").alias("id")).distinct(), "ids")
    some, _ = split_by(rows, "id", ids)
    sets = written(arrow_map(some.join(ids, "id", "left_semi").dropDuplicates(["id"]), shingle_task, "id bigint, shingles array<int>"), "sets")
    links: list[DataFrame] = []
    labels = None
    for turn in range(ROUNDS):
        now = met.where(F.col("band") < FIRST_BANDS) if turn == 0 else met
        if labels is None:
            now = now.withColumn("label", F.col("node"))
        else:
            now = now.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        new = written(linked(pairs_of(now, turn), sets), "links")
        if not new.limit(1).count():
            if turn:
                break
            continue
        links.append(new)
        give_back()
        labels = components(reduce(DataFrame.unionByName, links), written)
    known = met.select("node", F.col("node").alias("label")).distinct() if labels is None else labels
    rest = written(mixed_nodes(met, known), "rest")
    if rest.limit(1).count():
        links.append(written(linked(rest_pairs(rest, sets, written=written), sets), "links"))
        give_back()
        labels = components(reduce(DataFrame.unionByName, links), written)
    member = signed.select("id", "copy").join(nodes, "copy")
    if labels is None:
        out = member.select("id", F.col("node").alias("class"))
    else:
        out = member.join(labels, "node", "left").select("id", F.coalesce("label", "node").alias("class"))
    return out.unionByName(docs.where("id is null").select("id", F.lit(None).cast("bigint").alias("class")))


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, all columns as they were, without those that have a smaller id in their class.

    Only rows that may go are shuffled.  Of rows that share an id one stays; rows without an id all stay.
    """
    found = classes(docs, id_, text).where("id is not null")
    gone = found.where(F.col("id") != F.col("class")).select("id").distinct()
    repeated = found.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    perhaps, safe = split_by(docs, id_, gone.union(repeated))
    left = perhaps.withColumn("__quern_id", number(id_)).where("__quern_id is not null")
    left = left.join(gone.select(F.col("id").alias("__quern_gone")), F.col("__quern_id") == F.col("__quern_gone"), "left_anti")
    return safe.unionByName(perhaps.where(number(id_).isNull())).unionByName(left.dropDuplicates(["__quern_id"]).drop("__quern_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.coalesce(F.col("id") == F.col("class"), F.lit(True)).alias("kept"))
