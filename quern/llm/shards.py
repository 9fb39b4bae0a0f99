"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Rows get their global numbers 0 to n - 1 in the order of some columns, a permutation that n and a seed fix moves each
number to a position, and position p is slot p // shards of shard p % shards.  So the shuffle is the same wherever and
however often it runs, sizes of shards differ by one row at most, slots have no gaps, and both ways are arithmetic: where
a row goes (`Permutation.ahead`) and which row stands in a slot (`Permutation.back`), without a look at other rows.

The permutation is a Feistel network on pairs (left, right) of a * b >= n numbers, a and b about the root of n; rounds add
a keyed hash of one half to the other, modulo its size.  Positions beyond n - 1 are walked on: the network is applied
again until the position is below n.  Fewer than a numbers lie beyond, so hardly a row walks; how many steps the
longest walk takes is found from those numbers themselves, each of which is looked at, so no walk is cut short.

Everything is columns of integers.  Global numbers come from one range partitioning: only a count of rows for each of its
partitions is summed, whatever the data, and rows that agree in all columns are dealt over partitions too.

Rows whose order columns agree get neighbouring numbers, one as good as the other; nulls come first; a null text has no
bytes and the checksum of the empty text.  An empty table gives an empty one.  Columns that are there already under the
names that the operator writes (`row`, `shard`, `slot`) are replaced; other extra ones stay.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import in_order, scratch, table, written_at

SHARDS, SEED = 24, 12
ROUNDS = 8
#: The rounds' hashes are taken modulo this prime; halves stay below it, so a product of two stays within 62 bits.
PRIME = (1 << 31) - 1
#: Rows of a file of `write`.
FILE_ROWS = 1 << 20


def keys(seed: int, k: int) -> list[int]:
    """The four constants of round k, from 1 to PRIME - 1."""
    return [1 + zlib.crc32(f"{seed}/{k}/{i}".encode()) % (PRIME - 1) for i in range(4)]


def sides(n: int) -> tuple[int, int]:
    """The sizes a and b of the halves: a * b is n or less than a above it."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, max(1, -(-n // a))


def hashed(half: Column, key: Column) -> Column:
    t = (half * key[0] + key[1]) % PRIME
    t = ((t * t + half) % PRIME * key[2] + key[3]) % PRIME
    return (t * t + half) % PRIME


def floor_div(x: Column, by: int) -> Column:
    return F.call_function("div", x, F.lit(by).cast("bigint"))


@dataclass(frozen=True)
class Permutation:
    """Of the numbers 0 to n - 1; `walks` is how often the network is applied again at most (see `permutation`)."""

    n: int
    seed: int = SEED
    walks: int = 0

    def network(self, x: Column, back: bool = False) -> Column:
        """A number below a * b sent through the network, or back: a fold over the rounds, the half to change first."""
        a, b = sides(self.n)
        rounds = [[*keys(self.seed, k), a if k % 2 == 0 else b] for k in range(ROUNDS)]
        rounds = F.array(*[F.array(*[F.lit(v).cast("bigint") for v in r]) for r in (rounds[::-1] if back else rounds)])
        left, right = floor_div(x, b), x % b

        def one(at: Column, key: Column) -> Column:
            add = hashed(at["of"], key) % key[4]
            return F.struct(at["of"].alias("to"), ((at["to"] + (key[4] - add if back else add)) % key[4]).alias("of"))

        first = F.struct((right if back else left).alias("to"), (left if back else right).alias("of"))
        return F.aggregate(rounds, first, one, lambda at: at["of"] * b + at["to"] if back else at["to"] * b + at["of"])

    def walked(self, x: Column, back: bool) -> Column:
        """A number below n sent through the network until it is below n again."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(self.walks)), self.network(x, back), lambda at, _: F.when(at < self.n, at).otherwise(self.network(at, back))) if self.walks else self.network(x, back)

    def ahead(self, row: Column) -> Column:
        """The position of a row number."""
        return self.walked(row.cast("bigint"), back=False)

    def back(self, position: Column) -> Column:
        """The row number at a position."""
        return self.walked(position.cast("bigint"), back=True)


def permutation(spark: SparkSession, n: int, seed: int = SEED) -> Permutation:
    """The permutation of n numbers, with the length of its longest walk.

    A walk enters the numbers beyond n - 1 from below n and leaves them again, as the network is one to one; all such
    entries are followed at once, in as many steps as the longest needs (forth and back take the same).
    """
    a, b = sides(n)
    p = Permutation(n, seed)
    beyond = spark.range(n, a * b).select(F.col("id").alias("x")).where(p.network(F.col("x"), back=True) < n)
    walks = 0
    while n and beyond.limit(1).count():
        beyond = beyond.select(p.network(F.col("x")).alias("x")).where(F.col("x") >= n)
        walks += 1
    return Permutation(n, seed, walks)


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """rows with their global number `row` in the order of these columns, and how many there are.

    The rows are written once, in order; of the parts' counts, a row for each partition of the shuffle, running sums are
    joined to them.
    """
    spark = rows.sparkSession
    held = rows.drop("row")
    placed = written_at(in_order(held, order), scratch(spark, "ordered"))
    counts = placed.groupBy("quern_part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("quern_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("quern_part", F.coalesce(before, F.lit(0)).alias("quern_base"))
    out = placed.join(F.broadcast(bases), "quern_part").withColumn("row", F.col("quern_base") + F.col("quern_within"))
    return out.select(*held.columns, "row"), placed.count()


def sharded(rows: DataFrame, order: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """rows with row, shard and slot; `order` names the columns that number the rows."""
    out, n = numbered(rows.drop("shard", "slot"), order)
    place = "quern_position"
    out = out.withColumn(place, permutation(rows.sparkSession, n, seed).ahead(F.col("row")))
    return out.withColumns({"shard": (F.col(place) % shards).cast("int"), "slot": floor_div(F.col(place), shards)}).drop(place)


def rows_at(places: DataFrame, n: int, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """places(shard, slot) with the global number `row` of the row that stands there; NULL where there is none."""
    position = F.col("slot").cast("bigint") * shards + F.col("shard")
    there = (F.col("shard") >= 0) & (F.col("shard") < shards) & (F.col("slot") >= 0) & (position < n)
    row = permutation(places.sparkSession, n, seed).back(F.when(there, position)) if n else F.lit(None).cast("bigint")
    return places.drop("row").withColumn("row", row)


def write(placed: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """The rows of each shard as Parquet files under shard=<number>, each a run of slots in order and `file_rows` rows at most."""
    run = floor_div(F.col("slot"), file_rows)
    spread = placed.withColumn("quern_run", run).repartition("shard", "quern_run").sortWithinPartitions("shard", "quern_run", "slot")
    spread.drop("quern_run").write.partitionBy("shard").option("maxRecordsPerFile", file_rows).parquet(path)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8 more) and text_crc32 of whole texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text).cast("bigint") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def placed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The shard and slot of each document, by the law of equal counts of rows: equal texts aren't kept together."""
    out = sharded(measured(docs), ["doc_id", "size", "text_crc32"], shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed(table(spark, sf_dir, "documents"))


# -- the same in SQL


def _hashed_sql(half: str, k: int) -> str:
    m1, c1, m2, c2 = keys(SEED, k)
    t = f"(({half} * {m1} + {c1}) % {PRIME})"
    t = f"((({t} * {t} + {half}) % {PRIME} * {m2} + {c2}) % {PRIME})"
    return f"({t} * {t} + {half}) % {PRIME}"


def _network_sql(rows: str) -> str:
    """rows(id, x) with x sent through the network; `dims` holds a, b and n."""
    sql = f"SELECT id, x // b AS l, x % b AS r, a, b FROM {rows}, dims"
    for k in range(ROUNDS):
        changed = f"l, (r + {_hashed_sql('l', k)}) % b AS r" if k % 2 else f"(l + {_hashed_sql('r', k)}) % a AS l, r"
        sql = f"SELECT id, {changed}, a, b FROM ({sql})"
    return f"SELECT id, l * b + r AS x FROM ({sql})"


def _crc_sql() -> str:
    """CRC-32 of a text's bytes: the table's entry of a byte is the sum, without carries, of those of its bits."""

    def entry(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c

    sql = "(c >> 8)"
    for i in range(8):
        sql = f"xor({sql}, {entry(1 << i)} * ((xor(c, y) >> {i}) & 1))"
    digits = "regexp_extract_all(hex(encode(coalesce(text, ''))), '..')"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform({digits}, lambda h: ('0x' || h)::BIGINT)), lambda c, y: {sql}), 4294967295)"


ORACLE_SQL = f"""WITH RECURSIVE measured AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, ''))::BIGINT + 8 AS size, {_crc_sql()}::BIGINT AS text_crc32 FROM documents),
numbered AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS id FROM measured),
side AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a FROM measured), dims AS MATERIALIZED (SELECT n, a, (n + a - 1) // a AS b FROM side),
walk AS ({_network_sql("(SELECT id, id AS x FROM numbered)")} UNION ALL {_network_sql("(SELECT id, x FROM walk WHERE x >= (SELECT n FROM dims))")})
SELECT doc_id, size, text_crc32, 'rows' AS law, (x % {SHARDS})::INTEGER AS shard, x // {SHARDS} AS slot, NULL::INTEGER AS grown_shard, id AS row
FROM numbered JOIN walk USING (id) WHERE x < (SELECT n FROM dims)"""
