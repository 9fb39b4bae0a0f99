"""Sharding by a Feistel permutation: against plain Python, both ways, and the edge cases that its docstring states."""

from __future__ import annotations

import zlib

import pytest
from pyspark.sql import functions as F

from quern.llm import shards

DOCS = "doc_id bigint, text string, shard string, row string, quern_note int"


def plain(n: int, seed: int) -> list[int]:
    """The position of each of n rows, one by one."""
    a, b = shards.sides(n)

    def hashed(x: int, k: int) -> int:
        m1, c1, m2, c2 = shards.keys(seed, k)
        t = (x * m1 + c1) % shards.PRIME
        t = ((t * t + x) % shards.PRIME * m2 + c2) % shards.PRIME
        return (t * t + x) % shards.PRIME

    def network(x: int) -> int:
        left, right = divmod(x, b)
        for k in range(0, shards.ROUNDS, 2):
            left = (left + hashed(right, k)) % a
            right = (right + hashed(left, k + 1)) % b
        return left * b + right

    out = []
    for x in range(n):
        x = network(x)
        while x >= n:
            x = network(x)
        out.append(x)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 13, 24, 50, 101, 1000, 4099])
def test_permutation_is_the_plain_one_and_goes_back(spark, n):
    for seed in (0, 12):
        p = shards.permutation(spark, n, seed)
        rows = spark.range(n).select("id", p.ahead(F.col("id")).alias("p")).select("id", "p", p.back(F.col("p")).alias("again")).collect()
        got = [r.p for r in sorted(rows)]
        assert sorted(got) == list(range(n)) and got == plain(n, seed) and all(r.id == r.again for r in rows)


def test_positions_are_spread(spark):
    """Neighbours part: of 20,000 rows, each tenth of the numbers has about a tenth of the positions of every tenth."""
    n = 20_000
    p = shards.permutation(spark, n)
    cells = spark.range(n).select((F.col("id") * 10 / n).cast("int").alias("a"), (p.ahead(F.col("id")) * 10 / n).cast("int").alias("b")).groupBy("a", "b").count().collect()
    assert len(cells) == 100 and sum((r["count"] - 200) ** 2 / 200 for r in cells) < 160


def test_one_walk_less_would_leave_numbers_outside(spark):
    n = 5
    p = shards.permutation(spark, n, 3)
    short = shards.Permutation(n, 3, p.walks - 1)
    if p.walks:
        assert spark.range(n).where(short.ahead(F.col("id")) >= n).count()


def test_rows_find_their_slots(spark):
    texts = [None, "", "a", "a", "é" * 10, "x" * 300_000, *[f"text {i}" for i in range(94)]]
    ids = [None, 7, 7, 7, 3, -2, *range(100, 194)]
    docs = spark.createDataFrame([(i, t, "s", "r", 1) for i, t in zip(ids, texts, strict=True)], DOCS)
    rows = shards.placed(docs, shards=7).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows) == sorted((i is not None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(ids, texts, strict=True))
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert sorted(by) == list(range(7)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    order = sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32, r.row) for r in rows)
    assert [x[-1] for x in order] == list(range(100))
    position = plain(100, shards.SEED)
    assert all(divmod(position[r.row], 7) == (r.slot, r.shard) for r in rows)


def test_the_shuffle_does_not_hang_on_partitions_and_equal_rows_spread(spark):
    rows = [(5, "copy", "s", "r", 1)] * 4000 + [(i, f"t{i}", "s", "r", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, DOCS)
    seen = [sorted(map(tuple, shards.placed(d).drop("row").collect()), key=str) for d in (docs.coalesce(1), docs.repartition(9))]
    assert seen[0] == seen[1] and len(seen[0]) == 6000
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = shards.in_order(shards.measured(docs.repartition(9)), ["doc_id", "size", "text_crc32"]).where("doc_id = 5").select("quern_part").distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


def test_extra_columns_stay_and_places_lead_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "s", "r", i) for i in range(53)], DOCS)
    out = shards.sharded(docs, ["doc_id"], shards=4)
    rows = {(r.shard, r.slot): r for r in out.collect()}
    assert out.columns == ["doc_id", "text", "quern_note", "row", "shard", "slot"] and all(r.quern_note == r.doc_id == r.row for r in rows.values())
    asked = spark.createDataFrame([(s, t) for s in range(-1, 5) for t in range(-1, 15)], "shard int, slot bigint")
    for r in shards.rows_at(asked, 53, shards=4).collect():
        assert r.row == (rows[r.shard, r.slot].row if (r.shard, r.slot) in rows else None)
    shards.write(out, f"file://{tmp_path}/out", file_rows=5)
    back = spark.read.parquet(f"file://{tmp_path}/out")
    assert back.count() == 53 and back.where("shard = 2").count() == len([1 for s, _ in rows if s == 2])


def test_empty_table(spark):
    docs = spark.createDataFrame([], DOCS)
    assert shards.placed(docs).count() == 0 and shards.sharded(docs, ["doc_id"]).count() == 0
    assert shards.rows_at(spark.createDataFrame([(0, 0)], "shard int, slot bigint"), 0).collect()[0].row is None


def test_main_path_runs_no_python(spark):
    docs = spark.createDataFrame([(i, f"t{i}", "s", "r", i) for i in range(20)], DOCS)
    plan = shards.placed(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
