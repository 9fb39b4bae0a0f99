"""The Pareto front of three measures: quality, of which more is better, and cost and latency, of which less is.

A point is dominated if another is at least as good in all three and better in one.  Points with equal measures stand or fall
together.  A point with a NULL or NaN measure can't be compared: it neither dominates nor stands on the front.

Distinct points are put in a grid whose cuts are quantiles of each measure.  A cell that another occupied cell beats in
all three measures goes whole.  Each task then reduces its points to their own front, whatever cells they are in, and what
is left of a cell is held against the cells that are no worse in any measure.  No pairs of points are made: a front is found in
one sweep by falling quality, with a staircase of the least latency for each cost.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.graph import step

#: Parts of a measure; so there are CELLS ** 3 cells at most.
CELLS = 8
LOSSES = ("x", "y", "z")


def swept(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The indices of the points that no other dominates, less being better; points are distinct."""
    order = np.lexsort((z, y, x))
    costs: list[float] = []
    least: list[float] = []
    out = []
    for i, b, c in zip(order.tolist(), y[order].tolist(), z[order].tolist(), strict=True):
        at = bisect.bisect_right(costs, b)
        if at and least[at - 1] <= c:
            continue
        # costs rise and latencies fall along the staircase; what the new step covers goes
        at = bisect.bisect_left(costs, b)
        end = at
        while end < len(costs) and least[end] >= c:
            end += 1
        costs[at:end], least[at:end] = [b], [c]
        out.append(i)
    return np.array(sorted(out), np.int64)


def front_of(batches: Iterable[pa.RecordBatch | pa.Table]) -> pa.Table | None:
    """The front of the rows of all batches, kept small by sweeping after each."""
    held: pa.Table | None = None
    for batch in batches:
        new = batch if isinstance(batch, pa.Table) else pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        held = held.take(pa.array(swept(*(held.column(c).to_numpy() for c in LOSSES)))).combine_chunks()
    return held


def local_fronts(points: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = front_of(batches)
        if held is not None:
            yield from held.to_batches()

    return points.mapInArrow(run, points.schema)


def part_of(measure: str) -> Column:
    """How many cuts a value is above."""
    return F.size(F.filter(f"cuts_{measure}", lambda cut: cut < F.col(measure)))


def pareto_front(points: DataFrame, cells: int = CELLS) -> DataFrame:
    """points(id, quality, cost, latency) -> those that no other dominates, with all their columns."""
    loss = [-F.col("quality").cast("double"), F.col("cost").cast("double"), F.col("latency").cast("double")]
    # 0.0 makes a negative zero a plain one
    losses = {c: v + F.lit(0.0) for c, v in zip(LOSSES, loss, strict=True)}
    known = F.lit(True)
    for c in LOSSES:
        known &= F.col(c).isNotNull() & ~F.isnan(c)
    rows = points.withColumns({f"loss_{c}": v for c, v in losses.items()})
    distinct = rows.select(*[F.col(f"loss_{c}").alias(c) for c in LOSSES]).where(known).distinct()
    parts = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cuts = distinct.agg(*[F.percentile_approx(c, parts).alias(f"cuts_{c}") for c in LOSSES])
    # a value in a later part of its measure is larger than all in an earlier one
    part = {f"p{c}": part_of(c) for c in LOSSES}
    placed = step(distinct.crossJoin(F.broadcast(cuts)).withColumns(part).select(*LOSSES, *part))

    keys = list(part)
    taken = step(placed.select(*keys).distinct())
    a, b = (taken.select(*[F.col(k).alias(f"{end}{k}") for k in keys]) for end in "ab")
    worse = a.join(F.broadcast(b), (F.col("apx") < F.col("bpx")) & (F.col("apy") < F.col("bpy")) & (F.col("apz") < F.col("bpz")))
    live = step(taken.join(worse.select(*[F.col(f"b{k}").alias(k) for k in keys]).distinct(), keys, "left_anti"))
    left = step(local_fronts(placed.join(F.broadcast(live), keys, "left_semi").select(*LOSSES, *keys)))

    # to each live cell its own points and those of the live cells that are no worse in any measure
    a, b = (live.select(*[F.col(k).alias(f"{end}{k}") for k in keys]) for end in "ab")
    ways = a.join(F.broadcast(b), (F.col("apx") <= F.col("bpx")) & (F.col("apy") <= F.col("bpy")) & (F.col("apz") <= F.col("bpz")))
    met = left.join(F.broadcast(ways), [F.col(k) == F.col(f"a{k}") for k in keys])
    met = met.select(*LOSSES, *[f"b{k}" for k in keys], (F.struct(*keys) == F.struct(*[F.col(f"b{k}").alias(k) for k in keys])).alias("own"))

    def merged(group: pa.Table) -> pa.Table:
        held = front_of([group])
        return held.filter(held.column("own")).select(list(LOSSES))

    front = met.groupBy(*[f"b{k}" for k in keys]).applyInArrow(merged, "x double, y double, z double")
    return rows.join(front.select(*[F.col(c).alias(f"loss_{c}") for c in LOSSES]), [f"loss_{c}" for c in LOSSES], "left_semi").drop(*[f"loss_{c}" for c in LOSSES]).select(*points.columns)
