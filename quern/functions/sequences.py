"""Measures of pairs of sequences, in Arrow batches: each needs a pass over one sequence with the other as a row of bits.

Python's whole numbers are the bit rows, so a sequence of n items against one of m takes n steps on m bits.
"""

from __future__ import annotations

from collections.abc import Hashable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Below this, pairs are counted in one numpy comparison.
BLOCK = 128


def positions(a: Sequence[Hashable]) -> dict[Hashable, int]:
    """For each item the bits of its places in a."""
    out: dict[Hashable, int] = {}
    for i, x in enumerate(a):
        out[x] = out.get(x, 0) | 1 << i
    return out


def common(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """The length of the longest common subsequence: a row's zeros are the places where the best length rises."""
    at, full = positions(a), (1 << len(a)) - 1
    row = full
    for x in b:
        met = row & at.get(x, 0)
        row = (row + met | row - met) & full
    return len(a) - row.bit_count()


def distance(a: Sequence[Hashable], b: Sequence[Hashable]) -> int:
    """The least number of items to insert, delete or replace; rises and falls along a column are two rows of bits."""
    if not a:
        return len(b)
    at, full, last = positions(a), (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, cost = full, 0, len(a)
    for x in b:
        same = at.get(x, 0)
        diagonal = (((same & up) + up) ^ up | same | down) & full
        right_up, right_down = (down | ~(diagonal | up)) & full, up & diagonal
        cost += (1 if right_up & last else 0) - (1 if right_down & last else 0)
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = (right_down | ~(diagonal | right_up)) & full, right_up & diagonal
    return cost


def ascending_pairs(x: np.ndarray) -> int:
    """How many pairs of places have the smaller value first, counted while halves are merged."""
    if len(x) <= BLOCK:
        return int(np.triu(x[:, None] < x[None, :], 1).sum())
    half = len(x) // 2
    left, right = x[:half], x[half:]
    return ascending_pairs(left) + ascending_pairs(right) + int(np.searchsorted(np.sort(left), right, "left").sum())


def of_pairs(kind: str, a: Column, b: Column) -> Column:
    """common or distance of two arrays of strings, row by row; NULL where one is NULL."""
    measure = {"common": common, "distance": distance}[kind]

    @F.pandas_udf("long")
    def measured(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else measure(list(p), list(q)) for p, q in zip(x, y, strict=True)], dtype="Int64")

    return measured(a.cast("array<string>"), b.cast("array<string>"))


def ascents(a: Column) -> Column:
    """The number of ascending pairs of an array of numbers."""

    @F.pandas_udf("long")
    def counted(x: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else ascending_pairs(np.asarray(p, np.int64)) for p in x], dtype="Int64")

    return counted(a.cast("array<bigint>"))
