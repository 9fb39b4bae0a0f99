"""The kernel of shortest paths for graphs whose nodes the fixed limits bound: a task holds the graph as a matrix.

It takes an Arrow table of edges (src, dst); 1200 nodes make a matrix of 12 MB.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def numbered(edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted node names, and the numbers of the edges' ends."""
    src, dst = (edges.column(c).combine_chunks() for c in ("src", "dst"))
    names = pc.unique(pa.concat_arrays([src, dst]))
    names = names.take(pc.sort_indices(names))
    return np.asarray(names.to_pylist(), object), *(pc.index_in(x, value_set=names).to_numpy().astype(np.int64) for x in (src, dst))


def brandes(edges: pa.Table, turn: int = 0, turns: int = 1) -> pa.Table:
    """id, score: the shortest paths between others that lead through a node, from every turns-th source, level by level."""
    names, src, dst = numbered(edges)
    n = len(names)
    step = np.zeros((n, n))
    step[src[src != dst], dst[src != dst]] = 1
    ways = level = np.eye(n)[turn::turns]
    dist = np.where(level > 0, 0, -1)
    depth = 0
    while True:
        ahead = level @ step
        new = (ahead > 0) & (dist < 0)
        if not new.any():
            break
        depth += 1
        dist[new] = depth
        level = np.where(new, ahead, 0)
        ways = ways + level
    share = np.zeros(ways.shape)
    for d in range(depth, 1, -1):
        part = np.divide(1 + share, ways, out=np.zeros(ways.shape), where=dist == d)
        share += np.where(dist == d - 1, ways * (part @ step.T), 0)
    return pa.table({"id": pa.array(names, pa.string()), "score": share.sum(axis=0)})
