"""Connected components of an edge table, without collecting it: spanning forests of bounded parts until one part is left;
where they no longer get fewer, large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dropped, share

EDGES = 500_000  # edges that a task holds


def least_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges a - b: their nodes, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, up = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up != (far := up[up])).any():
            up = far
        x, y = up[x], up[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[up]


def _least(batches: Iterator[pa.RecordBatch], bound: int, roots: bool) -> Iterator[pa.RecordBatch]:
    """(node, least node that it reaches by the edges of the batches), of up to `bound` edges at a time; the least too, if roots."""

    def forest() -> tuple[np.ndarray, np.ndarray]:
        node, least = least_reachable(*(np.concatenate(x) for x in zip(*held)))
        return (node, least) if roots else (node[node != least], least[node != least])

    held, n = [], 0
    out = lambda node, least: pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["a", "b"])
    for batch in batches:
        a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        held.append((a[a != b], b[a != b]))
        n += len(held[-1][0])
        if n > bound and not roots:
            held = [forest()]
            n = len(held[0][0])
            if 2 * n > bound:
                yield out(*held[0])
                held, n = [], 0
    if n:
        yield out(*forest())


def _forests(edges: DataFrame, parts: int | None = None, roots: bool = False) -> DataFrame:
    """Edges with the same components, forests of `parts` tasks, or of those that edges has. Written."""
    bound = EDGES
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
    return share((edges.coalesce(parts) if parts else edges).mapInArrow(lambda batches: _least(batches, bound, roots), "a long, b long"), "edges")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node points its larger (or smaller and equal) neighbours to the least of its neighbours and itself. Written."""
    if large:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # partial minima before the shuffle; written first, so that the join is one of two plain exchanges, which Spark can
    # split at a hub, whose rows are many
    least = share(sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    joined = sides.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    else:
        both = joined.select(F.col("b").alias("x"), "m").unionByName(least.select(F.col("a").alias("x"), "m"))
        out = both.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
    out = share(out, "edges")
    dropped(least)
    return out


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b) of integers: (node, component), the least node reachable. Nodes without edges are not listed."""
    now, before = _forests(edges), None
    n = now.count()
    while n > EDGES:  # as long as forests of more edges at a time have fewer of them
        next_ = _forests(now, -(-n // EDGES))
        dropped(now)
        now, last, n = next_, n, next_.count()
        if 4 * n > 3 * last:
            break
    while n > EDGES:
        half = _star(now, True)
        next_ = _star(half, False)
        dropped(now, half)
        now = next_
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(state) == before:
            nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            roots = now.select(F.col("b").alias("node")).distinct()
            return nodes.unionByName(roots.withColumn("component", F.col("node"))).groupBy("node").agg(F.min("component").alias("component"))
        before, n = tuple(state), state["n"]
    found = _forests(now, 1, roots=True)
    dropped(now)
    return found.withColumnsRenamed({"a": "node", "b": "component"})
