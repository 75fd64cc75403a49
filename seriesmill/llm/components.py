"""Connected components of an edge table by randomised contraction (after Bögeholz, Brand and Todor 2020)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialise, release


#: Edges that a task contracts together.
FLUSH_EDGES = 1 << 21


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, vertex) of each vertex that isn't the smallest of its component: roots hook on to smaller neighbours."""
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(names))
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (parent[parent] != parent).any():
            parent = parent[parent]
    own = np.flatnonzero(parent != np.arange(len(names)))
    return names[parent[own]], names[own]


def _forests(batches):
    """Edges of a task, in runs of bounded length, as stars with the same components."""
    held, n = [], 0

    def flush():
        x = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        return pa.RecordBatch.from_arrays([pa.array(v) for v in forest(*x)], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n > FLUSH_EDGES:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long) -> (v long, label long), label the smallest vertex that v reaches.

    Each round gives every vertex a rank, merges it into the lowest-ranked vertex of its closed neighbourhood and keeps
    the edges between what is left. In the first round hubs rank lowest, so stars fall together at once; in later ones
    ranks are hashes drawn anew, by which at least a constant share of the vertices is expected to go whatever the
    graph's shape: the number of rounds is logarithmic, the sum of all rounds linear, and there is no bound on rounds.
    Before each round every task turns its own edges into stars (a forest of the same components), so few edges travel.
    Minima are combined before the shuffle; the joins have one row a vertex on one side, so a hub's rows can be split.
    """

    def stars(df: DataFrame, a: str, b: str) -> DataFrame:
        return materialise(df.where(F.col(a) != F.col(b)).select(a, b).mapInArrow(_forests, "a long, b long"), "edges")

    left = stars(edges, "a", "b")
    merges: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("u")), F.struct(F.col("b").alias("v"), F.col("a").alias("u")))).alias("e")).select("e.v", "e.u")

        def draw(c: str) -> Column:
            return F.xxhash64(F.lit(len(merges)), c)

        if merges:
            low = ends.groupBy("v").agg(F.min(F.struct(draw("u").alias("r"), F.col("u"))).alias("m")).select("v", F.least(F.struct(draw("v").alias("r"), F.col("v").alias("u")), F.col("m")).alias("m"))
        else:
            rank = ends.groupBy("v").agg((-F.count("*")).alias("d"))
            ranked = ends.join(rank.select(F.col("v").alias("u"), "d"), "u")
            low = ranked.groupBy("v").agg(F.min(F.struct("d", draw("u").alias("r"), "u")).alias("m")).join(rank, "v")
            low = low.select("v", F.least(F.struct("d", draw("v").alias("r"), F.col("v").alias("u")), F.col("m")).alias("m"))
        into = materialise(low.select("v", F.col("m.u").alias("into")), "merges")
        moved = left.join(into.select(F.col("v").alias("a"), F.col("into").alias("x")), "a").join(into.select(F.col("v").alias("b"), F.col("into").alias("y")), "b")
        rest = stars(moved, "x", "y")
        release(left)
        left = rest
        merges.append(into)
    if not merges:
        out = left.select(F.col("a").alias("v"), F.col("b").alias("label"))
        out._held_at = left._held_at
        return out
    # back through the rounds: a vertex's last name is that of the vertex it was merged into
    last = merges.pop()
    while merges:
        earlier = merges.pop()
        names = last.select(F.col("v").alias("into"), F.col("into").alias("later"))
        named = materialise(earlier.join(names, "into", "left").select("v", F.coalesce("later", "into").alias("into")), "merges")
        release(last, earlier)
        last = named
    least = last.groupBy("into").agg(F.min("v").alias("label"))
    out = materialise(last.join(least, "into").select("v", "label"), "labels")
    release(left, last)
    return out
