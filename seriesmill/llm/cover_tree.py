"""Exact top-k inner-product search with two cover trees.

Queries and data are both indexed by cover trees: a node of scale s is split into a net of its points, so that every child
centre is a point of the node (the node's own centre first: nesting), no point is farther than s / 2 from its child's
centre (covering), and centres are more than s / 2 apart (separation). A pair of nodes holds no two vectors with a product
over <q, x> + r_q |x| + r_x |q| + r_q r_x (q, x centres, r covering radii: the farthest point in fact, not the scale), so
a pair whose bound is under the worst kth score of the query group is dropped. Vectors are integers, floor(1024 x), so
scores are exact.

Data are dealt to buckets by hash, and each block of queries goes as rows to every bucket; a task reads a block's queries,
then its bucket's data in runs of ``RUN_ROWS``, and returns k candidates a query, so neither side passes the driver and
memory follows the block and the run only. Where vectors lie evenly on a sphere of many dimensions no metric bound prunes;
the search then costs one product a pair, in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a data tree and of a query block, and points that a leaf holds at most (unless they are equal).
RUN_ROWS, BLOCK_QUERIES, LEAF = 2048, 4096, 48
#: Data rows of a bucket, about.
BUCKET_ROWS = 1 << 17
SCALE = 1024


class Node:
    """A ball: centre, covering radius, the rows in it; children, or for a bunch of leaves the arrays of all of them."""

    __slots__ = ("centre", "radius", "norm", "rows", "children", "scale", "leaves")

    def __init__(self, centre, radius, rows, scale):
        self.centre, self.radius, self.norm, self.rows, self.scale = centre, radius, float(np.linalg.norm(centre)), rows, scale
        self.children: list[Node] = []
        self.leaves = None


def cover_tree(x: np.ndarray, leaf: int = LEAF) -> Node:
    """The cover tree of the rows of ``x``; nodes of at most ``leaf`` rows aren't split further."""
    sq = (x * x).sum(axis=1)
    dist = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * (x @ x.T), 0))
    every = np.arange(len(x))
    far = float(dist[0].max())
    root = Node(x[0], far, every, far)
    todo = [(root, 0)]
    while todo:
        node, c = todo.pop()
        if len(node.rows) <= leaf or node.radius == 0:
            continue
        half = node.radius / 2
        # the centre first, then whatever it doesn't cover, in order of rows
        left, centres, members = node.rows, [], []
        nxt = c
        while True:
            near = dist[nxt, left] <= half
            centres.append(nxt)
            members.append(left[near])
            left = left[~near]
            if not len(left):
                break
            nxt = int(left[0])
        for i, own in zip(centres, members, strict=True):
            child = Node(x[i], float(dist[i, own].max()), own, half)
            node.children.append(child)
            todo.append((child, i))
    return root


def _bunch(node: Node) -> list[Node]:
    """What a node's visit goes on to: its children, those without children together as one bunch."""
    inner = [c for c in node.children if c.children]
    small = [c for c in node.children if not c.children]
    if len(small) > 1:
        both = Node(node.centre, node.radius, np.concatenate([c.rows for c in small]), node.scale)
        both.leaves = (np.stack([c.centre for c in small]), np.array([c.radius for c in small]), np.array([c.norm for c in small]), np.repeat(np.arange(len(small)), [len(c.rows) for c in small]))
        return [*inner, both]
    return inner + small


class TopK:
    """Best k (score, id) of each query; ties go to the smaller id. ``products`` counts all products of vectors computed, those
    for bounds too."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.ids, self.k = q, ids, k
        self.trees = [cover_tree(q[lo : lo + RUN_ROWS]) for lo in range(0, len(q), RUN_ROWS)]
        for i, t in enumerate(self.trees):
            self._shift(t, i * RUN_ROWS)
        self.score = np.full((len(q), k), -np.inf)
        self.best = np.full((len(q), k), np.iinfo(np.int64).max)
        self.products = 0

    def _shift(self, node, by):
        node.rows = node.rows + by
        for c in node.children:
            self._shift(c, by)

    def search(self, x: np.ndarray, ids: np.ndarray) -> None:
        """Offer the rows of ``x``: node pairs by falling bound, so that good scores come early and prune the rest."""
        root = cover_tree(x)
        for tree in self.trees:
            self._pairs(tree, root, x, ids)

    def _pairs(self, qtree, xtree, x, ids):
        n, parts = 0, {}
        heap = [(-np.inf, 0, qtree, xtree)]
        while heap:
            bound, _, a, b = heapq.heappop(heap)
            worst = self.score[a.rows, -1].min()
            if -bound < worst:
                continue
            if not a.children and not b.children:
                rows = b.rows
                if b.leaves is not None and np.isfinite(worst):
                    centres, radius, norm, part = b.leaves
                    self.products += len(centres)
                    most = centres @ a.centre + a.radius * norm + radius * a.norm + a.radius * radius
                    rows = rows[(most + 1e-6 * np.abs(most) + 1e-3 >= worst)[part]]
                for lo in range(0, len(rows), 512):
                    self._offer(a.rows, x[rows[lo : lo + 512]], ids[rows[lo : lo + 512]])
                continue
            if a.children and (not b.children or a.radius >= b.radius):
                pairs = [(c, b) for c in a.children]
            else:
                if id(b) not in parts:
                    parts[id(b)] = _bunch(b)
                pairs = [(a, d) for d in parts[id(b)]]
            self.products += len(pairs)
            for c, d in pairs:
                most = float(c.centre @ d.centre) + c.radius * d.norm + d.radius * c.norm + c.radius * d.radius
                most += 1e-6 * abs(most) + 1e-3
                if most >= self.score[c.rows, -1].min():
                    n += 1
                    heapq.heappush(heap, (-most, n, c, d))

    def _offer(self, rows, x, ids):
        if not len(ids):
            return
        s = self.q[rows] @ x.T
        self.products += s.size
        s[self.ids[rows][:, None] == ids[None, :]] = -np.inf
        # a score equal to the worst may still win by its id
        better = np.flatnonzero((s >= self.score[rows, -1:]).any(axis=1) & np.isfinite(s).any(axis=1))
        rows, s = rows[better], s[better]
        if not len(rows):
            return
        score = np.concatenate([self.score[rows], s], axis=1)
        best = np.concatenate([self.best[rows], np.broadcast_to(ids, s.shape)], axis=1)
        best[np.isneginf(score)] = np.iinfo(np.int64).max
        order = np.lexsort((best, -score), axis=1)[:, : self.k]
        self.score[rows], self.best[rows] = np.take_along_axis(score, order, 1), np.take_along_axis(best, order, 1)


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, floor(1024 x) as float64) of a batch's usable rows (columns vec_id, v)."""
    ids, vec = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    values = vec.flatten()
    size = np.diff(vec.offsets.to_numpy()) if len(vec) else np.zeros(0, np.int64)
    flat = np.floor(SCALE * values.cast(pa.float64()).to_numpy(zero_copy_only=False))
    start = np.cumsum(size) - size
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        m = flat[start[rows][:, None] + np.arange(d)]
        ok = np.isfinite(m).all(axis=1)
        if ok.any():
            yield int(d), ids[rows[ok]].astype(np.int64), m[ok]


def _search(k: int):
    """Rows come by block and bucket, the queries of a block before the bucket's data."""

    def result(tops):
        for top in tops.values():
            row, at = np.nonzero(np.isfinite(top.score))
            score = np.clip(top.score[row, at], -(2.0**63), 2.0**63 - 1024).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(top.ids[row]), pa.array(top.best[row, at]), pa.array(score)], ["query_id", "vec_id", "score"])

    def run(batches):
        here, queries, held, tops = None, {}, {}, {}

        def flush(d):
            if held.get(d):
                tops[d].search(np.concatenate([m for _, m in held[d]]), np.concatenate([i for i, _ in held[d]]))
                held[d] = []

        def group():
            for d in tops:
                flush(d)
            yield from result(tops)

        for b in batches:
            key = b.column("block").to_numpy().astype(np.int64) << 32 | b.column("bucket").to_numpy()
            data = b.column("data").to_numpy(zero_copy_only=False).astype(np.int64)
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (data[1:] != data[:-1])]))
            for lo, hi in zip(cut, [*cut[1:], len(key)], strict=True):
                if key[lo] != here:
                    yield from group()
                    here, queries, held, tops = key[lo], {}, {}, {}
                for d, ids, m in _matrix(b.slice(lo, hi - lo)):
                    if not data[lo]:
                        queries.setdefault(d, []).append((ids, m))
                        continue
                    if d not in queries:
                        continue
                    if d not in tops:
                        tops[d] = TopK(np.concatenate([m for _, m in queries[d]]), np.concatenate([i for i, _ in queries[d]]), k)
                    for at in range(0, len(ids), RUN_ROWS):
                        held.setdefault(d, []).append((ids[at : at + RUN_ROWS], m[at : at + RUN_ROWS]))
                        if sum(len(i) for i, _ in held[d]) >= RUN_ROWS:
                            flush(d)
        yield from group()

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``is_query`` holds, its k best other rows by integer product.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows of null vec_id; a query
    is compared with vectors of its own length. Rows that share a query's id are its own and no candidates. Repeated
    candidate rows are candidates each; a repeated query row is one query, and query rows of one id with different vectors
    share that id's k places. Ties go to the smaller vec_id. Products of 2^53 and more are rounded, and cut to a long's
    range. Other columns are ignored, whatever their names; no queries or no vectors: no rows.
    """
    own = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")).where("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    n_rows, n_queries = own.agg(F.count("*"), F.count_if("q")).first()
    blocks, buckets = max(1, -(-n_queries // BLOCK_QUERIES)), max(1, own.rdd.getNumPartitions(), -(-n_rows // BUCKET_ROWS))
    asked = own.where("q").select("vec_id", "v").distinct().select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(False).alias("data"), "vec_id", "v")
    data = own.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("vec_id", "v"), F.lit(buckets)).cast("int").alias("bucket"), F.lit(True).alias("data"), "vec_id", "v")
    dealt = asked.unionAll(data).repartition(blocks * buckets, "block", "bucket").sortWithinPartitions("block", "bucket", "data")
    out = dealt.mapInArrow(_search(k), "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
