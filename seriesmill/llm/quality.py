"""Quality by regularised quadratic discriminant analysis over transformed document statistics.

One pass turns each text into a vector of statistics (lengths, shares of kinds of bytes, repetition, line shape), each
transformed towards a bell shape. Class means and covariances are sums over all labelled rows, gathered as one row of
moments a task. Covariances are shrunk towards the pooled one and its diagonal, factored once (Cholesky), and a score is
the logistic of the difference of the two classes' log densities and log shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import LETTERS, NOT_SPACE, U, chunks, hashes, spans
from .storage import materialise

POOL, RIDGE = 0.2, 0.05
_CLASS = np.zeros((256, 6), bool)
_CLASS[65:91, 0] = True  # upper case
_CLASS[48:58, 1] = True  # digits
_CLASS[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 124, 125, 126], 2] = True  # symbols
_CLASS[[34, 39, 40, 41, 44, 45, 46, 47, 58, 59, 63, 91, 93], 3] = True  # other ASCII marks
_CLASS[128:, 4] = True  # non-ASCII
_CLASS[[32, 9, 10, 11, 12, 13], 5] = True  # white space
N_STATS = 19


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of transformed statistics for each text of a chunk."""
    n = len(off) - 1
    size = np.diff(off).astype(np.float64)

    def by_text(flags):
        c = np.concatenate([[0], np.cumsum(flags)])
        return (c[off[1:]] - c[off[:-1]]).astype(np.float64)

    byte = [by_text(_CLASS[data, k]) for k in range(_CLASS.shape[1])]
    starts, ends, text = spans(data, off, NOT_SPACE)
    length = (ends - starts).astype(np.float64)
    n_words = np.bincount(text, minlength=n).astype(np.float64)
    some = np.maximum(n_words, 1)
    mean = np.bincount(text, length, minlength=n) / some
    var = np.bincount(text, length**2, minlength=n) / some - mean**2
    h = hashes(data, starts, ends)
    key = np.sort((text.astype(U) << U(48)) | (h >> U(16)))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    owner = (key[first] >> U(48)).astype(np.int64)
    distinct = np.bincount(owner, minlength=n)
    most = np.zeros(n)
    if len(first):
        np.maximum.at(most, owner, np.diff(np.append(first, len(key))).astype(np.float64))
    pair = np.flatnonzero(text[1:] == text[:-1])
    same = np.bincount(text[pair], h[pair] == h[pair + 1], minlength=n)
    plain = LETTERS[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    marked = np.bincount(text, ~plain, minlength=n)
    symbol_end = np.bincount(text, _CLASS[data[ends - 1], 2], minlength=n) if len(ends) else np.zeros(n)
    alone = np.bincount(text, ~LETTERS[data[starts]] & (length < 3), minlength=n) if len(starts) else np.zeros(n)
    lines = by_text(data == 10) + 1
    stops = by_text(np.isin(data, [46, 33, 63]))
    total, share = np.maximum(size, 1), np.arcsinh

    def rate(x, of):
        return share(50 * x / of)

    out = [
        np.log1p(n_words), np.log1p(lines), np.log1p(n_words / lines), mean.clip(0, 30), np.sqrt(var.clip(0, 900)),
        *(rate(b, total) for b in byte), np.sqrt(distinct / some), rate(most, some), rate(same, some), rate(marked, some),
        rate(symbol_end, some), rate(alone, some), rate(stops, some), (n_words == 0).astype(np.float64),
    ]
    return np.stack(out, axis=1)


def _statistic_rows(batches):
    for b in batches:
        for lo, hi, data, off in chunks(b.column(2)):
            x = statistics(data, off)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_STATS).cast(pa.list_(pa.float64()))], ["doc_id", "held_out", "stats"])


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def _moments(batches):
    sums = {v: [0, np.zeros(N_STATS), np.zeros((N_STATS, N_STATS))] for v in (0, 1)}
    for b in batches:
        x, y = _matrix(b.column(0)), b.column(1).to_numpy()
        for v, s in sums.items():
            own = x[y == v]
            s[0] += len(own)
            s[1] += own.sum(axis=0)
            s[2] += own.T @ own
    yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([sums[v][0] for v in (0, 1)]), pa.array([sums[v][1].tobytes() + sums[v][2].tobytes() for v in (0, 1)], pa.binary())], ["label", "n", "sums"])


class Quadratic:
    """Two Gaussian classes: means, inverse Cholesky factors, log determinants and log shares."""

    def __init__(self, n: dict, first: dict, second: dict):
        cov, self.parts = {}, {}
        for v in (0, 1):
            m = first[v] / n[v]
            cov[v] = second[v] / n[v] - np.outer(m, m)
        both = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
        scale = np.diag(both).clip(1e-6)
        for v in (0, 1):
            own = (1 - POOL) * cov[v] + POOL * both
            own = own + RIDGE * np.diag(scale) + 1e-6 * np.eye(N_STATS)
            factor = np.linalg.cholesky(own)
            self.parts[v] = (first[v] / n[v], np.linalg.inv(factor).T, 2 * np.log(np.diag(factor)).sum(), np.log(n[v] / (n[0] + n[1])))

    def log_density(self, x: np.ndarray, v: int) -> np.ndarray:
        mean, inverse, logdet, share = self.parts[v]
        return share - 0.5 * (logdet + (((x - mean) @ inverse) ** 2).sum(axis=1))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_density(x, 1) - self.log_density(x, 0), -35, 35)))


def _scores(model):
    def run(batches):
        for b in batches:
            x = _matrix(b.column(2))
            s = model.score(x) if isinstance(model, Quadratic) else np.full(len(x), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["doc_id", "held_out", "score"])

    return run


def score(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; nothing of rows where ``held_out`` holds is learned.

    All labelled rows are learned from. A null text counts as empty; rows of null doc_id are scored and not learned from;
    repeated rows count each; without labels of both kinds the score is the share of label 1 (one half without any); an
    empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    stats = materialise(own.mapInArrow(_statistic_rows, "doc_id long, held_out boolean, stats array<double>"), "stats")
    named = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    train = stats.where(~F.col("held_out")).join(named, "doc_id").select("stats", "label")
    n, first, second = {0: 0, 1: 0}, {0: np.zeros(N_STATS), 1: np.zeros(N_STATS)}, {0: np.zeros((N_STATS, N_STATS)), 1: np.zeros((N_STATS, N_STATS))}
    for r in train.mapInArrow(_moments, "label int, n long, sums binary").toLocalIterator():
        s = np.frombuffer(bytes(r["sums"]))
        n[r["label"]] += r["n"]
        first[r["label"]] += s[:N_STATS]
        second[r["label"]] += s[N_STATS:].reshape(N_STATS, N_STATS)
    model = Quadratic(n, first, second) if min(n.values()) > 1 else (n[1] + 0.5) / (n[0] + n[1] + 1)
    return stats.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))
