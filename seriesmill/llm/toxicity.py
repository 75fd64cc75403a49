"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and an L1 penalty (McMahan et al. 2013) leave few non-zero weights out of 2^BITS, which
are broadcast as the indices and values of those that aren't zero. Features are binary: words, pairs, pairs with one word between, and the
first 4, 5 and 6 bytes of longer words (inflected insults share a stem; whole words alone miss the forms never seen).
A word is a run of letters, digits and non-ASCII bytes with A-Z lowered, so marks around it don't hide it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import LETTERS, U, chunks, hashes, spans, windows

BITS = 20
GRAMS = ((0,), (0, 1), (0, 2))
STEMS = (4, 5, 6)
#: The fit reads at most so many labelled texts of each label; each is read whole and gives at most 2^BITS features.
SAMPLE = 4000
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 1.0, 1.0, 3


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of all grams of a chunk, with repeats."""
    starts, ends, text = spans(data, off, LETTERS)
    h = hashes(data, starts, ends)
    cols, rows = [], []
    for n in STEMS:
        long = ends - starts > n
        g = hashes(data, starts[long], starts[long] + n) ^ U(n * 0x2545F4914F6CDD1D & (1 << 64) - 1)
        cols.append((g >> U(64 - BITS)).astype(np.int64))
        rows.append(text[long])
    for i, places in enumerate(GRAMS):
        g, at = windows(h ^ U(i * 0x5851F42D4C957F2D & (1 << 64) - 1), text, places)
        cols.append((g >> U(64 - BITS)).astype(np.int64))
        rows.append(text[at])
    return np.concatenate(cols), np.concatenate(rows)


def _feature_rows(batches):
    for b in batches:
        for lo, hi, data, off in chunks(b.column(1)):
            f, t = features(data, off)
            packed = np.unique(t << BITS | f)
            lists = np.split((packed & (1 << BITS) - 1).astype(np.int32), np.searchsorted(packed >> BITS, np.arange(1, hi - lo)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([x.tobytes() for x in lists], pa.binary())], ["label", "features"])


def ftrl(rows: list[tuple[int, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of (label, feature indices) rows, in the order given."""
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z, bias_n, bias = 0.0, 0.0, 0.0
    for _ in range(epochs):
        for y, i in rows:
            zi, ni = z[i], n[i]
            wi = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(wi.sum() + bias, -35, 35)))
            g = p - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[i] = zi + g - sigma * wi
            n[i] = ni + g * g
            step = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA
            bias_z += g - step * bias
            bias_n += g * g
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    live = np.abs(z) > L1
    w[live] = -(z[live] - np.sign(z[live]) * L1) / ((BETA + np.sqrt(n[live])) / ALPHA + L2)
    return w.astype(np.float32), float(bias)


def _scores(model):
    def run(batches):
        index, weight, bias = model.value
        w = np.zeros(1 << BITS, np.float32)
        w[index] = weight
        for b in batches:
            for lo, hi, data, off in chunks(b.column(2)):
                f, t = features(data, off)
                live = w[f] != 0
                packed = np.unique(t[live] << BITS | f[live])
                s = np.bincount(packed >> BITS, w[packed & (1 << BITS) - 1], minlength=hi - lo) + bias
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-np.clip(s, -35, 35))))], ["doc_id", "held_out", "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on at most ``sample`` labelled texts of each label, chosen by a hash of their id; the bias is moved back to the
    share of the label among all labelled ids."""
    named = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("label")).where("i is not null and label in (0, 1)").groupBy("i").agg(F.max("label").alias("label"))
    total = {int(r[0]): r[1] for r in named.groupBy("label").count().collect()}
    parts = [named.where(F.col("label") == v).orderBy(F.xxhash64("i"), "i").limit(sample) for v in (0, 1)]
    own = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).cast("string").alias("text")).where("text is not null")
    # at most 2 x sample rows of two numbers are broadcast
    chosen = own.join(F.broadcast(parts[0].unionAll(parts[1])), "i")
    got = chosen.select("i", "label", "text").select("label", "text", "i").mapInArrow(_feature_rows, "label int, features binary").collect()
    rows = sorted((int(r["label"]), bytes(r["features"])) for r in got)
    order = np.random.default_rng(7).permutation(len(rows))
    rows = [(rows[i][0], np.frombuffer(rows[i][1], np.int32)) for i in order]
    seen = {v: sum(y == v for y, _ in rows) for v in (0, 1)}
    if not seen[0] or not seen[1]:
        share = (total.get(1, 0) + 0.5) / (sum(total.values()) + 1)
        return np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share)))
    w, bias = ftrl(rows)
    return w, bias + float(np.log(total[1] / total[0]) - np.log(seen[1] / seen[0]))


def score(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; nothing of rows where ``held_out`` holds is learned.

    A null or word-less text has the score of the bias; rows of null doc_id are scored and not learned from; repeated
    rows are scored each; with no labels of both kinds, the score is the share of label 1; other columns are ignored; texts
    of any length are read whole; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"))
    train = own.where(~F.col("held_out"))
    usable = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(~F.coalesce(held_out, F.lit(False)))
    weights, bias = fit(train, usable, "label")
    live = np.flatnonzero(weights)
    model = docs.sparkSession.sparkContext.broadcast((live.astype(np.int32), weights[live], bias))
    scored = own.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
