"""Language identification by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of ``WINDOW`` bytes that cover all of it. Filters of several widths slide over each window's
bytes (one-hot, so a filter is a table of byte weights by place), the largest response of each filter in the window is
kept, and a softmax over these gives the window's probabilities; a text's are the mean over its windows, weighted by
letters. A-Z are lowered, and bytes that are no letters count as blanks, so that marks and digits decide nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import LOWER, chunks

WINDOW, WIDTHS, FILTERS = 128, (2, 3, 4), 16
#: The fit reads about so many different texts of each language, all windows of each.
SAMPLE = 400
EPOCHS, BATCH, RATE = 6, 64, 0.01
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = LOWER[65:91]
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def window_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a chunk's texts (blank-padded at a text's end) and the text of each."""
    n = np.diff(off)
    count = -(-n // WINDOW)
    text = np.repeat(np.arange(len(n)), count)
    out = np.full(len(text) * WINDOW, 32, np.uint8)
    shift = (np.cumsum(count) - count) * WINDOW - off[:-1]
    out[np.arange(len(data)) + np.repeat(shift, n)] = _FOLD[data]
    return out.reshape(-1, WINDOW), text


class ByteConvNet:
    def __init__(self, names: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.names = names
        self.params = {f"c{w}": rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS}
        self.params |= {f"b{w}": np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.params["out"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32)
        self.params["bias"] = np.zeros(len(names), np.float32)
        self.pairs = None

    def _responses(self, x):
        for w in WIDTHS:
            n = x.shape[1] - w + 1
            yield w, sum(self.params[f"c{w}"][j][x[:, j : j + n]] for j in range(w)) + self.params[f"b{w}"]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> ByteConvNet:
        """Adam on the cross entropy; max pooling sends a gradient to the place of the largest response only."""
        rng = np.random.default_rng(3)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(p) for k, p in self.params.items()}
        step, col = 0, np.arange(FILTERS)
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for lo in range(0, len(x), BATCH):
                i = order[lo : lo + BATCH]
                xb, pool, where = x[i], [], {}
                for w, r in self._responses(xb):
                    where[w] = r.argmax(axis=1)
                    pool.append(np.take_along_axis(r, where[w][:, None], 1)[:, 0])
                a = np.maximum(np.concatenate(pool, axis=1), 0)
                p = softmax(a @ self.params["out"] + self.params["bias"])
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                g = {"out": a.T @ p, "bias": p.sum(0)}
                back = (p @ self.params["out"].T) * (a > 0)
                for k, w in enumerate(WIDTHS):
                    gw = back[:, k * FILTERS : (k + 1) * FILTERS]
                    g[f"b{w}"] = gw.sum(0)
                    g[f"c{w}"] = np.zeros_like(self.params[f"c{w}"])
                    for j in range(w):
                        np.add.at(g[f"c{w}"][j], (xb[np.arange(len(i))[:, None], where[w] + j], col), gw)
                step += 1
                for name, grad in g.items():
                    m[name] += 0.1 * (grad - m[name])
                    v[name] += 0.001 * (grad * grad - v[name])
                    self.params[name] -= RATE * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)
        return self

    def _pair_tables(self):
        """A filter's weights for two neighbouring bytes at once: half as many look-ups."""
        out = {}
        for w in WIDTHS:
            c = self.params[f"c{w}"]
            out[w] = [(j, (c[j][:, None] + c[j + 1][None]).reshape(-1, FILTERS)) for j in range(0, w - 1, 2)]
            if w % 2:
                out[w].append((w - 1, c[w - 1]))
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of each window, in tiles that stay in the processor's cache."""
        if self.pairs is None:
            self.pairs = self._pair_tables()
        out = np.zeros((len(x), len(self.names)), np.float32)
        for lo in range(0, len(x), 64):
            t = x[lo : lo + 64]
            two = t[:, :-1].astype(np.int64) << 8 | t[:, 1:]
            pool = []
            for w in WIDTHS:
                n, r = WINDOW - w + 1, None
                for j, table in self.pairs[w]:
                    part = table.take((two if len(table) > 256 else t)[:, j : j + n], axis=0)
                    r = part if r is None else np.add(r, part, out=r)
                pool.append(r.max(axis=1) + self.params[f"b{w}"])
            out[lo : lo + 64] = softmax(np.maximum(np.concatenate(pool, axis=1), 0) @ self.params["out"] + self.params["bias"])
        return out

    def __getstate__(self):
        return self.__dict__ | {"pairs": None}


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _sample_rows(batches):
    for b in batches:
        for lo, hi, data, off in chunks(b.column(1)):
            x, text = window_rows(data, off)
            some = (x != 32).any(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).take(pa.array(text[some])), pa.array([r.tobytes() for r in x[some]], pa.binary())], ["lang", "window"])


def fit(train: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE) -> ByteConvNet | None:
    """Fit on about ``sample`` different texts of each language, chosen by a hash of the text; None without labelled texts."""
    own = train.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    # copies count once, so a text that fills a third of the table is one text of the sample too
    counts = {r[0]: r[1] for r in own.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    if not counts:
        return None
    draw = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(v) for k, n in sorted(counts.items()) for v in (k, min(1.0, sample / max(n, 1)))])[F.col("lang")]
    chosen = own.where(draw < share).dropDuplicates(["lang", "h"]).select("lang", "text")
    rows = sorted((r[0], bytes(r[1])) for r in chosen.mapInArrow(_sample_rows, "lang string, window binary").collect())
    names = sorted(counts)
    if not rows:
        return ByteConvNet(names)
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    return ByteConvNet(names).fit(x, np.array([names.index(r[0]) for r in rows]))


def _predict(model):
    def run(batches):
        net = model.value
        for b in batches:
            for lo, hi, data, off in chunks(b.column(2)):
                n = hi - lo
                x, text = window_rows(data, off)
                letters = np.bincount(text, (x != 32).sum(axis=1), minlength=n)
                ascii_letter = np.bincount(text, ((x >= 97) & (x <= 122)).sum(axis=1), minlength=n) > 0
                some = ascii_letter.copy()
                for i in np.flatnonzero((letters > 0) & ~ascii_letter):
                    some[i] = any(c.isalpha() for c in bytes(data[off[i] : off[i + 1]]).decode("utf-8", "replace"))
                if net is None:
                    lang, score = np.full(n, "und", object), np.zeros(n)
                else:
                    weight = (x != 32).sum(axis=1).astype(np.float64)
                    p = net.predict(x)
                    total = np.stack([np.bincount(text, weight * p[:, k], minlength=n) for k in range(p.shape[1])], axis=1)
                    best = total.argmax(axis=1)
                    lang = np.where(some, np.array(net.names, object)[best], "und")
                    score = np.where(some, total[np.arange(n), best] / np.maximum(letters, 1), 0.0)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, n), b.column(1).slice(lo, n), pa.array(lang.tolist(), pa.string()), pa.array(np.clip(score, 0, 1))], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; nothing of rows where ``held_out`` holds is learned.

    ``und`` with score 0 where the text is null or has no letter, or where nothing could be learned. Rows of null lang
    aren't learned from; repeated rows and null doc_ids are predicted like any other; other columns are ignored; texts of
    any length are read whole; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own.where(~F.col("held_out"))))
    return own.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
