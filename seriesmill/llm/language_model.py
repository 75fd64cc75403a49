"""N-gram language model held in a log-frequency Bloom filter.

Fit: words, word pairs and word triples of the training texts, with their counts, go to hash ranges. A count gets a level:
itself up to 8, then steps of a quarter of a power of two. Its n-gram goes into a Bloom filter once for each level up to its
own; a level stands for the counts from ``low`` to ``high``. Each range's part of the filter is built in segments that fit a
processor's cache and is written to the shared folder, a row a range: that table, with the exact counts of words for the base
score, is the model. It scores any texts, training ones or others.

Score: each run of texts sends its distinct n-grams to the ranges that they hash to; a range's task reads its own segments,
probes them level after level until one is missing, and sends the levels back to the runs, which meet their texts again. The
filter grows with the corpus, so it isn't broadcast whole, and texts aren't read once for each part of it either: each segment
goes to the one task that probes it, and work and exchange follow the corpus.

Smoothing (Dirichlet priors, after MacKay and Peto 1995): P(w) = (c(w) + 1/2) / (N + (V + 1) / 2), where the half more is
for all unseen words; P(w | u) = (c(u w) + K P(w)) / (c(u) + K), and so again for triples over pairs. A word is followed by
a token as often as it occurs, so each sums to 1. An n-gram's own count is read as ``low``, a context's as ``high``: with
quantised counts too a sum is never over 1, and exactly 1 while counts are at most 8 (Bloom false positives apart).
"""

from __future__ import annotations

import zlib
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U, chunks, mix, words
from .storage import materialise, release

#: Weight of the lower order after one word and after two.
PRIORS = (8.0, 2.0)
BITS_PER_KEY, PROBES = 12, 5
#: Bytes and texts of a run; bytes of text for each hash range, and how many ranges there are at least; levels in a segment of the filter.
FLUSH_BYTES, FLUSH_TEXTS = 6 << 20, 65_000
RANGE_BYTES, LEAST_RANGES, SEGMENT_LEVELS = 8 << 20, 256, 1 << 18
END = int(mix(np.array([12345], U))[0])


def _edges() -> np.ndarray:
    out = list(range(1, 9))
    while out[-1] < 1 << 40:
        out.append(int(out[-1] * 2**0.25) + 1)
    return np.array(out, np.int64)


#: The least count of each level from 1 on.
EDGES = _edges()
LEVELS = len(EDGES)


def level_of(c: np.ndarray) -> np.ndarray:
    return np.searchsorted(EDGES, c, "right")


def low(level: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], EDGES]).astype(np.float64)[level]


def high(level: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], EDGES[1:] - 1, EDGES[-1:]]).astype(np.float64)[level]


def _tokens(data, off):
    """(token, text) with an end token after each text, and the pair and triple ending at each token (0 for none)."""
    h, text = words(data, off)
    n = len(off) - 1
    after = np.searchsorted(text, np.arange(n), "right")
    h, text = np.insert(h, after, U(END)), np.insert(text, after, np.arange(n))
    pair, triple = np.zeros(len(h), U), np.zeros(len(h), U)
    inner = np.flatnonzero(text[1:] == text[:-1]) + 1
    pair[inner] = mix(h[inner - 1] * U(0x9E3779B97F4A7C15) + h[inner])
    deep = np.flatnonzero(text[2:] == text[:-2]) + 2
    triple[deep] = mix(pair[deep - 1] * U(0xD6E8FEB86659FD93) + h[deep]) >> U(16)
    return h, text, pair >> U(16), triple


def _starts(ranges: int) -> np.ndarray:
    return np.array([-(-(r << 48) // ranges) for r in range(ranges)], U)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _flushes(batches):
    """Runs of whole texts of bounded size, the same in every pass over the same table: (key, [(ids, learn, texts, bytes, offsets)]).

    The key holds the run's place and a checksum of its bytes, so runs of passes that differ don't meet.
    """
    part, no = TaskContext.get().partitionId() << 32, 0
    held, size, n_text, crc = [], 0, 0, 0

    def key():
        return int(mix(np.array([part + no], U) ^ mix(np.array([(crc << 32) + n_text], U))).view(np.int64)[0])

    for b in batches:
        known = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, off in chunks(b.column(2)):
            if held and (n_text + hi - lo > FLUSH_TEXTS or size + len(data) > FLUSH_BYTES):
                yield key(), held
                no += 1
                held, size, n_text, crc = [], 0, 0, 0
            held.append((b.column(0).slice(lo, hi - lo), known[lo:hi], b.column(2).slice(lo, hi - lo), data, off))
            size, n_text, crc = size + len(data), n_text + hi - lo, zlib.crc32(data, crc)
    if held:
        yield key(), held


def _grams(h, pair, triple):
    """A word's id is its upper 63 bits; pairs and triples share one row of 48-bit ids, told apart by how they are hashed."""
    return h >> U(1), np.concatenate([pair[pair > 0], triple[triple > 0]])


def _packed_times(times: np.ndarray) -> bytes:
    return zlib.compress(times.astype(np.min_scalar_type(int(times.max())) if len(times) else np.uint8).tobytes(), 1)


def _unpacked_times(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data)
    return np.frombuffer(data, f"u{len(data) // n}") if n else np.zeros(0, np.uint8)


_COUNTED = pa.schema([("rng", pa.int32()), ("words", pa.binary()), ("word_times", pa.binary()), ("first", pa.int64()), ("wide", pa.bool_()), ("steps", pa.binary()), ("times", pa.binary())])
_COUNTED_SQL = "rng int, words binary, word_times binary, first long, wide boolean, steps binary, times binary"
_ASKED = pa.schema([("rng", pa.int32()), ("flush", pa.int64()), ("words", pa.binary()), ("first", pa.int64()), ("wide", pa.bool_()), ("steps", pa.binary())])
_ASKED_SQL = "rng int, flush long, words binary, first long, wide boolean, steps binary"


def _slices(batches, ranges: int):
    """Distinct n-grams of each run by hash range, and how often each occurs: (run, range, words, times, n-grams, times) for the
    ranges that get any, so there are never more rows than n-grams."""
    starts = _starts(ranges)
    for no, held in _flushes(batches):
        words_, grams = [], []
        for _, _, _, data, off in held:
            h, _, pair, triple = _tokens(data, off)
            w, g = _grams(h, pair, triple)
            words_.append(w)
            grams.append(g)
        (w, w_times), (g, times) = (np.unique(np.concatenate(x), return_counts=True) for x in (words_, grams))
        w_cut = [0, *np.searchsorted(w, starts[1:] << U(15)), len(w)]
        cut = [0, *np.searchsorted(g, starts[1:]), len(g)]
        for r in range(ranges):
            lo, hi, w_lo, w_hi = cut[r], cut[r + 1], w_cut[r], w_cut[r + 1]
            if lo < hi or w_lo < w_hi:
                yield no, r, w[w_lo:w_hi], w_times[w_lo:w_hi], g[lo:hi], times[lo:hi]


def _stepped(g: np.ndarray) -> tuple:
    """Sorted 48-bit ids as a first one and steps."""
    step = np.diff(g)
    wide = bool(len(step)) and int(step.max()) >= 1 << 32
    return int(g[0]) if len(g) else None, wide, step.astype(np.uint64 if wide else np.uint32).tobytes()


def _rows_of(made, schema: pa.Schema):
    held = []
    for row in made:
        held.append(row)
        if len(held) == 256:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _count(ranges: int):
    def run(batches):
        made = ((r, w.tobytes(), _packed_times(w_times), *_stepped(g), _packed_times(times)) for _, r, w, w_times, g, times in _slices(batches, ranges))
        yield from _rows_of(made, _COUNTED)

    return run


def _ask(ranges: int):
    def run(batches):
        yield from _rows_of(((r, no, w.tobytes(), *_stepped(g)) for no, r, w, _, g, _ in _slices(batches, ranges)), _ASKED)

    return run


def _unpack(first, wide, steps):
    if first is None:
        return np.zeros(0, U)
    return np.concatenate([[U(first)], np.frombuffer(steps, np.uint64 if wide else np.uint32).astype(U)]).cumsum(dtype=U)


class LevelFilter:
    """One segment of the filter: n-grams ``h`` go in once for each level up to ``q``; ``levels`` reads them back."""

    def __init__(self, h: np.ndarray, q: np.ndarray, bits_per_key: int):
        n = int(q.sum())
        self.bits = max(64, -(-n * bits_per_key // 64) * 64)
        flags = np.zeros(self.bits, bool)
        live, level = np.flatnonzero(q > 0), 1
        while len(live):
            for p in self._places(h[live], level):
                flags[p] = True
            live = live[q[live] > level]
            level += 1
        self.data = np.packbits(flags, bitorder="little")

    def _places(self, h: np.ndarray, level: int):
        g = mix(h + U(level * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
        a, b = g & U(0xFFFFFFFF), (g >> U(32)) | U(1)
        for i in range(PROBES):
            yield ((((a + b * U(i)) & U(0xFFFFFFFF)) * U(self.bits)) >> U(32)).astype(np.int64)

    def levels(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint8)
        live = np.arange(len(h))
        for level in range(1, LEVELS + 1):
            ok = np.ones(len(live), bool)
            for p in self._places(h[live], level):
                ok &= (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1 > 0
            live = live[ok]
            if not len(live):
                break
            out[live] = level
        return out


class Segments:
    """A range's part of the filter: segments of about ``segment_levels`` entries each, every one for a stretch of ids."""

    def __init__(self, firsts: np.ndarray, filters: list[LevelFilter]):
        self.firsts, self.filters = firsts, filters

    @staticmethod
    def build(h: np.ndarray, c: np.ndarray, bits_per_key: int, segment_levels: int) -> Segments:
        """Of distinct n-grams ``h`` (in order) with counts ``c``."""
        q = level_of(c)
        before = np.cumsum(q) - q
        cut = np.unique(np.searchsorted(before, np.arange(0, int(q.sum()) + 1, segment_levels)))
        parts = [(lo, hi) for lo, hi in zip(cut, [*cut, len(h)][1:], strict=True) if lo < hi]
        return Segments(h[[lo for lo, _ in parts]] if parts else np.zeros(0, U), [LevelFilter(h[lo:hi], q[lo:hi], bits_per_key) for lo, hi in parts])

    def levels(self, h: np.ndarray) -> np.ndarray:
        """Levels of ``h`` (in order)."""
        out = np.zeros(len(h), np.uint8)
        cut = np.searchsorted(h, self.firsts)
        for lo, hi, part in zip(cut, [*cut, len(h)][1:], self.filters, strict=True):
            out[lo:hi] = part.levels(h[lo:hi])
        return out

    def packed(self) -> tuple[bytes, bytes, list[bytes]]:
        return self.firsts.tobytes(), np.array([f.bits for f in self.filters], np.int64).tobytes(), [f.data.tobytes() for f in self.filters]

    @staticmethod
    def unpacked(firsts: bytes, bits: bytes, data: list[bytes]) -> Segments:
        filters = []
        for n, d in zip(np.frombuffer(bits, np.int64), data, strict=True):
            own = LevelFilter.__new__(LevelFilter)
            own.bits, own.data = int(n), np.frombuffer(d, np.uint8)
            filters.append(own)
        return Segments(np.frombuffer(firsts, U), filters)


_MODEL_SQL = "rng int, words binary, word_counts binary, word_firsts binary, word_bits binary, word_filters array<binary>, firsts binary, bits binary, filters array<binary>, kinds long, total long"
_MODEL = pa.schema([("rng", pa.int32()), ("words", pa.binary()), ("word_counts", pa.binary()), ("word_firsts", pa.binary()), ("word_bits", pa.binary()), ("word_filters", pa.list_(pa.binary())), ("firsts", pa.binary()), ("bits", pa.binary()), ("filters", pa.list_(pa.binary())), ("kinds", pa.int64()), ("total", pa.int64())])


def _build(bits_per_key: int, segment_levels: int):
    """A hash range's row of the model, from the training runs' counts."""

    def summed(ids, times):
        """Distinct ids, in order, and their counts."""
        h = np.concatenate(ids)
        order = np.argsort(h)
        h, times = h[order], np.concatenate(times)[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[first], np.add.reduceat(times, first, dtype=np.int64) if len(h) else np.zeros(0, np.int64)

    def run(table: pa.Table) -> pa.Table:
        col = {name: table.column(name).to_pylist() for name in table.column_names}
        ids = [np.frombuffer(x, U) for x in col["words"]]
        w, c = summed(ids, [_unpacked_times(x, len(i)) for x, i in zip(col["word_times"], ids, strict=True)])
        row = [col["rng"][0], w.tobytes(), _packed_times(c), *Segments.build(w, c, bits_per_key, segment_levels).packed()]
        kinds, total = len(w), int(c.sum())
        ids = [_unpack(*x) for x in zip(col["first"], col["wide"], col["steps"], strict=True)]
        row += Segments.build(*summed(ids, [_unpacked_times(x, len(i)) for x, i in zip(col["times"], ids, strict=True)]), bits_per_key, segment_levels).packed()
        return pa.Table.from_batches([_batch([(*row, kinds, total)], _MODEL)])

    return run


_TOLD = pa.schema([("flush", pa.int64()), ("rng", pa.int32()), ("word_levels", pa.binary()), ("counts", pa.binary()), ("levels", pa.binary())])
_TOLD_SQL = "flush long, rng int, word_levels binary, counts binary, levels binary"


def _tell(asked: pa.Table, model: pa.Table) -> pa.Table:
    """Of a hash range: levels that its segments give what each run asked for, and words' exact counts."""
    own = model.to_pylist()[0] if model.num_rows else None
    words_ = np.frombuffer(own["words"], U) if own else np.zeros(0, U)
    known = _unpacked_times(own["word_counts"], len(words_)).astype(np.int64) if own else np.zeros(0, np.int64)
    none = Segments(np.zeros(0, U), [])
    word_filter = Segments.unpacked(own["word_firsts"], own["word_bits"], own["word_filters"]) if own else none
    gram_filter = Segments.unpacked(own["firsts"], own["bits"], own["filters"]) if own else none
    rows = asked.to_pylist()
    if not rows:
        return pa.Table.from_batches([], schema=_TOLD)

    def answers(parts, answer):
        """``answer`` of all runs' ids together, each id once, as a compressed part a run."""
        ids, back = np.unique(np.concatenate(parts), return_inverse=True)
        each = answer(ids)[back]
        ends = np.cumsum([len(x) for x in parts])
        return [zlib.compress(each[end - len(x) : end].tobytes(), 1) for x, end in zip(parts, ends, strict=True)]

    def exact(ids):
        at = np.minimum(np.searchsorted(words_, ids), max(len(words_) - 1, 0))
        return np.where(words_[at] == ids, known[at], 0) if len(words_) else np.zeros(len(ids), np.int64)

    words_asked = [np.frombuffer(x["words"], U) for x in rows]
    grams = [_unpack(x["first"], x["wide"], x["steps"]) for x in rows]
    told = [answers(words_asked, word_filter.levels), answers(words_asked, exact), answers(grams, gram_filter.levels)]
    return pa.Table.from_batches([_batch([(x["flush"], x["rng"], *t) for x, *t in zip(rows, *told, strict=True)], _TOLD)])


def probabilities(levels, text, total, kinds) -> np.ndarray:
    """P of each token after the tokens before it in its text, from the levels of n-grams."""
    word, *longer = levels
    p = (low(word) + 0.5) / (total + 0.5 * (kinds + 1))
    context = word
    for gram, prior, n in zip(longer, PRIORS, (1, 2), strict=True):
        # the context is the next shorter n-gram that ends at the token before
        own = np.flatnonzero(text[n:] == text[: len(text) - n]) + n
        c = high(context[own - 1])
        p[own] = np.where(c > 0, (np.minimum(low(gram[own]), c) + prior * p[own]) / (c + prior), p[own])
        context = gram
    return p


def _log_probability(levels, text, n_texts, total, kinds) -> np.ndarray:
    """Sum over each text of log10 P."""
    return np.bincount(text, np.log10(probabilities(levels, text, total, kinds)), minlength=n_texts)


def _held_texts(batches):
    """The rows of each run, packed."""
    for no, held in _flushes(batches):
        out = pa.BufferOutputStream()
        ids, texts = (pa.concat_arrays([x[i] for x in held]) for i in (0, 2))
        t = pa.table([ids, pa.array(np.concatenate([x[1] for x in held])), texts], names=["doc_id", "learn", "text"])
        with pa.ipc.new_stream(out, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_table(t)
        yield pa.RecordBatch.from_arrays([pa.array([no]), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["flush", "texts"])


_SCORES_SQL = "doc_id long, learn boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(held: pa.Table, told: pa.Table, kinds: int, total: int) -> pa.Table:
    """Of a run: its texts, scored with what the ranges told of its n-grams."""
    if held.num_rows != 1 or not told.num_rows:
        raise ValueError("the table gave other rows when it was read again; write it first")
    told = told.sort_by("rng")
    word_levels, counts, gram_levels = (np.frombuffer(b"".join(map(zlib.decompress, told.column(x).to_pylist())), kind) for x, kind in (("word_levels", np.uint8), ("counts", np.int64), ("levels", np.uint8)))
    t = pa.ipc.open_stream(held.column("texts")[0].as_py()).read_all().combine_chunks()
    n = t.num_rows
    tokens = [(lo, _tokens(data, off)) for lo, _, data, off in chunks(t.column("text").combine_chunks())]
    text = np.concatenate([x[1] + lo for lo, x in tokens])
    h, pair, triple = (np.concatenate([x[i] for _, x in tokens]) for i in (0, 2, 3))
    w, g = _grams(h, pair, triple)
    (words_, w_back), (grams, back) = np.unique(w, return_inverse=True), np.unique(g, return_inverse=True)
    if len(words_) != len(counts) or len(grams) != len(gram_levels):
        raise ValueError("a run got levels for other n-grams than its own")
    longer, at = [], 0
    for gram in (pair, triple):
        own = np.flatnonzero(gram)
        level = np.zeros(len(h), np.uint8)
        level[own] = gram_levels[back[at : at + len(own)]]
        longer.append(level)
        at += len(own)
    sizes = np.bincount(text, minlength=n)
    known = np.bincount(text, counts[w_back] > 0, minlength=n).astype(np.int64)
    base = np.bincount(text, np.log10(counts + 0.5)[w_back], minlength=n) - sizes * np.log10(total + 0.5 * (kinds + 1))
    score = _log_probability([word_levels[w_back], *longer], text, n, total, kinds)
    return pa.table([t.column("doc_id"), t.column("learn"), pa.array(sizes), pa.array(known), pa.array([total] * n, pa.int64()), pa.array(base), pa.array(score)], names=["doc_id", "learn", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


@contextmanager
def _short_lived_shuffles(spark: SparkSession):
    """Within it, a query's shuffle files go when the query ends instead of when its plan is collected as garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


@dataclass
class LanguageModel:
    """A fitted model: its table (a row a hash range), the number of ranges, distinct and all training tokens."""

    table: DataFrame
    ranges: int
    kinds: int
    total: int

    def release(self) -> None:
        release(self.table)


def fit(docs: DataFrame, text: str = "text", bits_per_key: int = BITS_PER_KEY, ranges: int | None = None, segment_levels: int = SEGMENT_LEVELS) -> LanguageModel:
    """The model of all texts of ``docs``; its table lies in the shared folder until ``release``.

    A null text counts as empty, which is one end token; repeated rows count each; an empty table gives a model under which
    every token has probability 1. ``ranges`` follows the bytes of text unless given.
    """
    own = docs.select(F.lit(0).cast("long").alias("doc_id"), F.lit(True).alias("learn"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    if ranges is None:
        ranges = ranges_of(own)
    with _short_lived_shuffles(docs.sparkSession):
        table = materialise(own.mapInArrow(_count(ranges), _COUNTED_SQL).groupBy("rng").applyInArrow(_build(bits_per_key, segment_levels), _MODEL_SQL), "model")
    kinds, total = table.agg(F.coalesce(F.sum("kinds"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    return LanguageModel(table, ranges, kinds, total)


def ranges_of(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_RANGES, -(-size // RANGE_BYTES))


def score_with(model: LanguageModel, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn=None) -> DataFrame:
    """Score every text of ``docs``, whether or not the model was fitted to it.

    Returns for each row doc_id, learn (as given, else false), n_tokens, n_known, train_tokens, base_score and score. Tokens
    are words (runs of non-white-space bytes, A-Z lowered) and one end token. A null text counts as empty, a null ``learn``
    as false; repeated rows are scored each; other columns are ignored; an empty table gives no rows. A very long text is one
    run of its own.
    """
    flag = F.lit(False) if learn is None else F.coalesce(learn, F.lit(False))
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), flag.alias("learn"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # runs are formed twice: rows that come out of an exchange, or of expressions drawn anew, may differ in between
    plan = own._jdf.queryExecution()
    written = "Exchange" in plan.executedPlan().toString() or not plan.analyzed().deterministic()
    if written:
        own = materialise(own, "texts")
    kinds, total = model.kinds, model.total
    asked = own.mapInArrow(_ask(model.ranges), _ASKED_SQL)
    with _short_lived_shuffles(docs.sparkSession):
        told = materialise(asked.groupBy("rng").cogroup(model.table.groupBy("rng")).applyInArrow(_tell, _TOLD_SQL), "told")
    held = own.mapInArrow(_held_texts, "flush long, texts binary")
    scores = materialise(held.groupBy("flush").cogroup(told.groupBy("flush")).applyInArrow(lambda a, b: _score(a, b, kinds, total), _SCORES_SQL), "scores")
    release(told, *([own] if written else []))
    return scores


def score_texts(docs: DataFrame, learn, doc_id: str = "doc_id", text: str = "text", bits_per_key: int = BITS_PER_KEY, segment_levels: int = SEGMENT_LEVELS) -> DataFrame:
    """Score every text with a model of the rows where ``learn`` (a boolean Column) holds; see ``fit`` and ``score_with``."""
    texts = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    model = fit(docs.where(F.coalesce(learn, F.lit(False))), text, bits_per_key, ranges_of(texts), segment_levels)
    scores = score_with(model, docs, doc_id, text, learn)
    model.release()
    return scores
