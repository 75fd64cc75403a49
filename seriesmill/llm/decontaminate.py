"""Benchmark decontamination by spaced-seed hashing.

A fixed mask keeps some word positions of a window and ignores the others, so a substituted word at an ignored position
leaves the hash as it is. ``MASKS`` was chosen by exhaustive search: whatever 3 words of a 12-word window differ, one
mask hits somewhere inside. Hits are verified along their diagonal: an overlap is a 12-word window of the test item of
which 9 words or more (75 %) stand at the same places in the document. So the result is exact, not only likely.
Items of n < 12 words are one window of n words, of which 75 % or more must agree; masks for these lengths are found by
a greedy cover: whatever words may differ, one mask ignores them all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, chunks, windows, words

WINDOW, EQUAL = 12, 9
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 7, 8), (0, 1, 4, 6, 7), (0, 1, 3, 4, 5))
#: Bound of a broadcast: items go out in blocks of at most so many words (8 bytes a word, 16 a seed of each mask, and
#: 2^22 bytes a mask for the filter of seeds).
BLOCK_WORDS = 1 << 17
#: Pairs of equal seeds looked at together.
STEP_PAIRS = 1 << 20
SCHEMA = "doc_id long, item_id long, doc_word long, item_word long, length long, equal long"
_FILTER_BITS = 22


def need_of(n):
    """Words of a window of n that must agree."""
    return -(-n * EQUAL // WINDOW)


@cache
def masks_of(n: int) -> tuple[tuple[int, ...], ...]:
    """Masks of a window of n words such that each choice of n - need_of(n) differing words leaves one mask untouched."""
    spare = n - need_of(n)
    open_ = set(combinations(range(n), spare))
    weight = max(1, min(n - spare, 5 if n > 8 else 4))
    masks, out = list(combinations(range(n), weight)), []
    while open_:
        best = max(masks, key=lambda m: (sum(not set(m) & set(d) for d in open_), m))
        out.append(best)
        open_ = {d for d in open_ if set(best) & set(d)}
    return tuple(out)


class SeedIndex:
    """Words and masked seeds of a block of test items."""

    def __init__(self, ids: list, texts: list[str]):
        h = np.zeros(0, U)
        text = np.zeros(0, np.int64)
        for lo, _, data, off in chunks(pa.array(texts, pa.string())):
            x, t = words(data, off)
            h, text = np.concatenate([h, x]), np.concatenate([text, t + lo])
        self.ids, self.words, self.owner = np.array(ids, np.int64), h, text
        self.start = np.searchsorted(text, np.arange(len(ids) + 1))
        size = np.diff(self.start)
        self.tables = []
        for places in MASKS:
            s, at = windows(h, text, places)
            self._add(places, s, at, size[text[at]] >= WINDOW)
        for n in np.unique(size[(size > 0) & (size < WINDOW)]):
            for mask in masks_of(int(n)):
                places = tuple(p - mask[0] for p in mask)
                s, at = windows(h, text, places)
                self._add(places, s, at, (size[text[at]] == n) & (at - self.start[text[at]] == mask[0]))

    def _add(self, places, s, at, keep):
        s, at = s[keep], at[keep]
        order = np.argsort(s, kind="stable")
        s, at = s[order], at[order]
        near = np.zeros(1 << _FILTER_BITS, bool)
        near[(s >> U(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.tables.append((places, s, at, near))

    def overlaps(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, item, first word in text, in item, length, equal words): the best overlap of each text, item and diagonal."""
        h, text = words(data, off)
        base = np.searchsorted(text, np.arange(len(off)))
        seen = []
        for places, s, at, near in self.tables:
            if not len(s):
                continue
            w, where = windows(h, text, places)
            may = np.flatnonzero(near[(w >> U(64 - _FILTER_BITS)).astype(np.int64)])
            lo, hi = np.searchsorted(s, w[may], "left"), np.searchsorted(s, w[may], "right")
            where, n = where[may], hi - lo
            # a seed that text and item hold often makes many pairs: only their diagonals are kept, a bounded step at a time
            many = np.cumsum(n)
            for first, last in _steps(many):
                m = n[first:last]
                pos = np.repeat(where[first:last], m)
                item_pos = at[np.repeat(lo[first:last], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
                item = self.owner[item_pos]
                seen.append(np.unique(np.stack([text[pos], item, pos - (item_pos - self.start[item])]), axis=1))
                if len(seen) > 8:
                    seen = [np.unique(np.concatenate(seen, axis=1), axis=1)]
        if not seen:
            return
        t, item, diagonal = np.unique(np.concatenate(seen, axis=1), axis=1)
        step = 20_000
        for lo in range(0, len(t), step):
            yield from self._verify(h, base, t[lo : lo + step], item[lo : lo + step], diagonal[lo : lo + step])

    def _verify(self, h, base, t, item, diagonal):
        size = (self.start[item + 1] - self.start[item]).astype(np.int64)
        n = np.repeat(np.arange(len(t)), size)
        place = np.arange(len(n)) - np.repeat(np.cumsum(size) - size, size)
        at = diagonal[n] + place
        inside = (at >= base[t][n]) & (at < base[t + 1][n])
        same = np.zeros(len(n), np.int64)
        same[inside] = h[at[inside]] == self.words[self.start[item][n[inside]] + place[inside]]
        total = np.concatenate([[0], np.cumsum(same)])
        end = np.cumsum(size)
        width = np.minimum(size, WINDOW)
        need = need_of(width)
        fits = place + width[n] <= size[n]
        at = np.flatnonzero(fits)
        score = total[at + width[n[at]]] - total[at]
        good = score >= need[n[at]]
        at, score = at[good], score[good]
        row = n[at]
        if not len(row):
            return
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        last = np.concatenate([first[1:] - 1, [len(row) - 1]])
        r = row[first]
        lo, hi = place[at[first]], place[at[last]] + width[r]
        equal = total[end[r] - size[r] + hi] - total[end[r] - size[r] + lo]
        yield t[r], item[r], diagonal[r] + lo - base[t[r]], lo, hi - lo, equal


def _steps(total: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of places whose counts (``total`` their running sum) come to about ``STEP_PAIRS``, one place at least."""
    lo = 0
    while lo < len(total) and total[-1]:
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + STEP_PAIRS, "right")))
        yield lo, hi
        lo = hi


def _scan(index):
    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1)):
                ids = b.column(0).slice(lo, hi - lo)
                for t, item, dw, iw, n, eq in index.value.overlaps(data, off):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(t)), *(pa.array(x, pa.int64()) for x in (index.value.ids[item], dw, iw, n, eq))], ["doc_id", "item_id", "doc_word", "item_word", "length", "equal"])

    return run


def _blocks(items: DataFrame) -> Iterator[tuple[list, list]]:
    ids, texts, held = [], [], 0
    for item, text in items.toLocalIterator():
        size = len(text.split())
        if ids and held + size > BLOCK_WORDS:
            yield ids, texts
            ids, texts, held = [], [], 0
        ids.append(item)
        texts.append(text)
        held += size
    if ids:
        yield ids, texts


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Overlaps of documents with test items: doc_id, item_id, doc_word, item_word (both from 0), length, equal (words).

    One row for each stretch: for a document, an item and a diagonal, from the first to the last window that passes.
    Words are runs of non-white-space bytes with A-Z lowered. Null or word-less texts and items overlap with nothing, null
    item ids are skipped, repeated rows give repeated results, other columns are ignored, an empty table gives no rows;
    texts of any length are read whole. Test items are a stated query
    set: they go to the workers in blocks of at most ``BLOCK_WORDS`` words, with one pass over the documents a block.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t")).where("i is not null and t is not null")
    sc, out = docs.sparkSession.sparkContext, None
    for ids, texts in _blocks(items):
        found = own.mapInArrow(_scan(sc.broadcast(SeedIndex(ids, texts))), SCHEMA)
        out = found if out is None else out.unionAll(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def contamination(docs: DataFrame, benchmark: DataFrame, **names: str) -> DataFrame:
    """(doc_id, item_id, overlaps, longest, equal): one row for each document and the test item it holds a part of."""
    best = F.max(F.struct("length", "equal"))
    return benchmark_overlaps(docs, benchmark, **names).groupBy("doc_id", "item_id").agg(F.count("*").alias("overlaps"), best.alias("best")).select("doc_id", "item_id", "overlaps", F.col("best.length").alias("longest"), F.col("best.equal").alias("equal"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text overlaps with a test item.

    Rows are told apart by id and text, so a clean text stays whatever else its id names, and a leaked one goes under a null
    id too; rows without text stay. All columns come back as they are.
    """
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(doc_id, text).alias("key"), F.col(text).alias("own_text"))
    leaked = benchmark_overlaps(rows, benchmark, doc_id="key", text="own_text").select(F.col("doc_id").alias("key")).distinct()
    return rows.join(leaked, "key", "left_anti").select("row.*")
