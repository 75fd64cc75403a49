"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the longest as fit, then the binary
digits of the rest, longest first. Each piece is a sequence of its own, so no sequence crosses documents and nothing is
padded; sequences of one length form a bucket (``bucket``, the exponent) that a training loader can batch.

Token ids are those of the ``tokenizers`` library for a BPE model with word ends. Most words are encoded here with numpy:
a chunk's distinct pretokens are merged together, rank by rank, and kept for later chunks. Words with anything but ASCII
and the lower Latin-1 letters, or with characters that the tokenizer's pattern treats specially, go through the library.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import CHUNK_BYTES, LOWER, NOT_SPACE, U, chunks, mix, raw_hashes, segments, spans

MOST = 4096
LONG_WORD = 48
CACHE_WORDS = 1_000_000
_OTHER, _LETTER, _DIGIT, _MARK, _WHOLE = 0, 1, 2, 3, 4
_KIND = np.full(256, _MARK, np.uint8)
_KIND[~NOT_SPACE] = _OTHER
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[128:] = _LETTER
_KIND[48:58] = _DIGIT


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE vocabularies (the usual published rule)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + extra))
        extra += b not in plain
    return out


class WordBpe:
    """Encoder for a ``tokenizers`` JSON file of BPE with end-of-word tokens, lower-casing, and letter/digit/mark pretokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        key = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.rank, self.made = key[order], order, made
        # merges by a hash of their pair; the few pairs that share a slot are found by binary search
        slot = self._slot(self.keys)
        self.slots = np.full(1 << 19, -1, np.int32)
        self.slots[slot] = np.arange(len(slot))
        self.crowded = np.bincount(slot, minlength=1 << 19) > 1
        self.known = np.zeros(0, U)
        self.at = np.zeros((0, 2), np.int64)
        self.pool = np.zeros(0, np.int64)

    @staticmethod
    def _slot(pair: np.ndarray) -> np.ndarray:
        return ((pair.astype(U) * U(0x9E3779B97F4A7C15)) >> U(45)).astype(np.int64)

    def _find(self, pair: np.ndarray) -> np.ndarray:
        """Index of each pair among the merges, -1 for none."""
        slot = self._slot(pair)
        at = self.slots[slot]
        shared = np.flatnonzero(self.crowded[slot])
        if len(shared):
            at[shared] = np.minimum(np.searchsorted(self.keys, pair[shared]), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, at, -1)

    def _merge(self, ids: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Token ids and lengths of n words given as bytes' ids: in each round every word makes its lowest-ranked merge."""
        done_ids, done_word = [], []
        while len(ids):
            pair = ids[:-1] << 16 | ids[1:]
            at = self._find(pair)
            ok = (at >= 0) & (word[1:] == word[:-1])
            rank = np.where(ok, self.rank[at], 1 << 30)
            rank = np.append(rank, 1 << 30)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            low_of = np.repeat(low, size)
            idle = low_of == 1 << 30
            if idle.any():
                done_ids.append(ids[idle])
                done_word.append(word[idle])
                ids, word, rank, low_of = ids[~idle], word[~idle], rank[~idle], low_of[~idle]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == low_of)
            run = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
            start = np.maximum.accumulate(np.where(run, np.arange(len(hit)), 0))
            hit = hit[(np.arange(len(hit)) - start) % 2 == 0]
            ids[hit] = self.made[rank[hit]]
            keep = np.ones(len(ids), bool)
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=n)

    def _learn(self, new: np.ndarray, data: np.ndarray, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> None:
        """Encode distinct pretokens (hash, place in the chunk) and keep them."""
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.at, self.pool = self.known[:0], self.at[:0], self.pool[:0]
        quick = np.flatnonzero(~whole & (ends - starts <= LONG_WORD))
        slow = np.flatnonzero(whole | (ends - starts > LONG_WORD))
        size = (ends - starts)[quick]
        word = np.repeat(np.arange(len(quick)), size)
        place = np.repeat(starts[quick] - np.cumsum(size) + size, size) + np.arange(len(word))
        ids = self.inner[data[place]]
        if len(quick):
            ids[np.cumsum(size) - 1] = self.last[data[ends[quick] - 1]]
        pool, count = self._merge(ids, word, len(quick)) if len(quick) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        parts, counts = [pool], np.zeros(len(new), np.int64)
        counts[quick] = count
        if len(slow):
            found = self.library.encode_batch([bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(starts[slow], ends[slow], strict=True)], add_special_tokens=False)
            parts += [np.array(e.ids, np.int64) for e in found]
            counts[slow] = [len(e.ids) for e in found]
        order = np.concatenate([quick, slow])
        offset = np.zeros(len(new), np.int64)
        offset[order] = len(self.pool) + np.cumsum(counts[order]) - counts[order]
        self.pool = np.concatenate([self.pool, *parts])
        known = np.concatenate([self.known, new])
        at = np.concatenate([self.at, np.stack([offset, counts], axis=1)])
        order = np.argsort(known)
        self.known, self.at = known[order], at[order]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk's texts end to end, and how many each text has; one long text is encoded a segment at a time."""
        n_texts = len(off) - 1
        if n_texts == 1 and len(raw) > 4 * CHUNK_BYTES:
            parts = [self.encode(x, np.array([0, len(x)]))[0].astype(np.uint32) for x in segments(raw)]
            return np.concatenate(parts), np.array([sum(map(len, parts))])
        if not len(raw):
            return np.zeros(0, np.int64), np.zeros(n_texts, np.int64)
        data = LOWER[raw]
        lead = np.zeros(len(raw), bool)
        lead[1:] = raw[:-1] == 0xC3
        up = lead & (raw >= 0x80) & (raw <= 0x9E)
        data[up] += 32
        bad = ((raw >= 128) & (raw != 0xC3) & ~lead) | (raw == 39) | (raw == 60) | ((raw < 32) & NOT_SPACE[raw]) | (raw == 127) | (lead & ((raw == 0x97) | (raw == 0xB7)))
        kind = _KIND[raw]
        if bad.any():
            starts, ends, _ = spans(raw, off, NOT_SPACE)
            n_bad = np.concatenate([[0], np.cumsum(bad)])
            for a, b in zip(*(x[n_bad[ends] > n_bad[starts]] for x in (starts, ends)), strict=True):
                kind[a:b] = _WHOLE
        begin = np.zeros(len(raw) + 1, bool)
        begin[off] = True
        fresh = begin[:-1].copy()
        fresh[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        starts = np.flatnonzero(fresh)
        real = kind[starts] != _OTHER
        starts, ends = starts[real], np.append(starts[1:], len(raw))[real]
        text = np.repeat(np.arange(n_texts), np.diff(np.searchsorted(starts, off)))
        whole = kind[starts] == _WHOLE
        h = mix(raw_hashes(np.where(kind == _WHOLE, raw, data), starts, ends) + whole.astype(U))
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._has(uniq))
        if len(new) and len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.at, self.pool = self.known[:0], self.at[:0], self.pool[:0]
            new = np.arange(len(uniq))
        if len(new):
            f = first[new]
            self._learn(uniq[new], data, raw, starts[f], ends[f], whole[f])
        at = self.at[np.searchsorted(self.known, uniq)][inverse]
        size = at[:, 1]
        place = np.repeat(at[:, 0] - np.cumsum(size) + size, size) + np.arange(size.sum())
        return self.pool[place], np.bincount(text, size, minlength=n_texts).astype(np.int64)

    def _has(self, h: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(h), bool)
        i = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        return self.known[i] == h


def pieces_of(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length) of the pieces of texts of n tokens each: longest first, every length a power of two."""
    top = most.bit_length() - 1
    text, start, length = [], [], []
    full = n >> top
    t = np.repeat(np.arange(len(n)), full)
    text.append(t)
    start.append((np.arange(len(t)) - np.repeat(np.cumsum(full) - full, full)) << top)
    length.append(np.full(len(t), most))
    for bit in range(top - 1, -1, -1):
        t = np.flatnonzero(n >> bit & 1)
        text.append(t)
        start.append(n[t] >> (bit + 1) << (bit + 1))
        length.append(np.full(len(t), 1 << bit))
    text, start, length = (np.concatenate(x) for x in (text, start, length))
    order = np.lexsort((start, text))
    return text[order], start[order], length[order]


_encoders: dict[str, WordBpe] = {}


def _pack(path: str, most: int, end_id: int, with_ids: bool):
    def run(batches):
        if path not in _encoders:
            _encoders[path] = WordBpe(path)
        bpe = _encoders[path]
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1), 2 << 20):
                ids, n = bpe.encode(data, off)
                ids = np.insert(ids, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                base = np.cumsum(n) - n
                text, start, length = pieces_of(n, most)
                at = base[text] + start
                buffer = memoryview(ids).cast("B")
                crc = np.array([zlib.crc32(buffer[4 * a : 4 * z]) for a, z in zip(at, at + length, strict=True)], np.int64)
                cols = [b.column(0).slice(lo, hi - lo).take(pa.array(text)), *(pa.array(x.astype(np.int64)) for x in (start, length, crc, n[text], np.log2(length)))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.append(at, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pack(docs: DataFrame, tokenizer: str, most: int = MOST, end_id: int = 2, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset (and ids).

    ``most`` is a power of two. ``tokenizer`` is the path of the BPE file, the same on every machine. A null or empty text
    is its end token alone (one piece of length 1); repeated rows are packed each; null doc_ids pass through; an empty
    table gives no rows. A sequence holds one piece, so ``offset`` is 0 and ``sequence_id`` unique.
    """
    if most & (most - 1):
        raise ValueError("most must be a power of two")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket long" + ", ids array<int>" * with_ids
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return own.mapInArrow(_pack(tokenizer, most, end_id, with_ids), schema).withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces with one folder for each length, so that a loader reads sequences of equal length together."""
    pieces.write.partitionBy("bucket").parquet(path)
