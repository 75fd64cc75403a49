"""Vectorised word hashing over Arrow text columns (numpy, no per-word Python objects).

A chunk is a run of whole texts laid end to end. Words are found with a byte table, and a word's hash is a
polynomial over its bytes read off one prefix sum of the chunk, so the cost is a few passes over the bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 1 << 15
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, U)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U) * U(_P) + U(seed)) | U(1)


BYTE_VALUE = _constants(256, 17)
PLACE = _constants(64, 99)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Letters, digits and every byte of a non-ASCII character.
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True

#: Bytes hashed off one prefix sum, and the powers that it needs.
BLOCK_BYTES = CHUNK_BYTES


def _powers_of(base: int) -> np.ndarray:
    steps = np.full(BLOCK_BYTES + 1, base, U)
    steps[0] = 1
    return np.multiply.accumulate(steps)


_UP, _DOWN = _powers_of(_P), _powers_of(_P_INV)


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of whole texts; a null counts as empty, a long text is a run of its own."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def segments(data: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """A text in pieces of about ``limit`` bytes, cut only before white space (so no word is cut)."""
    lo = 0
    while lo < len(data):
        hi = min(lo + limit, len(data))
        while hi < len(data):
            space = np.flatnonzero(~NOT_SPACE[data[hi : hi + limit]])
            if len(space):
                hi += int(space[0])
                break
            hi = min(hi + limit, len(data))
        yield data[lo:hi]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each maximal run of bytes in ``table``; no run crosses a text's end."""
    m = table[data]
    if not len(m):
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(len(m) + 1, bool)
    first[offsets] = True
    before, after = np.empty(len(m), bool), np.empty(len(m), bool)
    before[0] = after[-1] = False
    before[1:] = m[:-1]
    after[:-1] = m[1:]
    before &= ~first[:-1]
    after &= ~first[1:]
    starts, ends = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def raw_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span (starts in order) of a row of byte values below 256.

    Works in blocks of at most ``BLOCK_BYTES``, so memory beyond the result doesn't follow the length of a text.
    """
    out = np.zeros(len(starts), U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = min(int(np.searchsorted(starts, base + BLOCK_BYTES, "left")), len(starts))
        fits = ends[i:j] <= base + BLOCK_BYTES
        j = i + (len(fits) if fits.all() else int(np.argmin(fits)))
        if j == i:  # a span longer than a block: its pieces' hashes, moved to their places
            a, z, total = base, int(ends[i]), 0
            while a < z:
                piece = values[a : min(a + BLOCK_BYTES, z)]
                total += int((BYTE_VALUE[piece] * _UP[: len(piece)]).sum(dtype=U)) * pow(_P, a - base, 1 << 64)
                a += len(piece)
            out[i] = total & 0xFFFFFFFFFFFFFFFF
            i += 1
            continue
        own = values[base : int(ends[i:j].max())]
        sums = np.zeros(len(own) + 1, U)
        np.cumsum(BYTE_VALUE[own] * _UP[: len(own)], out=sums[1:])
        lo = starts[i:j] - base
        out[i:j] = (sums[ends[i:j] - base] - sums[lo]) * _DOWN[lo]
        i = j
    return out


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span's bytes with A-Z lowered; spans in order of their starts."""
    return mix(raw_hashes(LOWER[data], starts, ends))


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each word of a chunk, in order."""
    starts, ends, text = spans(data, offsets, table)
    return hashes(data, starts, ends), text


def windows(h: np.ndarray, text: np.ndarray, places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of the words at ``places`` (ascending, from 0) after each word, within one text."""
    n = len(h) - places[-1]
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    total = np.zeros(n, U)
    for j in places:
        total += h[j : j + n] * PLACE[j]
    whole = np.flatnonzero(text[:n] == text[places[-1] : places[-1] + n])
    return mix(total[whole]), whole


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sets of k-word shingles of each text of a chunk; a text of 1 to k-1 words has one shingle, its whole sequence.

    Returns (size, set key, text << 48 | 48-bit shingle, sorted and distinct). Equal sets have equal keys; empty ones 0.
    """
    h, text = words(data, offsets)
    n_texts = len(offsets) - 1
    s, at = windows(h, text, tuple(range(k)))
    owner = text[at]
    n_words = np.bincount(text, minlength=n_texts)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        pos = np.searchsorted(text, short)
        add = np.zeros(len(short), U)
        for j in range(k - 1):
            has = n_words[short] > j
            add[has] += h[pos[has] + j] * PLACE[j]
        s = np.concatenate([s, mix(add + n_words[short].astype(U))])
        owner = np.concatenate([owner, short])
    packed = np.sort((owner.astype(U) << U(48)) | (s >> U(16)))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    owner = (packed >> U(48)).astype(np.int64)
    size = np.bincount(owner, minlength=n_texts)
    key = np.zeros(n_texts, U)
    full = np.flatnonzero(size)
    if len(full):
        key[full] = mix(np.add.reduceat(mix(packed & U((1 << 48) - 1)), np.searchsorted(owner, full)) + size[full].astype(U))
    return size, key, packed
