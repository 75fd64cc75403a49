"""Lempel-Ziv phrase fingerprints (after the Lempel-Ziv Jaccard distance of Raff and Nicholas 2017).

A text's UTF-8 bytes are parsed as LZ78 does: each phrase is the shortest piece that isn't in the dictionary yet, and joins
it. The set of phrases is hashed into a minimum-hash signature of ``SLOTS`` 16-bit values by one permutation; slots without a
phrase borrow from others by a fixed hash order. Two texts' likeness is the share of equal slots, an estimate of the Jaccard
index of their phrase sets, which, as compression does, sees shared passages wherever they stand.

A dictionary of ``MOST_PHRASES`` starts anew, so memory doesn't follow the text's length; phrases of all its terms count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import U, mix, raw_hashes
from .storage import ranges_for

SLOTS, BITS = 128, 7
MOST_PHRASES = 1 << 20
#: Order in which an empty slot looks at the others.
_LOOK = np.argsort(mix(np.arange(SLOTS * SLOTS, dtype=U) + U(77)).reshape(SLOTS, SLOTS), axis=1)


class Parse:
    """LZ78 parse of a text that can go on with another ending.

    The dictionary is a trie: a phrase's number (in steps of 256) and the next byte lead to the longer phrase's number, so a
    byte is looked up once and no piece of the text is cut out.
    """

    def __init__(self, known: dict | None = None, start: int = 0, ends: list | None = None):
        self.known, self.start, self.ends = known if known is not None else {}, start, ends if ends is not None else []

    def read(self, data: bytes, until: int) -> None:
        """Read on to byte ``until``: a phrase that isn't complete there stays open from ``start``."""
        known, start, add = self.known, self.start, self.ends.append
        find, node, new, most = known.get, 0, (len(known) + 1) << 8, MOST_PHRASES << 8
        full = True
        while full:
            full = False
            for end, byte in enumerate(data[start:until], start + 1):
                at = node | byte
                node = find(at)
                if node is None:
                    node = 0
                    if new > most:
                        # the phrase is looked up anew
                        known.clear()
                        new, full = 256, True
                        break
                    known[at] = new
                    new += 256
                    add(end)
                    start = end
        self.start = start

    def fork(self) -> Parse:
        return Parse(dict(self.known), self.start, list(self.ends))


def _lowest(data: bytes, stop: np.ndarray, parts: np.ndarray, n_parts: int) -> np.ndarray:
    """Least hashes by part and slot of the phrases that end at ``stop``, one behind the other."""
    start = np.concatenate([[0], stop[:-1]])
    h = mix(raw_hashes(np.frombuffer(data, np.uint8), start, stop) + (stop - start).astype(U))
    low = np.full(n_parts * SLOTS, np.iinfo(U).max, U)
    np.minimum.at(low, parts * SLOTS + (h >> U(64 - BITS)).astype(np.int64), h & U((1 << (64 - BITS)) - 1))
    return low.reshape(n_parts, SLOTS)


def _signed(low: np.ndarray) -> bytes:
    """Signature of the least hashes of one text's slots."""
    full = low != np.iinfo(U).max
    bare = np.flatnonzero(~full)
    if len(bare) == SLOTS:
        return b""
    if len(bare):
        look = _LOOK[bare]
        lend = look[np.arange(len(bare)), full[look].argmax(axis=1)]
        low[bare] = mix(low[lend] + U(1) + bare.astype(U))
    return (mix(low) >> U(48)).astype(">u2").tobytes()


def signature(data: bytes, ends: list[int]) -> bytes:
    """Minimum-hash signature of the phrases that end at ``ends``: 2 bytes a slot; of no phrase, no bytes."""
    stop = np.array(ends, np.int64)
    return _signed(_lowest(data, stop, np.zeros(len(stop), np.int64), 1)[0]) if ends else b""


def signatures(data: bytes, ends: list[int], other: bytes, other_ends: list[int], shared: int) -> tuple[bytes, bytes]:
    """Signatures of two texts whose first ``shared`` phrases are the same ones; these are hashed once."""
    at = ends[shared - 1] if shared else 0
    last = ends[-1] if ends else 0
    stop = np.concatenate([np.array(ends, np.int64), np.array(other_ends[shared:], np.int64) + (last - at)])
    if not len(stop):
        return b"", b""
    parts = np.zeros(len(stop), np.int64)
    parts[shared : len(ends)], parts[len(ends) :] = 1, 2
    both, own, changed = _lowest(data[:last] + other[at:], stop, parts, 3)
    return _signed(np.minimum(both, own)), _signed(np.minimum(both, changed))


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal slots; 1 for two texts without phrases, 0 if one only has none."""
    if not a or not b:
        return float(a == b)
    return float((np.frombuffer(a, ">u2") == np.frombuffer(b, ">u2")).mean())


def characters(data: bytes) -> np.ndarray:
    """Places of the first bytes of code points."""
    return np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)


def fingerprint(text: bytes) -> bytes:
    parse = Parse()
    parse.read(text, len(text))
    return signature(text, parse.ends)


def with_edit(text: bytes, other: bytes) -> tuple[int, bytes, bytes, bytes]:
    """(code points, SHA-256 of the edited text, fingerprint, fingerprint of the edited text). The edited text has the first
    third of a text's code points (rounded down) of ``other``, or all, in place of the last third of ``text``."""
    at = characters(text)
    n, k = len(at), len(at) // 3
    cut = int(at[n - k]) if k else len(text)
    if k:
        # the k first code points of the other text lie in its first 4 k bytes
        there = characters(other[: 4 * k + 4])
        head = other[: int(there[k])] if len(there) > k else other
    else:
        head = b""
    edited = text[:cut] + head
    parse = Parse()
    parse.read(text, cut)
    changed, shared = parse.fork(), len(parse.ends)
    changed.read(edited, len(edited))
    parse.read(text, len(text))
    return n, hashlib.sha256(edited).digest(), *signatures(text, parse.ends, edited, changed.ends, shared)


_PLACED = "block int, follows boolean, k long, h long, doc_id long, text binary"


def _placed(keys: np.ndarray, hs: np.ndarray):
    """Rows with their blocks, given the first key (k, h) of each; a block's first row goes to the block before, too."""
    distinct, low = np.unique(keys, return_index=True)
    high = np.append(low[1:], len(keys))

    def run(batches):
        for b in batches:
            k, h = b.column(0).to_numpy(), b.column(1).to_numpy()
            at = np.searchsorted(distinct, k, "right") - 1
            block = np.where(at >= 0, high[at] - 1, -1)
            # ids that start several blocks: by hash
            for i in np.unique(at[(at >= 0) & (distinct[at] == k)]):
                own = np.flatnonzero((at == i) & (k == distinct[i]))
                block[own] = low[i] + np.searchsorted(hs[low[i] : high[i]], h[own], "right") - 1
            if (block < 0).any():
                raise ValueError("the table gave other rows when it was read again; write it first")
            first = np.flatnonzero((keys[block] == k) & (hs[block] == h))
            for rows, blocks, follows in ((None, block, False), (first, (block[first] - 1) % len(keys), True)):
                part = b if rows is None else b.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(np.full(len(blocks), follows)), *part.columns], ["block", "follows", "k", "h", "doc_id", "text"])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited", pa.binary()), ("own", pa.binary()), ("changed", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _fingerprinted(batches):
    """Rows of whole blocks in order: each meets the next one."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            for block, follows, doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5), strict=True):
                yield block, follows, doc_id, text.as_py()

    def results() -> Iterator[tuple]:
        held, made = None, None
        for block, follows, doc_id, text in rows():
            if held is None or held[0] != block:
                if held is not None and not held[1]:
                    raise ValueError("the table gave other rows when it was read again; write it first")
                held, made = None if follows else (block, follows, doc_id, text), None
                continue
            if held[1]:
                continue  # more copies of the row that follows the block
            n, edited, own, changed = with_edit(held[3], text)
            if made is not None:
                yield (*made, likeness(made[3], own))
            made = (held[2], n, edited, own, changed, likeness(own, changed))
            if follows:
                yield (*made, likeness(own, fingerprint(text)))
                made = None
            held = (block, follows, doc_id, text)
        if held is not None and not held[1]:
            raise ValueError("the table gave other rows when it was read again; write it first")

    found = []
    for row in results():
        found.append(row)
        if len(found) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _OUT, strict=True)], schema=_OUT)
            found = []
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), _OUT, strict=True)], schema=_OUT)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each text's fingerprint beside that of an edited text, and its likeness to the next document's.

    The next document is the one with the next smaller id (equal ids go by a hash of the text and by the text, null ids come
    last; after the last comes the first; a single row is followed by itself). Returns doc_id, n_chars (code points),
    edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next (0 to 1). A null text counts as empty: it has
    no phrases, an empty fingerprint, and is like empty texts only. Repeated rows follow one another; other columns are
    ignored; an empty table gives no rows.

    Rows are ranged by id into blocks of about the same number, a hot id's by the hash of its texts; a block's first row goes to
    the block before as well, so every row meets the next one in its task, which holds two texts at a time. The driver holds
    the first key of each block, 16 bytes.
    """
    id_, own = F.col(doc_id).cast("long"), F.coalesce(F.col(text).cast("string"), F.lit(""))
    # descending ids as ascending keys, null last
    rows = docs.select(F.coalesce(F.bitwise_not(id_), F.lit((1 << 63) - 1)).alias("k"), F.xxhash64(own).alias("h"), id_.alias("doc_id"), own.cast("binary").alias("text"))
    blocks = 4 * ranges_for(docs)
    firsts = rows.select("k", "h").repartitionByRange(blocks, "k", "h").groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("k", "h")).alias("first")).select("first.k", "first.h").toArrow()
    if not firsts.num_rows:
        return docs.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    firsts = firsts.sort_by([("k", "ascending"), ("h", "ascending")])
    placed = rows.mapInArrow(_placed(firsts.column("k").to_numpy(), firsts.column("h").to_numpy()), _PLACED)
    dealt = placed.repartition(ranges_for(docs), "block").sortWithinPartitions("block", "follows", "k", "h", "text")
    made = dealt.mapInArrow(_fingerprinted, "doc_id long, n_chars long, edited binary, own binary, changed binary, near_edited double, near_next double")
    return made.select("doc_id", "n_chars", *(F.lower(F.hex(a)).alias(b) for a, b in (("edited", "edited_sha256"), ("own", "fingerprint"), ("changed", "edited_fingerprint"))), "near_edited", "near_next")
