"""Phrase collocations: exact counts of phrases of 2 to 5 words, by dictionary codes, range-partitioned sort and run lengths.

Texts are lower-cased (A-Z) and split at ``[.,;:!?\\x0A-\\x0D]`` into pieces, pieces into words ``[^\\x20\\x09]+``. Words that are
frequent in their language get a code; each text becomes a stream of codes, broken (0) where a piece ends or a word isn't
frequent. Word pairs of the streams are packed into fixed-width binary keys, added up within each stream block, exchanged by
range, sorted there and counted by run length. Longer phrases go the same way, from stretches in which each pair is frequent:
one key of up to five codes a place, whose runs of equal first 3, 4 and 5 codes are the counts of all phrases that start there.

Codes: the dictionary goes to the tasks when it holds at most ``dictionary_words`` words (4-byte codes, its places). Beyond
that only a filter of fixed size goes there and a word's 64-bit hash is its code; a word or pair that passes the filter though
it isn't frequent only makes keys whose counts fall short. What is broadcast is bounded either way: 16 bytes for each of at
most ``dictionary_words`` words, and two filters of ``FILTER_BITS`` bits. Counts are exact unless two words of one language
share all 64 bits and one of them is frequent (about 1e-9 for a billion distinct words and ten frequent ones).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .kernel import LOWER, U, chunks, hashes, mix, segments, spans
from .storage import materialise, release

LEAST, MOST_WORDS = 100, 5
#: Words of the dictionary that may be broadcast; bits of each filter; codes of a stream block.
DICTIONARY_WORDS, FILTER_BITS, BLOCK = 4_000_000, 1 << 27, 1 << 22
COUNT_BYTES = 8 << 20
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = True
WORD = ~SEPARATOR
WORD[[32, 9]] = False


def _languages(langs: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct languages, hash of each, each row's place among them); a null is ``und``."""
    coded = langs.fill_null("und").dictionary_encode()
    names = coded.dictionary.to_pylist()
    raw = [np.frombuffer(x.encode(), np.uint8) for x in names]
    salts = [hashes(x, np.array([0]), np.array([len(x)])) if len(x) else np.zeros(1, U) for x in raw]
    return names, np.concatenate([np.zeros(0, U), *salts]) * U(0xD6E8FEB86659FD93), coded.indices.to_numpy()


def _word_hashes(data, starts, ends, salt) -> np.ndarray:
    return mix(hashes(data, starts, ends) + salt)


def _parts(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A chunk as it is, or one long text cut before white space."""
    if len(off) > 2 or len(data) <= COUNT_BYTES:
        yield data, off
        return
    for part in segments(data, COUNT_BYTES):
        yield part, np.array([0, len(part)])


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans as strings, A-Z lowered."""
    sizes = ends - starts
    off = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(off[-1]) - np.repeat(off[:-1] - starts, sizes)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(off.astype(np.int64)), pa.py_buffer(LOWER[data[at]])).cast(pa.string())


_WORDS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])


def _counted_words(batches):
    """Words of each run of texts with their counts; a row of null counts all words of a language there."""
    for b in batches:
        names, salts, lang = _languages(b.column(1))
        for lo, _, data, off in chunks(b.column(0), COUNT_BYTES):
            for part, at in _parts(data, off):
                s, e, text = spans(part, at, WORD)
                if not len(s):
                    continue
                own = lang[lo + text]
                _, first, n = np.unique(_word_hashes(part, s, e, salts[own]), return_index=True, return_counts=True)
                seen = np.flatnonzero(all_ := np.bincount(own, minlength=len(names)))
                which = pa.array(np.concatenate([own[first], seen]), pa.int32())
                strings = pa.concat_arrays([_strings(part, s[first], e[first]), pa.nulls(len(seen), pa.string())])
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(which), strings, pa.array(np.concatenate([n, all_[seen]]))], schema=_WORDS)


def _key(h: np.ndarray) -> pa.Array:
    """Rows of codes (n x k) as big-endian binary keys."""
    n, width = len(h), h.shape[1] * h.dtype.itemsize
    raw = np.ascontiguousarray(h.astype(h.dtype.newbyteorder(">")))
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(raw)])


def _coded_words(batches):
    """A column ``code`` (the word's hash, 8 bytes) before the words."""
    for b in batches:
        names, salts, lang = _languages(b.column(0))
        for lo, hi, data, off in chunks(b.column(1)):
            h = _word_hashes(data, off[:-1], off[1:], salts[lang[lo:hi]])
            yield pa.RecordBatch.from_arrays([_key(h[:, None]), *(b.column(i).slice(lo, hi - lo) for i in range(3))], ["code", "lang", "word", "n"])


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash of two words' hashes."""
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def _key_hashes(batches):
    """A hash of each key of one or two 8-byte codes."""
    for b in batches:
        h = np.frombuffer(b"".join(b.column(0).to_pylist()), ">u8").astype(U).reshape(b.num_rows, -1)
        yield pa.RecordBatch.from_arrays([pa.array((h[:, 0] if h.shape[1] == 1 else _pair_hash(h[:, 0], h[:, 1])).view(np.int64))], ["h"])


class HashFilter:
    """A set of hashes as a bitmap of fixed size: no false negatives; its bits are gathered by key on the executors."""

    def __init__(self, keys: DataFrame, column: str, bits: int):
        at = F.pmod("h", F.lit(bits)).alias("at")
        words = keys.select(column).mapInArrow(_key_hashes, "h long").select(at).select((F.col("at") / 64).cast("int").alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit"))
        found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        self.words = np.zeros(bits // 64, U)
        self.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(U)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h.view(np.int64) % np.int64(len(self.words) * 64)
        return (self.words[at >> 6] >> (at & 63).astype(U)) & U(1) > 0


class Dictionary:
    """Codes of frequent words by hash: places in a sorted table of 4 bytes, found from a hash's first bits."""

    dtype = np.uint32

    def __init__(self, known: np.ndarray):
        self.known = np.sort(known)
        self.shift = U(64 - max(8, int(len(known)).bit_length() + 2))
        slots = np.arange(1 << (64 - int(self.shift)), dtype=U) << self.shift
        self.first = np.searchsorted(self.known, slots).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        out = np.zeros(len(h), np.uint32)
        if not len(self.known):
            return out
        at, todo = self.first[h >> self.shift].astype(np.int64), np.arange(len(h))
        while len(todo):
            inside = at < len(self.known)
            at, todo = at[inside], todo[inside]
            own = self.known[at]
            same = own == h[todo]
            out[todo[same]] = at[same] + 1
            later = own < h[todo]
            at, todo = at[later] + 1, todo[later]
        return out

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        return self.known[codes.astype(np.int64) - 1]


class HashCodes:
    """Codes of frequent words where the dictionary is too large to broadcast: the hashes themselves, 8 bytes."""

    dtype = U

    def __init__(self, known: HashFilter):
        self.known = known

    def find(self, h: np.ndarray) -> np.ndarray:
        return np.where(self.known.has(h), h, U(0))

    def hashes(self, codes: np.ndarray) -> np.ndarray:
        return codes


def _blocks(streams: Iterator[np.ndarray], dtype, size: int) -> Iterator[tuple[np.ndarray, int]]:
    """(codes, starts) of blocks cut at breaks; a stretch longer than a block is cut within, its last codes being repeated
    as context: phrases start at the first ``starts`` places only."""
    rest = np.zeros(0, dtype)
    for x in streams:
        rest = np.concatenate([rest, x])
        rest = rest[(rest != 0) | np.concatenate([[True], rest[:-1] != 0])]
        while len(rest) > size:
            z = size - int(np.argmax(rest[size:0:-1] == 0)) if (rest[1 : size + 1] == 0).any() else 0
            if z:
                yield rest[:z], z
                rest = rest[z:]
            else:
                yield rest[:size], size - MOST_WORDS + 1
                rest = rest[size - MOST_WORDS + 1 :]
    if len(rest):
        yield rest, len(rest)


_STREAM = pa.schema([("codes", pa.binary()), ("n", pa.int64()), ("starts", pa.int64())])


def _encoded(codes, size: int):
    """Texts as stream blocks."""

    def streams(batches):
        for b in batches:
            _, salts, lang = _languages(b.column(1))
            for lo, _, data, off in chunks(b.column(0)):
                open_ = False
                for part, at in _parts(data, off):
                    s, e, text = spans(part, at, WORD)
                    gaps = np.flatnonzero(SEPARATOR[part])
                    if not len(s):
                        open_ = open_ and not len(gaps)
                        continue
                    code = codes.value.find(_word_hashes(part, s, e, salts[lang[lo + text]]))
                    piece = np.searchsorted(gaps, s)
                    fresh = np.concatenate([[not open_ or piece[0] > 0], (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])])
                    out = np.zeros(len(code) + int(fresh.sum()), code.dtype)
                    out[np.arange(len(code)) + np.cumsum(fresh)] = code
                    open_ = len(gaps) == piece[-1]
                    yield out

    def run(batches):
        for block, starts in _blocks(streams(batches), codes.value.dtype, size):
            yield pa.RecordBatch.from_arrays([pa.array([pa.compress(block.tobytes(), "zstd", asbytes=True)], pa.binary()), pa.array([len(block)]), pa.array([starts])], schema=_STREAM)

    return run


def _stream_rows(batches, dtype):
    for b in batches:
        for codes, n, starts in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            yield np.frombuffer(pa.decompress(codes, n * np.dtype(dtype).itemsize, "zstd", asbytes=True), dtype), starts


def sorted_counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of codes in order, and how often each occurs."""
    if keys.dtype == np.uint32 and keys.shape[1] == 2:
        packed = np.sort((keys[:, 0].astype(U) << U(32)) | keys[:, 1])
        keys = np.stack([packed >> U(32), packed & U(0xFFFFFFFF)], axis=1).astype(np.uint32)
    else:
        keys = keys[np.lexsort(keys.T[::-1])]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


_KEYS_SQL, _KEYS_BATCH = "key binary, n long", 1 << 17


def _key_batches(keys: np.ndarray):
    keys, n = sorted_counts(keys)
    for lo in range(0, len(keys), _KEYS_BATCH):
        yield pa.RecordBatch.from_arrays([_key(keys[lo : lo + _KEYS_BATCH]), pa.array(n[lo : lo + _KEYS_BATCH])], ["key", "n"])


def _pair_keys(codes):
    def run(batches):
        for x, starts in _stream_rows(batches, codes.value.dtype):
            at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
            at = at[at < starts]
            yield from _key_batches(np.stack([x[at], x[at + 1]], axis=1))

    return run


def _long_keys(codes, pairs):
    """A key of up to five codes for each place where three or more words follow whose pairs are all frequent."""

    def run(batches):
        for x, starts in _stream_rows(batches, codes.value.dtype):
            at = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
            ok = np.zeros(len(x) + MOST_WORDS, bool)
            ok[at[pairs.value.has(_pair_hash(*(codes.value.hashes(x[at + j]) for j in (0, 1))))]] = True
            at = np.flatnonzero(ok[:-1] & ok[1:])
            at = at[at < starts]
            keys, live = np.zeros((len(at), MOST_WORDS), x.dtype), np.ones(len(at), bool)
            for j in range(MOST_WORDS):
                keys[live, j] = x[at[live] + j]
                live &= ok[at + j]
            yield from _key_batches(keys)

    return run


def _run_lengths(codes, lengths: tuple[int, ...], least: int):
    """Counts of equal first ``m`` codes of a sorted partition, for each m of ``lengths``: those from ``least`` on, and the first
    and last run, which may go on in the neighbouring partitions. Phrases are given as 8-byte hashes."""

    def run(batches):
        size = np.dtype(codes.value.dtype).itemsize
        held = dict.fromkeys(lengths)

        def batch(found: list):
            keys = np.concatenate([k for k, _ in found])
            return pa.RecordBatch.from_arrays([_key(codes.value.hashes(keys).reshape(keys.shape)), pa.array(np.concatenate([n for _, n in found]))], ["k", "f"])

        for b in batches:
            column = b.column(0).cast(pa.binary())
            raw = np.frombuffer(column.buffers()[2], np.uint8)
            offset = np.frombuffer(column.buffers()[1], np.int32)[column.offset]
            width = len(column[0].as_py())
            keys = raw[offset : offset + width * len(column)].view(f">u{size}").reshape(len(column), -1).astype(codes.value.dtype)
            n = b.column(1).to_numpy()
            for m in lengths:
                at = np.flatnonzero(keys[:, m - 1] != 0)
                if not len(at):
                    continue
                own = keys[at, :m]
                first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(axis=1)]))
                own, f = own[first], np.add.reduceat(n[at], first)
                keep = f >= least
                keep[-1] = False
                before, last = held[m], (own[-1:], f[-1:])
                if before is None:
                    keep[0] = len(f) > 1
                elif (before[0] == own[:1]).all():
                    f[0] += before[1][0]
                    keep[0] = len(f) > 1
                    last = (own[-1:], f[-1:])
                else:
                    yield batch([before])
                held[m] = last
                if keep.any():
                    yield batch([(own[keep], f[keep])])
        for x in held.values():
            if x is not None:
                yield batch([x])

    return run


def _counted(keys: DataFrame, codes, lengths: tuple[int, ...], least: int) -> DataFrame:
    """Phrases (k, f) from key rows: range exchange, sort, run lengths; runs cut by partition borders are put together."""
    runs = keys.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_run_lengths(codes, lengths, least), "k binary, f long")
    return runs.groupBy("k").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _codes(k: str | Column, first: int, n) -> Column:
    """``n`` codes of a key of 8-byte codes, from the ``first`` on (from 0)."""
    return F.substring(k, F.lit(8 * first + 1) if isinstance(first, int) else 8 * first + 1, F.lit(8 * n) if isinstance(n, int) else 8 * n)


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = 2000, dictionary_words: int = DICTIONARY_WORDS, filter_bits: int = FILTER_BITS, block: int = BLOCK) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    a is a phrase's number of places, n the language's number of words. A cut after k words gives l and r, the numbers of
    places of the two parts, and floor(1000 a n / (l r)); the lowest-scoring cut counts, the smallest k on ties. Phrases under
    ``least`` places are none; one is dropped where a longer one that holds it has as many places. Order: score and a
    descending, phrase ascending by its bytes.

    A null text counts as empty, a null language as ``und``; repeated rows count each; other columns are ignored; an empty
    table gives no rows. Texts of any length are read in parts of ``COUNT_BYTES``.
    """
    spark = docs.sparkSession
    own = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    counted = own.mapInArrow(_counted_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    frequent = counted.where((F.col("n") >= least) | F.col("word").isNull())
    dictionary = materialise(frequent.mapInArrow(_coded_words, "code binary, lang string, word string, n long"), "dictionary")
    words, totals = dictionary.where("word is not null"), dictionary.where("word is null").select("lang", "n")
    some = words.select("code").limit(dictionary_words + 1).toArrow()
    if some.num_rows <= dictionary_words:
        known = Dictionary(np.frombuffer(b"".join(some.column("code").to_pylist()), ">u8").astype(U))
    else:
        known = HashCodes(HashFilter(words, "code", filter_bits))
    codes = spark.sparkContext.broadcast(known)
    streams = materialise(own.mapInArrow(_encoded(codes, block), "codes binary, n long, starts long"), "streams")
    pairs = materialise(_counted(streams.mapInArrow(_pair_keys(codes), _KEYS_SQL), codes, (2,), least), "pairs")
    frequent_pairs = spark.sparkContext.broadcast(HashFilter(pairs, "k", filter_bits))
    longer = materialise(_counted(streams.mapInArrow(_long_keys(codes, frequent_pairs), _KEYS_SQL), codes, tuple(range(3, MOST_WORDS + 1)), least), "phrases")
    release(streams)
    for sent in (codes, frequent_pairs):
        sent.destroy()

    phrases = pairs.unionByName(longer)
    size = (F.octet_length("k") / 8).cast("int")
    within = longer.select(F.explode(F.array(_codes("k", 0, size - 1), _codes("k", 1, size - 1))).alias("k"), "f").groupBy("k").agg(F.max("f").alias("over"))
    kept = phrases.join(within, "k", "left").where(F.coalesce(F.col("over") < F.col("f"), F.lit(True))).select("k", F.col("f").alias("a"))
    parts = phrases.unionByName(words.select(F.col("code").alias("k"), F.col("n").alias("f")))
    cuts = kept.select("k", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut")).select("k", "a", "cut", _codes("k", 0, F.col("cut")).alias("left"), _codes("k", F.col("cut"), size - F.col("cut")).alias("right"))
    cuts = cuts.join(parts.select(F.col("k").alias("left"), F.col("f").alias("l")), "left").join(parts.select(F.col("k").alias("right"), F.col("f").alias("r")), "right")
    owners = words.select(F.col("code").alias("word"), "lang").join(totals.withColumnRenamed("n", "total"), "lang")
    cuts = cuts.withColumn("word", _codes("k", 0, 1)).join(owners, "word")
    exact = "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(19,0)) * CAST(total AS DECIMAL(19,0)) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    scored = cuts.groupBy("lang", "k", "a", "total").agg(F.min(F.struct(F.expr(exact).alias("score"), "cut", "l", "r")).alias("low")).select("lang", "k", "a", F.col("total").alias("n"), "low.l", "low.r", "low.score")
    # phrases that tie at the end stay until words are known
    best = scored.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("place") <= top)
    spelt = best.select("k", F.posexplode(F.transform(F.sequence(F.lit(0), size - 1), lambda i: _codes("k", i, 1))).alias("i", "code")).join(words.select("code", "word"), "code")
    spelt = spelt.groupBy("k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x.word), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.join(spelt, "k").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = materialise(ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(dictionary, pairs, longer)
    return out
