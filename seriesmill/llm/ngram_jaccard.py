"""N-gram Jaccard join by token-combination prefixes.

Sets of word shingles link when their Jaccard similarity reaches a bound. The join is exact and runs in these steps:

1. *Index exchange.* Every set sends its tokens to hash ranges (packed binary blobs, not a row a token). A range knows
   each token's document frequency; tokens of one set only can be in no overlap and stop there. The others go back to
   their set with the frequency's logarithm. Equal sets share a key and count as one.
2. *Survivors.* A set whose shared tokens can't reach the overlap bound links with nothing and leaves the join.
3. *Prefixes.* Tokens are ordered by frequency, then hash. A prefix of n - ceil(t n) + 1 tokens meets that of any
   partner. Frequent tokens fall into classes by hash, and each class in a prefix lengthens it by k - 1 = 1 token; two
   linked sets then share a rare token or two frequent tokens of one class, so rare tokens are indexed alone and
   frequent ones as pairs within a class. That needs more overlap than classes: sets under ``WIDE / t`` tokens have one
   class; larger ones half the overlap that their size band (a power of two) needs at least, and a set whose larger partner
   may lie in the next band is indexed there, too, so any two that may link meet. Entries grow with a set's size, not with
   its square.
4. *Verify.* Entries held by the same sets count as one. Within each entry the most central set is compared first with
   all others (linear in the entry's size). What those links leave in different classes within an entry is compared in
   blocks, by one sparse product per pair of blocks: entry by entry, or all entries of sets that hang together by open
   entries at once, whichever sends fewer sets; a unit's largest class isn't compared with itself, and only a spanning
   forest of links leaves a block, never all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernel import U, chunks, mix, shingle_sets
from .storage import materialise, ranges_for, release

FLUSH_TOKENS, FLUSH_TEXTS = 4_000_000, 65_000
#: Tokens from which a set is indexed by more classes than one.
WIDE = 64
#: Log-frequency (in quarters of a power of two) from which a token counts as frequent: 16 sets.
FREQUENT = 16
BLOCK = 256
T48 = U((1 << 48) - 1)


def _reach(n, percent: int):
    """Least overlap that a set of n tokens needs with any partner."""
    return -(-n * percent // 100)


def _set_rows(k: int):
    def run(batches):
        for b in batches:
            for lo, hi, data, off in chunks(b.column(1)):
                size, key, _ = shingle_sets(data, off, k)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size, pa.int64()), pa.array(key.view(np.int64), mask=size == 0)], ["doc_id", "n_shingles", "set_key"])

    return run


def _index_blobs(k: int, ranges: int):
    edges = [-(-(r << 48) // ranges) for r in range(ranges + 1)]

    def flush(tokens, keys, sizes):
        t, keys, sizes = np.sort(np.concatenate(tokens)), np.concatenate(keys), np.concatenate(sizes)
        h = t >> U(16)
        cut = np.searchsorted(h, np.array(edges[1:-1], U))
        out = []
        for r, (lo, hi) in enumerate(zip([0, *cut], [*cut, len(t)], strict=True)):
            if lo < hi:
                own, at = np.unique((t[lo:hi] & U(0xFFFF)).astype(np.uint16), return_inverse=True)
                step = np.diff(h[lo:hi])
                wide = bool(len(step)) and int(step.max()) >= 1 << 32
                out.append((r, int(h[lo]), wide, step.astype(np.uint64 if wide else np.uint32).tobytes(), at.astype(np.uint16).tobytes(), keys[own].tobytes(), sizes[own].astype(np.uint32).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["rng", "first", "wide", "steps", "at", "keys", "sizes"])

    def run(batches):
        tokens, keys, sizes, n_tok, n_text = [], [], [], 0, 0
        seen = np.zeros(0, U)
        for b in batches:
            for _, _, data, off in chunks(b.column(0)):
                size, key, packed = shingle_sets(data, off, k)
                if not len(packed):
                    continue
                if n_text + len(size) > FLUSH_TEXTS or n_tok > FLUSH_TOKENS:
                    yield flush(tokens, keys, sizes)
                    tokens, keys, sizes, n_tok, n_text = [], [], [], 0, 0
                    seen = np.zeros(0, U)
                # of equal sets in a run, one goes on: a large group of copies is one set a run before the exchange
                fresh, at = np.unique(key, return_index=True)
                new = np.zeros(len(key), bool)
                new[at[~np.isin(fresh, seen)]] = True
                packed = packed[new[(packed >> U(48)).astype(np.int64)]]
                seen = np.union1d(seen, fresh)
                tokens.append(((packed & T48) << U(16)) | ((packed >> U(48)) + U(n_text)))
                keys.append(key)
                sizes.append(size)
                n_tok += len(packed)
                n_text += len(size)
        if tokens:
            yield flush(tokens, keys, sizes)

    return run


def _shared(ranges: int):
    """Of one hash range: tokens of two sets or more, packed by the range of their set's key."""

    def run(table: pa.Table) -> pa.Table:
        hs, ks, ns = [], [], []
        for x in table.to_pylist():
            step = np.frombuffer(x["steps"], np.uint64 if x["wide"] else np.uint32).astype(U)
            hs.append(np.concatenate([[U(x["first"])], step]).cumsum(dtype=U))
            at = np.frombuffer(x["at"], np.uint16)
            ks.append(np.frombuffer(x["keys"], U)[at])
            ns.append(np.frombuffer(x["sizes"], np.uint32)[at])
        h, key, n = np.concatenate(hs), np.concatenate(ks), np.concatenate(ns)
        del hs, ks, ns
        order = np.argsort(h)
        h, key, n = h[order], key[order], n[order]
        same = np.concatenate([[False], h[1:] == h[:-1], [False]])
        many = same[1:] | same[:-1]
        h, key, n = h[many], key[many], n[many]
        order = np.lexsort((key, h))
        h, key, n = h[order], key[order], n[order]
        if len(h):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])])
            h, key, n = h[new], key[new], n[new]
        _, inverse, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[inverse] if len(h) else np.zeros(0, np.int64)
        h, key, n, df = h[df > 1], key[df > 1], n[df > 1], df[df > 1]
        token = (np.minimum(255, (4 * np.log2(df)).astype(np.int64)).astype(U) << U(48)) | h
        order = np.lexsort((token, key))
        key, n, token = key[order], n[order], token[order]
        names, first, counts = np.unique(key, return_index=True, return_counts=True)
        to = ((names >> U(32)) * U(ranges) >> U(32)).astype(np.int64)
        out = []
        for r in np.unique(to):
            a, b = np.searchsorted(to, [r, r + 1])
            lo, hi = first[a], first[b - 1] + counts[b - 1]
            out.append((int(r), names[a:b].tobytes(), n[first[a:b]].tobytes(), counts[a:b].astype(np.uint32).tobytes(), token[lo:hi].tobytes()))
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        cols = list(zip(*out, strict=True)) or [()] * 5
        return pa.table([pa.array(c, type=t) for c, t in zip(cols, kinds, strict=True)], names=["rng", "keys", "sizes", "counts", "tokens"])

    return run


def _survivors(percent: int):
    """Sets of one key range whose shared tokens can reach the overlap bound, with these tokens in order."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        key = np.concatenate([np.repeat(np.frombuffer(x["keys"], U), np.frombuffer(x["counts"], np.uint32)) for x in rows])
        n = np.concatenate([np.repeat(np.frombuffer(x["sizes"], np.uint32), np.frombuffer(x["counts"], np.uint32)) for x in rows]).astype(np.int64)
        token = np.concatenate([np.frombuffer(x["tokens"], U) for x in rows])
        order = np.lexsort((token, key))
        key, n, token = key[order], n[order], token[order]
        names, first, counts = np.unique(key, return_index=True, return_counts=True)
        keep = np.flatnonzero(counts >= _reach(n[first], percent))
        return pa.table([pa.array(names[keep].view(np.int64)), pa.array(n[first[keep]]), pa.array([token[first[i] : first[i] + counts[i]].tobytes() for i in keep], pa.binary())], names=["key", "n", "tokens"])

    return run


def _class_counts(n: int, percent: int) -> list[int]:
    """Numbers of classes that a set of n tokens is indexed by: one while it is small, else half the overlap that the smallest
    set of its size band needs, for its own band (powers of two) and for each that a larger partner may lie in."""
    out = [1] if n < WIDE * 100 // percent + 1 else []
    band = n.bit_length() - 1
    while n >= WIDE and (band == n.bit_length() - 1 or percent << band <= 100 * n):
        out.append(max(1, (percent << band) // 200))
        band += 1
    return out


def signatures(n: int, token: np.ndarray, percent: int) -> np.ndarray:
    """Index entries of a set of n tokens, ``token`` those it shares with others, in order (log-frequency << 48 | hash)."""
    plain = n - int(_reach(n, percent)) + 1 - (n - len(token))
    frequent = np.flatnonzero((token >> U(48)) >= U(FREQUENT))
    rare = np.ones(len(token), bool)
    rare[frequent] = False
    # where an overlap of one is enough there may be no pair, so tokens are indexed alone
    found = [mix(token[: max(plain, 0)] & T48)] if _reach(n, percent) < 2 else []
    for classes in _class_counts(n, percent):
        kind = mix(token & T48) % U(classes)
        # the prefix: as many tokens as the plain one and the classes of frequent tokens in it
        fresh = np.zeros(len(token) + 1, np.int64)
        fresh[frequent[np.unique(kind[frequent], return_index=True)[1]] + 1] = 1
        end = min(int(np.searchsorted(np.arange(len(token) + 1) - fresh.cumsum(), plain)), len(token))
        found.append(mix(token[:end][rare[:end]] & T48))
        own = frequent[frequent < end]
        own = own[np.lexsort((own, kind[own]))]
        t, k = token[own] & T48, kind[own]
        apart = 1
        while apart < len(own):
            pair = np.flatnonzero(k[apart:] == k[:-apart])
            if not len(pair):
                break
            a, b = t[pair], t[pair + apart]
            found.append(mix(np.minimum(a, b) + mix(np.maximum(a, b))))
            apart += 1
    return np.unique(np.concatenate(found))


def _index(percent: int):
    def run(batches):
        for b in batches:
            sig, key, cent = [], [], []
            for k, n, blob in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                token = np.frombuffer(blob, U)
                s = signatures(n, token, percent)
                sig.append(s)
                key.append(np.full(len(s), k, np.int64))
                cent.append(np.full(len(s), float((token >> U(48)).sum()) / n, np.float64))
            if sig:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sig).view(np.int64)), pa.array(np.concatenate(key)), pa.array(np.concatenate(cent))], ["sig", "key", "cent"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)
            hit = []
            for _, _, n, m, x, y in rows:
                both = len(np.intersect1d(np.frombuffer(x, U) & T48, np.frombuffer(y, U) & T48, assume_unique=True))
                hit.append(100 * both >= percent * (n + m - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    return run


def _block_links(percent: int):
    """Links across classes of one pair of blocks of an entry: a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        key, comp, n = (table.column(c).to_numpy() for c in ("key", "comp", "n"))
        token = [np.frombuffer(x, U) & T48 for x in table.column("tokens").to_pylist()]
        n_sets, links = len(key), []
        if n_sets > 1 and len(np.unique(comp)) > 1:
            all_t, at = np.unique(np.concatenate(token), return_inverse=True)
            row = np.repeat(np.arange(n_sets), [len(t) for t in token])
            use = np.bincount(at, minlength=len(all_t)) > 1
            place = np.cumsum(use) - 1
            row, col = row[use[at]], place[at[use[at]]]
            both = np.zeros((n_sets, n_sets), np.float32)
            order = np.argsort(col, kind="stable")
            row, col = row[order], col[order]
            width = 8192
            for lo in range(0, int(use.sum()), width):
                a, b = np.searchsorted(col, [lo, lo + width])
                m = np.zeros((n_sets, min(width, int(use.sum()) - lo)), np.float32)
                m[row[a:b], col[a:b] - lo] = 1
                both += m @ m.T
            hit = (100 * both >= percent * (n[:, None] + n[None, :] - both)) & (comp[:, None] != comp[None, :])
            tree = {c: c for c in comp.tolist()}

            def root(c):
                while tree[c] != c:
                    tree[c] = c = tree[tree[c]]
                return c

            for i, j in zip(*np.nonzero(np.triu(hit, 1)), strict=True):
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x != y:
                    tree[x] = y
                    links.append((int(key[i]), int(key[j])))
        return pa.table([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _links(survivors: DataFrame, percent: int) -> DataFrame:
    """Set keys and the label of their class, for sets with a link."""
    entries = survivors.mapInArrow(_index(percent), "sig long, key long, cent double")
    held = entries.groupBy("sig").agg(F.count("*").alias("held"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "key")).alias("y"), F.max(F.struct("cent", "key")).alias("top"))
    same = held.where("held > 1").groupBy("held", "x", "y").agg(F.min("sig").alias("sig"), F.count("*").alias("weight"), F.first("top").alias("top"))
    member = materialise(entries.select("sig", "key").join(same.select("sig", "weight", F.col("top.key").alias("b")), "sig"), "members")
    star = member.where("key <> b").groupBy(F.col("key").alias("a"), "b").agg(F.sum("weight").alias("common"))
    best = star.groupBy("a").agg(F.max_by("b", F.struct("common", "b")).alias("b"))
    x, y = (survivors.select(F.col("key").alias(v), F.col("n").alias(f"n_{v}"), F.col("tokens").alias(f"t_{v}")) for v in ("a", "b"))
    near = best.join(x, "a").join(y, "b").where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    first = materialise(near.select("a", "b", "n_a", "n_b", "t_a", "t_b").mapInArrow(_verify(percent), "a long, b long"), "links")
    comp = components(first)
    named = member.join(comp.withColumnRenamed("v", "key"), "key", "left").select("sig", "key", "b", F.coalesce("label", "key").alias("comp"))
    split = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("held")).where("lo <> hi").select("sig", "held")
    open_ = materialise(named.join(split, "sig"), "open")
    # one set may stand in many open entries: entries of sets that hang together are compared as one unit where that
    # sends fewer sets to fewer blocks than entry by entry; either way every pair that shares an open entry meets
    cluster = components(open_.select(F.col("key").alias("a"), "b"))
    sets = open_.select("key", "comp").distinct().join(cluster.select(F.col("v").alias("key"), F.col("label").alias("cluster")), "key")
    cost = lambda n: F.sum(n * F.ceil(n / BLOCK))
    alone = open_.groupBy("sig").agg(F.first("held").alias("n"), F.first("b").alias("v")).join(cluster, "v").groupBy(F.col("label").alias("cluster")).agg(cost(F.col("n")).alias("alone"))
    together = sets.groupBy("cluster").agg(F.count("*").alias("n")).join(alone, "cluster").select("cluster", (F.col("n") * F.ceil(F.col("n") / BLOCK) <= F.col("alone")).alias("whole"))
    sets = sets.join(together, "cluster")
    parts = open_.join(sets.where("not whole").select("key"), "key").select(F.lit(False).alias("whole"), F.col("sig").alias("unit"), "key", "comp")
    units = materialise(sets.where("whole").select("whole", F.col("cluster").alias("unit"), "key", "comp").unionAll(parts), "units")
    sizes = units.groupBy("whole", "unit", "comp").agg(F.count("*").alias("c")).groupBy("whole", "unit").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("held"))
    blocks = sizes.select("whole", "unit", "main", F.ceil((F.col("held") - F.col("most")) / BLOCK).cast("int").alias("others"), F.ceil(F.col("most") / BLOCK).cast("int").alias("mains"))
    placed = units.join(blocks, ["whole", "unit"]).withColumn("own", F.expr("cast(if(comp = main, others + pmod(xxhash64(key), mains), pmod(xxhash64(key), others)) as int)"))
    # a block of the largest class meets the others' blocks only
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0, if(comp = main, others, others + mains) - 1)"))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    second = dealt.select("whole", "unit", "i", "j", "key", "comp").join(survivors, "key").groupBy("whole", "unit", "i", "j").applyInArrow(_block_links(percent), "a long, b long")
    more = materialise(second, "links")
    out = components(first.union(more))
    release(member, first, comp, open_, cluster, units, more)
    return out


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Classes of documents joined by links of Jaccard >= ``percent`` / 100 over ``words``-word shingles (exact).

    Words are runs of non-white-space bytes with A-Z lowered. A text of fewer words has one shingle, all of it; a null or
    word-less text has none and is a class of its own. Returns a row for each input row: doc_id, n_shingles,
    component_id (the smallest doc_id of the class). Repeated rows give repeated results; a null doc_id takes part
    (its class's smallest non-null id, null if there is none). Other columns are ignored; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    ranges = ranges_for(own)
    sets = materialise(own.mapInArrow(_set_rows(words), "doc_id long, n_shingles long, set_key long"), "sets")
    blobs = own.select("text").mapInArrow(_index_blobs(words, ranges), "rng int, first long, wide boolean, steps binary, at binary, keys binary, sizes binary")
    shared = blobs.groupBy("rng").applyInArrow(_shared(ranges), "rng int, keys binary, sizes binary, counts binary, tokens binary")
    survivors = materialise(shared.groupBy("rng").applyInArrow(_survivors(percent), "key long, n long, tokens binary"), "survivors")
    linked = _links(survivors, percent)
    firsts = sets.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first"))
    named = firsts.join(linked, firsts.set_key == linked.v, "left").select("set_key", "first", F.coalesce("label", "set_key").alias("label"))
    classes = named.groupBy("label").agg(F.min("first").alias("component"))
    named = named.join(classes, "label").select(F.col("set_key").alias("sk"), "component")
    return sets.join(named, sets.set_key == named.sk, "left").select("doc_id", "n_shingles", F.expr("if(set_key is null, doc_id, component)").alias("component_id"))
