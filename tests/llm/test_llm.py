import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesmill.llm import cover_tree, decontaminate, language_id, language_model, license_scan, line_dedup, ngram_jaccard, packing, quality, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, sig string, rng string, label string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    voc = ["alpha", "beta", "gamma", "Straße", "epsilon", "ζeta", "eta", "Theta", "iota", "kappa", "lambda", "mu"]
    base = [" ".join(rng.choice(voc, 60)) for _ in range(12)]
    out = base + base[:3]
    for i, t in enumerate(base[:8]):
        w = t.split()
        for j in rng.choice(len(w), i, replace=False):
            w[j] = "changed"
        out.append(" ".join(w))
    return [*out, None, "", "one", "two words", "two words", "x " * 20000, "a b c d e", "Line one is long enough here.\nLine one is long enough hera.\nshort\nshort"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", None, None, "h", "s", "r", "l") for i, t in enumerate(texts)]
    rows += [(None, "orphan text of some words to keep here", None, None, None, None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0, "clash") for i in range(20)] + [(None, 1, True, ""), (3, None, None, "")], "doc_id long, quality int, t boolean, text string").withColumn("toxic", F.col("t").cast("int"))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_against_brute_force(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    sets = []
    for r in rows:
        w = words(r.text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                comp[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        k = root(i)
        low[k] = min(x for x in (low.get(k), r.doc_id) if x is not None) if (low.get(k), r.doc_id) != (None, None) else None
    expected = Counter((r.doc_id, len(sets[i]), low[root(i)]) for i, r in enumerate(rows))
    assert Counter(map(tuple, ngram_jaccard.near_duplicate_classes(docs).collect())) == expected
    assert ngram_jaccard.near_duplicate_classes(empty(spark)).count() == 0


def test_signatures_share_an_entry_of_every_linked_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 200))
        pool = np.unique(rng.integers(1, 1 << 40, 3 * n).astype(np.uint64) | rng.integers(0, 40, 3 * n).astype(np.uint64) << np.uint64(48))
        a = rng.choice(pool, min(n, len(pool)), replace=False)
        b = np.concatenate([a[: max(1, len(a) - int(rng.integers(0, len(a) // 4 + 1)))], rng.choice(pool, int(rng.integers(0, len(a) // 6 + 1)))])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert len(np.intersect1d(ngram_jaccard.signatures(len(a), a, 75), ngram_jaccard.signatures(len(b), b, 75)))


def test_hot_group_is_split(spark):
    rng = np.random.default_rng(2)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(600):
        w = list(base)
        for j in rng.choice(60, int(rng.integers(0, 3)), replace=False):
            w[j] = f"x{i}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngram_jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    comp = list(range(600))
    for i in range(600):
        for j in range(i):
            if comp[i] != comp[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    assert got == dict(enumerate(comp)) and Counter(comp).most_common(1)[0][1] > 400


def test_line_dedup(spark, docs):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == docs.count()
    last = max(r.doc_id for r in rows if r.doc_id is not None)
    two = next(r for r in rows if r.doc_id == last)
    assert two.text == "Line one is long enough here.\nshort" and (two.n_lines, two.n_dropped) == (4, 2)
    assert next(r for r in rows if r.doc_id == 0).n_dropped == 0
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_near_lines_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcé "), 30)) for _ in range(20)]
    lines = []
    for i in range(200):
        t = list(base[int(rng.integers(20))])
        for _ in range(int(rng.integers(0, 3))):
            j = int(rng.integers(len(t)))
            kind = int(rng.integers(3))
            t[j : j + (kind > 0)] = [] if kind == 1 else [str(rng.choice(list("abz")))]
        lines.append("".join(t))
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), share=0.1).collect()

    def near(a, b):
        if a == b:
            return True
        if len(a) < len(b):
            a, b = b, a
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
        return (len(a) == len(b) and a[i + 1 :] == b[i + 1 :]) or (len(a) == len(b) + 1 and a[i + 1 :] == b[i:])

    dropped = {i for i, a in enumerate(lines) if any(near(a, b) for b in lines[:i])}
    assert {r.doc_id for r in got if r.n_dropped} == dropped


def test_lines_at_the_length_bounds(spark):
    rows = ["a", "a", "b", "", "", "12345678901234567890", "1234567890123456789", "1234567890123456789x", "short line", "short lina", "123456789012345678Z"]
    got = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_dropped} == {1, 6, 7}


def test_very_long_lines(spark):
    rng = np.random.default_rng(8)
    a = "".join(rng.choice(list("abcdefgh é"), 200_000))
    rows = [(0, a), (1, a[:150_000] + "Z" + a[150_001:]), (2, a[:7] + a[8:]), (3, a + "!"), (4, a[:5] + "Z" + a[6:199_000] + "Z" + a[199_001:]), (5, a[::-1]), (6, a)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.n_dropped} == {1, 2, 3, 6}


def test_line_dedup_with_clashing_columns(spark):
    names = ["doc_id", "text", "n_lines", "N_Dropped", "_id", "row", "i", "t", "h", "di", "drop", "_th", "a.b"]
    df = spark.createDataFrame([(1, "same line\nother", *range(11)), (2, "same line", *range(11))], "doc_id long, text string, " + ", ".join(f"`{n}` long" for n in names[2:]))
    out = line_dedup.dedup_lines(df)
    assert out.columns == ["doc_id", "text", *names[4:], "n_lines", "n_dropped"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[2].text == "" and got[2].n_dropped == 1 and got[1].n_lines == 2 and tuple(got[1])[2:11] == tuple(range(2, 11))


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[300:340] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(None, [1.0] * 16), (900, None), (901, [1.0] * 15 + [None]), (902, [float("nan")] * 16), (1000, [0.5] * 3), (1001, [0.25] * 3), (1002, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = Counter(map(tuple, cover_tree.top_k(df, F.col("vec_id") % 100 == 0, 10).collect()))
    e = np.floor(1024 * x.astype(float))
    want = Counter([(1000, 1, 1001, 3 * 512 * 256)])
    for q in range(0, 700, 100):
        s = e @ e[q]
        best = sorted((i for i in range(700) if i != q), key=lambda i: (-s[i], i))[:10]
        want.update((q, k + 1, i, int(s[i])) for k, i in enumerate(best))
    assert got == want
    assert cover_tree.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_repeated_rows_and_ties(spark):
    rows = [(100, [0.5, 0.5], 7)] * 2 + [(7, [0.25, 0.5], 7)] * 2 + [(i, [0.25, 0.25], 7) for i in range(20, 10, -1)] + [(200, [1.0, 0.0], 1), (200, [0.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score long")
    got = [tuple(r) for r in cover_tree.top_k(df, F.col("vec_id") == 100, 6).orderBy("rank").collect()]
    half, quarter = 512 * 512, 512 * 256
    assert got == [(100, 1, 200, 2 * half), (100, 2, 200, 2 * half), (100, 3, 7, half + quarter), (100, 4, 7, half + quarter), (100, 5, 11, 2 * quarter), (100, 6, 12, 2 * quarter)]


def test_cover_tree_invariants():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * (rng.normal(size=(40, 8))[rng.integers(0, 40, 1500)] + 0.05 * rng.normal(size=(1500, 8))))
    todo = [cover_tree.cover_tree(x, leaf=4)]
    assert sorted(todo[0].rows) == list(range(1500))
    while todo:
        node = todo.pop()
        far = np.sqrt(((x[node.rows] - node.centre) ** 2).sum(axis=1))
        assert far.max() <= node.radius + 1e-6 and node.radius <= node.scale + 1e-6
        if node.children:
            assert (node.children[0].centre == node.centre).all()
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            centres = np.stack([c.centre for c in node.children])
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
            assert apart[~np.eye(len(centres), dtype=bool)].min(initial=np.inf) > node.radius / 2
            todo += node.children


def test_cover_trees_prune_clustered_data():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 32))[rng.integers(0, 60, 6000)] + 0.03 * rng.normal(size=(6000, 32))
    x = np.floor(1024 * x / np.linalg.norm(x, axis=1, keepdims=True))
    top = cover_tree.TopK(x[:200], np.arange(200), 10)
    for lo in range(0, 6000, 2000):
        top.search(x[lo : lo + 2000], np.arange(lo, lo + 2000))
    s = x[:200] @ x.T
    s[np.arange(200), np.arange(200)] = -np.inf
    want = np.lexsort((np.broadcast_to(np.arange(6000), s.shape), -s), axis=1)[:, :10]
    assert (top.best == want).all() and top.products < 0.5 * s.size


def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(6)
    voc = [f"w{i}" for i in range(50)]
    items = [(i, " ".join(rng.choice(voc, int(rng.integers(4, 40))))) for i in range(12)] + [(90, None), (91, ""), (None, "w1 w2")]
    rows = []
    for i in range(120):
        w = list(rng.choice(voc, 80))
        if i % 2:
            t = words(items[i % 12][1])
            for j in rng.choice(len(t), min(len(t), i % 6), replace=False):
                t[j] = "other"
            w[20:20] = t[int(rng.integers(0, 3)) :]
        rows.append((i, " ".join(w)))
    rows += [(500, None), (501, ""), (None, items[0][1])]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = set()
    for d, t in rows:
        for i, b in items:
            a, b = words(t), words(b)
            size = min(len(b), 12)
            need = -(-size * 9 // 12)
            if i is not None and b and any(sum(x == y for x, y in zip(a[p : p + size], b[q : q + size], strict=True)) >= need for q in range(len(b) - size + 1) for p in range(len(a) - size + 1)):
                want.add((d, i))
    assert got == want
    left = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == {d for d, _ in rows} - {d for d, _ in want if d is not None} - {None}


def test_entries_grow_with_a_set_and_not_its_square():
    rng = np.random.default_rng(14)
    for n, most in ((500, 1000), (5_000, 5_000), (60_000, 60_000), (200_000, 200_000)):
        token = np.sort((np.uint64(40) << np.uint64(48)) | rng.choice(1 << 40, n, replace=False).astype(np.uint64) if n < 6_000 else (np.uint64(40) << np.uint64(48)) | np.unique(rng.integers(0, 1 << 48, n, dtype=np.uint64)))
        assert len(ngram_jaccard.signatures(len(token), token, 75)) < most


def test_near_copies_of_200_000_words(spark):
    rng = np.random.default_rng(15)
    w = np.array([f"w{i}" for i in range(3000)])[rng.integers(0, 3000, 200_000)]
    near, far = w.copy(), w.copy()
    near[rng.choice(len(w), 4_000, replace=False)] = "changed"
    far[rng.choice(len(w), 20_000, replace=False)] = "changed"
    rows = [(i, " ".join(x)) for i, x in enumerate((w, near, far))] + [(3 + i, " ".join(np.roll(w, 1000 * i)[:150_000])) for i in range(17)]
    got = {r.doc_id: r.component_id for r in ngram_jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got[1] == got[0] != got[2]


def test_masks_cover_every_choice_of_differing_words():
    from itertools import combinations

    for n in range(1, 12):
        spare = n - decontaminate.need_of(n)
        assert all(any(not set(m) & set(d) for m in decontaminate.masks_of(n)) for d in combinations(range(n), spare))


def test_leaked_rows_are_told_apart_by_id_and_text(spark):
    """A clean text under a leaked id stays; a leaked text under a null id goes; equal leaked rows all go."""
    import corpus_pipeline as p

    item = " ".join(f"t{i}" for i in range(20))
    rows = [(7, "x " + item, 1), (7, "a clean text under the same id", 2), (None, item + " y", 3), (None, "clean and nameless", 4), (8, None, 5), (9, "", 6), (10, item, 7), (10, item, 8)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, "k", "r") for i, t, n in rows], "doc_id long, text string, lang string, source string, n_chars long, key string, row string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.n_chars for r in left.collect()) == [2, 4, 5, 6]
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0 and decontaminate.decontaminate(docs, items.limit(0)).count() == 8
    assert p.STAGES[3][1] is p.by_benchmark


def test_stages_take_a_map_column(spark, tmp_path):
    import corpus_pipeline as p

    item = " ".join(f"t{i}" for i in range(20))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = "the quick words of a plain document that is long enough"
    rows = [(1, text, "en", {"b": 1}), (1, text, "en", {"a": 2}), (2, text + " one", "en", None), (3, item, "en", {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, more map<string,int>")
    for _, stage in p.STAGES[:1] + p.STAGES[2:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "more"]
    assert [(r.doc_id, r.more) for r in docs.collect() if r.doc_id == 1] == [(1, {"a": 2})]


def test_overlap_figures_and_odd_rows(spark):
    item = " ".join(f"t{i}" for i in range(20))
    w = item.split()
    long = "x " * 50_000 + " ".join([*w[:8], "odd", *w[9:16]]) + " y" * 50_000
    docs = spark.createDataFrame([(1, long, 7), (1, long, 7), (2, item.upper(), 7), (3, "none of it", 7), (4, None, 7)], "doc_id long, text string, item_id long")
    items = spark.createDataFrame([(5, item, 0), (6, "x x x x x x x x x x x x", 0)], "item_id long, text string, doc_id long")
    got = sorted(tuple(r) for r in decontaminate.benchmark_overlaps(docs, items).where("item_id = 5").collect())
    # the window from the first word that passes to the last: 16 words, 15 of them equal; the windows go on over 3 more that differ
    assert got[0][:4] == (1, 5, 50_000, 0) and got[0] == got[1] and got[0][5] == 15 and got[2] == (2, 5, 0, 0, 20, 20)
    top = {(r.doc_id, r.item_id): r for r in decontaminate.contamination(docs, items).collect()}
    assert set(top) == {(1, 5), (1, 6), (2, 5)} and top[1, 5].overlaps == 2 and top[2, 5].longest == 20
    assert decontaminate.contamination(docs.limit(0), items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_ftrl_against_a_plain_version():
    rng = np.random.default_rng(0)
    rows = [(int(rng.integers(2)), np.unique(rng.integers(0, 30, 6))) for _ in range(80)]
    z, n, w = Counter(), Counter(), {}
    bz = bn = b = 0.0
    a, beta, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / a + l2)
    for _ in range(toxicity.EPOCHS):
        for y, x in rows:
            w = {i: weight(i) for i in x}
            g = 1 / (1 + np.exp(-(sum(w.values()) + b))) - y
            for i in x:
                s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / a
                z[i] += g - s * w[i]
                n[i] += g * g
            s = ((bn + g * g) ** 0.5 - bn**0.5) / a
            bz += g - s * b
            bn += g * g
            b = -bz / ((beta + bn**0.5) / a)
    got, bias = toxicity.ftrl(rows)
    assert got[:30] == pytest.approx([weight(i) for i in range(30)], abs=1e-5) and bias == pytest.approx(b) and not got[30:].any()


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(9)
    voc = [f"word{i}" for i in range(300)]
    rows, bad = [], []
    for i in range(900):
        t = list(rng.choice(voc, 60))
        toxic = i % 3 == 0
        if toxic:
            t[int(rng.integers(60))] = ["idiots!", "Scum,", "moron"][int(rng.integers(3))]
        rows.append((i, " ".join(t) * (40 if i == 300 else 1) + " x" * (200_000 if i == 303 else 0)))
        bad.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bad, "doc_id long, toxic int")
    got = toxicity.score(docs, labels, F.col("doc_id") % 4 == 2).where("held_out").collect()
    assert sum(r.predicted == int(r.doc_id % 3 == 0) for r in got) / len(got) > 0.97


def test_licenses(spark):
    rows = [(1, "Released under the MIT License."), (2, "x\nLicensed under the Apache License, Version 2.0. under the mit license"), (3, None), (4, "..."), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "über CC BY-NC, cc by nc!"), (7, "license " * 5000)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels) == (5, 1, 1, "mit")
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 4, 9, "apache-2,mit")
    assert (got[3].n_words, got[3].labels, got[3].first_word, got[3].score) == (0, "", None, 0.0) and got[4].n_words == 0
    assert (got[5].base_labels, got[5].labels) == ("", "gpl-3") and got[6].n_base == 2 and got[7].n_words == 5000
    assert license_scan.scan(empty(spark)).count() == 0


def test_wrapped_notices_and_odd_rows(spark):
    gpl = next(t for t, label in license_scan.TEMPLATES if label == "gpl")
    w = gpl.split()
    rows = [(1, "# " + " ".join(w[:9]) + "\n# " + " ".join(w[9:15]) + " odd\n# " + " ".join(w[16:]), 3), (2, "Some text.\nAll rights\nreserved.", 3), (3, "licensed under cc by nc 4 0", 3), (4, "Released under the MIT license. Licensed under CC BY 4.0!", 3)]
    rows += [(5, " ".join(w[:5]) + " x" * 60 + " " + " ".join(w[5:]), 3), (None, "all rights reserved", 3), (2, "Some text.\nAll rights\nreserved.", 3), (6, "the " * 30_000 + gpl, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words long").repartition(3)
    got = [(r.doc_id, r.labels, [(b.first_word, b.label) for b in r.blocks]) for r in license_scan.scan(df).collect()]
    want = [(1, "gpl", [(0, "gpl")]), (2, "all-rights-reserved", [(2, "all-rights-reserved")])]
    assert all(x in got for x in want) and got.count(want[1]) == 2 and (None, "all-rights-reserved", [(0, "all-rights-reserved")]) in got
    assert (3, "cc-by-nc", [(0, "cc-by-nc")]) in got and (4, "cc-by,mit", [(0, "mit"), (5, "cc-by")]) in got
    assert [x[1] for x in got if x[0] == 5] == [""] and (6, "gpl", [(30_000, "gpl")]) in got


def test_license_blocks_against_brute_force_with_many_templates(spark):
    rng = np.random.default_rng(12)
    voc = [f"v{i}" for i in range(120)]
    templates = [(" ".join(rng.choice(voc, int(rng.integers(3, 12)))), f"l{i}") for i in range(200)]
    rows = []
    for i in range(40):
        t = list(rng.choice(voc, 30))
        own = templates[i][0].split()
        own[int(rng.integers(len(own)))] = "odd" if i % 2 else own[0]
        rows.append((i, " ".join(t + own + t[:7])))
    got = {(r.doc_id, b.first_word, b.label, round(b.score, 9)) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates=templates).collect() for b in r.blocks}
    want = set()
    for i, t in rows:
        w, hits = t.split(), []
        for text, label in templates:
            s, size = set(text.split()), len(text.split())
            for j in range(len(w)):
                held = len(s & set(w[j : j + size]))
                if w[j] in s and 100 * held >= 80 * len(s):
                    hits.append((held / len(s), len(s), -j, label, size))
        for h in hits:
            if not any(g > h and -g[2] < -h[2] + h[4] and -h[2] < -g[2] + g[4] for g in hits):
                want.add((i, -h[2], h[3], round(h[0], 9)))
    assert got == want and len(want) > 30


def test_language_model(spark, docs):
    rows = docs.select("doc_id", "text").collect()
    learn = lambda i: i is not None and i % 5 != 1
    c = Counter()
    for r in rows:
        if learn(r.doc_id):
            c.update([*words(r.text), "\0end"])
    n, v = sum(c.values()), len(c)
    want = Counter((r.doc_id, len(words(r.text)) + 1, sum(c[w] > 0 for w in [*words(r.text), "\0end"]), n, round(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*words(r.text), "\0end"]), 5)) for r in rows)
    one = language_model.score_texts(docs, F.col("doc_id") % 5 != 1).collect()
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in one) == want
    assert all(r.score <= 0 for r in one)
    many = language_model.score_texts(docs, F.col("doc_id") % 5 != 1, segment_levels=50, bits_per_key=256).collect()
    exact = language_model.score_texts(docs, F.col("doc_id") % 5 != 1, bits_per_key=256).collect()
    assert Counter((r.doc_id, round(r.score, 6)) for r in many) == Counter((r.doc_id, round(r.score, 6)) for r in exact)
    assert language_model.score_texts(empty(spark), F.col("doc_id") % 5 != 1).count() == 0


def _toy(seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(list("abcdefg"), int(rng.integers(0, 6)))), i % 4 > 0) for i in range(24)]


def test_language_model_score_against_brute_force(spark):
    rows = _toy(3)
    grams = Counter()
    for _, t, learn in rows:
        if learn:
            w = [*t.split(), "END"]
            grams.update(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total, kinds = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    level = {g: int(language_model.level_of(np.array([c]))[0]) for g, c in grams.items()}
    low, high = (lambda g, f=f: float(f(np.array([level.get(g, 0)]))[0]) for f in (language_model.low, language_model.high))

    def prob(w, before):
        p = (low((w,)) + 0.5) / (total + 0.5 * (kinds + 1))
        for n, prior in zip((1, 2), language_model.PRIORS):
            if len(before) >= n and high(before[-n:]):
                p = (low((*before[-n:], w)) + prior * p) / (high(before[-n:]) + prior)
        return p

    want = {}
    for i, t, _ in rows:
        w = (*t.split(), "END")
        want[i] = sum(np.log10(prob(w[j], w[:j])) for j in range(len(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    for size in (1 << 18, 20):
        got = {r.doc_id: r.score for r in language_model.score_texts(df, F.col("learn"), segment_levels=size, bits_per_key=256).collect()}
        assert got == pytest.approx(want, abs=1e-6)
    # every conditional distribution sums to at most 1 over the words and one unseen word, and nearly to 1
    for before in {(), *(g for g in grams if "END" not in g and len(g) < 3)}:
        assert 0.9 < sum(prob(w, before) for w in [*"abcdefg", "END", "unseen"]) <= 1 + 1e-9


def test_count_levels():
    c = np.arange(1, 100_000)
    q = language_model.level_of(c)
    assert (language_model.low(q) <= c).all() and (language_model.high(q) >= c).all()
    assert (language_model.low(q[:8]) == c[:8]).all() and (language_model.high(q) / language_model.low(q) < 1.25).all()


def test_grams_seen_once_are_scored(spark):
    rows = [(0, "a b", True), (1, "c d", True), (2, "a b", False), (3, "a d", False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    got = {r.doc_id: r.score for r in language_model.score_texts(df, F.col("learn")).collect()}
    assert got[2] > got[3] + 0.05


def test_language_model_reads_texts_as_often_for_a_large_filter(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(40)), i % 5 != 1) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")

    def read(size):
        seen = spark.sparkContext.accumulator(0)

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        got = sorted(language_model.score_texts(df.mapInArrow(run, df.schema), F.col("learn"), segment_levels=size, bits_per_key=256).collect())
        return got, seen.value

    (one, once), (many, often) = read(1 << 18), read(40)
    assert len(one) == 60 and one == many and often == once


def test_language_model_of_rows_whose_order_may_change(spark):
    df = spark.createDataFrame([(i, f"a{i % 7} b{i % 3} c", i % 5 != 1) for i in range(300)], "doc_id long, text string, learn boolean")
    plain = {r.doc_id: r for r in language_model.score_texts(df, F.col("learn")).collect()}
    dealt = language_model.score_texts(df.repartition(3), F.col("learn")).collect()
    assert len(dealt) == 300
    for r in dealt:
        assert (r.n_tokens, r.n_known, r.train_tokens) == (plain[r.doc_id].n_tokens, plain[r.doc_id].n_known, plain[r.doc_id].train_tokens)
        assert r.base_score == pytest.approx(plain[r.doc_id].base_score) and r.score == pytest.approx(plain[r.doc_id].score, abs=1e-6)


def test_filter_segments_give_counts_back():
    rng = np.random.default_rng(5)
    h = np.unique(rng.integers(0, 1 << 48, 300_000).astype(np.uint64))
    known = rng.random(len(h)) < 0.6
    c = rng.integers(1, 40, known.sum())
    built = language_model.Segments.build(h[known], c, 10, 1 << 16)
    q = np.zeros(len(h), int)
    q[known] = language_model.level_of(c)
    got = language_model.Segments.unpacked(*built.packed()).levels(h)
    assert len(built.filters) > 10 and (got == built.levels(h)).all()
    assert (got >= q).all() and (got > q).mean() < 0.03
    nothing = language_model.Segments.build(h[:0], c[:0], 10, 1 << 16)
    assert (nothing.levels(h) == 0).all() and len(built.levels(h[:0])) == 0


def _spoken(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.3, 60) % 500)) for i in range(n)]


def test_a_model_scores_texts_it_was_not_fitted_to(spark):
    schema = "doc_id long, text string"
    model = language_model.fit(spark.createDataFrame(_spoken(200, 1), schema))
    assert model.total == 200 * 61
    new = spark.createDataFrame([*_spoken(30, 2), (99, "never heard of"), (100, None)], schema)
    got = {r.doc_id: r for r in language_model.score_with(model, new).collect()}
    assert len(got) == 32 and all(r.score < 0 and r.train_tokens == model.total for r in got.values())
    assert got[99].n_known == 1 and got[99].score / 4 < min(r.score / r.n_tokens for i, r in got.items() if i < 30)
    # the same texts among the training ones: scored alike by score_texts
    both = spark.createDataFrame([*_spoken(200, 1), *((i + 1000, t) for i, t in _spoken(30, 2))], schema)
    again = {r.doc_id: r.score for r in language_model.score_texts(both, F.col("doc_id") < 1000).where("doc_id >= 1000").collect()}
    assert again == pytest.approx({i + 1000: r.score for i, r in got.items() if i < 30}, abs=1e-3)
    model.release()


def test_scores_follow_the_filter(spark):
    """Bits planted in the filter alone change the score, and nothing else: the score comes from it."""
    schema = "doc_id long, text string"
    model = language_model.fit(spark.createDataFrame(_spoken(100, 3), schema))
    new = spark.createDataFrame(_spoken(20, 4), schema)
    plain = {r.doc_id: r for r in language_model.score_with(model, new).collect()}
    full = F.transform("filters", lambda f: F.unhex(F.repeat(F.lit("FF"), F.octet_length(f))))
    model.table = model.table.withColumn("filters", full)
    planted = {r.doc_id: r for r in language_model.score_with(model, new).collect()}
    for i, r in plain.items():
        assert (r.base_score, r.n_known, r.n_tokens) == (planted[i].base_score, planted[i].n_known, planted[i].n_tokens)
        assert abs(planted[i].score - r.score) > 1


def test_error_at_the_usual_bits_a_key(spark):
    """False positives move a token's log10 probability by a hundredth or so on average."""
    schema = "doc_id long, text string"
    docs, new = spark.createDataFrame(_spoken(300, 5), schema), spark.createDataFrame(_spoken(60, 6), schema)
    scores = {}
    for bits in (language_model.BITS_PER_KEY, 256):
        model = language_model.fit(docs, bits_per_key=bits)
        scores[bits] = {r.doc_id: r.score / r.n_tokens for r in language_model.score_with(model, new).collect()}
    off = [abs(scores[language_model.BITS_PER_KEY][i] - scores[256][i]) for i in scores[256]]
    assert max(off) < 0.12 and np.mean(off) < 0.02


def test_rows_sent_follow_the_texts(spark):
    """A run sends a row to the ranges that it has n-grams for, however many ranges there are."""
    def sent(n, ranges):
        docs = spark.createDataFrame([(i, True, f"a{i} b{i} c{i}") for i in range(n)], "doc_id long, learn boolean, text string").coalesce(1)
        rows = docs.mapInArrow(language_model._ask(ranges), language_model._ASKED_SQL)
        return rows.count()

    few, many = sent(50, 1 << 14), sent(100, 1 << 15)
    assert few <= 50 * 8 + 1 and many <= 100 * 8 + 1 and 1.8 < many / few < 2.2


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_path())
    out = packing.pack(docs, queries.tokenizer_path(), with_ids=True).collect()
    assert len({r.sequence_id for r in out}) == len(out) and {r.offset for r in out} == {0}
    assert all(r.length & (r.length - 1) == 0 and r.length <= 4096 and len(r.ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in out)
    for i, text in docs.select("doc_id", "text").distinct().collect():
        want = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted({(r.start, tuple(r.ids)) for r in out if r.doc_id == i})
        assert [x for _, p in pieces for x in p] == want
    odd = ["it's <|endoftext|> ok 12a 3é4", "ÉCOLE ×÷ é", "日本語 aaa'sb " + "a" * 500, "ΣΑΣ ß ² \x1c\x85 z", "a\tb\x0bc"]
    bpe = packing.WordBpe(queries.tokenizer_path())
    import pyarrow as pa

    for lo, hi, data, off in packing.chunks(pa.array(odd)):
        ids, n = bpe.encode(data, off)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in odd[lo:hi]]
    assert packing.pack(empty(spark), queries.tokenizer_path()).count() == 0


@pytest.mark.parametrize("run", [lambda d, lab: toxicity.score(d, lab, F.col("doc_id") % 4 == 2), lambda d, lab: quality.score(d, lab, F.col("doc_id") % 3 == 1), lambda d, lab: language_id.predict(d, F.col("doc_id") % 4 == 2)])
def test_classifiers_take_any_rows(spark, docs, labels, run):
    got = run(docs, labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())
    assert all(0 <= r.score <= 1 for r in got)
    assert run(empty(spark), labels).count() == 0
    assert all(0 <= r.score <= 1 for r in run(docs, labels.limit(0)).collect())


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, d, "documents"), queries.table(spark, d, "labels").select("doc_id", "quality")
    lang = docs.select("doc_id", "lang")
    got = queries.op2_language_id(spark, d).join(lang, "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() / got.count() > 0.97
    got = queries.op7_quality(spark, d).join(labels, "doc_id").where("held_out")
    assert got.where("predicted = quality").count() / got.count() > 0.97


def test_und_for_texts_without_letters(spark):
    df = spark.createDataFrame([(0, "abc def ghi " * 9, "en"), (4, "äöü über alles " * 9, "de"), (8, None, "en"), (9, "1 2 … —", None), (10, "日本", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in language_id.predict(df, F.lit(False)).collect()}
    assert got[8] == got[9] == "und" and got[10] != "und"


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    good = "The first sentence of a plain document that stays as it is.\nAnd another line that is long enough to count."
    rows = [(i, good.replace("first", f"{w} {w}ly"), "en", "s", 1) for i, w in enumerate(["quick", "slow", "loud", "calm"])]
    rows += [(10, None, None, None, None), (11, "12 34", "en", "s", 5), (12, "", "en", "s", 0), (None, "a text without an id that is kept by every stage", "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = p.by_language(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {0, 1, 2, 3, None}
    lines = p.by_lines(spark, docs, "")
    assert lines.columns == docs.columns and sum("another line" in (r.text or "") for r in lines.collect()) == 1
    firsts = {r.component_id for r in ngram_jaccard.near_duplicate_classes(docs).collect()}
    left = [r.doc_id for r in p.by_ngrams(spark, docs.union(docs), "").collect()]
    assert set(left) == firsts | {None} and max(v for k, v in Counter(left).items() if k is not None) == 1
    assert len(p.STAGES) == 5


def test_pipeline_drops_equal_short_lines(spark):
    import corpus_pipeline as p

    rows = [(0, "And ornd.\n\nLes.", "en", "s", 15), (1, "Les.\n\nAnd ornd.\nAnd orne.", "en", "s", 25), (2, "Les.", "en", "s", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in p.by_lines(spark, docs, "").collect()}
    assert got == {0: (rows[0][1], 15), 1: ("\nAnd orne.", 10)}


def test_near_copy_chain_and_two_texts_under_one_id(spark):
    """A long chain of near copies is one class; rows of one doc_id with other texts are documents of their own."""
    import corpus_pipeline as p

    w = [f"w{i}" for i in range(14 * 400 + 100)]
    rows = [(i, " ".join(w[14 * i : 14 * i + 130])) for i in range(400)]
    got = ngram_jaccard.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}
    docs = spark.createDataFrame([(1, "one text of five words", "en", "s", 1, "r", "k"), (1, "quite another text of six words", "en", "s", 1, "r", "k"), (2, "one text of five words", "en", "s", 1, "r", "k"), (None, "one text of five words", "en", "s", 1, "r", "k")], "doc_id long, text string, lang string, source string, n_chars long, row string, key string")
    out = p.by_ngrams(spark, docs, "")
    assert out.columns == docs.columns and sorted((r.doc_id, r.text[:3]) for r in out.collect()) == [(1, "one"), (1, "qui")]


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows, against a plain version of what it keeps."""
    from tokenizers import Tokenizer

    import corpus_pipeline as p

    rng = np.random.default_rng(11)
    voc = {"en": "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were".split(), "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach".split()}
    item = " ".join(rng.choice(voc["en"], 30))
    rows = []
    for i in range(60):
        lang = ["en", "de"][i % 2]
        text = "\n".join(" ".join(rng.choice(voc[lang], 25)) for _ in range(4))
        rows.append((i, text + ("\n" + item if i in (7, 9) else "") + "\na footer line that all of the documents share", lang))
    rows += [(60, rows[3][1].rsplit("\n", 1)[0] + " end", "de"), (61, rows[4][1], "en"), (62, None, None), (63, "12 34 56", None), (64, "", "en")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = p.run(spark, str(tmp_path)).collect()
    seen, left = set(), {}
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            continue
        keep = []
        for line in t.split("\n"):
            if line not in seen:
                keep.append(line)
            seen.add(line)
        if keep:
            left[i] = "\n".join(keep)
    sets = {i: {tuple(words(t)[k : k + 5]) for k in range(len(words(t)) - 4)} for i, t in left.items()}
    for i in sorted(left):
        if any(j < i and j in left and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in sets):
            del left[i]
    a = words(item)
    for i in list(left):
        b = words(left[i])
        if any(sum(x == y for x, y in zip(a[s : s + 12], b[k : k + 12], strict=False)) >= 9 for s in range(len(a) - 11) for k in range(len(b) - 11)):
            del left[i]
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in left.items()}
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.start)):
        got.setdefault(r.doc_id, []).extend(r.ids)
    assert got == want and 61 not in got and 7 not in got
    assert p.by_benchmark(spark, docs.limit(0), str(tmp_path)).count() == 0 and p.packed(spark, docs.limit(0), "").count() == 0


def test_buckets_hold_sequences_of_one_length(spark, tmp_path):
    df = spark.createDataFrame([(0, "a b c d e f g"), (1, "a b"), (2, None)], "doc_id long, text string")
    packing.write_buckets(packing.pack(df, queries.tokenizer_path()), f"{tmp_path}/b")
    for r in spark.read.parquet(f"{tmp_path}/b").collect():
        assert r.length == 1 << r.bucket


def test_long_texts_are_hashed_in_blocks():
    from seriesmill.llm import kernel

    word = b"abcdefg" * 400_000
    data = np.frombuffer(b"one two " + word + b" three " + b"x y " * 600_000, np.uint8)
    off = np.array([0, len(data)])
    h, _ = kernel.words(data, off)
    small = np.frombuffer(b"one two three x y", np.uint8)
    g, _ = kernel.words(small, np.array([0, len(small)]))
    assert (h[[0, 1, 3, 4, -1]] == g).all() and len(h) == 4 + 1_200_000
    assert h[2] == kernel.words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))[0][0]
    assert b"".join(bytes(x) for x in kernel.segments(data, 1000)) == bytes(data)
