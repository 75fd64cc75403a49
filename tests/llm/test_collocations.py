"""Phrase collocations against a plain count."""

import re
from collections import Counter

import numpy as np

from seriesmill.llm import collocations

SCHEMA = "doc_id long, text string, lang string, n long, word string"


def plain(rows, least, top):
    n, seen = Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            seen.setdefault(lang, Counter()).update(tuple(w[i : i + m]) for m in range(1, 6) for i in range(len(w) - m + 1))
    out = []
    for lang, c in seen.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in candidates.items()):
                continue
            score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def corpus():
    rng = np.random.default_rng(4)
    voc = ["the", "Of", "a", "über", "né", "x", "y", "z"]
    marks = [" ", " ", " ", "\t", "  ", ", ", ".\n", "\r\n", " "]
    rows = [("".join(w + marks[int(rng.integers(len(marks)))] for w in rng.choice(voc, int(rng.integers(0, 60)))), ["en", "de", None, ""][i % 4]) for i in range(160)]
    rows += [("one two three four five six! ", "en")] * 12 + [("Tie tie tie tie tie tie", "en")] * 6 + [(None, "en"), ("", None), ("...", "fr"), (" a b", None)]
    return rows + [("long way home " * 900 + "w" * 5000, "xx")]


def frame(spark, rows):
    return spark.createDataFrame([(1, t, lang, 7, "w") for t, lang in rows], SCHEMA).repartition(4)


def test_against_a_plain_count(spark):
    rows = corpus()
    want = plain(rows, 6, 30)
    assert max(r[1] for r in want) == 30 and len({r[0] for r in want}) == 5
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows), least=6, top=30).collect())) == want


def test_hash_codes_and_small_blocks(spark):
    """Beyond the size that may be broadcast; filters with many false hits; stretches longer than a block."""
    rows = corpus()
    got = collocations.collocations(frame(spark, rows), least=6, top=30, dictionary_words=3, filter_bits=64, block=50)
    assert sorted(map(tuple, got.collect())) == plain(rows, 6, 30)


def test_nothing_to_find(spark):
    out = collocations.collocations(frame(spark, [("a b c", "en"), (None, None)]))
    assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and out.count() == 0
    assert collocations.collocations(frame(spark, [("x", "en")]).limit(0)).count() == 0


def test_one_long_text_is_read_in_parts(spark):
    text = ("aa bb, cc dd " * 800_000)[:-1]
    got = {r.phrase: r.a for r in collocations.collocations(frame(spark, [(text, "en"), ("aa bb", "en")])).collect()}
    assert len(text) > collocations.COUNT_BYTES and got == {"aa bb": 800_001, "cc dd aa bb": 799_999, "cc dd": 800_000}


def test_parts_of_a_text_keep_its_pieces():
    codes = collocations.Dictionary(np.arange(1, 6, dtype=np.uint64) << np.uint64(60))
    assert list(codes.find(np.array([1 << 60, 7, 5 << 60, (1 << 60) + 1], np.uint64))) == [1, 0, 5, 0]
    x = np.array([0, 1, 2, 0, 0, 3, 0, *[4] * 30, 0, 5], np.uint32)
    blocks = list(collocations._blocks(iter([x[:9], x[9:]]), np.uint32, 10))
    pairs = Counter((int(b[i]), int(b[i + 1])) for b, starts in blocks for i in range(min(starts, len(b) - 1)) if b[i] and b[i + 1])
    assert pairs == {(1, 2): 1, (4, 4): 29} and all(len(b) <= 10 for b, _ in blocks)
