"""Lempel-Ziv fingerprints against a plain parse."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from seriesmill.llm import phrase_fingerprint as lz


def phrases(data: bytes) -> list[bytes]:
    known, out, start = set(), [], 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in known:
            if len(known) >= lz.MOST_PHRASES:
                known.clear()
                if end - start > 1:
                    return out + phrases_from(data, start)
            known.add(data[start:end])
            out.append(data[start:end])
            start = end
    return out


def phrases_from(data, start):
    return phrases(data[start:])


def jaccard(a, b):
    a, b = set(phrases(a)), set(phrases(b))
    return len(a & b) / len(a | b) if a | b else 1.0


def parsed(data: bytes, *stops: int) -> list[bytes]:
    p = lz.Parse()
    for s in (*stops, len(data)):
        p.read(data, s)
    return [data[i:j] for i, j in zip([0, *p.ends], p.ends)]


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "river", "ünder", "stone", "a", "walks", "every", "morning", "nobody"], n)) + str(rng.integers(1 << 30))


def test_parse_against_a_plain_one(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [b"", b"a", b"aaaaaaaaaa", b"abababababab", prose(rng, 400).encode(), bytes(rng.integers(0, 3, 3000, dtype=np.uint8)), bytes(rng.integers(0, 256, 2000, dtype=np.uint8))]
    for most in (lz.MOST_PHRASES, 20):
        monkeypatch.setattr(lz, "MOST_PHRASES", most)
        for t in texts:
            assert parsed(t) == phrases(t) == parsed(t, *sorted(int(x) for x in rng.integers(0, len(t) + 1, 3)))


def test_signatures_estimate_the_jaccard_index():
    rng = np.random.default_rng(1)
    off = []
    for i in range(60):
        a = prose(rng, 300).encode()
        b = a[: len(a) * (i % 10) // 10] + prose(rng, 300).encode()[len(a) * (i % 10) // 10 :]
        off.append(lz.likeness(lz.fingerprint(a), lz.fingerprint(b)) - jaccard(a, b))
    assert abs(np.mean(off)) < 0.04 and np.std(off) < 0.06
    assert lz.likeness(lz.fingerprint(b"same"), lz.fingerprint(b"same")) == 1 and lz.likeness(b"", b"") == 1 and lz.likeness(b"", lz.fingerprint(b"x")) == 0
    assert lz.likeness(lz.fingerprint(b"ab"), lz.fingerprint(b"xy")) < 0.1


def plain(rows):
    """Rows (doc_id, text), in the operator's order when ids are distinct."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(rows):
        t, other = t or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + other[:k]
        a, b, c = (lz.fingerprint(x.encode()) for x in (t, edited, other))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), a.hex(), b.hex(), lz.likeness(a, b), lz.likeness(a, c)))
    return Counter(out)


def found(spark, rows, partitions=5):
    df = spark.createDataFrame([(d, t, 1, "f") for d, t in rows], "doc_id long, text string, n_chars long, fingerprint string").repartition(partitions)
    return Counter(map(tuple, lz.fingerprints(df).collect()))


def test_rows_against_plain_ones(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 3 - 50, prose(rng, int(rng.integers(1, 80)))) for i in rng.permutation(300)]
    rows += [(None, "no id"), (10**12, None), (10**12 + 1, ""), (10**12 + 2, "é𝄞x"), (10**12 + 3, "x " * 200_000), (-(10**12), "ab")]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[(5, "only one")], [(5, None)], [(5, "same text")] * 40, [(7, "y" * 9), (6, "z" * 9)]])
def test_few_rows(spark, rows):
    assert found(spark, rows, 3) == plain(rows)


def test_a_hot_id(spark):
    """Many texts under one id, and none: each meets exactly one other, in one order for all."""
    rows = [(i % 3 or None, f"{i:03d}" * 40) for i in range(240)] + [(1, "copy " * 9)] * 30
    got = found(spark, rows)
    assert sum(got.values()) == 270 and Counter(r[0] for r in got.elements()) == Counter(d for d, _ in rows)
    starts = Counter(r[2] for r in got.elements())
    assert sorted(starts.values(), reverse=True)[:2] == [29, 1]  # copies follow one another


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lz.fingerprints(df).columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"] and lz.fingerprints(df).count() == 0


def test_shared_phrases_are_hashed_once(monkeypatch):
    """What a text and its edited text have in common is parsed and hashed one time; the signatures are those of whole parses."""
    hashed = []
    raw = lz.raw_hashes
    monkeypatch.setattr(lz, "raw_hashes", lambda values, starts, ends: (hashed.append(len(starts)), raw(values, starts, ends))[1])
    rng = np.random.default_rng(4)
    for a, b in [(prose(rng, 500), prose(rng, 300)), ("a", "b"), ("", "b"), ("abc", ""), ("abab", "cd"), ("x " * 5000, "y" * 9)]:
        k = len(a) // 3
        edited = a[: len(a) - k] + b[:k]
        hashed.clear()
        n, _, own, changed = lz.with_edit(a.encode(), b.encode())
        done = sum(hashed)
        assert (n, own, changed) == (len(a), lz.fingerprint(a.encode()), lz.fingerprint(edited.encode()))
        both = [x == y for x, y in zip(phrases(a.encode()), phrases(edited.encode()))]
        same = both.index(False) if False in both else len(both)
        assert done <= len(phrases(a.encode())) + len(phrases(edited.encode())) - same + 1
