"""Prefix trie of conversations against a plain one."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np

from seriesmill.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string"


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)
    out, leaves, saved = [], Counter(), Counter()
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0) + sum(saved[x] for x in children[k])
        ends = ",".join(str(c) for c in sorted(c for c in nodes[k] if len(built[c]) == len(k)))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], SCHEMA).repartition(3)
    out = prefix_trie.conversation_trie(df, **more)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return Counter(map(tuple, out.collect()))


def test_against_a_plain_trie(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in [*range(-12, 60), 4095, 4096, 10**12]:
        n = int(rng.integers(1, 12))
        rows += [(c, None if t == 2 and c % 7 == 0 else int(t) // (1 + c % 2), ["user", "bot", None][t % 3], ["hi", "ho", None, "", "é", "long text"][int(rng.integers(6))]) for t in range(n)]
    rows += [(100 + i, 5 * t, "user", "the same") for i in range(40) for t in range(4)]  # a third are copies
    rows += rows[:9] + [(None, 1, "user", "of nobody"), (9999, None, None, None)]
    assert found(spark, rows) == plain(rows)


def test_long_paths_and_deep_branches(spark):
    """A conversation over many blocks, and one branch at each of its turns: the number of rounds stays small."""
    rows = [(1000, t, "user", f"t{t}") for t in range(120)]
    rows += [(c, t, "user", f"t{t}" if t < c - 1000 else "off") for c in range(1001, 1080) for t in range(c - 1000 + 1)]
    rows += [(c, t, "bot", str(c)) for c in (7, 8) for t in range(300)]
    assert found(spark, rows, block_bits=3) == plain(rows)


def test_no_conversations(spark):
    assert not found(spark, [(None, 1, "user", "x")])


def test_a_list_of_ids_in_pieces(spark):
    ids = [*range(-5, 40), 100]
    got = prefix_trie.end_digests(spark.createDataFrame([(1, 2, c) for c in ids] + [(1, 3, 7)], "k1 long, k2 long, c long"), piece_bits=2).collect()
    assert {(r.k2, r.sha) for r in got} == {(2, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()), (3, hashlib.sha256(b"7").hexdigest())}
