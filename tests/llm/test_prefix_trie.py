"""The trie against dictionaries of whole prefixes."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest

from vespera.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, a long, b long, part int, at int, n string"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "clash") for r in rows], SCHEMA).repartition(5)


def rebuilt(rows):
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in turns}
    return {c: turns.get(c - c % 20, [])[: h[c]] + own[h[c] :] for c, own in turns.items()}


def direct(convs):
    nodes = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = collections.defaultdict(set)
    for k in nodes:
        if k:
            children[k[:-1]].add(k)
    words = lambda k: len(k[-1][1].encode().split()) if k else 0
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) + (not children[k])
        saved[k] = sum(saved[x] for x in children[k]) + (len(nodes[k]) - 1) * words(k)
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k))))
        parent = min(nodes[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(children[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rows():
    rng = random.Random(4)
    texts = ["", " \t", "one two", "one  two\nthree", None, "é " * 50, "x" * 3000]
    out = []
    for c in range(260):
        for t in range(rng.choice([0, 1, 2, 5, 9])):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)))
    hot = [("user", "hello there you"), ("assistant", "good day"), ("user", "bye")]
    out += [(c, t, *hot[t]) for c in range(300, 420) for t in range(3)]  # copies, a third of all
    out += [(500, t, "user", f"turn {t}") for t in range(150)]  # long
    out += [(501, t, "user", f"turn {t}") for t in range(140)]
    out += [(600, None, "user", "no turn"), (600, 1, "user", "a"), (600, 1, "user", "b"), (600, 1, "user", "a")]
    out += [(None, 0, "user", "nobody"), (640, None, None, None), (661, 0, "user", "alone")]
    return out


@pytest.mark.parametrize(("heavy", "shard", "piece"), [(4096, 200_000, 500_000), (3, 20, 7), (40, 50, 1)])
def test_trie_matches_dictionaries(spark, monkeypatch, heavy, shard, piece):
    for name, value in (("HEAVY", heavy), ("SHARD_NODES", shard), ("PIECE", piece)):
        monkeypatch.setattr(trie, name, value)
    got = trie.prefix_trie(trie.with_shared_starts(table(spark, rows()))).drop("a", "b").collect()
    order = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(direct(rebuilt(rows())), key=order)


def test_trie_of_nothing_and_of_one_turnless_conversation(spark):
    assert trie.prefix_trie(trie.with_shared_starts(table(spark, []))).count() == 0
    lone = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 > 0)  # its only turn is dropped, and no first one is there
    got = trie.prefix_trie(trie.with_shared_starts(table(spark, [(lone, 0, "user", "gone")]))).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_leaves) for r in got] == [(lone, 0, None, 1, 1)]


def test_node_table_has_a_slot_for_each_digest_and_refuses_others():
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**62), 2**62, (2, 5000))
    table = trie.NodeTable(a, b)
    assert sorted(table.slots(a, b)) == list(range(5000))
    assert (table.slots(a + 1, b) == -1).all()
