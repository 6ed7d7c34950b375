"""Repeated windows against dictionaries of whole windows, and the index against plain counting."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vespera.llm import fm_index as fm

SCHEMA = "doc_id long, text string, none boolean, doc long, copy long, spans string, head int, row int"


def table(spark, rows, parts=4):
    return spark.createDataFrame([(*r, None, 1, 2, "clash", 3, 4) for r in rows], SCHEMA).repartition(parts)


def direct(spark, rows, window):
    """Rows in the order of doc_id (null first) and the hash of the text; equal rows are one document."""
    hashes = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")
    )
    documents = sorted({(r.doc_id is not None, r.doc_id or 0, r.h, r.text) for r in hashes.collect()}, key=lambda r: r[:3])
    seen, kept = set(), {}
    for known, doc, _, text in documents:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in seen:
                gone[s : s + window] = [True] * window
            seen.add(w)
        left = [w for w, g in zip(words, gone) if not g]
        kept[doc if known else None, text] = (len(words), len(words) - len(left), b" ".join(left).decode())
    return collections.Counter((d, *kept[d, t]) for d, t in rows)


def rows():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "é"]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line = text(70), text(24)
    out = [(i, " ".join(text(rng.randint(0, 90)))) for i in range(60)]
    out += [(100 + i, " ".join(text(rng.randint(0, 30)) + passage + text(10))) for i in range(40)]  # differing surroundings
    out += [(200 + i, " ".join(text(9) + line[: rng.randint(15, 24)] + text(9))) for i in range(40)]
    near = text(150)
    for i in range(30):
        copy = list(near)
        copy[rng.randrange(150)] = f"x{i}"
        out.append((300 + i, "\n".join(copy)))
    out += [(400 + i, " ".join(near)) for i in range(30)]  # copies
    out += [(500, "go " * 300), (501, "go " * 25), (502, " ".join(passage + passage)), (503, " \t"), (504, ""), (505, None)]
    out += [(506, " ".join(near).upper()), (507, " ".join(text(20_000))), (508, " ".join(line[:19])), (509, " ".join(line))]
    out += [(None, " ".join(near[20:80])), (None, " ".join(text(40))), (None, None)]
    out += [(300, " ".join(near[5:60])), (100, " ".join(passage))]  # an id with other texts
    return out + out[100:110] + [out[70]] * 40  # repeated rows


@pytest.mark.parametrize(("window", "gram", "hot", "words", "parts"), [(20, 6, 2000, 10**6, 4), (20, 6, 5, 900, 1), (20, 6, 12, 200, 7), (7, 3, 30, 2000, 3)])
def test_removed_words_match_dictionaries(spark, monkeypatch, window, gram, hot, words, parts):
    monkeypatch.setattr(fm, "HOT", hot)
    monkeypatch.setattr(fm, "SHARD_WORDS", words)
    got = fm.remove_repeats(table(spark, rows(), parts), window, gram).collect()
    assert collections.Counter(map(tuple, got)) == direct(spark, rows(), window)


def test_nothing_to_remove(spark):
    assert fm.remove_repeats(table(spark, [])).count() == 0
    got = fm.remove_repeats(table(spark, [(1, None), (2, "a b")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, ""), (2, 2, 0, "a b")]


def test_ranks_of_the_wavelet_matrix_are_counts():
    rng = np.random.default_rng(2)
    for symbols, n in ((1, 5), (2, 64), (7, 1000), (300, 129)):
        values = rng.integers(0, symbols, n)
        matrix = fm.WaveletMatrix(values, symbols)
        symbol, place = rng.integers(0, symbols, 500), rng.integers(0, n + 1, 500)
        assert matrix.rank(symbol, place).tolist() == [int((values[:p] == s).sum()) for s, p in zip(symbol, place)]


@pytest.mark.parametrize("symbols", [2, 5, 60])
def test_matching_statistics_are_longest_recurring_suffixes(symbols):
    rng = np.random.default_rng(symbols)
    text = np.concatenate([rng.integers(1, symbols + 1, 400), [0]])
    text[200:230] = text[50:80]
    index = fm.FmIndex(text, symbols + 1, 20)
    ends = np.arange(25, 400)
    length, low = index.matching_statistics(text, ends, 20)
    plain = text.tolist()
    places = collections.defaultdict(list)
    for n in range(1, 21):
        for s in range(len(plain) - n + 1):
            places[tuple(plain[s : s + n])].append(s)
    want = [max(n for n in range(21) if n == 0 or len(places[tuple(plain[e - n + 1 : e + 1])]) > 1) for e in ends]
    assert length.tolist() == want
    full = [(int(lo), tuple(plain[e - 19 : e + 1])) for e, lo, n in zip(ends, low, length) if n == 20]
    assert full and len({lo for lo, _ in full}) == len({p for _, p in full}) == len(set(full))
