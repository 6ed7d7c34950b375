"""Each operator against a direct version, on rows with nulls, empty and long texts, repeats and extra columns."""

import collections
import hashlib
import math
import random
import re
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from vespera.llm import ann, bpe, embed_dedup, keyed, mixing, ordinal, packing, separators, simhash, suffixes
from vespera.llm.components import components
from vespera.llm.tokens import PieceEncoder, tokenizer_path
from vespera.session import scratch_path

DOCS = "doc_id long, text string, source string, n int, fp string, start int, cell int"


def rows():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeiost") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = text(60)
    out = [(i, text(rng.randint(1, 120)), rng.choice(["a", "a", "a", "b", None])) for i in range(40)]
    out += [(40 + i, f"{text(30)} {shared}\n{text(20)}", "b") for i in range(4)]
    out += [(50, None, "a"), (51, "", None), (52, " \t ", "c"), (53, text(30_000), "c"), (None, text(70), "a")]
    out += [(54, out[0][1], "a"), (0, out[0][1], "a"), (55, "x<|endoftext|>y  z é😀", "b"), (56, "go " * 400, "b")]
    return [(*r, 1, "clash", 2, 3) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids


def test_piece_encoder_and_bpe_give_the_library_ids(docs, none):
    texts = [r[1] for r in rows()]
    odd = ["a  b", " a", "a\n\nb", "a\x00b c", "don't we'll 12.5 x", "aaaa" * 40, "-" * 37, "\x1f a"]
    want = [array("I", reference_ids(t)).tobytes() for t in texts + odd]
    assert PieceEncoder(tokenizer_path()).encode(texts + odd) == want
    assert bpe.ByteBpe(tokenizer_path()).encode(texts + odd) == want
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, tokenizer_path()).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {(r[0], len(w) // 4, digest(w), digest((r[1] or "").encode())) for r, w in zip(rows(), want)}
    assert bpe.encode_digests(none, tokenizer_path()).count() == 0


def test_doubled_spaces_beside_other_white_space_give_the_library_ids(spark):
    texts = ["a\xa0b ", "a b\xa0c ", " a\xa0b", "a  b\xa0c", "a\n\n\nb\xa0c\xa0d", "a\n b\u2003c", "a \nb\u3000c", "a\x85b\n", "a\u2003b c"]
    want = [array("I", reference_ids(t)).tobytes() for t in texts]
    assert PieceEncoder(tokenizer_path()).encode(texts) == want
    assert bpe.ByteBpe(tokenizer_path()).encode(texts) == want


def test_keyed_ids_are_in_order_and_found_by_key(spark, docs, none):
    path = scratch_path(spark, "keyed")
    keyed.write_keyed(docs, path, tokenizer_path(), end_id=2, shard_ids=700)
    got = keyed.read_keyed(spark, path).collect()
    at = 0
    want = []
    for doc, text in sorted(((r[0], r[1]) for r in rows()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = array("I", [*reference_ids(text), 2])
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: (r[1], r[2])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    found = keyed.lookup(spark.createDataFrame([(3,), (53,), (999,), (None,)], "doc_id long"), path).collect()
    texts = {r[0]: r[1] for r in rows()}
    assert {r.doc_id: r.ids for r in found} == {i: [*reference_ids(texts[i]), 2] for i in (3, 53)}
    empty = scratch_path(spark, "keyed")
    keyed.write_keyed(none, empty, tokenizer_path())
    assert keyed.read_keyed(spark, empty).count() == 0


def test_perfect_hash_is_minimal_and_refuses_other_keys():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype("u8")
    index = keyed.PerfectHash.load(keyed.PerfectHash.build(keys).dump())
    assert sorted(index.slots(keys).tolist()) == list(range(5000))
    assert keyed.PerfectHash.build(np.zeros(0, "u8")).slots(keys[:3]).tolist() == [-1, -1, -1]


@pytest.mark.parametrize("block", [7, 1000, 10**6])
def test_separator_scan_stitches_blocks(spark, docs, block):
    path = scratch_path(spark, "flat")
    separators.write_flat(docs, path, tokenizer_path(), 50256, block_ids=block * 10 if block == 7 else block)
    blocks = spark.read.parquet(path)
    got = separators.named(separators.scan_separators(blocks, 50256), blocks).collect()
    plain = PieceEncoder(tokenizer_path(), special_as_text=True)
    want = [(r[0], len(x) // 4) for r, x in zip(rows(), plain.encode([r[1] for r in rows()]))]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(want, key=key)


def test_separator_scan_without_last_separator_and_empty_blocks(spark):
    raw = lambda *x: bytearray(array("H", x).tobytes())
    data = [(1, 0, 2, raw(5, 9)), (1, 1, 2, raw()), (1, 2, 2, raw(9, 4, 4)), (1, 3, 2, raw(4)), (2, 0, 2, None)]
    blocks = spark.createDataFrame(data, "file long, block long, width int, payload binary")
    got = sorted(map(tuple, separators.scan_separators(blocks, 9).collect()))
    assert got == [(1, 0, 0, 1), (1, 1, 2, 0), (1, 2, 3, 3)]


@pytest.mark.parametrize("target", [None, {"a": 1.0, "b": 1.0}])
def test_packing_places_each_id_once(docs, none, target):
    got = packing.pack(docs, tokenizer_path(), length=256, end_id=1, target=target).toPandas()
    pieces = collections.defaultdict(list)
    for r in got.itertuples():
        pieces[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for part in pieces.values():
        at = 0
        for offset, length in sorted(part):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes)
    total = sum(len(reference_ids(r[1])) + 1 for r in rows())
    assert sum(sizes) == total == got.length.sum()
    ids = {r[0]: array("I", [*reference_ids(r[1]), 1]) for r in rows() if r[0] not in (None, 0)}
    for r in got[got.doc_id.isin(list(ids))].itertuples():
        mine = ids[int(r.doc_id)]
        assert r.doc_tokens == len(mine)
        assert r.ids_crc32 == zlib.crc32(mine[r.start : r.start + r.length].tobytes())
    if target is None:  # every full window holds the corpus' proportions, to a token or two
        share = got.groupby(got.source.fillna("-")).length.sum() / total
        full = got[got.sequence_id < total // 256]
        held = full.groupby(["sequence_id", full.source.fillna("-")]).length.sum().unstack().fillna(0)
        assert (abs(held - 256 * share) <= 2).all().all()
    assert packing.pack(none, tokenizer_path()).count() == 0


def placed_once(got, length):
    at = collections.defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for part in at.values():
        end = 0
        for offset, n in sorted(part):
            assert offset == end
            end += n
        assert end == length or end & (end - 1) == 0
    done = collections.Counter()
    for r in got:
        done[r.doc_id] += r.length
    assert done == {r.doc_id: r.doc_tokens for r in got}


@pytest.mark.parametrize(("sources", "length", "queues"), [(30, 4, 1000), (30, 1, 1000), (200, 16, 20), (2000, 64, 1000)])
def test_packing_of_many_equal_sources_loses_nothing(spark, monkeypatch, sources, length, queues):
    monkeypatch.setattr(packing, "QUEUES", queues)
    rows_ = [(i, "one two " * (1 + i // sources % 3), f"s{i % sources:04}", 0) for i in range(max(2 * sources, 90))]
    table = spark.createDataFrame(rows_, "doc_id long, text string, source string, start int").repartition(3)
    got = packing.pack(table, tokenizer_path(), length=length).collect()
    assert len({r.doc_id for r in got}) == len(rows_)
    placed_once(got, length)


def test_packing_serves_a_small_source_that_the_target_names(spark, monkeypatch):
    monkeypatch.setattr(packing, "QUEUES", 3)
    rows_ = [(i, "word " * 100, f"big{i % 4}") for i in range(60)] + [(900 + i, "word " * 20, "small") for i in range(4)]
    table = spark.createDataFrame(rows_, "doc_id long, text string, source string")
    got = packing.pack(table, tokenizer_path(), length=64, target={"small": 1.0, "big0": 1.0}).collect()
    placed_once(got, 64)
    first = collections.Counter()
    for r in got:
        if r.sequence_id < 2:
            first[r.source] += r.length
    assert abs(first["small"] - 64) <= 2 and abs(first["big0"] - 64) <= 2


def direct_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def linked(ids, near):
    """Component labels by direct search."""
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if near(ids[i], ids[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_components(docs, none):
    got = simhash.near_duplicates(docs).collect()
    data = [(r[0], direct_fingerprint(r[1])) for r in rows()]
    label = linked([f for _, f in data], lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (doc, _), c in zip(data, label):
        if doc is not None:
            least[c] = min(doc, least.get(c, doc))
    want = collections.Counter((d, f"{f:016x}", least.get(c)) for (d, f), c in zip(data, label))
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(label))
    assert simhash.near_duplicates(none).count() == 0


def planted_copies():
    """Texts beside copies with ever more words replaced, a group of many near copies, exact copies and blank texts."""
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out = []
    for changes in (1, 2, 3, 4, 5, 6, 8, 12):
        for _ in range(6):
            words = text(200)
            near = list(words)
            for p in rng.sample(range(200), changes):
                near[p] = "new"
            out += [" ".join(words), " ".join(near)]
    centre = text(150)
    for _ in range(60):
        near = list(centre)
        for p in rng.sample(range(150), 2):
            near[p] = f"x{rng.randrange(99)}"
        out.append(" ".join(near))
    return [*out, out[0], out[0].upper().replace(" ", "  "), "", None, " \t", "one two", "one two"]


def test_pipeline_drops_near_copies_as_brute_force_does(spark, docs, none):
    close = lambda a, b: (a ^ b).bit_count() <= 2
    texts = planted_copies()
    label = linked([simhash.fingerprint(t) for t in texts], close)
    table = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    kept = corpus_pipeline.near_duplicates(spark, table.repartition(3), "")
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))
    kept = corpus_pipeline.near_duplicates(spark, docs, "")  # null and repeated ids
    label = linked([simhash.fingerprint(r[1]) for r in rows()], close)
    assert kept.count() == len(set(label)) and kept.columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, none, "").count() == 0


@pytest.mark.parametrize(("one_task", "most"), [(50_000, 2), (40, 2), (40, 1), (50_000, 1), (40, 0)])
def test_simhash_links_connect_all_close_fingerprints(spark, monkeypatch, one_task, most):
    monkeypatch.setattr(simhash, "ONE_TASK", one_task)
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    close = {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(700)}
    values = sorted(close | {rng.getrandbits(64) for _ in range(100)})
    signed = np.array(values, "u8").view("i8").tolist()
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most)
    found = {r.id: r.component for r in components(links).collect()}
    want = linked(values, lambda a, b: (a ^ b).bit_count() <= most)
    groups = collections.defaultdict(set)
    for v, c in zip(signed, want):
        groups[c].add(found.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_repeated_passages(docs, none):
    got = collections.defaultdict(set)
    for r in suffixes.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start, r.end))
    first, want = {}, collections.defaultdict(set)
    for doc, text in sorted({(r[0], r[1] or "") for r in rows()}, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = text.encode().lower().split()
        for p in range(len(words) - 49):
            at = first.setdefault(tuple(words[p : p + 50]), (doc, p))
            if at != (doc, p) and (at[0] != doc or p - at[1] >= 50):
                want[doc].update(range(p, p + 50))
    assert dict(got) == dict(want) and want
    cut = suffixes.without_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(rows())
    size = {r.doc_id: len((r.text or "").split()) for r in cut.collect()}
    before = {r[0]: len((r[1] or "").split()) for r in rows()}
    assert all(size[d] == before[d] - len(want.get(d, ())) for d in size)
    assert suffixes.repeated_passages(none).count() == 0 and suffixes.without_repeats(none).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_first_document_of_a_passage_does_not_depend_on_tasks(spark, parts):
    rng = random.Random(2)
    word = lambda: f"w{rng.randrange(3000)}"
    one, two = " ".join(word() for _ in range(120)), " ".join(word() for _ in range(70))
    texts = {i: one for i in range(3, 40)} | {50 + i: f"{word()} {word()} {two} {word()} {word()}" for i in range(30)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartitionByRange(parts, F.hash("doc_id"))
    got = suffixes.repeated_passages(table).collect()
    assert {r.doc_id: (r.start, r.end, r.first_doc_id) for r in got} == (
        {i: (0, 120, 3) for i in range(4, 40)} | {i: (2, 72, 50) for i in range(51, 80)}
    )
    nobody = table.union(spark.createDataFrame([(None, one)], table.schema)).repartition(parts, F.hash("text", "doc_id"))
    assert {r.first_doc_id for r in suffixes.repeated_passages(nobody).where("doc_id < 40").collect()} == {None}


def test_quality_orders_grades_and_keeps_good(spark, docs, none):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    data = []
    for i in range(600):
        grade = rng.choice([0, 1, 2, 2, 2])
        words = [word() for _ in range(rng.randint(5, 60))]
        words = words + ["nasty"] if grade == 0 else [w + "###" for w in words] if grade == 1 else words
        data.append((i, " ".join(words), grade, "x"))
    table = spark.createDataFrame(data, "doc_id long, text string, grade int, tails string")
    model = ordinal.train(table.drop("grade"), table.where("doc_id < 400").select("doc_id", "grade"), 3)
    scored = ordinal.score(table, model).where("doc_id >= 400").collect()
    right = sum((r.tails[-1] >= 0.5) == (r.grade == 2) for r in scored) / len(scored)
    assert right > 0.95
    assert all(r.tails[0] >= r.tails[1] and abs(sum(r.tails) - r.expected_grade) < 1e-9 for r in scored)
    kept = ordinal.select_good(docs, model)
    assert kept.columns == docs.columns and kept.count() <= len(rows())
    assert ordinal.select_good(none, model).count() == 0
    nothing = ordinal.train(none, table.where("false").select("doc_id", "grade"), 3)
    assert ordinal.select_good(docs, nothing).count() == len(rows())


def test_quality_fit_comes_as_low_as_plain_descent(spark):
    """The penalised likelihood of the fit, against many small steps down its numeric gradient from other starts."""
    rng = np.random.default_rng(4)
    rows_ = []
    for i in range(60):
        grade = i % 3
        words = rng.choice(12, size=6, p=np.roll(np.linspace(0.2, 1, 12) / np.linspace(0.2, 1, 12).sum(), 3 * grade))
        rows_.append((grade, np.unique(words).astype("i8")))
    ridge = 0.01
    y = np.array([g for g, _ in rows_])
    x = np.zeros((60, 12))
    for i, (_, f) in enumerate(rows_):
        x[i, f] = 1
    often = x.sum(axis=0) >= ordinal.SUPPORT
    weight = np.sqrt(60 / np.bincount(y, minlength=3))[y]
    weight = weight / weight.sum()

    def loss(v, t):
        z, edges = x @ (v * often), np.concatenate([[-60.0], t, [60.0]])
        cdf = lambda e: 1 / (1 + np.exp(-(e - z)))
        return -(weight * np.log(np.maximum(cdf(edges[y + 1]) - cdf(edges[y]), 1e-12))).sum() + ridge / 2 * (v * often) @ v

    got = ordinal.fit(rows_, 3, rounds=600, ridge=ridge)
    mine = loss(got.weights[:12], got.thresholds)
    best = np.inf
    for seed in range(3):
        theta = np.random.default_rng(seed).normal(0, 0.3, 14)
        theta[12:] = [-1, 1]
        for _ in range(4000):
            up = np.array([loss((theta + e)[:12], np.sort((theta + e)[12:])) for e in np.eye(14) * 1e-5])
            theta = theta - 0.5 * (up - loss(theta[:12], np.sort(theta[12:]))) / 1e-5
        best = min(best, loss(theta[:12], np.sort(theta[12:])))
    assert mine <= best * 1.005 + 1e-6
    texts = ["", None, "a b a", "c " * 9000]
    table = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, tails string")
    scored = {r.doc_id: r for r in ordinal.score(table, got).collect()}
    for i, t in enumerate(texts):
        z = got.weights.astype("f4")[ordinal.features(t)].sum(dtype="f8")
        tails = [1 / (1 + math.exp(c - z)) for c in got.thresholds]
        assert scored[i].tails == pytest.approx(tails, rel=1e-5) and scored[i].expected_grade == pytest.approx(sum(tails), rel=1e-5)


def test_quality_fits_one_row_per_rated_id(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordinal, "fit", lambda rows, grades: seen.append(rows))
    data = [(1, f"copy number {i % 7}") for i in range(300)] + [(i, f"text {i}") for i in range(2, 60)]
    texts = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(1, 90)], "doc_id long, grade int")
    ordinal.train(texts, ratings, 3)
    ordinal.train(texts, ratings, 3, most=50)
    assert [len(r) for r in seen] == [59, 50]
    assert collections.Counter(g for g, _ in seen[0]) == collections.Counter(i % 3 for i in range(1, 60))


def test_mixed_scores(docs, none):
    got = {r.doc_id: r for r in mixing.score_texts(docs).collect() if r.doc_id not in (None, 0)}
    held = lambda d: d is None or zlib.crc32(str(d).encode()) % 10 == 0
    words = [(r[0], (r[1] or "").encode().lower().split()) for r in rows()]
    seen = collections.Counter(w for d, ws in words if not held(d) for w in ws)
    ends = sum(not held(d) for d, _ in words)
    n, v = sum(seen.values()) + ends, len(seen) + 1
    for d, ws in words:
        if d in got:
            r = got[d]
            base = sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in [*(seen[w] for w in ws), ends])
            assert r.held_out == held(d) and r.n_tokens == len(ws) + 1 and r.train_tokens == n
            assert r.n_known == sum(seen[w] > 0 for w in ws) + 1
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
            assert r.score < 0 and math.isfinite(r.score)
    assert mixing.score_texts(none).count() == 0


def test_every_bit_of_a_code_is_mixed():
    frequent = [b"w%d" % i for i in range(200)]
    codes = mixing.Codes(frequent, np.arange(400, 200, -1), 1, 100, 14, np.zeros(200, "i8")).prepare()
    texts = [[b"w199", b"w0", b"other"], [b"w57"]]
    first, symbols = codes.bits_of(texts)[0], [[201, 2, 1, 0], [59, 0]]
    bits = [codes.bits[codes.offsets[s] : codes.offsets[s + 1]] for text in symbols for s in text]
    assert max(map(len, bits)) > 6 and first.bit.tolist() == np.concatenate(bits).tolist()
    # Counts too large for the table of logarithms keep their ratio, in learning as in scoring.
    odds, _ = mixing._odds(np.array([40_000, 3]), np.array([10_000, 12]))
    assert abs(odds[0] - math.log(0.25)) < 0.01 and abs(odds[1] - math.log(12.3 / 3.3)) < 1e-5


def test_a_long_text_is_worked_in_blocks(monkeypatch):
    frequent = [b"w%d" % i for i in range(300)]
    codes = mixing.Codes(frequent, np.arange(600, 300, -1), 1, 100, 14, np.zeros(300, "i8")).prepare()
    sizes, expand = [], mixing.Codes._expand
    monkeypatch.setattr(mixing.Codes, "_expand", lambda *a: (lambda b: sizes.append(len(b.bit)) or b)(expand(*a)))
    mixer, tables, gates = mixing.Mixer(codes.odds), np.zeros((2, 1 << 14, 2), "i4"), np.zeros(mixing._GATES)
    text = [b"w%d" % (i * i % 307) for i in range(50_000)] + [b"x" * 40_000]
    mixing.learn_chunk(codes, mixer, tables, gates, [text])
    assert gates.sum() == sum(sizes) == tables[0].sum() == tables[1].sum()
    assert sum(sizes) > 400_000 and max(sizes) < 60_000


def test_words_are_counted_by_kind_of_text(spark):
    texts = ["b a\x0bB\x1f a", "a b c", None, " \t", "É é\r\nz z", "a b c c"]
    got = {(r.word and bytes(r.word), r.top): r.n for r in mixing.word_counts(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    want = collections.Counter()
    for t in texts:
        own = collections.Counter(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()))
        top = min(own, key=lambda w: (-own[w], w), default=b"")
        want.update({(w, zlib.crc32(top) & 0xFFFFFF): n for w, n in own.items()})
    assert got == {**want, (None, 0): len(texts)}


def test_mixing_learns_context():
    frequent, sizes = [b"a", b"b", b"c", b"d"], np.array([500, 500, 500, 500])
    codes = mixing.Codes(frequent, sizes, 1, 100, 14, np.zeros(4, "i8")).prepare()
    mixer, tables, gates = mixing.Mixer(codes.odds), np.zeros((2, 2, 1 << 14), "i4"), np.zeros(mixing._GATES)
    text = [b"a", b"b", b"c", b"d"] * 5
    costs = [mixing.learn_chunk(codes, mixer, tables, gates, [text] * 5) for _ in range(60)]
    assert costs[-1] < 0.4 * costs[0]
    # Paths of all symbols add up to probability one under any odds.
    mass = 0.0
    for s in range(len(sizes) + 2):
        path = slice(codes.offsets[s], codes.offsets[s + 1])
        p = 1 / (1 + np.exp(-codes.odds[codes.nodes[path]].astype("f8")))
        mass += np.prod(np.where(codes.bits[path] == 1, p, 1 - p))
    assert abs(mass - 1) < 1e-6


VECTORS = "vec_id long, embedding array<float>, label int, node int, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 16))
    x[50:110] = x[0] + 0.05 * rng.standard_normal((60, 16))
    x[110:150] = x[1]
    x[150:160] = 3 * x[2]
    data = [(i, v.tolist(), i % 2 if i >= 160 else 0) for i, v in enumerate(x)]
    bad = [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [1.0] * 15]
    data += [(400 + i, v, 0) for i, v in enumerate(bad)] + [(420, x[1].tolist(), None), (None, x[3].tolist(), 0)]
    return spark.createDataFrame([(*r, 1, "clash") for r in data], VECTORS).repartition(3)


def valid(r):
    v = r.embedding
    return bool(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)


@pytest.mark.parametrize("cell", [8192, 32])
def test_nearest_vectors(vectors, cell):
    got = ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20, cell=cell).collect()
    good = [r for r in vectors.collect() if r.vec_id is not None and valid(r)]
    ids, x = np.array([r.vec_id for r in good]), np.array([r.embedding for r in good])
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found[r.query_id].append((r.vec_id, r.score))
    assert sorted(found) == sorted(i for i in ids.tolist() if i % 20 == 0)
    hits = 0
    for q, mine in found.items():
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert len(mine) == 20 and [s for _, s in mine] == sorted((s for _, s in mine), reverse=True)
        hits += len({i for i, _ in mine} & set(ids[order].tolist()))
    assert hits >= 0.95 * 20 * len(found)
    assert ann.nearest(vectors.where("false"), vectors).count() == 0


def test_search_looks_at_its_test_less_often_the_longer_it_goes_on(monkeypatch):
    x = np.random.default_rng(6).standard_normal((4096, 8))
    axes = np.random.default_rng(7).standard_normal((8, ann.DIMS))
    data = pd.DataFrame({"ids": [[i] for i in range(len(x))], "v": list(x), "p": list(x @ axes)})
    wanted = pd.DataFrame({"q": [0], "v": [x[0]], "p": [x[0] @ axes], "bound": [None]})
    looks, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda *a: looks.append(1) or partition(*a))
    found = ann._search(data, wanted, 20, 1e9, float((x * x).sum(axis=1).max()))  # a test that never holds
    assert found["seen"].sum() == len(x) and len(looks) < 40
    assert sorted(found["vec_id"]) == sorted(np.argsort(-(x @ x[0]))[:21])


@pytest.mark.parametrize("cell", [8192, 256])
def test_search_stops_by_its_test_before_all_is_verified(spark, cell):
    """On given vectors, which all lie about as far apart, and on groups of near ones, where the test saves most."""
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 32))
    grouped = [(i, (centres[i % 40] + 0.1 * rng.standard_normal(32)).tolist()) for i in range(1600)]
    grouped = spark.createDataFrame(grouped, "vec_id long, embedding array<double>")
    for table, most in ((given, 0.9), (grouped, 0.2)):
        rows_ = table.collect()
        ids, x = np.array([r.vec_id for r in rows_]), np.array([r.embedding for r in rows_])
        got = ann.nearest(table, table.where("vec_id % 20 = 0"), k=20, cell=cell).collect()
        found, verified = collections.defaultdict(set), {}
        for r in got:
            found[r.query_id].add(r.vec_id)
            verified[r.query_id] = r.verified
        hits = 0
        for q, mine in found.items():
            order = [i for i in np.lexsort((ids, -(x @ x[ids == q][0]))) if ids[i] != q][:20]
            hits += len(mine & set(ids[order].tolist()))
        assert hits >= 0.9 * 20 * len(found)
        assert 20 * len(found) < sum(verified.values()) < most * len(rows_) * len(found)


def test_chi_square_quantile():
    draws = (np.random.default_rng(0).standard_normal((200_000, ann.DIMS)) ** 2).sum(axis=1)
    assert abs((draws < ann.chi_square_quantile(0.99)).mean() - 0.99) < 0.002


@pytest.mark.parametrize("block", [1024, 16])
def test_vector_duplicates(vectors, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    got = {r.vec_id: r for r in embed_dedup.near_duplicate_vectors(vectors, 0.98).collect()}
    data = vectors.collect()
    good = [r for r in data if valid(r) and r.label is not None]
    unit = [np.array(r.embedding) / np.linalg.norm(r.embedding) for r in good]
    near = lambda i, j: good[i].label == good[j].label and float(unit[i] @ unit[j]) >= 0.98
    label = linked(range(len(good)), near)
    least = {}
    for r, c in zip(good, label):
        if r.vec_id is not None:
            least[c] = min(r.vec_id, least.get(c, r.vec_id))
    for i, r in enumerate(good):
        links = sum(near(i, j) for j in range(len(good)) if j != i)
        assert (got[r.vec_id].n_links, got[r.vec_id].component_id) == (links, least.get(label[i]))
    assert len(got) == len(data)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got.values())


def test_empty_tables_give_empty_results(spark, none, tmp_path):
    vectors = spark.createDataFrame([], VECTORS)
    assert embed_dedup.near_duplicate_vectors(vectors, 0.98).count() == 0
    path = f"{tmp_path}/flat"
    separators.write_flat(none, path, tokenizer_path(), 50256)
    blocks = spark.read.schema(separators.FILE).parquet(path)
    assert separators.named(separators.scan_separators(blocks, 50256), blocks).count() == 0
    assert ordinal.score(none, ordinal.train(none, none.selectExpr("doc_id", "1 as grade"), grades=3)).count() == 0


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(3, 3), (160, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {7} and 3 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_of_ascii_letters_need_no_translation():
    encoder = PieceEncoder(tokenizer_path())
    texts = ["plain words,\nof letters été naïve straße", "Zeile\nnächste x9 ɐ word.", "\0 a  b"]
    want = [np.array(x.ids, "<u4").tobytes() for x in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert PieceEncoder(tokenizer_path()).encode(texts) == want
    encoder.bytes = {b: c for b, c in encoder.bytes.items() if not (b < 128 and chr(b).isalpha())} | {ord("w"): "?"}
    assert encoder.encode(texts[::2]) == want[::2]


def test_a_batch_asks_once_for_each_different_piece():
    encoder, asked = PieceEncoder(tokenizer_path()), []

    class Asked(type(encoder.known)):
        def __getitem__(self, piece):
            asked.append(piece)
            return super().__getitem__(piece)

    encoder.known = Asked(encoder._learn)
    rng, signs = random.Random(5), "ab eéÉ×÷ßǅɏɐ .,;:!?#$%&*|'\n19-_\"(“é😀ñ字"
    texts = ["so so, so.\nso so; so", None, "", "so", "a  b", "x<|endoftext|>y", "\xe9t\xe9, 'tis.\n\xf7. \xd7,\n", "don't, 's. we'll,"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    whole = encoder.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)
    assert encoder.encode(pa.array(["-", *texts])[1:]) == [array("I", x.ids).tobytes() for x in whole]
    assert len(asked) == len(set(asked)) > 1000 and {"so", " so", "\n", ","} <= set(asked)


def test_encoding_holds_a_few_times_the_bytes_it_cuts(monkeypatch):
    """What a worker's encoder keeps and needs at once is bounded; the vocabulary is not written out a second time."""
    from vespera.llm import tokens

    monkeypatch.setattr(tokens.json, "loads", lambda raw, f=tokens.json.loads: f(raw) if len(raw) < 10_000 else pytest.fail("whole"))
    assert PieceEncoder(tokenizer_path()).plain
    assert 2 * tokens.PIECES * 250 <= 75_000_000 and 4 * tokens.CUT_BYTES <= 8 << 20


def test_search_of_a_cell_takes_projected_distances_as_a_product_of_blocks(monkeypatch):
    """Queries of a block share one product; a test that never holds leaves nothing out, a bound that holds nearly all."""
    rng = np.random.default_rng(8)
    x, axes = rng.standard_normal((500, 8)), rng.standard_normal((8, ann.DIMS))
    x[400:] = x[300:400]
    data = pd.DataFrame({"ids": [[i] for i in range(len(x))], "v": list(x), "p": list(x @ axes)})
    wanted = pd.DataFrame({"q": range(150), "v": list(x[:150]), "p": list(x[:150] @ axes), "bound": [None] * 149 + [0.0]})
    top = float((x * x).sum(axis=1).max())
    monkeypatch.setattr(ann, "BLOCK", 64)
    found = ann._search(data, wanted, 20, 1e9, top)
    for q, mine in found.groupby("q"):
        score = x @ x[q]
        want = np.lexsort((np.arange(len(x)), -score))[:21]
        if q < 149:
            assert mine["vec_id"].tolist() == want.tolist() and mine["seen"].sum() == len(x)
            assert np.allclose(mine["score"], score[want], rtol=1e-12)
    assert found.loc[found["q"] == 149, "seen"].sum() < 5
    many = ann._search(data, wanted[:2], 100, 1e9, top)  # more neighbours than the first look takes
    assert many[many["q"] == 1]["vec_id"].tolist() == np.lexsort((np.arange(len(x)), -(x @ x[1])))[:101].tolist()
    assert many["seen"].sum() == 2 * len(x)
