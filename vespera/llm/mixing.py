"""Log-probabilities of texts by online logistic mixing of hashed-context bit predictors.

A token is coded as a path of bits: frequent words have a code of their own (shorter for more frequent ones), which
starts with the kind of document that they are found in most, told by the most frequent word there. Other have an escape and their letters up to the space that ends them. A bit is predicted from how it fell before in its
place of the code, in that place after the latest of the ``COMMON`` most frequent words (or two letters), and behind the
last word (or four letters). The predictors' log-odds are added with weights from a set that a gate chooses by how often the contexts have
been seen; the sum is refined by how often such sums have come true. Every bit of every code is mixed; bits of all tokens
add up to the bits of the text.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, smaller_batches

#: Words with a code of their own at most; table slots of each context (between these powers of two, by the number of
#: training tokens); partial tables that are added up in one task.
WORDS, SLOT_BITS, MERGED = 1 << 18, (14, 21), 32
_SLAB = 1 << 16
COMMON = 64
#: Tokens (and letters) whose bits are worked at once: few enough that their arrays stay in a core's cache.
BLOCK = 2000
#: Tokens after which the spelling of their rare words is learned.
CHUNK = 16_000
#: Levels of a code whose slots lie side by side, in one line of a core's cache.
LEVELS = 3
_CONFIDENCE = np.searchsorted([1, 2, 3, 6, 20], np.arange(64), side="right").astype("u1")  # seen 0, 1, 2, 3.., 6.., 20..
_GATES = 2 * 6 * 6
_ROUGH, _DEPTHS = 33, 24
STEP = 0.3


def held_out(doc_id: Column) -> Column:
    """Every tenth document by the checksum of its id as text; a null id is held out too."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts, one after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = split.flatten().cast(pa.binary())
    real = pc.binary_length(words).to_numpy() > 0
    ends = np.cumsum(split.value_lengths().to_numpy(), dtype="i8")
    sizes = np.diff(np.concatenate([[0], np.cumsum(real)])[np.concatenate([[0], ends])])
    return words.filter(pa.array(real)), sizes


def _tree(weights: np.ndarray, groups: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Codes by weight: (offsets, nodes, bits) of the path to each symbol, each node's log-odds of a 1, and its place: the
    node ``LEVELS`` levels of the tree begin with, times 8, and the number below it.

    Symbols of a group hang together below one node.
    """
    n = len(weights)
    parent, side = np.zeros(2 * n, "i8"), np.zeros(2 * n, "i1")
    odds = np.zeros(max(1, n - 1))
    made = n

    def join(heap: list[tuple[int, int]]) -> tuple[int, int]:
        nonlocal made
        heapq.heapify(heap)
        while len(heap) > 1:
            (w0, a), (w1, b) = heapq.heappop(heap), heapq.heappop(heap)
            parent[a] = parent[b] = made
            side[b] = 1
            odds[made - n] = np.log(w1 / w0)
            heapq.heappush(heap, (w0 + w1, made))
            made += 1
        return heap[0]

    members: dict[int, list[tuple[int, int]]] = {}
    for i, (w, g) in enumerate(zip(weights.tolist(), (np.zeros(n, "i8") if groups is None else groups).tolist())):
        members.setdefault(g, []).append((w, i))
    join([join(m) for m in members.values()])
    root, at = made - 1, np.arange(n)
    steps = []
    while True:
        moving = at != root
        if not moving.any():
            break
        up = np.where(moving, parent[at], root)
        steps.append((np.where(moving, up - n, -1), np.where(moving, side[at], 0)))
        at = up
    if not steps:
        return np.zeros(n + 1, "i8"), np.zeros(0, "i4"), np.zeros(0, "i1"), odds, np.zeros(len(odds), "i8")
    nodes, bits = np.stack([s[0] for s in steps[::-1]], axis=1), np.stack([s[1] for s in steps[::-1]], axis=1)
    used = nodes >= 0
    offsets, nodes, bits = np.concatenate([[0], np.cumsum(used.sum(axis=1))]), nodes[used].astype("i4"), bits[used].astype("i1")
    depth = np.arange(len(nodes)) - np.repeat(offsets[:-1], np.diff(offsets))
    top, below = nodes.copy(), np.zeros(len(nodes), "i8")
    for back in range(1, LEVELS):
        deep = np.flatnonzero(depth % LEVELS >= back)
        top[deep] = nodes[deep - back]
        below[deep] += np.int64(1) << (back - 1)  # the levels above it
        below[deep] += bits[deep - back].astype("i8") << (back - 1)
    place = np.zeros(len(odds), "i8")
    place[nodes] = top * np.int64(1 << LEVELS) + below
    return offsets, nodes, bits, odds, place


@dataclass
class Codes:
    """Codes of the tokens. Symbols: 0 ends a text, 1 escapes, then words by frequency. Letters are bytes."""

    words: list[bytes]
    counts: np.ndarray
    escapes: int
    ends: int
    slot_bits: int
    groups: np.ndarray

    def prepare(self) -> Codes:
        self.index = pa.array(self.words, pa.binary())
        weights = np.concatenate([[max(1, self.ends), max(1, self.escapes)], self.counts]).astype("i8")
        self.offsets, self.nodes, self.bits, odds, places = _tree(weights, np.concatenate([[-2, -1], self.groups]))
        letters = np.ones(256, "i8")
        for w, c in zip(self.words, self.counts.tolist()):
            np.add.at(letters, np.frombuffer(w + b" ", "u1"), c)
        self.letter_offsets, self.letter_nodes, self.letter_bits, more, further = _tree(letters)
        self.letter_nodes = self.letter_nodes + np.int32(len(odds))
        self.odds = np.concatenate([odds, more]).astype("f4")
        places = np.concatenate([places, further + (len(odds) << LEVELS)])
        if len(places) > 1 << 23:
            raise ValueError("more nodes than a packed entry can name")
        self.entries = self._packed(self.offsets, self.nodes, self.bits, places, 0)
        self.letter_entries = self._packed(self.letter_offsets, self.letter_nodes, self.letter_bits, places, 1)
        self.spans = _spans(self.offsets)
        self.letter_spans = _spans(self.letter_offsets)
        return self

    def _packed(self, offsets: np.ndarray, nodes: np.ndarray, bits: np.ndarray, places: np.ndarray, kind: int) -> np.ndarray:
        """All that is asked of a bit in one number, so that a code lies in one or two lines of a cache: the bit, its place
        (3 bits below a node of 23), its depth (5) and its log-odds (32)."""
        depth = np.arange(len(nodes)) - np.repeat(offsets[:-1], np.diff(offsets))
        rough = np.minimum(depth, _DEPTHS // 2 - 1) + kind * (_DEPTHS // 2)
        place = places.take(nodes)
        low = bits.astype("i8") | (place & 7) << 1 | rough << 4 | place >> LEVELS << 9
        return low.view("u8") | self.odds.take(nodes).view("u4").astype("u8") << np.uint64(32)

    @classmethod
    def of(cls, parts: dict) -> Codes:
        """From ``parts`` of another; a broadcast holds plain values, since executors have no copy of this module."""
        codes = cls.__new__(cls)
        codes.__dict__.update(parts)
        return codes

    def parts(self) -> dict:
        """What coding needs."""
        return {k: getattr(self, k) for k in ("ends", "slot_bits", "index", "odds", "entries", "letter_entries", "spans", "letter_spans")}

    def tokens(self, words: pa.Array, sizes: np.ndarray) -> Tokens:
        """Words of texts, one after the other, as symbols with an end after each text."""
        sizes = sizes + 1
        ends = np.cumsum(sizes) - 1
        symbols = np.zeros(sizes.sum(), "i4")
        named = np.ones(len(symbols), bool)
        named[ends] = False
        symbols[named] = pc.index_in(words, value_set=self.index).fill_null(-1).to_numpy() + 2
        escaped = symbols == 1
        before = np.concatenate([np.zeros(1, "i4"), symbols[:-1]])
        # The latest common word or end of a text; none yet is the last place, an end.
        marks = (symbols < 2 + COMMON) & ~escaped
        mark = np.maximum.accumulate(np.where(marks, np.arange(len(symbols), dtype="i4"), np.int32(-1)))
        common = np.concatenate([np.zeros(1, "i4"), symbols[mark[:-1]]])
        return Tokens(sizes, symbols, before, common, np.flatnonzero(escaped), words.filter(pa.array(escaped[named])))

    def listed(self, docs: list[list[bytes]]) -> Tokens:
        return self.tokens(pa.array(chain.from_iterable(docs), pa.binary()), np.array([len(d) for d in docs]))

    def bits_of(self, docs: Tokens | list[list[bytes]]) -> tuple[Bits, Tokens]:
        """Bits of all codes with their contexts; the tokens."""
        if not isinstance(docs, Tokens):
            docs = self.listed(docs)
        spans = self.spans.take(docs.symbols)
        return self._expand(spans, self.entries, 0, _hash(docs.common, 11), _hash(docs.before, 12)), docs

    def letters_of(self, words: pa.Array) -> Iterator[Bits]:
        """Bits of the spelling of the words one after the other, a space behind each, some letters at a time."""
        if not len(words):
            return
        ended = pc.binary_join_element_wise(words, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()))
        lengths = pc.binary_length(ended).to_numpy()
        raw = np.frombuffer(ended.buffers()[2], "u1", lengths.sum(dtype="i8")).astype("i4")
        place = np.arange(len(raw)) - np.repeat(np.cumsum(lengths, dtype="i8") - lengths, lengths)
        back = [np.where(place >= k, np.concatenate([np.full(k, 32, "i4"), raw])[: len(raw)], 32) for k in (1, 2, 3, 4)]
        near = back[0] | back[1] << 8
        far = near | back[2] << 16 | back[3] << 24
        for lo in range(0, len(raw), 2 * BLOCK):
            at = slice(lo, lo + 2 * BLOCK)
            yield self._expand(self.letter_spans.take(raw[at]), self.letter_entries, 1, _hash(near[at], 14), _hash(far[at], 15))

    def _expand(self, spans: np.ndarray, entries: np.ndarray, kind: int, near: np.ndarray, far: np.ndarray) -> Bits:
        first, size = spans >> 8, spans & 255
        starts = np.cumsum(size) - size
        token = np.repeat(np.arange(len(first)), size)
        at = (first - starts).take(token)
        at += np.arange(len(token))
        entry = entries.take(at).view("u4")
        low, odds = entry[::2].copy(), entry[1::2].copy().view("f4")
        below, node = low >> np.uint32(1) & np.uint32(7), low >> np.uint32(9)
        shift = np.uint32(32 - self.slot_bits)
        slots = []
        for h in (near, far):
            x = h.take(token)
            x ^= node
            x *= np.uint32(0xB8665FD9)
            x >>= shift
            x ^= below
            slots.append(x.astype(np.intp))
        rough = (low >> np.uint32(4) & np.uint32(31)).view("i4")
        return Bits(starts, odds, (low & np.uint32(1)).astype("i1"), rough, kind, *slots)


def _spans(offsets: np.ndarray) -> np.ndarray:
    """Where each code begins, times 256, and its length."""
    return offsets[:-1] << 8 | np.diff(offsets)


@dataclass
class Tokens:
    """Symbols of texts one after the other, each with the symbol before it and the latest common one in its text, and
    the words behind the escapes. sizes: symbols of each text."""

    sizes: np.ndarray
    symbols: np.ndarray
    before: np.ndarray
    common: np.ndarray
    escaped: np.ndarray
    spelled: pa.Array

    def cut(self, lo: int, hi: int) -> Tokens:
        """Some of the symbols, which may begin and end within a text."""
        a, b = np.searchsorted(self.escaped, (lo, hi))
        at = slice(lo, hi)
        some = self.symbols[at], self.before[at], self.common[at], self.escaped[a:b] - lo, self.spelled[a:b]
        return Tokens(np.array([len(some[0])]), *some)

    def by_text(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each symbol."""
        return np.add.reduceat(values, np.cumsum(self.sizes) - self.sizes)


@dataclass
class Bits:
    """Bits of tokens or letters one after the other. starts: the first bit of each."""

    starts: np.ndarray
    odds: np.ndarray
    bit: np.ndarray
    rough: np.ndarray
    kind: int
    near: np.ndarray
    far: np.ndarray


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    h = (x.astype("i8").view("u8") + np.uint64(seed << 40)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB) >> np.uint64(32)).astype("u4")


class Mixer:
    """The predictors' log-odds to one probability. The nodes' own come with the bits."""

    def __init__(self, _odds: np.ndarray | None = None, weights: np.ndarray | None = None, refined: np.ndarray | None = None):
        self.weights = np.tile(np.array([0.8, 0.15, 0.15], "f4"), (_GATES, 1)) if weights is None else weights
        self.refined = np.zeros((_DEPTHS * _ROUGH, 2)) if refined is None else refined

    def mix(self, b: Bits, near: np.ndarray, far: np.ndarray, seen_near: np.ndarray, seen_far: np.ndarray):  # noqa: ANN201
        """(gate, inputs, mixed probability, cell of the refinement) of a 1 for every bit."""
        gate = (seen_near * np.uint8(6) + seen_far + np.uint8(b.kind * 36)).astype(np.intp)
        inputs = (b.odds, near, far)
        total, *more = (w.take(gate) for w in np.ascontiguousarray(self.weights.T))
        total *= b.odds
        for part, x in zip(more, (near, far)):
            part *= x
            total += part
        np.clip(total, -16, 16, out=total)
        cell = np.rint(total * np.float32((_ROUGH - 1) / 32)).astype("i4")
        cell += b.rough * np.int32(_ROUGH) + np.int32((_ROUGH - 1) // 2)
        p = np.exp(np.negative(total, out=total), out=total)
        p += 1
        return gate, inputs, np.reciprocal(p, out=p), cell

    def refine(self, p: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """The final probability of a 1."""
        n0, n1 = self.refined[:, 0], self.refined[:, 1]
        # A cell that has seen little keeps the mixed value.
        trust = 0.5 * (n0 + n1) / (n0 + n1 + 200)
        own, shift = (1 - trust).astype("f4"), (trust * (n1 + 0.5) / (n0 + n1 + 1)).astype("f4")
        final = own.take(cell)
        final *= p
        final += shift.take(cell)
        return np.clip(final, 1e-6, 1 - 1e-6, out=final)

    def cost(self, b: Bits, p: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Bits that coding takes, for each token or letter."""
        right = self.refine(p, cell)
        right -= b.bit ^ 1
        np.abs(right, out=right)
        return -np.add.reduceat(np.log2(right, out=right), b.starts).astype("f8")

    def learn(self, bit: np.ndarray, gate, inputs, p, cell) -> np.ndarray:  # noqa: ANN001
        """One step down the coding cost for every gate's weights; returns how many bits each gate saw."""
        n = np.bincount(gate, minlength=_GATES)
        rate = STEP * n / (n + 200.0)
        order = np.argsort(gate.astype("u1"), kind="stable")
        seen = np.flatnonzero(n)
        starts = (np.cumsum(n) - n)[seen]
        p = p.take(order)
        error = bit.take(order) - p
        spread = p * (1 - p)
        for j, x in enumerate(inputs):
            x = x.take(order)
            slope = np.add.reduceat(error * x, starts)
            x *= x
            x *= spread
            curve = np.add.reduceat(x, starts)
            self.weights[seen, j] += (rate[seen] * slope / (curve + 0.02 * n[seen] + 1)).astype("f4")
        self.refined += np.bincount(cell * 2 + bit, minlength=2 * len(self.refined)).reshape(-1, 2)
        return n


def _odds(n0: np.ndarray, n1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds and confidence class of counts."""
    x0, x1 = n0.astype("f4"), n1.astype("f4")
    x0 += np.float32(0.3)
    x1 += np.float32(0.3)
    x1 /= x0
    return np.log(x1, out=x1), _CONFIDENCE.take(n0 + n1, mode="clip")


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Its different values in order, and how often each occurs; ``x`` itself is sorted for it."""
    x.sort()
    starts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
    return x[starts], np.diff(starts, append=len(x))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word binary, top int, n) over docs(text): how often words stand in documents whose most frequent word has the
    code ``top`` (24 bits of a checksum).

    A null word counts the documents. Words are summed in tasks before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches, 12 << 20):
            words, sizes = _split(batch["text"])
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.binary()), pa.array([0], pa.int32()), pa.array([len(sizes)], pa.int64())], names=["word", "top", "n"]
            )
            if not len(words):
                continue
            coded = words.dictionary_encode()
            distinct = coded.dictionary
            word = coded.indices.to_numpy().astype("i8")
            text = np.repeat(np.arange(len(sizes)), sizes)
            key, n = _counted(text * len(distinct) + word)
            owner, own = np.divmod(key, len(distinct))
            # The most frequent word of each text; the least of several.
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            most = n == np.repeat(np.maximum.reduceat(n, starts), np.diff(starts, append=len(n)))
            ranked = np.unique(own[most])
            ranked = ranked[pc.sort_indices(distinct.take(pa.array(ranked))).to_numpy()]
            rank = np.full(len(distinct), len(distinct))
            rank[ranked] = np.arange(len(ranked))
            top = np.zeros(len(sizes), "i8")
            top[owner[starts]] = np.minimum.reduceat(np.where(most, rank[own], len(distinct)), starts)
            del key, owner, most
            key, n = _counted(top[text] * len(distinct) + word)
            del text, word
            top, own = np.divmod(key, len(distinct))
            codes = np.array([zlib.crc32(w) & 0xFFFFFF for w in distinct.take(pa.array(ranked)).to_pylist()], "i4")
            columns = [distinct.take(pa.array(own)), pa.array(codes[top]), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "top", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word binary, top int, n long")
    return rows.groupBy("word", "top").agg(F.sum("n").alias("n"))


def kinds_of(tops: list, sizes: np.ndarray, least: float = 0.02) -> np.ndarray:
    """Group numbers: words of tops with this share of all words or more; 0 for the others."""
    mass: Counter = Counter()
    for t, n in zip(tops, sizes.tolist()):
        mass[t] += n
    large = sorted(t for t, n in mass.items() if n >= least * sizes.sum())
    number = {t: i + 1 for i, t in enumerate(large)}
    return np.array([number.get(t, 0) for t in tops], "i8")


def learn_chunk(
    c: Codes, mixer: Mixer, tables: np.ndarray, gates: np.ndarray, chunk: Tokens | list[list[bytes]], measured: bool = True
) -> float:
    """Predict some tokens with what has been learned so far, then learn from them; returns their bits as predicted
    (0 unless measured)."""
    if not isinstance(chunk, Tokens):
        chunk = c.listed(chunk)
    cost = 0.0
    blocks = (c.bits_of(chunk.cut(lo, lo + BLOCK))[0] for lo in range(0, len(chunk.symbols), BLOCK))
    for b in chain(blocks, c.letters_of(chunk.spelled.unique())):
        (near, sure_near), (far, sure_far) = (_odds(*_counts(t, x)) for t, x in zip(tables, (b.near, b.far)))
        gate, inputs, p, cell = mixer.mix(b, near, far, sure_near, sure_far)
        if measured:
            cost += float(mixer.cost(b, p, cell).sum())
        gates += mixer.learn(b.bit, gate, inputs, p, cell)
        for t, x in zip(tables, (b.near, b.far)):
            x += x
            x += b.bit
            np.add.at(t.reshape(-1), x, np.int32(1))  # equal types: the fast way
    return cost


def _counts(table: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """How often 0 and 1 were seen in each of the slots, whose two counts lie side by side and are fetched as one."""
    return table.reshape(-1).view("i8").take(slots).view("i4").reshape(-1, 2).T


def _trained(docs: DataFrame, codes, size: int) -> DataFrame:  # noqa: ANN001
    """Each task's counts of context slots, mixing weights and refinement cells, as (slab, raw)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Codes.of(codes.value)
        mixer = Mixer(c.odds)
        tables = np.zeros((2, size, 2), "i4")  # context, slot, bit
        gates = np.zeros(_GATES)
        step = 1000.0  # fewer at first
        for batch in smaller_batches(batches, 4 << 20):
            tokens = c.tokens(*_split(batch["text"]))
            lo = 0
            while lo < len(tokens.symbols):
                learn_chunk(c, mixer, tables, gates, tokens.cut(lo, lo + int(step)), measured=False)
                lo += int(step)
                step = min(CHUNK, step * 1.1)
        part = TaskContext.get().partitionId()
        parts = [(-1, np.concatenate([(mixer.weights * gates[:, None]).ravel(), gates, mixer.refined.ravel()]))]
        parts += [(t * (size // step) + s, tables[t][s * step : (s + 1) * step].T.ravel()) for step in [min(size, _SLAB)] for t in (0, 1) for s in range(size // step)]
        for slab, x in parts:
            raw = _pressed(x, "<f8" if slab < 0 else "<u4")
            yield pa.RecordBatch.from_pydict({"slab": [slab], "part": [part], "raw": [raw]}, schema=_RAW)

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slab int, part int, raw binary")


_RAW = pa.schema([("slab", pa.int32()), ("part", pa.int32()), ("raw", pa.binary())])


def _pressed(x: np.ndarray, kind: str) -> bytes:
    return len(x).to_bytes(8, "little") + pa.compress(x.astype(kind).tobytes(), "zstd", asbytes=True)


def _restored(raw: bytes, kind: str) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little") * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(raw[8:], size, "zstd", asbytes=True), kind)


def _added(group: pd.DataFrame) -> pd.DataFrame:
    slab = int(group["slab"].iloc[0])
    kind = "<f8" if slab < 0 else "<u4"
    total = None
    for raw in group.sort_values("part")["raw"]:
        x = _restored(raw, kind)
        # Counts stay under 32 bits: beyond that only their ratio matters, which a bound keeps well enough.
        total = x.astype("f8" if slab < 0 else "u8") if total is None else total + x
    if slab >= 0:
        total = np.minimum(total, 0xFFFFFFFF)
    return pd.DataFrame({"slab": [slab], "part": [int(group["part"].min())], "raw": [_pressed(total, kind)]})


def score_texts(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte), one row per row of
    docs(doc_id, text).

    Learns from the documents that ``held_out`` leaves. score is the log10 probability of the tokens under the mixed
    model, base_score under smoothed word counts. A null text is empty: its end alone. Null and repeated ids are scored
    like others; a null id is not learned from. Without training documents all codes are spelled with even odds.

    Three passes: word counts (grow with the vocabulary, joined and never sent whole), one online pass of every task
    over its training documents, and the scoring. A task's tables have a fixed number of slots; they are added up slab
    by slab in a tree of tasks. The ``words`` most frequent words and the tables (2 x 2^21 slots at most) are all that
    reaches the driver and the tasks.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id")))
    training = docs.where("not held_out")
    # The count and the code of a word's most frequent top in one number, so that rows are added up without sorting.
    top = F.max(F.shiftleft("n", 24).bitwiseOR(F.col("top").cast("long"))).bitwiseAND(F.lit(0xFFFFFF))
    counts = word_counts(training).groupBy("word").agg(F.sum("n").alias("n"), top.alias("top"))
    counts = materialize(counts, "word-totals")
    ends = (counts.where("word is null").agg(F.sum("n")).first()[0]) or 0
    named = counts.where("word is not null")
    total = named.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = (total.n or 0) + ends, total.v + (ends > 0)
    floor = 0.1 * (distinct + 1) + tokens
    most = named.where("n > 1").orderBy(F.desc("n"), "word").limit(words).toArrow()
    frequent, sizes = most["word"].to_pylist(), most["n"].to_numpy()
    groups = kinds_of(most["top"].to_pylist(), sizes)
    bits = min(max(SLOT_BITS[0], int(tokens / 4).bit_length()), SLOT_BITS[1])
    codes = Codes(frequent, sizes, int(tokens - ends - sizes.sum()), int(ends), bits, groups).prepare()
    shared = spark.sparkContext.broadcast(codes.parts())
    size = 1 << bits

    partial = materialize(_trained(training, shared, size), "partial-tables")
    tasks = partial.agg(F.max("part")).first()[0]
    level = 1
    while tasks is not None and tasks >= level:
        level *= MERGED
        partial = partial.groupBy("slab", F.floor(F.col("part") / level)).applyInPandas(_added, "slab int, part int, raw binary")
        if tasks >= level:
            partial = materialize(partial, "partial-tables")
    slots = np.zeros(2 * size, "u4")
    weights = refined = None
    step = min(size, _SLAB)
    for r in partial.select("slab", "raw").toLocalIterator():
        if r.slab < 0:
            x = _restored(bytes(r.raw), "<f8")
            w, gates = x[: 3 * _GATES].reshape(_GATES, 3), x[3 * _GATES : 4 * _GATES]
            start = Mixer(codes.odds).weights
            weights = np.where(gates[:, None] > 0, w / np.maximum(gates, 1)[:, None], start).astype("f4")
            refined = x[4 * _GATES :].reshape(-1, 2)
        else:
            n = _restored(bytes(r.raw), "<u4").reshape(2, -1).astype("i8")
            at = slice(r.slab * step, (r.slab + 1) * step)
            odds, sure = _odds(*n)
            slots[at] = odds.view("u4") & np.uint32(0xFFFFFFF8) | sure  # the class in the last bits of the log-odds
    model = spark.sparkContext.broadcast((slots, weights, refined))
    known_log = np.log10((np.concatenate([[ends, 0], sizes]) + 0.1) / floor)
    known_log[1] = 0  # escaped words are joined
    fields = "doc_id long, held_out boolean, n_tokens long, known long, base double, bits double, bytes long, rest array<struct<word:binary,n:long>>"
    base_log = spark.sparkContext.broadcast(known_log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, (slots, weights, refined), base = Codes.of(shared.value), model.value, base_log.value
        mixer = Mixer(c.odds, weights, refined)

        def cost(b: Bits) -> np.ndarray:
            near, far = slots.take(b.near), slots.take(b.far + size)
            seen = ((x & np.uint32(7)).astype("u1") for x in (near, far))
            return mixer.cost(b, *mixer.mix(b, near.view("f4"), far.view("f4"), *seen)[2:])

        for batch in smaller_batches(batches, 4 << 20):
            words, sizes = _split(batch["text"])
            tokens = c.tokens(words, sizes)
            symbols, texts = tokens.symbols, len(sizes)
            blocks = (tokens.cut(lo, lo + BLOCK) for lo in range(0, len(symbols), BLOCK))
            bits = np.concatenate([cost(c.bits_of(b)[0]) for b in blocks])
            coded = tokens.spelled.dictionary_encode()
            rare, distinct = coded.indices.to_numpy().astype("i8"), coded.dictionary
            if len(rare):
                letters = np.concatenate([cost(b) for b in c.letters_of(distinct)])
                lengths = pc.binary_length(distinct).to_numpy().astype("i8") + 1
                bits[tokens.escaped] += np.add.reduceat(letters, np.cumsum(lengths) - lengths)[rare]
            owner = np.repeat(np.arange(texts), tokens.sizes)[tokens.escaped]
            key, n = np.unique(owner * max(1, len(distinct)) + rare, return_counts=True)
            owner, rare = np.divmod(key, max(1, len(distinct)))
            length = np.concatenate([[0], np.cumsum(pc.binary_length(words).to_numpy() + 1, dtype="i8")])
            length = np.diff(length[np.concatenate([[0], np.cumsum(sizes)])])
            inner = pa.StructArray.from_arrays([distinct.take(pa.array(rare)), pa.array(n, pa.int64())], names=["word", "n"])
            columns = [
                pa.array(tokens.sizes, pa.int64()),
                pa.array(tokens.by_text((symbols > 1).astype("i8")) + (c.ends > 0), pa.int64()),
                pa.array(tokens.by_text(base.take(symbols)), pa.float64()),
                pa.array(tokens.by_text(bits), pa.float64()),
                pa.array(length, pa.int64()),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(texts + 1)).astype("i4")), inner),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], *columns],
                names=["doc_id", "held_out", "n_tokens", "known", "base", "bits", "bytes", "rest"],
            )

    scored = docs.select("doc_id", "held_out", "text").mapInArrow(run, fields)
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("k"))
    found = rest.join(named.drop("top"), "word", "left").select(
        "row", "k", F.coalesce("n", F.lit(0)).alias("c")
    )
    sums = found.groupBy("row").agg(
        F.sum(F.col("k") * F.log10((F.col("c") + 0.1) / F.lit(float(floor)))).alias("more"),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("known_more"),
    )
    none = F.lit(0)
    return scored.drop("rest").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("known_more", none)).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (-F.col("bits") * float(np.log10(2))).alias("score"),
        F.when(F.col("bytes") > 0, F.col("bits") / F.col("bytes")).alias("bits_per_byte"),
    )
