"""Repeated windows of words by compressed FM-indexes, one per shard.

A window of ``WINDOW`` words is marked by the sequence of ``GRAM`` words in it with the smallest hash, so equal windows
are marked alike; the neighbouring windows with one mark are a segment. Segments whose mark occurs once cannot repeat.
Equal segments are brought together by their hashes and the earliest of them kept; what is left differs in part, and
goes to the shard of its mark. A shard indexes its segments: the Burrows-Wheeler transform of their words in a wavelet
matrix of packed bits. Each window end is then searched backwards in it for as long as the words occur twice; windows
whose matching statistic reaches ``WINDOW`` repeat, those in one interval of the index are equal, and all but the
earliest are reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, materialize, smaller_batches
from .suffixes import Hashes, _settled, retained

#: Words of a window and of the sequence that marks it.
WINDOW, GRAM = 20, 6
#: Words in a shard's index. Segments of one mark up to which the mark stays in one shard; the segments of a more
#: frequent mark are cut into single windows, which are dealt by their own hashes.
SHARD_WORDS, HOT = 1_000_000, 2_000
#: Words whose hashes a worker remembers, under 200 bytes each. A worker that meets more starts afresh.
REMEMBERED = 250_000

_KEY = ["none", "doc", "copy"]
_SPAN = "none boolean, doc long, copy long, lo int, hi int"


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words between ASCII white space, as they are."""
    import xxhash

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > REMEMBERED:
                self.clear()
            got = self[word] = xxhash.xxh64_intdigest(word, 11)
            return got

    words = (text or "").encode("utf-8", "replace").split()
    return np.fromiter(map(kept_by_worker("unchanged words", Known).__getitem__, words), "u8", len(words))


class WaveletMatrix:
    """How often a symbol stands before a place, for whole arrays of symbols and places.

    A level holds one bit of every symbol, packed into 64-bit words with the number of ones before each word; the
    symbols of the next level are in the order of the bits so far.
    """

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = []
        for bit in reversed(range(max(1, (symbols - 1).bit_length()))):
            one = (values >> bit) & 1 == 1
            packed = np.packbits(one, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, "<u8")
            words.view("u1")[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words[:-1]), dtype="i8")]).astype("u4")
            self.levels.append((bit, words, before, len(values) - int(one.sum())))
            values = np.concatenate([values[~one], values[one]])
        self.first = self._descend(np.arange(symbols), np.zeros(symbols, "i8"))

    def _descend(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for bit, words, before, zeros in self.levels:
            word = place >> 6
            below = (np.uint64(1) << (place & 63).astype("u8")) - np.uint64(1)
            ones = before[word] + np.bitwise_count(words[word] & below)
            place = np.where((symbol >> bit) & 1 == 1, zeros + ones, place - ones)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        return self._descend(symbol, place) - self.first[symbol]


class FmIndex:
    """Backward search in a text of symbols 0 … symbols - 1, for patterns of up to ``depth`` symbols."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        order = self._sorted_suffixes(text, depth)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.wavelet = WaveletMatrix(text[order - 1], symbols)

    @staticmethod
    def _sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
        """Places in the order of the ``depth`` symbols from there or more, by doubling; equal ones in any order."""
        rank, known = text.astype("i8"), 1
        order = np.argsort(rank)
        while known < depth:
            after = np.zeros(len(rank), "i8")
            after[:-known] = rank[known:] + 1
            key = rank * (rank.max(initial=0) + 2) + after
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty_like(rank)
            rank[order] = new
            if new[-1] == len(new) - 1:
                break
            known *= 2
        return order

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        base = self.before[symbol]
        return base + self.wavelet.rank(symbol, lo), base + self.wavelet.rank(symbol, hi)

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place in ``ends``: how many symbols up to it occur twice in the index, ``most`` at most.

        Also the lower end of the interval reached; it is the same for equal patterns of full length.
        """
        symbol = text[ends]
        lo, hi = self.before[symbol], self.before[symbol + 1]
        length, low = np.zeros(len(ends), "i4"), np.zeros(len(ends), "i8")
        open_ = np.arange(len(ends))
        for n in range(1, most + 1):
            twice = hi - lo >= 2
            open_, lo, hi = open_[twice], lo[twice], hi[twice]
            length[open_], low[open_] = n, lo
            if n == most or not len(open_):
                break
            lo, hi = self.step(text[ends[open_] - n], lo, hi)
        return length, low


def _runs(none: np.ndarray, doc: np.ndarray, copy: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Window starts of documents as ranges of neighbouring ones, both ends included."""
    order = np.lexsort((start, copy, doc, none))
    none, doc, copy, start = none[order], doc[order], copy[order], start[order]
    apart = (none[1:] != none[:-1]) | (doc[1:] != doc[:-1]) | (copy[1:] != copy[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], apart])) if len(start) else np.zeros(0, "i8")
    last = np.append(first[1:] - 1, len(start) - 1)[: len(first)]
    return {"none": none[first], "doc": doc[first], "copy": copy[first], "lo": start[first].astype("i4"), "hi": start[last].astype("i4")}


def _shard_spans(rows: pa.Table, window: int) -> pa.Table:
    """The windows of one shard's segments that occur earlier in another place."""
    c = {k: rows[k].to_numpy() for k in ("none", "doc", "copy", "lo", "hi")}
    size = (c["hi"] - c["lo"] + window).astype("i8")
    words = np.frombuffer(b"".join(rows["words"].to_pylist()), "<u8")
    begin = np.cumsum(size + 1) - size - 1  # in the text, where a separator ends each segment
    kinds, code = np.unique(words, return_inverse=True)
    text = np.zeros(int(size.sum()) + len(size), "i8")
    text[np.arange(len(words)) + np.repeat(np.arange(len(size)), size)] = code + 1
    index = FmIndex(text, len(kinds) + 1, window)

    count = size - window + 1
    seg = np.repeat(np.arange(len(size)), count)
    offset = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)
    length, low = index.matching_statistics(text, begin[seg] + offset + window - 1, window)
    hit = length == window
    seg, low, start = seg[hit], low[hit], c["lo"][seg[hit]] + offset[hit]
    none, doc, copy = c["none"][seg], c["doc"][seg], c["copy"][seg]
    order = np.lexsort((start, copy, doc, ~none, low))
    new = np.concatenate([[True], np.diff(low[order]) != 0])[: len(order)]
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(order) else order
    same = (none[order] == none[first]) & (doc[order] == doc[first]) & (copy[order] == copy[first]) & (start[order] == start[first])
    late = order[~same]
    return pa.table(_runs(none[late], doc[late], copy[late], start[late]))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    """(none, doc, copy, text): a document is its id, or that it has none, and a hash of its text."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        doc_id.isNull().alias("none"),
        F.coalesce(doc_id, F.lit(0).cast("long")).alias("doc"),
        _text_hash().alias("copy"),
        F.col("text").cast("string").alias("text"),
    )


def _ids(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What ``_settled`` orders by: doc_id, null where there is none, and copy."""
    ids = pa.array(batch["doc"].to_numpy(), mask=batch["none"].to_numpy(zero_copy_only=False))
    return pa.RecordBatch.from_arrays([ids, batch["copy"]], names=["doc_id", "copy"])


def _flags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return batch["none"].to_numpy(zero_copy_only=False), batch["doc"].to_numpy(), batch["copy"].to_numpy()


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(head, stretch, none, doc, copy, place, lo, hi, known): segments, or with ``known`` ranges of repeated windows.

    Of equal segments in a batch, only the earliest goes on; the others are repeats.
    """
    names = ["head", "stretch", "none", "doc", "copy", "place", "lo", "hi", "known"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches, 32 << 20):
            parts, row = [], []
            for i, text in enumerate(batch["text"]):
                found = retained(word_hashes(text.as_py()), window, gram)
                if found:
                    parts.append(found)
                    row.append(np.full(len(found["place"]), i))
            if not parts:
                continue
            c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            at = np.concatenate(row)
            order, first, late = _settled(c["head"], c["stretch"], _ids(batch), at, c["place"], 1)
            none, doc, copy = _flags(batch)
            alone = order == first  # rows that are equal in all are neither late nor the first
            out, gone = order[alone], order[late]
            starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(c["lo"][gone], c["hi"][gone])] or [np.zeros(0, "i8")])
            of = np.repeat(at[gone], c["hi"][gone] - c["lo"][gone] + 1)
            runs = _runs(none[of], doc[of], copy[of], starts)
            n, m = len(out), len(runs["lo"])
            long = lambda a, b: pa.array(np.concatenate([a, b]).astype("i8"))
            short = lambda a, b: pa.array(np.concatenate([a, b]).astype("i4"))
            yield pa.RecordBatch.from_arrays(
                [
                    long(c["head"][out], np.zeros(m)),
                    long(c["stretch"][out], np.zeros(m)),
                    pa.array(np.concatenate([none[at[out]], runs["none"]])),
                    long(doc[at[out]], runs["doc"]),
                    long(copy[at[out]], runs["copy"]),
                    short(c["place"][out], np.zeros(m)),
                    short(c["lo"][out], runs["lo"]),
                    short(c["hi"][out], runs["hi"]),
                    pa.array(np.arange(n + m) >= n),
                ],
                names=names,
            )

    fields = "head long, stretch long, none boolean, doc long, copy long, place int, lo int, hi int, known boolean"
    return _keyed(docs).mapInArrow(run, fields)


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(none, doc, copy, lo, hi): starts of windows, both ends included, whose words also start earlier.

    Earlier is in a document with a smaller doc_id (null first, equal ids in the order of a hash of the text) or before
    in the same document. Ranges of a document may overlap. docs(doc_id, text); other columns are not read.
    """
    order = [F.desc("none"), "doc", "copy", "place"]
    here = F.struct("none", "doc", "copy", "place")
    records = materialize(_segments(docs, window, gram), "fm-segments")
    open_ = records.where("not known")
    heads = open_.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
    heads = materialize(heads.select("head", (F.col("n") > HOT).alias("hot")), "fm-heads")

    # Marks that are not too frequent: a mark's segments meet in one task.
    by_stretch = Window.partitionBy("head", "stretch").orderBy(*order)
    by_head = Window.partitionBy("head")
    meeting = open_.join(heads.where("not hot").select("head"), "head")
    compared = (
        meeting.withColumn("first", F.first(here).over(by_stretch))
        .withColumn("mixed", F.min("stretch").over(by_head) != F.max("stretch").over(by_head))
        .withColumn("late", here != F.col("first"))
        .where("late or mixed")
        .select("head", *_KEY, "lo", "hi", "late", F.lit(False).alias("hot"))
    )
    # Frequent marks: only equal segments meet.
    frequent = open_.join(heads.where("hot").select("head"), "head")
    first = F.first(here).over(by_stretch)
    frequent = frequent.withColumn("late", here != first).select("head", *_KEY, "lo", "hi", "late", F.lit(True).alias("hot"))
    compared = materialize(compared.union(frequent), "fm-compared")

    wanted = compared.where("not late")
    words = wanted.where("not hot").agg(F.sum(F.col("hi") - F.col("lo") + window)).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    shard = F.when(~F.col("hot"), F.pmod(F.xxhash64("head"), F.lit(shards)).cast("int")).otherwise(-1)
    ranges = wanted.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi", shard.alias("shard"))).alias("ranges"))
    texts = _keyed(docs).join(ranges, _KEY)
    one = F.row_number().over(Window.partitionBy(*_KEY).orderBy("doc"))  # equal rows are one document
    texts = texts.withColumn("row", one).where("row = 1").select(*_KEY, "text", "ranges")
    cut_fields = "shard int, key long, none boolean, doc long, copy long, lo int, hi int, words binary"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches, 8 << 20):
            shards_, lo, hi, of, words_ = [], [], [], [], []
            keys, begin, row = [], [], []
            for i, (text, ranges_) in enumerate(zip(batch["text"], batch["ranges"], strict=True)):
                hashed = word_hashes(text.as_py())
                ranges_ = ranges_.as_py()
                for r in ranges_:
                    if r["shard"] >= 0:
                        shards_.append(r["shard"])
                        lo.append(r["lo"])
                        hi.append(r["hi"])
                        of.append(i)
                        words_.append(hashed[r["lo"] : r["hi"] + window].tobytes())
                single = [np.arange(r["lo"], r["hi"] + 1) for r in ranges_ if r["shard"] < 0]
                if single:
                    starts = np.unique(np.concatenate(single))
                    keys.append(Hashes(hashed).of(starts, starts + window).view("i8"))
                    begin.append(starts)
                    row.append(np.full(len(starts), i))
            none, doc, copy = _flags(batch)
            out = {"key": np.zeros(0, "i8"), "start": np.zeros(0, "i8"), "at": np.zeros(0, "i8")}
            if keys:
                key, start, at = np.concatenate(keys), np.concatenate(begin), np.concatenate(row)
                order_, first_, late_ = _settled(key, key, _ids(batch), at, start, 1)
                # Each window that occurs earlier in this batch is late for good: shard -2.
                out = {"key": np.where(late_, 0, key[order_]), "start": start[order_], "at": at[order_], "late": late_}
            n, m = len(of), len(out["at"])
            place = np.concatenate([np.array(of, "i8"), out["at"]])
            short = lambda a, b: pa.array(np.concatenate([np.array(a, "i4"), b.astype("i4")]))
            yield pa.RecordBatch.from_arrays(
                [
                    short(shards_, np.where(out["late"], -2, -1) if m else np.zeros(0)),
                    pa.array(np.concatenate([np.zeros(n, "i8"), out["key"]])),
                    pa.array(none[place]),
                    pa.array(doc[place]),
                    pa.array(copy[place]),
                    short(lo, out["start"]),
                    short(hi, out["start"]),
                    pa.array([*words_, *[None] * m], pa.binary()),
                ],
                names=["shard", "key", "none", "doc", "copy", "lo", "hi", "words"],
            )

    pieces = materialize(texts.mapInArrow(cut, cut_fields), "fm-pieces")
    indexed = pieces.where("shard >= 0").drop("key").groupBy("shard")
    found = indexed.applyInArrow(lambda rows: _shard_spans(rows, window), _SPAN)
    by_window = Window.partitionBy("key").orderBy(F.desc("none"), "doc", "copy", "lo")
    start = F.struct("none", "doc", "copy", "lo")
    single = pieces.where("shard = -1").withColumn("late", start != F.first(start).over(by_window)).where("late")
    fields = [*_KEY, "lo", "hi"]
    return (
        records.where("known")
        .select(*fields)
        .union(compared.where("late").select(*fields))
        .union(pieces.where("shard = -2").select(*fields))
        .union(single.select(*fields))
        .union(found.select(*fields))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) for every row of docs(doc_id, text); ``kept`` is text, words joined by a space.

    Words are what stands between ASCII white space, unchanged. Each word goes that a window of ``window`` consecutive
    words covers whose sequence also starts earlier: in a document with a smaller doc_id, or before in the same one,
    overlapping or not. Windows are judged on the input. A null text has no words; shorter texts than a window lose
    none. A null doc_id comes before all others; equal ids with different texts are different documents, in the order
    of a hash of the text; rows equal in both are one document and lose the same words. Other columns are not read.

    Hot passages cost a row per task: equal segments are settled in the task that made them, and segments of one very
    frequent mark are dealt by window. No rows no result.
    """
    spans = repeated_windows(docs, window, gram)
    by_doc = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # a document's words at most
    by_doc = materialize(by_doc, "fm-spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            total, removed, kept = [], [], []
            for text, spans_ in zip(batch["text"].to_pylist(), batch["spans"].to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "replace").split()
                total.append(len(words))
                if spans_:
                    edge = np.zeros(len(words) + 1, "i8")
                    for s in spans_:
                        edge[s["lo"]] += 1
                        edge[s["hi"] + window] -= 1
                    words = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            none = batch["none"].to_numpy(zero_copy_only=False)
            columns = [pa.array(batch["doc"].to_numpy(), mask=none), pa.array(total, pa.int64()), pa.array(removed, pa.int64())]
            columns.append(pa.array([k.decode("utf-8") for k in kept], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])

    texts = _keyed(docs).join(by_doc, _KEY, "left").select(*_KEY, "text", "spans")
    return texts.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
