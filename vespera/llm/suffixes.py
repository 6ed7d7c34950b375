"""Repeated passages by a sparse suffix array.

Suffixes are retained at minimiser positions only: of every ``PASSAGE`` words in a row, the ``GRAM``-word sequence with
the smallest hash marks one. Equal passages mark equal places. Suffixes are sorted by the sequence they start with, then
by the stretch that they speak for (all passages that have marked them); neighbours are compared. Where neighbours start
alike but their stretches differ, matches are extended to the left and right, word by word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, materialize, smaller_batches

#: Words of the shortest passage that counts, and words of a minimiser's sequence.
PASSAGE, GRAM = 50, 13
#: Words whose hashes a worker remembers, under 200 bytes each. A worker that meets more starts afresh.
REMEMBERED = 250_000
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_BASE = 0x9E3779B97F4A7C15


def _word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words; A-Z lower-cased."""
    import xxhash

    class Known(dict):
        def __missing__(self, word: bytes) -> int:
            if len(self) > REMEMBERED:
                self.clear()
            got = self[word] = xxhash.xxh64_intdigest(word, 7)
            return got

    words = (text or "").encode("utf-8", "replace").lower().split()
    known = kept_by_worker("word hashes", Known)
    return np.fromiter(map(known.__getitem__, words), "u8", len(words))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any stretch of words from sums over prefixes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE, "u8")]), dtype="u8")
        back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, pow(_BASE, -1, 1 << 64), "u8")]), dtype="u8")
        self.back = back
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * power[:n], dtype="u8")])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _spread((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype("u8"))


def retained(words: np.ndarray, passage: int = PASSAGE, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Suffixes of one document: start hash, stretch hash, place, and the first and last passage that mark it."""
    n = len(words)
    if n < passage:
        return {}
    hashes = Hashes(words)
    starts = np.arange(n - gram + 1)
    grams = hashes.of(starts, starts + gram)
    wide = passage - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, wide)
    mark = np.concatenate(
        [views[at : at + 65536].argmin(axis=1) + np.arange(at, min(at + 65536, len(views))) for at in range(0, len(views), 65536)]
    )
    first = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(mark) - 1]])
    place = mark[first]
    stretch = _spread(hashes.of(first, last + passage) ^ _spread((place - first).astype("u8") + np.uint64(1)))
    return {"head": grams[place].view("i8"), "stretch": stretch.view("i8"), "place": place, "lo": first, "hi": last}


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), _text_hash().alias("copy"), F.col("text").cast("string").alias("text")
    )


def repeated_passages(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM, with_first: bool = True) -> DataFrame:
    """(doc_id, copy, start, end, first_doc_id): stretches of words that stand earlier, in the order of doc_id and place.

    Word positions count from 0, ``end`` is exclusive. Every run of ``passage`` words that equals a run in an earlier
    document, or earlier in the same document without overlap, lies in a returned stretch, and each stretch consists of
    such runs; first_doc_id is the smallest document of those that the stretch's suffixes and runs were found equal to,
    in whichever tasks they were met (without ``with_first``, which saves a join, any of them). The first occurrence is
    never returned. ``copy`` is a hash of the text: rows with equal doc_id and text count as one document. Null and short
    texts have no passages; a null doc_id comes before all others. docs(doc_id, text); other columns are not read.

    Hot passages cost a row per task and document, never a group: each task first compares the suffixes that it made
    itself and passes on the first of equal ones only, and sorting is by Spark, which spills.
    """
    fields = "head long, stretch long, doc_id long, copy long, place int, lo int, hi int, first_doc long, known boolean"
    schema = pa.schema(
        [(c, pa.int64()) for c in ("head", "stretch", "doc_id", "copy")]
        + [(c, pa.int32()) for c in ("place", "lo", "hi")]
        + [("first_doc", pa.int64()), ("known", pa.bool_())]
    )

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches, 32 << 20):
            parts, row = [], []
            for i, text in enumerate(batch["text"]):
                found = retained(_word_hashes(text.as_py()), passage, gram)
                if found:
                    parts.append(found)
                    row.append(np.full(len(found["place"]), i))
            if not parts:
                continue
            c = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
            at = np.concatenate(row)
            out, first, known = _settled(c["head"], c["stretch"], batch, at, c["place"], passage)
            c = {k: v[out] for k, v in c.items()}
            docs_ = batch["doc_id"].take(pa.array(at[out]))
            columns = [pa.array(c["head"]), pa.array(c["stretch"]), docs_, batch["copy"].take(pa.array(at[out]))]
            columns += [pa.array(c[k].astype("i4")) for k in ("place", "lo", "hi")]
            columns += [batch["doc_id"].take(pa.array(at[first])), pa.array(known)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    records = materialize(_documents(docs).mapInArrow(suffixes, fields), "suffixes")

    order = ["doc_id", "copy", "place"]
    equal = Window.partitionBy("head", "stretch").orderBy(*order)
    rows = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    alike = Window.partitionBy("head").orderBy("stretch", *order)
    candidates = records.where("not known").select("head", "stretch", *order, "lo", "hi")
    compared = (
        candidates.repartition("head")
        .withColumn("first", F.first(F.struct(*order)).over(rows))
        .withColumn("before", F.lag("stretch").over(alike))
        .withColumn("after", F.lead("stretch").over(alike))
        .withColumn("variants", F.size(F.array_distinct(F.array_compact(F.array("before", "stretch", "after")))))
    )
    here = F.struct(*order)
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.copy") == F.col("copy"))
    near = own & (F.col("place") - F.col("first.place") < passage)
    # A neighbour with another stretch touches the last or first row of a run of equal ones; the run's first row stands
    # for all, so it must know of neighbours on either side of the run.
    mixed = F.max(F.col("variants")).over(rows) > 1
    compared = compared.withColumn("mixed", mixed).where(~here.eqNullSafe(F.col("first")) | F.col("mixed"))
    compared = materialize(
        compared.select(
            "head",
            "stretch",
            "doc_id",
            "copy",
            "lo",
            "hi",
            F.col("first.doc_id").alias("first_doc"),
            (~here.eqNullSafe(F.col("first")) & ~near).alias("known"),
        ),
        "compared",
    )

    # Extension: passages of the suffixes whose neighbours start alike and go on differently, one by one.
    open_ = compared.where("not known").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
    wanted = open_.select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "open")
    texts = _documents(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("copy") == F.col("_copy")))
    spot = "hash long, doc_id long, copy long, start int, first_doc long, known boolean"

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches, 32 << 20):
            keys, row, begin = [], [], []
            for i, (text, ranges) in enumerate(zip(batch["text"], batch["open"], strict=True)):
                hashes = Hashes(_word_hashes(text.as_py()))
                starts = np.unique(np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in ranges.as_py()]))
                keys.append(hashes.of(starts, starts + passage).view("i8"))
                begin.append(starts)
                row.append(np.full(len(starts), i))
            if not keys:
                continue
            key, start, at = np.concatenate(keys), np.concatenate(begin), np.concatenate(row)
            out, first, known = _settled(key, key, batch, at, start, passage)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[out]),
                    batch["doc_id"].take(pa.array(at[out])),
                    batch["copy"].take(pa.array(at[out])),
                    pa.array(start[out].astype("i4")),
                    batch["doc_id"].take(pa.array(at[first])),
                    pa.array(known),
                ],
                names=["hash", "doc_id", "copy", "start", "first_doc", "known"],
            )

    spots = materialize(texts.select("doc_id", "copy", "text", "open").mapInArrow(extended, spot), "passages")
    place = ["doc_id", "copy", "start"]
    by_hash = Window.partitionBy("hash").orderBy(*place)
    late = spots.where("not known").withColumn("first", F.first(F.struct(*place)).over(by_hash))
    own = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.copy") == F.col("copy"))
    late = late.where(~F.struct(*place).eqNullSafe(F.col("first")) & ~(own & (F.col("start") - F.col("first.start") < passage)))
    settled, spotted = records.where("known"), spots.where("known")
    if with_first:  # what a task has settled by itself may have occurred before in another one
        settled = _with_first(settled, compared.where("known"), ["head", "stretch"], F.col("first_doc"))
        spotted = _with_first(spotted, late, ["hash"], F.col("first.doc_id"))
    span = lambda df, a, b, first: df.select("doc_id", "copy", F.struct(F.expr(a).alias("a"), F.expr(b).alias("b"), F.expr(first).alias("f")).alias("s"))  # noqa: E501, E731
    whole = f"hi + {passage}"
    spans = (
        span(settled, "lo", whole, "first_doc")
        .union(span(compared.where("known"), "lo", whole, "first_doc"))
        .union(span(spotted, "start", f"start + {passage}", "first_doc"))
        .union(span(late, "start", f"start + {passage}", "first.doc_id"))
    )
    by_doc = spans.groupBy("doc_id", "copy").agg(F.sort_array(F.collect_set("s")).alias("s"))  # a document's words at most

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, copy, s in zip(*(batch[c].to_pylist() for c in ("doc_id", "copy", "s")), strict=True):
                a = b = None
                firsts: list[int | None] = []
                for x in [*s, None]:
                    if x is None or b is None or x["a"] > b:
                        if b is not None:
                            out.append((doc, copy, a, b, None if None in firsts else min(firsts)))
                        if x is None:
                            break
                        a, b, firsts = x["a"], x["b"], []
                    b = max(b, x["b"])
                    firsts.append(x["f"])
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(list(v), k) for v, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "copy", "start", "end", "first_doc_id"])

    return by_doc.mapInArrow(merged, "doc_id long, copy long, start int, end int, first_doc_id long")


def _with_first(settled: DataFrame, late: DataFrame, key: list[str], first: Column) -> DataFrame:
    """``settled`` with the first document of its key over all tasks, where ``late`` knows an earlier one."""
    least = F.min(F.struct(first.isNotNull().alias("known"), first.alias("doc"))).alias("least")
    earlier = late.groupBy(*key).agg(least).select(*key, F.lit(True).alias("earlier"), F.col("least.doc").alias("doc"))
    joined = settled.join(materialize(earlier, "earlier"), key, "left")
    return joined.withColumn("first_doc", F.when(F.col("earlier"), F.col("doc")).otherwise(F.col("first_doc")))


def _settled(
    head: np.ndarray, stretch: np.ndarray, batch: pa.RecordBatch, at: np.ndarray, place: np.ndarray, passage: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort a batch's suffixes and compare neighbours: (order, first of the equal ones, True if that settles the row)."""
    ids = batch["doc_id"]
    null = ids.is_null().to_numpy(zero_copy_only=False)[at]
    doc = pc.fill_null(ids, 0).to_numpy()[at]
    copy = batch["copy"].to_numpy()[at]
    order = np.lexsort((place, copy, doc, ~null, stretch, head))
    h, s = head[order], stretch[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (s[1:] != s[:-1])])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    own = (doc[order] == doc[first]) & (null[order] == null[first]) & (copy[order] == copy[first])
    return order, first, ~new & ~(own & (place[order] - place[first] < passage))


def without_repeats(docs: DataFrame, passage: int = PASSAGE, gram: int = GRAM) -> DataFrame:
    """docs with repeated passages cut out of ``text``; the first occurrence of each stays, and so do all rows.

    Other columns stay as they are, but an n_chars column is set anew where the text was cut. White space around a cut
    stays. Rows with equal doc_id and text are cut alike.
    """
    found = repeated_passages(docs, passage, gram, with_first=False)
    found = found.groupBy(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy")).agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans")
    )
    found = materialize(found, "spans")

    @F.pandas_udf("string")
    def cut(text, spans):  # noqa: ANN001, ANN202
        import pandas as pd

        out = []
        for t, s in zip(text, spans):
            if s is None or t is None:
                out.append(t)
                continue
            raw = t.encode("utf-8", "surrogatepass")
            words = [m.span() for m in _WORD.finditer(raw)]
            kept, last = [], 0
            for x in s:
                kept.append(raw[last : words[x["start"]][0]])
                last = words[x["end"] - 1][1]
            out.append(b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass"))
        return pd.Series(out, dtype=object)

    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("hash"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_copy")), "left")
    whole = F.col("_spans").isNull()
    field = lambda c: F.col("row").getField(c)
    joined = joined.withColumn("new", F.when(whole, field("text")).otherwise(cut(field("text"), F.col("_spans"))))
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("new").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(whole, field(c)).otherwise(F.length("new").cast(docs.schema[c].dataType)).alias(c))
        else:
            columns.append(field(c).alias(c))
    return joined.select(*columns)
