"""Token counts from flat token files: a scan for end-of-document ids, stitched across blocks by a prefix scan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import smaller_batches
from .tokens import CUT_BYTES, encoder

#: Ids in a block. A document may span any number of blocks.
BLOCK_IDS = 1 << 20
FILE = "file long, block long, width int, payload binary, doc_ids array<bigint>"


def write_flat(docs: DataFrame, path: str, tokenizer: str, separator: int, block_ids: int = BLOCK_IDS) -> None:
    """Write docs(doc_id, text) as flat files: ids of one document after the other, each followed by ``separator``.

    Texts that spell a special token are encoded as ordinary text, so the separator ends documents and nothing else.
    Files are cut in blocks of ``block_ids`` wherever that falls. ``doc_ids`` names the documents in their order,
    beside the payload and never read by the scan. A null text is an empty document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, special_as_text=True)
        wide = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), separator + 1) > 65536
        width, file, block = (4 if wide else 2), TaskContext.get().partitionId(), 0
        end = int(separator).to_bytes(4, "little")
        held, names = bytearray(), []

        def cut(raw: bytes) -> pa.RecordBatch:
            nonlocal block, names
            row = [[file], [block], [width], [raw], [names]]
            block, names = block + 1, []
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
            arrays = [pa.array(v, k) for v, k in zip(row, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, names=["file", "block", "width", "payload", "doc_ids"])

        for batch in smaller_batches(batches, CUT_BYTES):
            for doc, ids in zip(batch["doc_id"].to_pylist(), enc.encode(batch["text"]), strict=True):
                held += np.frombuffer(ids + end, "<u4").astype(f"<u{width}").tobytes()
                names.append(doc)
                while len(held) >= block_ids * width:
                    raw = bytes(held[: block_ids * width])
                    del held[: block_ids * width]
                    yield cut(raw)
        if held or names:
            yield cut(bytes(held))

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    columns.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(path)


def scan_separators(blocks: DataFrame, separator: int) -> DataFrame:
    """(file, ordinal, start, n_tokens) of every document in blocks(file, block, width, payload), separators excluded.

    Each block is searched on its own for separators, as one array. A block passes on three numbers: its length, its
    separators and the ids after its last one. A prefix scan of these over the blocks of a file gives each block the
    ordinal, the position and the open length that it starts with; that completes the document which crosses into it.
    Ids after the last separator of a file are a document without end and are counted too. Empty blocks and files are
    allowed; an empty table gives an empty result.
    """
    found = "file long, block long, n long, ends array<long>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            sizes, ends = [], []
            for raw, width in zip(batch["payload"].to_pylist(), batch["width"].to_pylist(), strict=True):
                ids = np.frombuffer(raw or b"", f"<u{width}")
                sizes.append(len(ids))
                ends.append(np.flatnonzero(ids == separator).astype("i8"))
            yield pa.RecordBatch.from_arrays(
                [batch["file"], batch["block"], pa.array(sizes, pa.int64()), pa.array(ends, pa.list_(pa.int64()))],
                names=["file", "block", "n", "ends"],
            )

    spots = blocks.select("file", "block", "width", "payload").mapInArrow(search, found)
    in_file = Window.partitionBy("file").orderBy("block")
    before = in_file.rowsBetween(Window.unboundedPreceding, -1)
    placed = spots.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)))
    last = F.when(F.size("ends") > 0, F.col("at") + F.element_at("ends", -1) + 1)
    placed = (
        placed.withColumn("done", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
        .withColumn("open_at", F.coalesce(F.max(last).over(before), F.lit(0)))
        .withColumn("is_last", F.lead("block").over(in_file).isNull())
    )
    # A file that ends without separator: its end counts as one.
    tail = F.when(F.size("ends") > 0, F.element_at("ends", -1) + 1).otherwise(F.col("open_at") - F.col("at"))
    closes = F.when(
        F.col("is_last") & (F.col("n") > tail), F.concat("ends", F.array(F.col("n")))
    ).otherwise(F.col("ends"))
    rows = placed.select("file", "at", "done", "open_at", closes.alias("ends")).select(
        "file", "at", "done", "open_at", "ends", F.posexplode("ends").alias("i", "end")
    )
    start = F.when(F.col("i") == 0, F.col("open_at")).otherwise(
        F.col("at") + F.get("ends", F.col("i") - 1) + 1
    )
    return rows.select(
        "file",
        (F.col("done") + F.col("i")).cast("long").alias("ordinal"),
        start.alias("start"),
        (F.col("at") + F.col("end") - start).alias("n_tokens"),
    )


def named(counts: DataFrame, blocks: DataFrame) -> DataFrame:
    """``counts`` with the doc_id that the writer noted for each ordinal."""
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    names = blocks.select("file", "block", "doc_ids").withColumn(
        "done", F.coalesce(F.sum(F.size("doc_ids")).over(before), F.lit(0))
    )
    names = names.select("file", "done", F.posexplode("doc_ids").alias("i", "doc_id")).select(
        "file", (F.col("done") + F.col("i")).cast("long").alias("ordinal"), "doc_id"
    )
    return counts.join(names, ["file", "ordinal"])
