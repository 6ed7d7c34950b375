"""Token ids in shards with a minimal perfect hash index: keyed access without scanning.

A shard is one row of a Parquet table. ``payload`` holds the raw ids of its documents one after the other, two bytes
each where the vocabulary allows it, ``ids_before`` counts the ids of earlier shards of the same task. The index maps a document's key to one of ``n_docs`` slots without storing keys:
``levels`` are bit arrays, level after level; a key's slot is the number of set bits before its own. Each slot stores
the key's fingerprint, so that keys which are not there are refused, and the offset of the document in the payload.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, smaller_batches
from .tokens import CUT_BYTES, encoder

#: A shard is closed by the document that brings it to this many ids; a longer document has a shard of its own.
SHARD_IDS = 1_000_000
#: Bits per key in each level of the hash, and levels before the few keys left are listed.
GAMMA, LEVELS = 2.0, 24

_SHARD = (
    "part int, shard int, n_docs int, n_ids long, ids_before long, width int, first_key long, last_key long, levels binary, "
    "fingerprints binary, offsets binary, keys binary, payload binary"
)
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("ids_before", pa.int64())]
    + [("width", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64())]
    + [(c, pa.binary()) for c in ("levels", "fingerprints", "offsets", "keys", "payload")]
)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of good spread, on whole arrays."""
    x = x.astype("u8") + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Distinct 64-bit keys to the numbers below their count, each used once."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype("i8")
        self.rank = np.concatenate([[0], np.cumsum(bits, dtype="i8")])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Each level keeps the keys that hash alone; the others go on to the next level."""
        sizes, bits, left, level = [], [], keys.astype("u8"), 0
        while len(left):
            size = max(1, int(GAMMA * len(left)))
            at = (_mix(left, level) % np.uint64(size)).astype("i8")
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(alone)
            left = left[~alone[at]]
            level += 1
            if level > 64 * LEVELS:
                raise ValueError("keys of a shard must be distinct")
        return cls(sizes, np.concatenate(bits) if bits else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 where no level has it."""
        keys = keys.astype("u8")
        out, open_ = np.full(len(keys), -1, "i8"), np.ones(len(keys), bool)
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_mix(keys, level) % np.uint64(size)).astype("i8")
            hit = open_ & self.bits[at]
            out[hit] = self.rank[at[hit]]
            open_ &= ~hit
            if not open_.any():
                break
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], "<i8").tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def load(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw[:8], "<i8")[0])
        sizes = np.frombuffer(raw[8 : 8 + 8 * n], "<i8").tolist()
        return cls(sizes, np.unpackbits(np.frombuffer(raw[8 + 8 * n :], "u1"), count=sum(sizes)).astype(bool))


def _key(ids: np.ndarray, known: np.ndarray, copy: np.ndarray) -> np.ndarray:
    """Keys of documents: doc_id, whether it is not null, and the number of earlier rows with the same id."""
    return _mix(_mix(ids, 101) ^ _mix(known.astype("u8"), 103) ^ _mix(copy, 107), 109)


class Shard:
    """Reading one shard: ids of a key in constant time."""

    def __init__(self, row: dict):
        self.hash = PerfectHash.load(row["levels"])
        self.fingerprints = np.frombuffer(row["fingerprints"], "<u4")
        self.offsets = np.frombuffer(row["offsets"], "<i8").reshape(-1, 2)
        self.payload, self.width = row["payload"], row["width"]

    def places(self, keys: np.ndarray) -> np.ndarray:
        """(start, length) in ids for each key; (-1, 0) for keys that are not in the shard."""
        slot = self.hash.slots(keys)
        found = slot >= 0
        found[found] = self.fingerprints[slot[found]] == (_mix(keys[found], 211) >> np.uint64(32)).astype("u4")
        out = np.tile(np.array([-1, 0], "i8"), (len(keys), 1))
        out[found] = self.offsets[slot[found]]
        return out

    def ids(self, start: int, length: int) -> np.ndarray:
        raw = self.payload[start * self.width : (start + length) * self.width]
        return np.frombuffer(raw, f"<u{self.width}")


def write_keyed(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> None:
    """Write docs(doc_id, text) as shards in ascending order of doc_id; other columns are not read.

    A null text is empty and has the end id alone. Null ids come first. Rows that repeat an id stay, in the order of
    their texts, and are found by their number among the copies. An empty table writes no shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        wide = max(enc.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1) > 65536
        width, part, shard = (4 if wide else 2), TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        copies: list[int] = []
        pieces: list[bytes] = []
        size, written, last, copy = 0, 0, (), 0

        def close() -> pa.RecordBatch:
            nonlocal ids, copies, pieces, size, written, shard
            plain = np.array([i or 0 for i in ids], "i8")
            known = np.array([i is not None for i in ids])
            keys = _key(plain, known, np.array(copies, "i8"))
            index = PerfectHash.build(keys)
            slot = index.slots(keys)
            lengths = np.array([len(p) // 4 for p in pieces], "i8")
            offsets = np.empty((len(ids), 2), "<i8")
            offsets[slot, 0], offsets[slot, 1] = np.cumsum(lengths) - lengths, lengths
            prints = np.empty(len(ids), "<u4")
            prints[slot] = (_mix(keys, 211) >> np.uint64(32)).astype("u4")
            payload = np.frombuffer(b"".join(pieces), "<u4").astype(f"<u{width}").tobytes()
            listed = np.stack([plain, known.astype("i8"), np.array(copies, "i8")], axis=1).astype("<i8").tobytes()
            row = [part, shard, len(ids), size, written, width, ids[0], ids[-1], index.dump(), prints.tobytes()]
            row += [offsets.tobytes(), listed, payload]
            shard += 1
            written += size
            ids, copies, pieces, size = [], [], [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([v], f.type) for v, f in zip(row, _SCHEMA, strict=True)], schema=_SCHEMA
            )

        for batch in smaller_batches(batches, CUT_BYTES):
            for doc, x in zip(batch["doc_id"].to_pylist(), enc.encode(batch["text"]), strict=True):
                copy = copy + 1 if last == (doc,) else 0
                last = (doc,)
                ids.append(doc)
                copies.append(copy)
                pieces.append(x + end)
                size += len(x) // 4 + 1
                if size >= shard_ids:
                    yield close()
        if ids:
            yield close()

    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = columns.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, _SHARD).write.option("compression", "zstd").parquet(path)


#: Tasks whose sums (12 bytes each) are sent to all readers: 12 MB at most. More are joined by a shuffle.
SENT_PARTS = 1_000_000


def _with_starts(shards: DataFrame) -> DataFrame:
    """Shards with ``before``: ids of all documents before each. Only the sums of the writing tasks are ordered as a whole.

    The sums go to where the shards lie, so that payloads are not shuffled.
    """
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    base = materialize(parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "shard-parts")
    small = base.limit(SENT_PARTS + 1).count() <= SENT_PARTS
    joined = shards.join(F.broadcast(base) if small else base, "part")
    return joined.withColumn("before", F.col("base") + F.col("ids_before"))


def read_keyed(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each fetched from its shard by its key.

    A shard's list of keys says what to ask for; place and ids come from the hash index and the payload.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            for row in batch.to_pylist():
                shard = Shard(row)
                listed = np.frombuffer(row["keys"], "<i8").reshape(-1, 3)
                places = shard.places(_key(listed[:, 0], listed[:, 1], listed[:, 2]))
                if (places[:, 0] < 0).any():
                    raise ValueError("a listed key is missing from its shard")
                crc = [zlib.crc32(shard.ids(int(s), int(n)).astype("<u4").tobytes()) for s, n in places]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(i) if k else None for i, k, _ in listed], pa.int64()),
                        pa.array(places[:, 0] + row["before"]),
                        pa.array(places[:, 1]),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    shards = _with_starts(spark.read.schema(_SHARD).parquet(path))
    return shards.select("levels", "fingerprints", "offsets", "keys", "payload", "width", "before").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


#: Shards whose directory (16 bytes each) is sent to the tasks that look keys up: 64 MB at most.
DIRECTORY_SHARDS = 4_000_000


def lookup(wanted: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for the ids in wanted(doc_id) that the shards hold; the first copy where an id repeats.

    Shards lie in the order of their keys, so a directory of first keys names the shard of each wanted id; only shards
    that are asked for are read. Raises for more shards than ``DIRECTORY_SHARDS``: write larger shards then.
    """
    spark = wanted.sparkSession
    shards = spark.read.schema(_SHARD).parquet(path)
    listing = shards.where("first_key is not null or last_key is not null").select(
        F.coalesce("first_key", F.lit(-(2**63))).alias("k"), "part", "shard"
    )
    rows = listing.limit(DIRECTORY_SHARDS + 1).collect()
    if len(rows) > DIRECTORY_SHARDS:
        raise ValueError("more shards than the directory may hold")
    rows.sort(key=lambda r: (r.part, r.shard))
    firsts = [r.k for r in rows]
    names = [(r.part, r.shard) for r in rows]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [i for i in batch["doc_id"].to_pylist() if i is not None]
            # The first copy of a repeated id is in the first shard that can hold it.
            spots = [max(0, bisect.bisect_left(firsts, i) - 1) for i in ids]
            both = [(i, names[s]) for i, s in zip(ids, spots, strict=True) if names]
            both += [
                (i, names[s + 1])
                for i, s in zip(ids, spots, strict=True)
                if s + 1 < len(names) and firsts[s + 1] == i
            ]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": [i for i, _ in both], "part": [n[0] for _, n in both], "shard": [n[1] for _, n in both]},
                schema=pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("shard", pa.int32())]),
            )

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            for row in batch.to_pylist():
                shard, asked = Shard(row), np.array(row["asked"], "i8")
                places = shard.places(_key(asked, np.ones(len(asked)), np.zeros(len(asked), "i8")))
                hits = [(int(i), shard.ids(int(s), int(n)).tolist()) for i, (s, n) in zip(asked, places) if s >= 0]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [i for i, _ in hits], "ids": [x for _, x in hits]},
                    schema=pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]),
                )

    routed = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    routed = routed.mapInArrow(route, "doc_id long, part int, shard int")
    asked = routed.groupBy("part", "shard").agg(F.collect_list("doc_id").alias("asked"))  # at most a shard's documents
    hit = shards.join(asked, ["part", "shard"])
    return hit.select("levels", "fingerprints", "offsets", "payload", "width", "asked").mapInArrow(
        fetch, "doc_id long, ids array<long>"
    )
