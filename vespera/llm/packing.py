"""Mixture-controlled packing: deficit round-robin over source queues.

Every window takes from each source its share of the tokens. A source's quantum per window is its share of the window
length; what a window could not serve as whole tokens stays as a deficit that later windows serve. What a source has
been served after any number of windows follows from its quanta alone, so each task works out the deficits that the
windows before its own have left, and no task waits for another.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, scratch_path, smaller_batches
from .tokens import CUT_BYTES, encoder

#: Sources with a queue of their own beside those that the caller's target names; the smaller ones share the last queue,
#: in the order of their documents. A window could not hold a share of more of them anyway.
QUEUES = 1000
#: Windows whose edges are worked out together, and bytes of edges that a worker keeps.
EDGE_WINDOWS, EDGE_BYTES = 256, 64 << 20

_TOKENS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("queue", pa.string()),
        ("part", pa.int64()),
        ("local_start", pa.int64()),
        ("n", pa.int64()),
        ("ids", pa.binary()),
    ]
)
_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)


class RoundRobin:
    """Which place each token of each queue gets.

    Token ``i`` of a queue with weight ``w`` is due at time ``(i + 1) / w``; tokens are served in the order of these
    times, equal times in the order of the queues. Between two windows every queue has then been served its quanta
    rounded to whole tokens. A queue that has run empty leaves its share to the others in their proportions.
    """

    def __init__(self, sizes: Mapping[str, int], target: Mapping[str, float] | None, length: int):
        self.names = sorted(k for k, n in sizes.items() if n)
        self.sizes = np.array([sizes[k] for k in self.names], "i8")
        asked = np.array([(target or sizes).get(k, 0) for k in self.names], "f8")
        # A queue that the target leaves out, or gives nothing, still loses no token: it comes after all others.
        least = asked[asked > 0].min() if (asked > 0).any() else 1.0
        self.weights = np.where(asked > 0, asked, least * 1e-6)
        self.weights = self.weights / self.weights.sum()
        self.length = length
        self.total = int(self.sizes.sum())

    def served(self, time: np.ndarray, queue: int | None = None) -> np.ndarray:
        """Tokens due up to each time, of one queue or of all."""
        some = range(len(self.names)) if queue is None else [queue]
        out = np.zeros(len(time), "i8")
        for q in some:
            out += np.minimum(np.floor(time * self.weights[q]).astype("i8"), self.sizes[q])
        return out

    def closing(self, windows: np.ndarray) -> np.ndarray:
        """For each window number, the tokens of every queue (rows) that it and the earlier ones have taken."""
        goal = np.minimum((windows + 1) * self.length, self.total)
        low, high = np.zeros(len(windows)), np.full(len(windows), float((self.sizes / self.weights).max()) + 1)
        for _ in range(80):
            mid = (low + high) / 2
            enough = self.served(mid) >= goal
            low, high = np.where(enough, low, mid), np.where(enough, mid, high)
        before = np.stack([self.served(low, q) for q in range(len(self.names))])
        after = np.stack([self.served(high, q) for q in range(len(self.names))])
        missing = goal - before.sum(axis=0)
        extra = after - before
        ahead = np.cumsum(extra, axis=0) - extra
        return before + np.clip(missing - ahead, 0, extra)

    def about(self, tokens: np.ndarray, queues: np.ndarray) -> np.ndarray:
        """For each (queue, token), a window near its own: tokens due at the same time may lie in several windows."""
        rank = self.served((tokens + 1) / self.weights[queues])
        return np.clip(rank - 1, 0, max(0, self.total - 1)) // self.length


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, queue, part, local_start, n, ids): each document's ids, counted along its queue within its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        end = int(end_id).to_bytes(4, "little")
        small = enc.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 and end_id < 65536
        part = TaskContext.get().partitionId()
        seen: dict[str | None, int] = {}
        for batch in smaller_batches(batches, CUT_BYTES):
            ids = [x + end for x in enc.encode(batch["text"])]
            starts = []
            for queue, x in zip(batch["source"].to_pylist(), ids, strict=True):
                starts.append(seen.get(queue, 0))
                seen[queue] = starts[-1] + len(x) // 4
            sizes = [len(x) // 4 for x in ids]
            stored = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids] if small else ids
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"],
                    batch["source"],
                    pa.array([part] * len(ids), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(stored, pa.binary()),
                ],
                schema=_TOKENS,
            )

    columns = docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string").alias("text")
    )
    return columns.mapInArrow(run, "doc_id long, queue string, part long, local_start long, n long, ids binary")


def pack(
    docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, target: Mapping[str, float] | None = None
) -> DataFrame:
    """Pieces of documents placed in sequences of ``length`` tokens, each window in the target proportions by source.

    docs(doc_id, text, source); other columns are not read. ``target`` gives the wanted share per source; the default
    is each source's share of all tokens, so that all queues end together. A null text counts as empty, so the document
    is its end id alone; a null source is a queue of its own; a null or repeated doc_id is packed like any other, once
    per row. An empty table gives an empty result. Each id lies in exactly one piece. The tokens left at the end fill
    sequences whose lengths are powers of two, which need no padding.

    Two passes: ids are written once where the documents lie; sums of tokens by (task, source) then tell every
    document its place in its queue. Texts and ids are not shuffled.
    """
    spark = docs.sparkSession

    at = scratch_path(spark, "packed-ids")
    written = tokenized(docs, path, end_id)
    written.write.option("compression", "zstd").parquet(at)
    ids = spark.read.schema(written.schema).parquet(at)
    parts = materialize(ids.groupBy("queue", "part").agg(F.sum("n").alias("n")), "queue-parts")

    sums = parts.groupBy("queue").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "queue")
    sizes = {r.queue: r.n for r in sums.limit(QUEUES).collect()}
    if target:
        sizes |= {r.queue: r.n for r in sums.where(F.col("queue").isin(list(target))).collect()}
    total = parts.agg(F.sum("n")).first()[0] or 0
    rest = total - sum(sizes.values())
    # Queue names become "s" + source; a null source is "n", all sources beyond the largest ones are "r".
    named = {("n" if k is None else "s" + k): n for k, n in sizes.items()} | ({"r": rest} if rest else {})
    wanted = {"s" + k: v for k, v in target.items()} if target else None
    plan = RoundRobin(named, wanted, length)

    own = F.when(F.col("queue").isNull(), "n").otherwise(F.concat(F.lit("s"), "queue"))
    if rest:
        own = F.when(own.isin(list(named)), own).otherwise(F.lit("r"))
    by_queue = parts.withColumn("q", own)
    # Tasks are few beside documents: one row per task and source. A source's rows are summed in its own window.

    order = Window.partitionBy("q").orderBy("part", "queue").rowsBetween(Window.unboundedPreceding, -1)
    before = by_queue.select("queue", "part", "q", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    same = (ids["queue"].eqNullSafe(before["queue"])) & (ids["part"] == before["part"])
    placed = ids.join(before, same).select(
        "doc_id", ids["queue"].alias("source"), "q", "n", (F.col("before") + F.col("local_start")).alias("first"), "ids"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        position = {name: i for i, name in enumerate(plan.names)}
        full, windows = plan.total // plan.length, -(-plan.total // plan.length)
        tail, tail_ends = plan.total % plan.length, []
        for bit in reversed(range(plan.length.bit_length())):
            if tail >> bit & 1:
                tail_ends.append((tail_ends[-1] if tail_ends else 0) + (1 << bit))
        cache: dict[int, np.ndarray] = {}

        def edges(first: int, last: int) -> np.ndarray:
            """closing() of windows first - 1 to last, as one array per call; column 0 is what came before."""
            block = EDGE_WINDOWS
            parts = []
            for b in range(first // block, last // block + 1):
                if b not in cache:
                    if len(cache) * len(plan.names) * 8 * block > EDGE_BYTES:
                        cache.clear()
                    w = np.arange(b * block - 1, (b + 1) * block)
                    got = plan.closing(np.maximum(w, 0))
                    if b == 0:
                        got[:, 0] = 0
                    cache[b] = got
                parts.append(cache[b][:, 1:] if parts else cache[b])
            whole = np.concatenate(parts, axis=1)
            start = first - (first // block) * block
            return whole[:, start : start + last - first + 2]

        for batch in smaller_batches(batches):
            out: dict[str, list] = {f.name: [] for f in _piece_schema()}
            docs_, sources = batch["doc_id"].to_pylist(), batch["source"].to_pylist()
            queues, sizes_, firsts = batch["q"].to_pylist(), batch["n"].to_pylist(), batch["first"].to_pylist()
            own_queues = np.array([position[q] for q in queues], "i8")
            starts = np.array(firsts, "i8")
            low = plan.about(starts, own_queues)
            high = plan.about(starts + np.array(sizes_, "i8") - 1, own_queues)
            for i, raw in enumerate(batch["ids"].to_pylist()):
                n, first, q, w0, w1 = sizes_[i], firsts[i], int(own_queues[i]), int(low[i]), int(high[i])
                wide = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                grid = edges(w0, w1)
                wider = 1
                while grid[q][0] > first or grid[q][-1] < first + n:
                    w0 = max(0, w0 - wider) if grid[q][0] > first else w0
                    w1 = min(windows - 1, w1 + wider) if grid[q][-1] < first + n else w1
                    grid, wider = edges(w0, w1), 2 * wider
                mine = grid[q]
                cut_off = 0
                ahead = (grid[:q, 1:] - grid[:q, :-1]).sum(axis=0)
                for k, w in enumerate(range(w0, w1 + 1)):
                    a, b = max(first, int(mine[k])), min(first + n, int(mine[k + 1]))
                    if a >= b:
                        continue
                    offset = int(ahead[k]) + a - int(mine[k])
                    spans = [(a, b, w, offset)]
                    if w >= full:  # the tail: cut at the ends of its power-of-two sequences
                        spans, s0 = [], 0
                        for j, s1 in enumerate(tail_ends):
                            c, d = max(offset, s0), min(offset + b - a, s1)
                            if c < d:
                                spans.append((a + c - offset, a + d - offset, full + j, c - s0))
                            s0 = s1
                    for c, d, sequence, place in spans:
                        out["doc_id"].append(docs_[i])
                        out["start"].append(c - first)
                        out["length"].append(d - c)
                        out["ids_crc32"].append(zlib.crc32(wide[c - first : d - first].tobytes()))
                        out["doc_tokens"].append(n)
                        out["sequence_id"].append(sequence)
                        out["offset"].append(place)
                        out["source"].append(sources[i])
                        cut_off += d - c
                if cut_off != n:
                    raise AssertionError(f"document {docs_[i]} has {n} tokens, {cut_off} of them placed")
            yield pa.RecordBatch.from_pydict(out, schema=_piece_schema())

    return placed.mapInArrow(cut, _PIECES)


def _piece_schema() -> pa.Schema:
    longs = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.schema([(c, pa.int64()) for c in longs] + [("source", pa.string())])
