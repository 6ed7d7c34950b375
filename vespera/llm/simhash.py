"""SimHash near-duplicates with the generalised pigeonhole principle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, smaller_batches
from .components import components

BITS = 64
#: Fingerprints of a group up to which they are compared pair by pair, and up to which one task takes the group.
PAIRWISE, ONE_TASK = 512, 50_000


def fingerprint(text: str | None, words_per_shingle: int = 3) -> int:
    """Bit set where over half the shingle hashes have it; words are split at ASCII white space, A-Z lower-cased."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), words_per_shingle
    if len(words) <= k:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1]).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], 42) for s, e in zip(starts, ends[k - 1 :].tolist())]
    raw = np.array(hashes, "<u8").view("u1").reshape(-1, 8)
    ones = np.zeros(BITS, "i8")
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype="i8")
    return int(np.packbits(ones * 2 > len(raw), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """docs(doc_id, text) to (doc_id, text_hash, fp long): the 64 bits as a signed number. A null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            fp = [fingerprint(t, words_per_shingle) for t in batch["text"].to_pylist()]
            signed = pa.array(np.array(fp, "<u8").view("<i8"))
            columns = [batch["doc_id"], batch["text_hash"], signed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "fp"])

    text = F.col("text").cast("string")
    columns = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _text_hash().alias("text_hash"))
    return columns.mapInArrow(run, "doc_id long, text_hash long, fp long")


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def correlated_partitions(fps: DataFrame, parts: int) -> list[list[int]]:
    """Bits dealt to ``parts`` partitions of about equal size, bits that go together in the same one.

    Correlations are counted over all fingerprints: each task returns 64 x 64 sums, which are added up by Spark.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = _unpacked(batch["fp"].to_numpy()).astype("f4")
            both += bits.T @ bits
            n += len(bits)
        if n:
            cells = pd.DataFrame({"cell": np.arange(BITS * BITS), "n": both.ravel()})
            yield pd.concat([cells, pd.DataFrame({"cell": [-1], "n": [float(n)]})])

    cells = fps.select("fp").mapInPandas(count, "cell int, n double").groupBy("cell").agg(F.sum("n").alias("n"))
    sums = {r.cell: r.n for r in cells.collect()}  # 4097 rows
    n = sums.get(-1, 0.0)
    if not n:
        return [list(range(i, BITS, parts)) for i in range(parts)]
    joint = np.array([sums.get(c, 0.0) for c in range(BITS * BITS)]).reshape(BITS, BITS) / n
    p = np.diag(joint)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    alike = np.abs((joint - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(BITS)), []
    for i in range(parts):
        room = BITS // parts + (i < BITS % parts)
        # Start from the pair that goes together most, then add what goes best with the bits taken.
        first = max(free, key=lambda b: (sum(alike[b, c] for c in free if c != b), -b))
        taken = [first]
        free.discard(first)
        while len(taken) < room:
            best = max(free, key=lambda b: (alike[b, taken].sum(), -b))
            taken.append(best)
            free.discard(best)
        out.append(sorted(taken))
    return out


def _unpacked(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(fp.astype("<i8").view("u1").reshape(-1, 8), axis=1, bitorder="little")


def _values(bits: np.ndarray, where: list[int]) -> np.ndarray:
    return bits[:, where].astype("i8") @ (1 << np.arange(len(where), dtype="i8"))


class Thresholds:
    """Which radius each partition of a fingerprint is searched with.

    The radii of the partitions, -1 for none, add up to ``most - parts + 1``: a pair within ``most`` bits then lies
    within the radius in some partition. Of all such choices, dynamic programming over the partitions takes the one
    with the least estimated work: probes, and candidates in the values probed. Candidates are estimated from counts of
    all fingerprints by the two halves of each partition.
    """

    PROBE = 2.0  # work of one probe, in candidates

    def __init__(self, partitions: list[list[int]], most: int, counts: dict[tuple[int, int], np.ndarray], total: int):
        self.partitions, self.most, self.total = partitions, most, total
        self.near = {}
        for (part, half), n in counts.items():
            by_distance = [n / max(total, 1)]
            bits = (len(n) - 1).bit_length()
            at = np.arange(len(n))
            # Exactly at distance d: each such value is met from d single flips of values at distance d - 1.
            ring = [by_distance[0]]
            for d in range(1, most + 1):
                flips = sum(ring[d - 1][at ^ (1 << b)] for b in range(bits))
                back = ring[d - 2] * (bits - d + 2) if d > 1 else 0
                ring.append((flips - back) / d)
            self.near[part, half] = ring

    def choose(self, bits: np.ndarray) -> np.ndarray:
        """Radii (fingerprints x partitions)."""
        n, m, most = len(bits), len(self.partitions), self.most
        goal = most - m + 1
        low, high = -m, most
        best = {0: np.zeros(n)}
        steps: list[dict[int, tuple[np.ndarray, np.ndarray]]] = []
        for i, where in enumerate(self.partitions):
            half = len(where) // 2
            a, b = _values(bits, where[:half]), _values(bits, where[half:])
            cost = {-1: np.zeros(n)}
            expected, probes = np.zeros(n), 0.0
            for r in range(most + 1):
                for e in range(r + 1):
                    expected = expected + self.total * self.near[i, 0][e][a] * self.near[i, 1][r - e][b]
                probes += float(_choose(len(where), r))
                cost[r] = expected + self.PROBE * probes
            after: dict[int, np.ndarray] = {}
            step: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for total, so_far in best.items():
                for r, c in cost.items():
                    t = total + r
                    if not low <= t <= high:
                        continue
                    value = so_far + c
                    if t not in after:
                        after[t] = value
                        step[t] = (np.full(n, r), np.full(n, total))
                    else:
                        better = value < after[t]
                        after[t] = np.where(better, value, after[t])
                        step[t] = (np.where(better, r, step[t][0]), np.where(better, total, step[t][1]))
            best = after
            steps.append(step)
        radii, at = np.empty((n, m), "i8"), np.full(n, goal)
        for i in reversed(range(m)):
            came = np.empty(n, "i8")
            for t, (r, before) in steps[i].items():
                mine = at == t
                radii[mine, i], came[mine] = r[mine], before[mine]
            at = came
        return radii


def _choose(n: int, k: int) -> int:
    import math

    return math.comb(n, k)


def _flips(bits: int, radius: int) -> np.ndarray:
    from itertools import combinations

    return np.array([sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(bits), r)], "i8")


def _linked_in_group(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of positions within ``most`` <= 2 bits that connect all that such pairs connect.

    Larger groups go by shared neighbours: two values within two bits have a common value within one bit of both.
    """
    if len(fp) <= PAIRWISE or most != 2:
        a, b = [], []
        for at in range(0, len(fp), 256):
            x = fp[at : at + 256, None] ^ fp[None, :]
            i, j = np.nonzero(np.bitwise_count(x.view("u8")) <= most)
            keep = i + at < j
            a.append(i[keep] + at)
            b.append(j[keep])
        return np.concatenate(a), np.concatenate(b)
    single = np.concatenate([[0], np.left_shift(np.uint64(1), np.arange(BITS, dtype="u8")).view("i8")])
    keys = (fp[:, None] ^ single[None, :]).ravel()
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    return order[:-1][same] // len(single), order[1:][same] // len(single)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each position's smallest connected position, as links; positions alone give none."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        new = new[new]
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(n))
    return root[rest], rest


def links(fps: DataFrame, most: int = 2, parts: int = 3) -> DataFrame:
    """Links (a, b) between distinct fingerprints fps(fp) that connect exactly those within ``most`` bits, transitively.

    Every fingerprint lies in the group of its value in each partition, and also in the groups of the values that its
    own radii probe. All fingerprints that meet in a group are verified against each other, which can only add true
    links. A group up to ``ONE_TASK`` is worked in one task, which returns its spanning links. Larger groups (many
    different fingerprints that agree in a whole partition) never meet in one task: there, fingerprints within two bits
    are brought together by the values within one bit of both, and each such value links its smallest to the others.
    ``most`` above 2 is refused, since such values would not meet there.
    """
    if not 0 <= most <= 2:
        raise ValueError("fingerprints link at 0, 1 or 2 differing bits")
    partitions = correlated_partitions(fps, parts)
    names = [(i, h) for i in range(parts) for h in (0, 1)]

    def halves(where: list[int]) -> tuple[list[int], list[int]]:
        return where[: len(where) // 2], where[len(where) // 2 :]

    def histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {(i, h): np.zeros(1 << len(halves(partitions[i])[h]), "i8") for i, h in names}
        for batch in batches:
            bits = _unpacked(batch["fp"].to_numpy())
            for i, h in names:
                n = sums[i, h]
                n += np.bincount(_values(bits, halves(partitions[i])[h]), minlength=len(n))
        for (i, h), n in sums.items():
            at = np.flatnonzero(n)
            yield pd.DataFrame({"part": i, "half": h, "value": at, "n": n[at]})

    counted = fps.select("fp").mapInPandas(histogram, "part int, half int, value long, n long")
    counts = {(i, h): np.zeros(1 << len(halves(partitions[i])[h])) for i, h in names}
    total = 0
    for r in counted.groupBy("part", "half", "value").agg(F.sum("n").alias("n")).collect():  # 2^11 values in each half
        counts[r.part, r.half][r.value] = r.n
        total += r.n if (r.part, r.half) == (0, 0) else 0
    plan = Thresholds(partitions, most, counts, total)
    flips = {(len(w), r): _flips(len(w), r) for w in partitions for r in range(most + 1)}

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 4096):
                fp = whole["fp"].to_numpy()[at : at + 4096]
                bits = _unpacked(fp)
                radii = plan.choose(bits)
                for i, where in enumerate(partitions):
                    value = _values(bits, where)
                    for r in range(-1, most + 1):
                        mine = radii[:, i] == r
                        if mine.any():
                            mask = flips[len(where), max(r, 0)]
                            key = (value[mine][:, None] ^ mask[None, :]).ravel()
                            key = key * parts + i
                            yield pd.DataFrame({"key": key, "fp": np.repeat(fp[mine], len(mask))})

    probes = materialize(fps.select("fp").mapInPandas(probe, "key long, fp long"), "probes")
    sizes = materialize(probes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "probe-groups")
    hot = sizes.where(F.col("n") > ONE_TASK)
    meeting = probes.join(sizes.where(F.col("n") <= ONE_TASK), "key")
    groups = meeting.groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")  # ONE_TASK at most

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            offsets = batch["fps"].offsets.to_numpy()
            values = batch["fps"].values.to_numpy()
            sizes = np.diff(offsets)
            out_a, out_b = [], []
            # Groups of one size are compared as one array.
            for size in np.unique(sizes[sizes <= 64]):
                rows = np.flatnonzero(sizes == size)
                fp = values[offsets[rows][:, None] + np.arange(size)]
                for d in range(1, size):
                    x = fp[:, d:] ^ fp[:, :-d]
                    near = np.bitwise_count(x.view("u8")) <= most
                    out_a.append(fp[:, :-d][near])
                    out_b.append(fp[:, d:][near])
            for row in np.flatnonzero(sizes > 64):
                fp = np.unique(values[offsets[row] : offsets[row + 1]])
                i, j = _linked_in_group(fp, most)
                i, j = _forest(i, j, len(fp))
                out_a.append(fp[i])
                out_b.append(fp[j])
            if out_a:
                a, b = np.concatenate(out_a), np.concatenate(out_b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = groups.mapInArrow(verify, "a long, b long")
    if most and hot.limit(1).count():
        crowded = probes.join(hot.select("key"), "key", "left_semi").select("fp").distinct()
        ball = F.array(F.lit(0).cast("long"), *[F.shiftleft(F.lit(1).cast("long"), b) for b in range(BITS)])
        near = crowded.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
        if most == 1:  # one of the two is the centre
            least = crowded.select(F.col("fp").alias("centre"), F.col("fp").alias("a"))
        else:
            least = near.groupBy("centre").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
        found = found.union(near.join(least, "centre").where("fp <> a").select("a", F.col("fp").alias("b")))
    return found.distinct()


def near_duplicates(docs: DataFrame, most: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp, text_hash) for every row of docs(doc_id, text); other columns are not read.

    Fingerprints link at ``most`` (up to 2) or fewer differing bits; component_id is the smallest doc_id of all that
    links reach. A null or blank text has fingerprint zero. Equal fingerprints are one node, so copies of any number
    cost nothing. A null doc_id is never a component_id unless all ids of its component are null.
    """
    prints = materialize(fingerprints(docs, words_per_shingle), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    comps = components(links(nodes, most))
    member = nodes.join(comps, nodes["fp"] == comps["id"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    member = materialize(member, "members")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp", "text_hash"
    )


def keep_one(docs: DataFrame, most: int = 2, words_per_shingle: int = 3) -> DataFrame:
    """docs without all but one document of each near-duplicate group: the one with the smallest doc_id.

    Columns stay as they are, whatever their names. Rows that repeat an id and a text leave one row; an id that repeats
    with other texts counts as different documents. A null doc_id stays only if its group has no other id.
    """
    groups = near_duplicates(docs, most, words_per_shingle)
    chosen = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = chosen.groupBy(F.col("doc_id").alias("kept_id"), "component_id", "fp").agg(
        F.min("text_hash").alias("kept_hash"), F.count("*").alias("n")
    )
    kept = materialize(kept, "kept")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), _text_hash().alias("hash"))
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    once = rows.join(kept.where("n = 1"), same, "left_semi")
    repeated = kept.where("n > 1")
    if repeated.limit(1).count():
        again = rows.join(repeated, same, "left_semi")
        once = once.union(again.dropDuplicates(["id", "hash"]))
    return once.select("row.*")
