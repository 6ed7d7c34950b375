"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, smaller_batches
from .components import components
from .vectors import matrix, usable

#: Bucket width, the chance of missing a pair that is just similar enough, and vectors of one side of a comparison.
WIDTH, MISS, BLOCK = 1.0, 1e-5, 1024


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that one quantised Gaussian projection puts two points at this distance in the same bucket."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(rows: int, cosine: float) -> tuple[int, int]:
    """Projections per table and number of tables.

    More rows get more projections, so that a bucket holds about as many unrelated vectors at any size; tables are then
    as many as it takes to miss a pair at the threshold with chance ``MISS`` at most.
    """
    unrelated = collision(1.2)
    each = max(4, math.ceil(math.log(max(rows, 64) / 64) / math.log(1 / unrelated)))
    near = collision(math.sqrt(max(2 - 2 * cosine, 1e-12))) ** each
    return each, max(1, math.ceil(math.log(MISS) / math.log(1 - near))) if near < 1 else 1


def _hashes(unit: np.ndarray, each: int, tables: int, seed: int = 7) -> np.ndarray:
    """32-bit bucket numbers (vectors x tables)."""
    rng = np.random.default_rng([seed, unit.shape[1], each])
    out = np.empty((len(unit), tables), "i4")
    for t in range(tables):
        a = rng.standard_normal((unit.shape[1], each))
        b = rng.uniform(0, WIDTH, each)
        cell = np.floor((unit @ a + b) / WIDTH).astype("i8").astype("u8")
        h = np.full(len(unit), t + 1, "u8")
        for k in range(each):
            h = (h ^ cell[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out[:, t] = (h >> np.uint64(32)).astype("u4").view("i4")
    return out


def near_duplicate_vectors(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of vectors(vec_id, embedding, label).

    Vectors of one label and one length link at this cosine or more; rows with a null label and unusable vectors (null,
    empty, zero, null or non-finite components) link with nothing. Equal vectors of a label are one node with a number
    of copies, however many they are. Buckets over ``BLOCK`` vectors are compared block against block in different
    tasks, so no bucket meets in one task, and what leaves a task is a count per vector and links that span what it
    found, never all pairs. A pair that several tables find is counted in the first of them. A null vec_id is a row
    like others and is a component_id only if all ids there are null; it is never kept.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").alias("l")
    )
    good = rows.where(F.col("l").isNotNull() & usable(F.col("v")))
    nodes = good.groupBy("l", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    each, tables = parameters(nodes.count(), cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            sizes = np.diff(batch["v"].offsets.to_numpy())
            unit = np.zeros((len(sizes), int(sizes.max(initial=1))))
            h = np.empty((len(sizes), tables), "i4")
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                x = matrix(batch["v"].take(pa.array(mine)), int(dim))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                unit[mine, :dim] = x
                h[mine] = _hashes(x, each, tables)
            flat = np.concatenate([unit[i, :s] for i, s in enumerate(sizes)]) if len(sizes) else np.zeros(0)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"))
            codes = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype="i4") * tables), pa.array(h.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch["node"], batch["g"], batch["copies"], pa.ListArray.from_arrays(offsets, pa.array(flat)), codes],
                names=["node", "g", "copies", "unit", "codes"],
            )

    label_key = F.xxhash64(F.col("l").cast("string"), F.size("v")).alias("g")
    units = nodes.select("node", label_key, "copies", "v").mapInArrow(
        hashed, "node long, g long, copies long, unit array<double>, codes array<int>"
    )
    units = materialize(units, "vector-units")
    keys = units.select("node", "g", F.posexplode("codes").alias("t", "code"))
    sizes = keys.groupBy("g", "t", "code").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(sizes, ["g", "t", "code"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    dealt = shared.select("node", "g", "t", "code", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    dealt = dealt.select(
        "node", "g", "t", "code", "own", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j")
    )
    members = dealt.join(units.select("node", "copies", "unit", "codes"), "node")
    row = F.struct("node", "copies", "own", "unit", "codes")
    groups = members.groupBy("g", "t", "code", "i", "j").agg(F.collect_list(row).alias("rows"))  # 2 x BLOCK at most, about

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
        for batch in smaller_batches(batches):
            lists = batch["rows"]
            at = lists.offsets.to_numpy()
            inner = lists.values
            part = {f: inner.field(f) for f in ("node", "copies", "own", "unit", "codes")}
            table, first, second = (batch[c].to_numpy() for c in ("t", "i", "j"))
            counts: list[np.ndarray] = []
            found: list[np.ndarray] = []
            for r in range(batch.num_rows):
                s, e = int(at[r]), int(at[r + 1])
                node = part["node"].slice(s, e - s).to_numpy()
                copies = part["copies"].slice(s, e - s).to_numpy()
                block = part["own"].slice(s, e - s).to_numpy()
                unit_rows = part["unit"].slice(s, e - s)
                x = unit_rows.flatten().to_numpy().reshape(e - s, -1)
                codes = part["codes"].slice(s, e - s).flatten().to_numpy().reshape(e - s, -1)
                left, right = np.flatnonzero(block == first[r]), np.flatnonzero(block == second[r])
                links_a, links_b = [], []
                for top in range(0, len(left), 512):
                    mine = left[top : top + 512]
                    a, b = np.nonzero(x[mine] @ x[right].T >= cosine)
                    a, b = mine[a], right[b]
                    keep = a < b if first[r] == second[r] else np.ones(len(a), bool)
                    a, b = a[keep], b[keep]
                    links_a.append(a)
                    links_b.append(b)
                    for cut in range(0, len(a), 1 << 17):
                        p, q = a[cut : cut + (1 << 17)], b[cut : cut + (1 << 17)]
                        now = (codes[p] == codes[q]).argmax(axis=1) == table[r]
                        p, q = p[now], q[now]
                        n = np.bincount(p, copies[q], e - s) + np.bincount(q, copies[p], e - s)
                        some = np.flatnonzero(n)
                        counts.append(np.stack([node[some], np.full(len(some), -1), n[some].astype("i8")], axis=1))
                a, b = np.concatenate(links_a), np.concatenate(links_b)
                if len(a):
                    root, rest = _spanning(a, b, e - s)
                    found.append(np.stack([node[root], node[rest], np.zeros(len(rest), "i8")], axis=1))
            if counts or found:
                both = np.concatenate(counts + found).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in both.T], schema=schema)

    results = materialize(groups.select("rows", "t", "i", "j").mapInArrow(verify, "a long, b long, n long"), "vector-links")
    linked = components(results.where("b >= 0").select("a", "b"))
    degree = results.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    full = (
        nodes.join(linked, nodes["node"] == linked["id"], "left")
        .join(degree, "node", "left")
        .select("node", "l", "v", "least", "copies", F.coalesce("component", "node").alias("c"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    full = materialize(full, "vector-members")
    least = full.groupBy("c").agg(F.min("least").alias("component_id"))
    named = full.join(least, "c").select("l", "v", "component_id", (F.col("n") + F.col("copies") - 1).alias("n_links"))
    out = good.join(named, ["l", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(F.col("l").isNotNull() & usable(F.col("v"))))
    alone = alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return out.union(alone).withColumn("kept", kept)


def _spanning(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            break
        root = new
    rest = np.flatnonzero(root != np.arange(n))
    return root[rest], rest
