"""Approximate largest inner products: stable projections to few dimensions, a kd-tree, and a chi-square stopping test."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, smaller_batches
from .vectors import matrix, usable

#: Projected dimensions, chance with which a neighbour may be missed, vectors that are verified before the first look at
#: the stopping test, how many times as many before each next one, and queries whose projected distances are one product.
DIMS, MISS, STEP, GROWTH, BLOCK = 16, 0.03, 64, 4, 64
#: Vectors in a cell of the shared tree, cells at most, rows that the cells are fitted on, queries per task and cell.
CELL, CELLS, SAMPLE, QUERIES = 8192, 4096, 65_536, 4096

_FOUND = "q long, vec_id long, score double, seen long"


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """The value that a chi-square variable of an even number of dimensions stays under with chance ``p``."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        term, total = 1.0, 0.0
        for i in range(dims // 2):
            total += term
            term *= mid / 2 / (i + 1)
        low, high = (mid, high) if 1 - math.exp(-mid / 2) * total < p else (low, mid)
    return high


class Tree:
    """Median splits along the widest side; leaves are ranges of the sorted points with their boxes."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.order = np.arange(len(points))
        self.bounds: list[tuple[int, int]] = []
        self.splits: list[tuple[int, float, int, int]] = []  # axis, value, left, right; leaves are ~number
        self.root = self._split(points, 0, len(points), leaf)
        boxes = [points[self.order[a:b]] for a, b in self.bounds]
        self.low = np.array([x.min(axis=0) for x in boxes])
        self.high = np.array([x.max(axis=0) for x in boxes])

    def _split(self, points: np.ndarray, a: int, b: int, leaf: int) -> int:
        mine = points[self.order[a:b]]
        wide = np.ptp(mine, axis=0) if b > a else np.zeros(1)
        axis = int(wide.argmax())
        if b - a <= leaf or wide[axis] == 0:
            self.bounds.append((a, b))
            return ~(len(self.bounds) - 1)
        half = (b - a) // 2
        part = np.argpartition(mine[:, axis], half)
        self.order[a:b] = self.order[a:b][part]
        value = float(mine[part[half], axis])
        at = len(self.splits)
        self.splits.append((axis, value, 0, 0))
        left = self._split(points, a, a + half, leaf)
        right = self._split(points, a + half, b, leaf)
        self.splits[at] = (axis, value, left, right)
        return at

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        out = np.full(len(points), self.root)
        for at in range(len(self.splits)):  # children have larger numbers than their parent
            axis, value, left, right = self.splits[at]
            here = out == at
            if here.any():
                out[here] = np.where(points[here, axis] < value, left, right)
        return ~out


def _gap(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(points), len(low)))
    for d in range(points.shape[1]):
        p = points[:, d, None]
        side = np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0)
        out += side * side
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, miss: float = MISS, cell: int = CELL) -> DataFrame:
    """(query_id, rank, vec_id, score, verified): for each row of queries(vec_id, embedding) its ``k`` largest inner products.

    vectors(vec_id, embedding); a query's own vec_id is no candidate. score is the inner product in double precision;
    ties go to the smaller vec_id. Rows with a null vec_id and unusable vectors (null, empty, zero, null or non-finite
    components) take no part; shorter vectors count as filled up with zeros. Fewer candidates give fewer rows, an empty
    table none.

    A vector gets one more component that brings all to one length, so the largest inner product is the smallest
    distance. Gaussian projections of a difference with squared length d are d times a chi-square variable. Cells of a
    kd-tree over the projections, fitted on at most ``SAMPLE`` rows, are the partitions of the index; all rows are
    indexed. A query first searches its own cell, which bounds the distance of its k-th neighbour, then those cells that
    the stopping test does not rule out under this bound. Within a cell, the projected distances of a block of queries are
    one product, and vectors are verified in the order of these distances, ``STEP`` at first and ``GROWTH`` times as many
    each time, until the test holds for all others: a nearer vector would lie that far away in the projection with chance ``miss`` at most. ``verified`` counts the
    different vectors whose inner product with the query was worked out; it says how much the test has saved. Equal
    vectors are searched as one, with as many ids as can matter (k + 1).
    """
    stop = chi_square_quantile(1 - miss)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("v"))
    asked = asked.where(F.col("query_id").isNotNull() & usable(F.col("v")))
    first = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    points = rows.withColumn("r", first).where(F.col("r") <= k + 1).groupBy("v").agg(F.collect_list("vec_id").alias("ids"))
    points = materialize(points, "points")
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(length).alias("top")).first()
    empty = "query_id long, rank int, vec_id long, score double, verified long"
    if not shape.n:
        return vectors.sparkSession.createDataFrame([], empty)
    n, dim, top = shape.n, shape.dim, shape.top
    axes = np.random.default_rng(20).standard_normal((dim + 1, DIMS))

    def projected(x: np.ndarray, as_query: bool) -> np.ndarray:
        squared = (x * x).sum(axis=1)
        if as_query:
            return (x * np.sqrt(top / squared)[:, None]) @ axes[:dim]
        return x @ axes[:dim] + np.sqrt(np.maximum(top - squared, 0))[:, None] * axes[dim]

    def with_projection(df: DataFrame, other: str, kind: str, as_query: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in smaller_batches(batches):
                x = matrix(batch["v"], dim)
                if as_query and x.shape[1] > dim:
                    x = x[:, :dim]
                p = projected(x, as_query)
                lists = lambda m: pa.FixedSizeListArray.from_arrays(pa.array(m.ravel()), m.shape[1])
                plain = [m.cast(pa.list_(pa.float64())) for m in (lists(x), lists(p))]
                yield pa.RecordBatch.from_arrays([batch[other], *plain], names=[other, "v", "p"])

        return df.mapInArrow(run, f"{other} {kind}, v array<double>, p array<double>")

    index = with_projection(points.select("ids", "v"), "ids", "array<long>", False)
    count = min(CELLS, 1 << max(0, math.ceil(math.log2(max(1, n / cell)))))
    sample = index.select("p", F.xxhash64("ids").alias("h")).orderBy("h").select("p").limit(SAMPLE)
    fitted = np.array([r.p for r in sample.collect()]) if count > 1 else np.zeros((1, DIMS))
    tree = Tree(fitted, max(1, -(-len(fitted) // count)))

    def with_cell(df: DataFrame, fields: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = pa.array(tree.leaf_of(matrix(batch["p"], DIMS)).astype("i4"))
                yield pa.RecordBatch.from_arrays([*batch.columns, at], names=[*batch.schema.names, "cell"])

        return df.mapInArrow(run, f"{fields}, cell int")

    index = with_cell(index, "ids array<long>, v array<double>, p array<double>")
    index = materialize(index, "index")
    edges = [f(F.get("p", F.lit(d))) for d in range(DIMS) for f in (F.min, F.max)]
    cells = {r[0]: r[1:] for r in index.groupBy("cell").agg(F.count("*"), *edges).collect()}  # CELLS rows at most
    # A cell that got far more rows than the sample promised is split by hash; each part is searched on its own.
    parts = {c: max(1, -(-r[0] // (2 * cell))) for c, r in cells.items()}
    names = np.array(sorted(cells), "i4")
    low = np.array([[cells[c][1 + 2 * d] for d in range(DIMS)] for c in names])
    high = np.array([[cells[c][2 + 2 * d] for d in range(DIMS)] for c in names])
    of_cell = F.create_map(*[F.lit(x) for c in names for x in (int(c), parts[int(c)])])
    index = index.withColumn("part", F.pmod(F.xxhash64("ids"), of_cell[F.col("cell")]).cast("int"))

    distinct = asked.groupBy("v").agg(F.min("query_id").alias("q"))
    goals = materialize(with_projection(distinct.select("q", "v"), "q", "long", True), "queries")

    def routed(bounds: DataFrame | None) -> DataFrame:
        """Queries with the cells to search: the nearest cell, or the others that their bound leaves open."""
        own = bounds is None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in smaller_batches(batches, 1 << 20):
                gap = _gap(matrix(batch["p"], DIMS), low, high)
                home = gap.argmin(axis=1)
                if own:
                    row, at = np.arange(len(home)), home
                else:
                    reach = batch["bound"].to_numpy(zero_copy_only=False)
                    open_ = gap <= stop * np.where(np.isnan(reach), np.inf, reach)[:, None] + 1e-9 * top
                    open_[np.arange(len(home)), home] = False
                    row, at = np.nonzero(open_)
                took = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*took.columns, pa.array(names[at])], names=[*batch.schema.names, "cell"])

        source = goals.withColumn("bound", F.lit(None).cast("double")) if bounds is None else goals.join(bounds, "q", "left")
        source = source.select("q", "v", "p", "bound")
        got = source.mapInArrow(run, "q long, v array<double>, p array<double>, bound double, cell int")
        return materialize(got, "routed")

    def search(wanted: DataFrame) -> DataFrame:
        per_cell = {r[0]: r[1] for r in wanted.groupBy("cell").agg(F.count("*")).collect()}
        if not per_cell:
            return vectors.sparkSession.createDataFrame([], _FOUND)
        shares = F.create_map(*[F.lit(x) for c, m in per_cell.items() for x in (int(c), max(1, -(-m // QUERIES)))])
        split = F.create_map(*[F.lit(x) for c in per_cell for x in (int(c), parts[int(c)])])
        side = wanted.withColumn("share", F.pmod(F.xxhash64("q"), shares[F.col("cell")]).cast("int"))
        side = side.withColumn("part", F.explode(F.sequence(F.lit(0), split[F.col("cell")] - 1)))
        data = index.where(F.col("cell").isin([int(c) for c in per_cell])).withColumn(
            "share", F.explode(F.sequence(F.lit(0), shares[F.col("cell")] - 1))
        )

        def run(data: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(data) or not len(wanted):
                return pd.DataFrame({"q": [], "vec_id": [], "score": [], "seen": []}).astype({"q": "i8", "vec_id": "i8", "seen": "i8"})
            return _search(data, wanted, k, stop, top)

        keys = ["cell", "part", "share"]
        return data.groupBy(*keys).cogroup(side.groupBy(*keys)).applyInPandas(run, _FOUND)

    near = materialize(search(routed(None)), "near")
    last = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    kth = near.withColumn("r", F.row_number().over(last)).where(F.col("r") == k + 1)
    norm = goals.select("q", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x).alias("qq"))
    bounds = kth.join(norm, "q").select("q", (2 * top - 2 * F.col("score") * F.sqrt(top / F.col("qq"))).alias("bound"))
    bounds = bounds.select("q", F.greatest("bound", F.lit(0.0)).alias("bound"))
    found = materialize(near.union(search(routed(bounds))), "found")
    best = found.withColumn("r", F.row_number().over(last)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    padded = materialize(best.join(found.groupBy("q").agg(F.sum("seen").alias("verified")), "q"), "best")
    same = asked.join(distinct, "v").select("query_id", "q")
    ranked = same.join(padded, "q").where("vec_id <> query_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "verified")


def _search(data: pd.DataFrame, wanted: pd.DataFrame, k: int, stop: float, top: float) -> pd.DataFrame:
    """The k + 1 nearest of each query in one part of a cell; ``seen``, on a query's first row, counts what it verified."""
    v, p = np.stack(data["v"].to_numpy()), np.stack(data["p"].to_numpy())
    ids = data["ids"].to_numpy()
    many = np.array([len(x) for x in ids])
    x, points = np.stack(wanted["v"].to_numpy()), np.stack(wanted["p"].to_numpy())
    bounds = wanted["bound"].to_numpy(dtype="f8", na_value=np.nan)
    bounds = np.where(np.isnan(bounds), np.inf, bounds)
    scale = np.sqrt(top / (x * x).sum(axis=1))
    slack = 1e-9 * top
    out_q, out_id, out_score, out_seen = [], [], [], []
    for at in range(0, len(x), BLOCK):
        # Projected distances of a block of queries as one product. Its rounding only changes the order of looks.
        block = points[at : at + BLOCK]
        away = (block * block).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (block @ p.T)
        np.maximum(away, 0, out=away)
        for row, gaps in enumerate(away, at):
            limit = bounds[row]
            left = np.flatnonzero(gaps <= stop * limit + slack)
            spots, scores, seen, look = np.zeros(0, "i8"), np.zeros(0), 0, STEP
            while len(left):
                # The nearest of those left come next; the others wait until the test has been looked at again.
                new = left if look >= len(left) else left[np.argpartition(gaps[left], look - 1)[:look]]
                spots, scores = np.concatenate([spots, new]), np.concatenate([scores, v.take(new, axis=0) @ x[row]])
                seen += len(new)
                if len(spots) > k + 1:
                    cut = np.partition(scores, len(scores) - (k + 1))[len(scores) - (k + 1)]  # ties with it stay
                    spots, scores = spots[scores >= cut], scores[scores >= cut]
                if many[spots].sum() > k:
                    best = np.argsort(-scores, kind="stable")
                    kth = scores[best][np.searchsorted(np.cumsum(many[spots][best]), k + 1)]
                    limit = min(limit, max(0.0, 2 * top - 2 * kth * scale[row]))
                if len(new) == len(left):
                    break
                # The test: what lies beyond its reach is so far away that no nearer neighbour is to be expected.
                gaps[new] = np.nan  # looked at: within no limit
                left = left[gaps[left] <= stop * limit + slack]
                look *= GROWTH
            pairs = sorted((-float(s), int(i)) for spot, s in zip(spots, scores) for i in ids[spot])[: k + 1]
            out_q += [wanted["q"].iat[row]] * len(pairs)
            out_id += [i for _, i in pairs]
            out_score += [-s for s, _ in pairs]
            out_seen += [seen, *[0] * (len(pairs) - 1)] if pairs else []
    columns = {"q": (out_q, "i8"), "vec_id": (out_id, "i8"), "score": (out_score, "f8"), "seen": (out_seen, "i8")}
    return pd.DataFrame({name: np.array(values, kind) for name, (values, kind) in columns.items()})
