"""Quality by ordinal regression: one hashed weight vector, ordered thresholds, a grade for every document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, smaller_batches

#: Hash buckets, labelled rows a fit takes at most, and labelled rows a feature must occur in to get a weight.
BUCKETS, LABELLED, SUPPORT = 1 << 20, 20_000, 4
_MARKS = bytes(sorted(set(range(0x21, 0x7F)) - set(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")))
_LETTERS = bytes(b"abcdefghijklmnopqrstuvwxyz") + bytes(range(0x80, 0x100))


def features(text: str | None) -> np.ndarray:
    """Buckets of what a text has: its different words, marks at their ends, and shape by tenths."""
    raw = (text or "").encode("utf-8", "replace").lower()
    words = raw.split()
    seen = set(words)
    names, marks = set(), set()
    for w in seen:
        core = w.strip(_MARKS)
        names.add(b"w" + core)
        end = w[len(w.rstrip(_MARKS)) :]
        if end:
            marks.add(b"m" + end[:8])
    n = max(1, len(words))
    odd = sum(w[-1:] in b"#$%&*!|@~^<>{}[]=+_" for w in words)
    lines = raw.split(b"\n")
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    shape = [
        b"odd%d" % (10 * odd // n),
        b"different%d" % (10 * len(seen) // n),
        b"lines%d" % (10 * len(set(lines)) // max(1, len(lines))),
        b"size%d" % len(words).bit_length(),
        b"long%d" % min(20, len(raw) // n),
        b"letters%d" % (10 * letters // max(1, len(raw))),
    ]
    return np.fromiter({zlib.crc32(x) % BUCKETS for x in (*names, *marks, *shape)}, "i4")


@dataclass
class Grades:
    """P(grade <= j) = sigmoid(threshold_j - weights . features)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= 1), P(grade >= 2), ..."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - self.weights[found].sum(), -40, 40)))


def fit(rows: list[tuple[int, np.ndarray]], grades: int, rounds: int = 150, ridge: float = 1e-4) -> Grades:
    """Cumulative-link fit by full gradients with adaptive steps. Grades weigh by the root of their rarity.

    Without rows of at least two grades every document gets the same grade: the highest if there are none.
    """
    y = np.array([g for g, _ in rows], "i8")
    w, t = np.zeros(BUCKETS), np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(grades - 1)
    if len(np.unique(y)) < 2:
        return Grades(w, np.where(np.arange(grades - 1) < (y[0] if len(y) else grades), -20.0, 20.0))
    sizes = np.array([len(f) for _, f in rows])
    cols = np.concatenate([f for _, f in rows]).astype("i8")
    often = np.bincount(cols, minlength=BUCKETS) >= SUPPORT
    keep = often[cols]
    doc = np.repeat(np.arange(len(rows)), sizes)[keep]
    names, cols = np.unique(cols[keep], return_inverse=True)
    count = np.bincount(y, minlength=grades)
    row_weight = np.sqrt(len(y) / np.maximum(count, 1))[y]
    row_weight = row_weight / row_weight.sum()
    v = np.zeros(len(names))
    state = [np.zeros(len(v)), np.zeros(len(v)), np.zeros(len(t)), np.zeros(len(t))]
    gaps = np.concatenate([t[:1], np.log(np.diff(t))]) if grades > 2 else t.copy()
    for step in range(1, rounds + 1):
        t = np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))])
        z = np.bincount(doc, v[cols], len(rows))
        edges = np.concatenate([[-60.0], t, [60.0]])
        upper = 1 / (1 + np.exp(-np.clip(edges[y + 1] - z, -60, 60)))
        lower = 1 / (1 + np.exp(-np.clip(edges[y] - z, -60, 60)))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        gz = row_weight * (du - dl)  # of minus the log likelihood
        gv = np.bincount(cols, gz[doc], len(v)) + ridge * v
        gt = np.array([(row_weight * dl)[y == j + 1].sum() - (row_weight * du)[y == j].sum() for j in range(grades - 1)])
        gg = np.concatenate([[gt.sum()], [gt[j:].sum() * np.exp(gaps[j]) for j in range(1, grades - 1)]])
        for x, g, m, s in ((v, gv, 0, 1), (gaps, gg, 2, 3)):
            state[m] = 0.9 * state[m] + 0.1 * g
            state[s] = 0.99 * state[s] + 0.01 * g * g
            x -= 0.08 * (state[m] / (1 - 0.9**step)) / (np.sqrt(state[s] / (1 - 0.99**step)) + 1e-9)
    w[names] = v
    return Grades(w, np.concatenate([gaps[:1], gaps[0] + np.cumsum(np.exp(gaps[1:]))]))


def train(docs: DataFrame, ratings: DataFrame, grades: int, most: int = LABELLED) -> Grades:
    """Fit on ratings(doc_id, grade) joined with docs(doc_id, text): at most ``most`` of them, by the hash of their id.

    The bound is on the fit alone, and on ids that docs has. Null ids or grades and grades outside 0 to ``grades`` - 1
    are left out; an id with several ratings takes the lowest, one with several texts that of the smallest hash.
    """
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    rated = rated.where(f"doc_id is not null and grade between 0 and {grades - 1}").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    there = rated.join(text.select("doc_id"), "doc_id", "left_semi")
    # Written, so that Spark knows how few these are and broadcasts them: no text is moved to find its rating.
    chosen = materialize(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "rated")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text", "grade")).alias("one")
    texts = text.join(chosen, "doc_id").groupBy("doc_id").agg(one).select("doc_id", "one.text", "one.grade")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller_batches(batches):
            found = pa.array([features(t) for t in batch["text"].to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["grade"], found], names=["doc_id", "grade", "found"])

    rows = texts.mapInArrow(run, "doc_id long, grade int, found array<int>").toArrow()
    grade, found, ids = rows["grade"].to_numpy(), rows["found"].combine_chunks(), rows["doc_id"].to_numpy()
    at, flat = found.offsets.to_numpy(), found.values.to_numpy()
    order = np.argsort(ids)  # so that the fit doesn't depend on how rows arrive
    return fit([(int(grade[i]), np.sort(flat[at[i] : at[i + 1]])) for i in order], grades)


def score(docs: DataFrame, model: Grades) -> DataFrame:
    """docs with expected_grade double and tails array<double> = [P(grade >= 1), P(grade >= 2), ...] added.

    One row per row, whole texts, a null text counts as empty. Columns of docs with these names are replaced.
    """
    bc = docs.sparkSession.sparkContext.broadcast((model.weights.astype("f4"), model.thresholds))  # 4 MB, by BUCKETS

    @F.pandas_udf("array<double>")
    def tails(text):  # noqa: ANN001, ANN202
        import pandas as pd

        weights, thresholds = bc.value
        grades = Grades(weights, thresholds)
        return pd.Series([grades.tails(features(t)) for t in text])

    out = docs.withColumn("tails", tails(F.col("text").cast("string")))
    return out.withColumn("expected_grade", F.aggregate("tails", F.lit(0.0), lambda s, x: s + x))


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from labels(doc_id, quality, toxic): 0 toxic, 1 poor, 2 good. A null toxic counts as not toxic."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def select_good(docs: DataFrame, model: Grades, least: float = 0.5) -> DataFrame:
    """docs whose chance of the highest grade is at least ``least``; columns stay as they are."""
    columns = docs.columns
    mine = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text"))
    kept = score(mine, model).where(F.element_at("tails", -1) >= least)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in columns])
