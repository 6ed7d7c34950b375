"""Quality metrics from verdict tables, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import LABELS
from ..functions.scoring import nan_to_null

_SPAN = 4096
_EPSILON = 1e-10


def running_totals(rows: DataFrame, key: str, order: str, totals: dict[str, Column], span: int = _SPAN) -> DataFrame:
    """Running sums per key in the order of a unique integer column, for keys of any size.

    A plain window would sort each key inside one task. Here a key is cut into spans of the order column; totals of
    whole spans are summed first, and only the rows of one span are ever sorted together.
    """
    cut = rows.withColumn("_span", F.floor(F.col(order) / F.lit(span)).cast("bigint"))
    cut = cut.withColumns({f"_{name}": value for name, value in totals.items()})
    spans = cut.groupBy(key, "_span").agg(*[F.sum(f"_{name}").alias(f"_span_{name}") for name in totals])
    earlier = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = spans.select(
        key, "_span", *[F.coalesce(F.sum(f"_span_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in totals]
    )
    so_far = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    within = cut.withColumns({f"_in_{name}": F.sum(f"_{name}").over(so_far) for name in totals})
    joined = within.join(offsets, [key, "_span"])
    return joined.select(*rows.columns, *[(F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in totals])


def judged_contexts(samples: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``qid, rank, context, relevant``: each retrieved context of ``samples(qid, contexts)`` beside its verdict.

    Ranks count from 1. A context without a verdict stays, with NULL; a verdict without a context has no row.
    """
    ranked = samples.select("qid", F.posexplode("contexts").alias("pos", "context"))
    ranked = ranked.select("qid", (F.col("pos") + 1).alias("rank"), "context")
    return ranked.join(verdicts.select("qid", "rank", "relevant"), ["qid", "rank"], "left")


def context_precision(verdicts: DataFrame) -> DataFrame:
    """``qid, context_precision`` from ``verdicts(qid, rank, relevant 0/1)``.

    Mean over the relevant contexts of the share of relevant ones down to that place. ``rank`` gives the order of a
    question's contexts; it must be unique per question and may have gaps.
    """
    relevant = F.col("relevant").cast("bigint")
    walked = running_totals(verdicts, "qid", "rank", {"hits": relevant, "place": F.lit(1).cast("bigint")})
    at_hit = F.when(F.col("relevant") > 0, F.col("hits") / F.col("place")).otherwise(F.lit(0.0))
    return walked.groupBy("qid").agg(
        (F.sum(at_hit) / (F.sum(relevant) + F.lit(_EPSILON))).alias("context_precision")
    )


def faithfulness(verdicts: DataFrame) -> DataFrame:
    """``qid, faithfulness`` from ``verdicts(qid, supported 0/1)``: share of supported statements."""
    return verdicts.groupBy("qid").agg(F.avg(F.col("supported").cast("double")).alias("faithfulness"))


def class_summary(scores: DataFrame) -> DataFrame:
    """``position, classification, n, total, percentage`` for the three labels, in report order, zero-filled."""
    counts = [F.count_if(F.col("classification") == label).alias(f"n{i}") for i, label in enumerate(LABELS)]
    one_row = scores.agg(F.count(F.lit(1)).alias("total"), *counts)
    entries = F.array(
        *[
            F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("classification"), F.col(f"n{i}").alias("n"))
            for i, label in enumerate(LABELS)
        ]
    )
    share = F.bround(F.col("n").cast("double") / F.col("total") * 100, 1)
    return one_row.select("total", F.inline(entries)).select(
        "position",
        "classification",
        "n",
        "total",
        F.when(F.col("total") > 0, share).otherwise(F.lit(0.0)).alias("percentage"),
    )


def metric_means(scores: DataFrame, key: str = "qid") -> DataFrame:
    """``metric, mean`` for every numeric column but the key, NULL and NaN left out, in one pass."""
    numeric = [f.name for f in scores.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != key]
    means = scores.agg(*[F.avg(nan_to_null(F.col(f"`{name}`"))).alias(f"m{i}") for i, name in enumerate(numeric)])
    entries = [F.struct(F.lit(name).alias("metric"), F.col(f"m{i}").alias("mean")) for i, name in enumerate(numeric)]
    return means.select(F.inline(F.array(*entries)))
