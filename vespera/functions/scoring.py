"""Columns used to judge answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed_values import (
    EXPECTED_EVENT_TERMS,
    FAIR_FAITHFULNESS,
    GOOD_FAITHFULNESS,
    GOOD_PRECISION,
    LABELS,
)
from .text import contains_any


def expects_event(reference) -> Column:
    """True when the reference answer says that an event should be found."""
    return contains_any(F.lower(F.coalesce(reference, F.lit(""))), EXPECTED_EVENT_TERMS)


def nan_to_null(c: Column) -> Column:
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def num_or_zero(c: Column) -> Column:
    """Number, or 0 for text, NULL and NaN."""
    return F.coalesce(nan_to_null(c), F.lit(0.0))


def classify(faithfulness: Column, precision: Column, contexts: Column, reference: Column) -> Column:
    """``correcte``, ``partiellement correcte`` or ``incorrecte``; rules apply in this order."""
    good, fair, bad = LABELS
    faith = num_or_zero(faithfulness)
    no_context = contexts.isNull() | (F.size(contexts) <= 0)
    return (
        F.when(no_context & expects_event(reference), F.lit(bad))
        .when((faith >= GOOD_FAITHFULNESS) & (num_or_zero(precision) >= GOOD_PRECISION), F.lit(good))
        .when(faith >= FAIR_FAITHFULNESS, F.lit(fair))
        .otherwise(F.lit(bad))
    )
