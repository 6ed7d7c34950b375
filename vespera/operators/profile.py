"""Corpus counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import iso_date, month_year
from ..functions.text import arrondissement, postal_code


def events_by_month(events: DataFrame, date_col: str = "firstdate_begin") -> DataFrame:
    """``month_year, count`` in month order; unreadable dates are left out. A date as text counts in its written month."""
    text = isinstance(events.schema[date_col].dataType, T.StringType)
    day = iso_date(F.col(date_col)) if text else F.col(date_col).cast("date")
    dated = events.select(day.alias("day")).where(F.col("day").isNotNull())
    return dated.groupBy(month_year(F.col("day")).alias("month_year")).count().orderBy("month_year")


def top_groups(rows: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` largest groups, ties by key."""
    return rows.groupBy(key).count().orderBy(F.desc("count"), key).limit(n)


def top_arrondissements(
    events: DataFrame, n: int = 10, postal_col: str = "location_postalcode"
) -> DataFrame | None:
    """``arrondissement, count`` for the busiest Paris districts; None when the table has no postal codes."""
    if postal_col not in events.columns:
        return None
    coded = events.select(postal_code(F.col(postal_col)).alias("code"))
    district = coded.select(arrondissement(F.col("code")).alias("arrondissement"))
    return top_groups(district.where(F.col("arrondissement").isNotNull()), "arrondissement", n)
