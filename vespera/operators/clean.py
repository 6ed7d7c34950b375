"""Steps that turn raw event records into documents."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed_values import EVENT_COLUMNS, METADATA_NAMES
from ..functions.text import event_text, is_missing, missing_to_null, strip, strip_basic_html
from ..session import materialize


def scope_events(events: DataFrame, city: str = "Paris", since: str = "2025-07-12") -> DataFrame:
    """Events of one city from a day on; both tests are plain comparisons that reach a Parquet scan."""
    return events.where((F.col("location_city") == city) & (F.col("firstdate_begin") >= since))


def prune_columns(events: DataFrame) -> DataFrame:
    return events.select([c for c in EVENT_COLUMNS if c in events.columns])


def drop_missing(events: DataFrame) -> DataFrame:
    return events.dropna(subset=["description_fr"])


def compose_text(events: DataFrame, null_text: str = "None", row_fallback: bool = False) -> DataFrame:
    """Add ``text_to_embed``.

    A missing column prints as nothing, a NULL value as ``null_text``. The short description stands in for the long
    one when the long column is absent; with ``row_fallback`` also where a single value is missing.
    """

    def value(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(null_text)) if name in events.columns else F.lit("")

    if "longdescription_fr" not in events.columns:
        description = value("description_fr")
    elif row_fallback:
        description = F.coalesce("longdescription_fr", value("description_fr"))
    else:
        description = value("longdescription_fr")
    text = event_text(
        value("title_fr"),
        value("location_city"),
        value("location_department"),
        value("firstdate_begin"),
        value("lastdate_end"),
        description,
    )
    return events.withColumn("text_to_embed", text)


def strip_html(events: DataFrame, column: str = "text_to_embed") -> DataFrame:
    return events.withColumn(column, strip_basic_html(F.col(column)))


def usable_text(rows: DataFrame, column: str = "text_to_embed") -> DataFrame:
    """Trim the text; drop rows where nothing, or only ``nan``, is left."""
    return rows.where(~is_missing(F.col(column))).withColumn(column, strip(F.col(column)))


def with_ordinals(rows: DataFrame, name: str = "doc_ord", first: int = 0) -> DataFrame:
    """Add consecutive numbers from ``first`` in input order.

    Rows are written once with their partition and place; a prefix sum over the partitions' counts, one row each, gives
    where each partition starts. No row is moved.
    """
    place = F.monotonically_increasing_id()
    placed = rows.withColumns({"_part": F.shiftright(place, 33), "_row": place.bitwiseAND(F.lit(2**33 - 1))})
    placed = materialize(placed, "placed")
    counts = sorted(placed.groupBy("_part").agg(F.count("*").alias("n")).collect())
    starts = list(zip([r["_part"] for r in counts], accumulate((r["n"] for r in counts), initial=first)))
    starts = rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint")
    number = (F.col("_start") + F.col("_row")).alias(name)
    return placed.join(F.broadcast(starts), "_part").select(number, *rows.columns)


def _metadata(events: DataFrame) -> list[Column]:
    """The renamed metadata columns; missing values and missing columns are NULL."""

    def value(source: str) -> Column:
        if source not in events.columns:
            return F.lit(None).cast("string")
        return missing_to_null(F.col(source).cast("string"))

    return [value(source).alias(name) for source, name in METADATA_NAMES.items()]


def event_metadata(events: DataFrame) -> DataFrame:
    """The metadata of events as documents carry it, also for events that make no document."""
    return events.select(*_metadata(events))


def to_documents(events: DataFrame, ord_col: str | None = None, first_ord: int = 0) -> DataFrame:
    """``doc_ord, text`` and the renamed metadata of clean events with usable text.

    ``ord_col`` names a unique integer that gives the order of the documents; without it documents are numbered
    consecutively in input order. Numbers start at ``first_ord``.
    """
    usable = usable_text(events)
    if ord_col is None:
        usable = usable.select(F.col("text_to_embed").alias("text"), *_metadata(events))
        return with_ordinals(usable, "doc_ord", first_ord)
    order = F.col(ord_col).cast("bigint") + F.lit(first_ord)
    return usable.select(order.alias("doc_ord"), F.col("text_to_embed").alias("text"), *_metadata(events))
