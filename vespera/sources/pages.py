"""Raw event records stored as API pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed_values import EVENT_COLUMNS

EVENT_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in EVENT_COLUMNS])


def read_event_pages(
    spark: SparkSession,
    path: str,
    schema: T.StructType = EVENT_SCHEMA,
    page_size: int | None = None,
    page_pattern: str = r"(\d+)[^\d]*$",
) -> DataFrame:
    """Records of all pages, one JSON object with a ``results`` array per file.

    All stored pages are read, in one pass. With ``page_size`` the pages are checked to be one complete fetch, at the
    cost of a second pass over the files: every file has a page number of its own (the first group of ``page_pattern``
    in its path, by default the last number) and no page with records follows one that has fewer than ``page_size``.
    Anything else raises, nothing is left out.
    """
    wrapper = T.StructType([T.StructField("results", T.ArrayType(schema))])
    pages = spark.read.schema(wrapper).option("multiLine", True).json(path)
    if page_size is None:
        return pages.select(F.inline("results"))
    number = F.regexp_extract(F.col("_metadata.file_path"), page_pattern, 1).try_cast("bigint")
    numbered = pages.select(number.alias("page"), "results")
    size = F.coalesce(F.size("results"), F.lit(0))
    found = numbered.agg(
        F.count_if(F.col("page").isNull()).alias("unnumbered"),
        (F.count("page") - F.count_distinct("page")).alias("repeated"),
        F.min(F.when(size < page_size, F.col("page"))).alias("short"),
        F.max(F.when(size > 0, F.col("page"))).alias("last"),
    ).first()
    if found["unnumbered"] or found["repeated"]:
        raise ValueError(f"{found['unnumbered']} pages without number, {found['repeated']} with a number used before")
    if found["short"] is not None and found["last"] is not None and found["last"] > found["short"]:
        raise ValueError(f"page {found['short']} is short, but page {found['last']} has records")
    return pages.select(F.inline("results"))
