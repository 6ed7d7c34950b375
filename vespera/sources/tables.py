"""Event, index and score tables on disk, and the checks made before using one."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pages import EVENT_SCHEMA

CLEAN_SCHEMA = T.StructType([*EVENT_SCHEMA.fields, T.StructField("text_to_embed", T.StringType())])

# Quotes are doubled inside quoted values, values may span lines, and blanks around values are kept.
_CSV = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_clean_csv(spark: SparkSession, path: str, schema: T.StructType = CLEAN_SCHEMA) -> DataFrame:
    """CSV with a header line, with or without a byte-order mark, read by the names in it.

    Columns may come in any order; those of ``schema`` that the file lacks are NULL, others are left out. Files of a
    folder must have the same header, or reading fails.
    """
    wanted = spark.createDataFrame([], schema).schema
    # Nothing between commas is NULL, quotes around nothing are an empty text: the mark for NULL must be neither.
    found = spark.read.options(**_CSV, enforceSchema=False, nullValue="\0").csv(path)
    names = {c.strip("\ufeff"): c for c in found.columns}
    columns = [
        (F.col(f"`{names[f.name]}`") if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted
    ]
    return found.select(*columns)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame, what: str = "table") -> DataFrame:
    """Raise when empty; reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"the {what} is empty")
    return df


def table_problem(df: DataFrame, columns: Iterable[str] = (), what: str = "table") -> str | None:
    """What makes a table unusable as input, as text: columns it lacks, or that it has no rows; None if nothing does."""
    try:
        require_rows(require_columns(df, columns), what)
    except ValueError as e:
        return str(e)
    return None


def _write(df: DataFrame, path: str, fmt: str) -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**{k: v for k, v in _CSV.items() if k != "multiLine"}).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def write_events(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    _write(events, path, fmt)


def write_scores(scores: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Scores as Parquet, or as CSV with array and struct columns written as JSON text."""
    if fmt == "csv":
        nested = (T.ArrayType, T.StructType, T.MapType)
        columns = [
            F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
            for f in scores.schema.fields
        ]
        scores = scores.select(*columns)
    _write(scores, path, fmt)


def read_test_set(spark: SparkSession, path: str) -> DataFrame:
    """Annotated questions ``question, reference`` from CSV, checked for both columns and at least one row."""
    rows = spark.read.options(**_CSV).csv(path)
    return require_rows(require_columns(rows, ["question", "reference"]), "test set")
