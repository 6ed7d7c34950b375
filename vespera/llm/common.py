"""Small helpers that several operators share."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_path

__all__ = ["batches_of", "distinct_rows_of", "kept_by_worker", "materialize", "scratch_path", "smaller_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept_by_worker(name: str, make: Callable[[], Any]) -> Any:
    """A value that a Python worker makes once and keeps for its later tasks, until one of another name is asked for.

    One at a time, so that the tables of a pipeline's earlier stages don't add up to those of later ones. Task code
    travels by value, so a module's own variables would be new in each task.
    """
    kept = sys.__dict__.setdefault("_vespera_kept", {})
    if name not in kept:
        kept.clear()
        kept[name] = make()
    return kept[name]


def smaller_batches(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes; one row, however long, is never cut."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * most / max(most, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def batches_of(schema: pa.Schema, rows: Iterator[dict[str, list]]) -> Iterator[pa.RecordBatch]:
    for columns in rows:
        yield pa.RecordBatch.from_pydict(columns, schema=schema)


def distinct_rows_of(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Undirected pairs as (a, b) with a < b, each once."""
    low, high = F.least(a, b), F.greatest(a, b)
    return edges.select(low.alias("a"), high.alias("b")).where("a < b").distinct()
