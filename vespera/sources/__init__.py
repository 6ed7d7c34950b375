"""Readers and writers."""

from .index import compact_index, drop_replaced, read_index, read_log, write_index
from .pages import EVENT_SCHEMA, read_event_pages
from .tables import (
    CLEAN_SCHEMA,
    read_clean_csv,
    read_test_set,
    require_columns,
    require_rows,
    table_problem,
    write_events,
    write_scores,
)

__all__ = [
    "CLEAN_SCHEMA",
    "EVENT_SCHEMA",
    "compact_index",
    "drop_replaced",
    "read_clean_csv",
    "read_event_pages",
    "read_index",
    "read_log",
    "read_test_set",
    "require_columns",
    "require_rows",
    "table_problem",
    "write_events",
    "write_index",
    "write_scores",
]
