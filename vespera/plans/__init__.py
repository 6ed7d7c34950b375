"""End-to-end jobs."""

from .jobs import (
    add_classification,
    build_index,
    clean_events,
    evaluate,
    evaluation_samples,
    index_documents,
    load_clean_events,
    rebuild_index,
    retrieve,
    search,
)

__all__ = [
    "add_classification",
    "build_index",
    "clean_events",
    "evaluate",
    "evaluation_samples",
    "index_documents",
    "load_clean_events",
    "rebuild_index",
    "retrieve",
    "search",
]
