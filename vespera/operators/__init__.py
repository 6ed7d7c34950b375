"""DataFrame-to-DataFrame operators."""

from .chunk import chunk_text, window_chunks, with_chunk_id
from .clean import (
    compose_text,
    drop_missing,
    prune_columns,
    scope_events,
    strip_html,
    to_documents,
    usable_text,
    with_ordinals,
)
from .constraints import apply_constraints, dedup_first, first_events, first_matches, with_facets
from .context import answer_rows, context_text, project_sources, retrieved_contexts
from .embed import embed
from .gazetteer import with_first_label, with_labels
from .knn import knn, top_k
from .metrics import class_summary, context_precision, faithfulness, judged_contexts, metric_means, running_totals
from .profile import events_by_month, top_arrondissements, top_groups
from .questions import parse_questions, validate_questions

__all__ = [
    "answer_rows",
    "apply_constraints",
    "chunk_text",
    "class_summary",
    "compose_text",
    "context_precision",
    "context_text",
    "dedup_first",
    "drop_missing",
    "embed",
    "events_by_month",
    "faithfulness",
    "first_events",
    "first_matches",
    "judged_contexts",
    "knn",
    "metric_means",
    "parse_questions",
    "project_sources",
    "prune_columns",
    "retrieved_contexts",
    "running_totals",
    "scope_events",
    "strip_html",
    "to_documents",
    "top_arrondissements",
    "top_groups",
    "top_k",
    "usable_text",
    "validate_questions",
    "window_chunks",
    "with_chunk_id",
    "with_facets",
    "with_first_label",
    "with_labels",
    "with_ordinals",
]
