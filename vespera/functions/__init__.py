"""Column functions: text, dates, topics, vectors and answer scoring."""

from .dates import iso_date, long_date, make_date_or_null, month_year, try_timestamp
from .scoring import classify, expects_event, nan_to_null, num_or_zero
from .text import (
    arrondissement,
    assemble_prompt,
    blank_to_null,
    context_block,
    date_phrase,
    event_text,
    excerpt,
    missing_to_null,
    postal_code,
    searchable_text,
    strip,
    strip_basic_html,
)
from .topics import match_topics, topics_ok
from .vectors import cosine, dot, l2sq, norm

__all__ = [name for name in dir() if not name.startswith("_")]
