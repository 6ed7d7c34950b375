"""Structured Streaming jobs."""

from .jobs import refresh_batch, stream_answers, stream_event_pages, stream_index

__all__ = ["refresh_batch", "stream_answers", "stream_event_pages", "stream_index"]
