"""Pipelines and batch calls."""

from .batch import batch, configure_threads, levenshtein_each, thread_count
from .pipeline import Pipeline, pipeline

__all__ = ["Pipeline", "pipeline", "batch", "levenshtein_each", "thread_count", "configure_threads"]
