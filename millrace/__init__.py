"""Batch text and bytes analytics on Spark."""

from .errors import InvalidArg, ItemError
from .operators import Pipeline, batch, configure_threads, levenshtein_each, pipeline, thread_count
from .operators.pipeline import run_collect, run_count, run_settled, run_stream, run_write_files
from .plans import compile_plan
from .sources import Files, expand_glob, files

__all__ = [
    "InvalidArg", "ItemError", "Pipeline", "pipeline", "batch", "levenshtein_each", "thread_count", "configure_threads",
    "compile_plan", "run_collect", "run_settled", "run_count", "run_write_files", "run_stream", "Files", "files", "expand_glob",
]
