"""Batch calls: lists in, lists out, on the cluster; and the size of the local session."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArg, ItemError
from ..functions import KERNELS
from ..functions.kernel import BYTES, STR, Kernel, settled_udf
from ..functions.sorting import sort_numbers, sort_strings

_BYTES_ONLY = ("sha256Hex", "blake3Hex", "xxh3Hex", "xxh64Hex")
_PAIRS = ("levenshtein", "similarity", "diff")
_threads: int | None = None


def own_session() -> SparkSession:
    """The session made when none is active, of as many threads as were configured."""
    threads = "*" if _threads is None else _threads
    return SparkSession.builder.master(f"local[{threads}]").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def configure_threads(n: int) -> None:
    """Threads of the session that will be made; once, and before there is a session."""
    global _threads
    if isinstance(n, bool) or not isinstance(n, int) or not 1 <= n <= 1024:
        raise InvalidArg(f"threads must be 1-1024, got {n}")
    if _threads is not None or SparkContext._active_spark_context is not None:
        raise RuntimeError("pool already initialized")
    _threads = n


def thread_count() -> int:
    """Tasks at a time: of the session there is, or of the one that would be made; none is made."""
    context = SparkContext._active_spark_context
    if context is not None:
        return context.defaultParallelism
    import os

    return _threads or len(os.sched_getaffinity(0))


def _frame(spark: SparkSession, kernel: Kernel, items: Sequence, other: Sequence | None) -> tuple[DataFrame, list[str]]:
    mixed = {isinstance(v, str) for v in items}
    for i, v in enumerate(items):
        if not isinstance(v, (str, bytes, bytearray)):
            raise InvalidArg(f"item {i}: expected bytes or a string")
        if kernel.takes == BYTES and isinstance(v, str) or kernel.takes == STR and not isinstance(v, str):
            raise InvalidArg(f"item {i}: expected {'bytes' if kernel.takes == BYTES else 'a string'}")
    binary = mixed != {True}
    rows = [(i, (v.encode() if isinstance(v, str) else bytes(v)) if binary else v) for i, v in enumerate(items)]
    if other is None:
        df = spark.createDataFrame(rows, f"item_index bigint, a {'binary' if binary and items else 'string'}")
        return df.repartition(min(len(rows), spark.sparkContext.defaultParallelism)) if len(rows) > 1 else df, ["a"]
    if len(other) != len(items):
        raise InvalidArg(f"arrays must have equal length, got {len(items)} and {len(other)}")
    rows = [(i, a, b) for (i, a), b in zip(rows, other)]
    df = spark.createDataFrame(rows, "item_index bigint, a string, b string")
    return df.repartition(min(len(rows), spark.sparkContext.defaultParallelism)) if len(rows) > 1 else df, ["a", "b"]


def batch(name: str, items: Sequence, *args, spark: SparkSession | None = None, **options) -> list:
    """A function over a list (pairs take their second list next), in the order of items; the lowest failing item is raised.

    ``name`` is a function's plan name, or sortNumbers or sortStrings.
    """
    spark = spark or SparkSession.getActiveSession() or own_session()
    if name in ("sortNumbers", "sortStrings"):
        kind, sort = ("double", sort_numbers) if name == "sortNumbers" else ("string", sort_strings)
        return [r[0] for r in sort(spark.createDataFrame([(v,) for v in items], f"v {kind}"), "v").collect()]
    if name not in KERNELS:
        raise InvalidArg(f"unknown function '{name}'")
    other, args = (args[0], args[1:]) if name in _PAIRS else (None, args)
    kernel = KERNELS[name](*args, **options)
    if name in _BYTES_ONLY and any(isinstance(v, str) for v in items):
        raise InvalidArg(f"{name}: items must be bytes")
    if not len(items) and not len(other or ()):
        return []
    df, cols = _frame(spark, kernel, items, other)
    if kernel.native is None:
        df = df.select("item_index", settled_udf([kernel])(*map(F.col, cols)).alias("r")).select("item_index", "r.value", "r.error")
    else:
        value, error = kernel.native(*map(F.col, cols))
        df = df.select("item_index", value.alias("value"), (F.lit(None).cast("string") if error is None else error).alias("error"))
    rows = sorted(df.collect(), key=lambda r: r[0])
    for r in rows:
        if r["error"] is not None:
            raise ItemError(r["item_index"], r["error"])
    return [bytes(r["value"]) if isinstance(r["value"], bytearray) else r["value"] for r in rows]


def levenshtein_each(a: Sequence[str], b: Sequence[str], spark: SparkSession | None = None) -> list[Future]:
    """Distances of pairs, each as a future; all are done by one Spark job."""
    if len(a) != len(b):
        raise InvalidArg(f"arrays must have equal length, got {len(a)} and {len(b)}")
    out: list[Future] = [Future() for _ in a]

    def work() -> None:
        try:
            for f, d in zip(out, batch("levenshtein", a, b, spark=spark)):
                f.set_result(d)
        except BaseException as e:  # handed to whoever waits for a result
            for f in out:
                if not f.done():
                    f.set_exception(e)

    pool = ThreadPoolExecutor(1)
    pool.submit(work)
    pool.shutdown(wait=False)
    return out
