"""Helpers shared by the corpus operators: tables, work folders, samples and Arrow text buffers."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only in local mode, where the machine is the cluster, is a folder made when none is set.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="millrace-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a parquet table in the shared folder: later plans start from files, not from lineage.

    The folder is removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables written on the way to a result that is itself written: removed as soon as that is there."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, label: str) -> DataFrame:
        self.tables.append(written(df, label))
        return self.tables[-1]

    def clear(self) -> None:
        for df in self.tables:
            sc = df.sparkSession.sparkContext
            for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
                where = sc._jvm.org.apache.hadoop.fs.Path(folder)
                where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
        self.tables.clear()


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that df does not have, whatever extra columns it carries."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name, k = f"_{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"_{base}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> str:
    """A column name quoted, so that dots in it are not read as fields."""
    return "`" + name.replace("`", "``") + "`"


def unit_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the values of the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def bounded_rows(df: DataFrame, key: str | tuple[str, ...], by: str, most: int, seed: int = 0, classes: int = 500) -> DataFrame:
    """About ``most`` rows of each value of ``by`` at any table size (never above twice that, but for chance).

    One narrow pass counts each value; a second keeps rows whose hash of ``key`` falls under
    the share wanted, so that what reaches the driver is bounded whatever the size of df. Rows of equal
    keys (one column or several) are kept or left together. Of more values than ``classes`` those of the most rows
    are taken (ties: the smaller value), so that neither the counts nor the sample grow with stray values.
    """
    counts = df.where(F.col(by).isNotNull()).groupBy(by).count().orderBy(F.col("count").desc(), by).limit(classes)
    counts = {r[0]: r[1] for r in counts.collect()}
    if not counts:
        return df.limit(0)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 1.2 * most / n))])
    return df.where(unit_hash(*map(F.col, (key,) if isinstance(key, str) else key), seed=seed) < share[F.col(by)])


# -- Arrow text buffers


def released(run: Callable) -> Callable:
    """An iterator function over Arrow arrays that gives its memory back to the machine at a partition's end.

    Python workers live on between stages, and what the allocators keep for later use would be counted to them.
    """

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    wrapped.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return wrapped


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``most`` bytes together; a longer text is alone in its range."""
    n = len(texts)
    if not n:
        return
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, stop
        start = stop


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after another, and the end of each text."""
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


def segment_sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of values over the segments that end at ``ends``; 0 for empty ones."""
    out = np.zeros((len(ends), *values.shape[1:]), np.float64)
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
    full = ends > starts
    if full.any():
        out[full] = np.add.reduceat(values, starts[full], axis=0, dtype=np.float64)
    return out
