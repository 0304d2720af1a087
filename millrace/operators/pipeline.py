"""The fluent, immutable pipeline and its terminals."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator, Sequence
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, replace
from itertools import chain, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidArg, ItemError
from ..functions.kernel import ANY, ARROW, AT_ONCE, BYTES, SPARK_TYPE, STR, Kernel, as_bytes, run_items, slices
from ..plans import STAGES, Compiled, Stage, compile_plan, settled_columns
from ..plans.compile import strict
from ..sources import Files, item_kind, items_frame, paths_frame, read_file

Source = Sequence[bytes | str] | Files | DataFrame


def _session(spark: SparkSession | None) -> SparkSession:
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        from .batch import own_session

        spark = own_session()
    return spark


def settled_frame(source: Source, plan: Compiled, spark: SparkSession | None = None, column: str = "value") -> DataFrame:
    """(item_index, value, error) of a source put through a plan; other columns of a DataFrame source stay.

    A DataFrame needs item_index only for terminals that name items; errors read ``{op}: {cause}``.
    """
    if isinstance(source, DataFrame):
        kind = {"binary": BYTES, "string": STR}.get(dict(source.dtypes).get(column))
        if kind is None:
            raise InvalidArg(f"column '{column}' must be binary or string")
        _accept(plan, kind)
        return settled_columns(source, column, plan.kernels, kind)
    spark = _session(spark)
    if isinstance(source, Files):
        _accept(plan, BYTES)
        # the stages up to the last in Python run where the files are read
        own = max((i + 1 for i, k in enumerate(plan.kernels) if k.native is None or (not i and k.stream is not None)), default=0)
        df = _read(source.frame if source.frame is not None else paths_frame(spark, source.resolve()), list(plan.kernels[:own]))
        kind = plan.kernels[own - 1].out_kind if own else BYTES
        return settled_columns(df, "value", plan.kernels[own:], kind, "unread").select("item_index", "value", "error")
    if isinstance(source, (str, bytes)) or not isinstance(source, Sequence):
        raise InvalidArg("expected a list of bytes or strings, a DataFrame, or a files() source")
    kind = item_kind(source) or (STR if plan.input_kind == STR else BYTES)
    _accept(plan, kind)
    return settled_columns(items_frame(spark, source, kind), "value", plan.kernels, kind)


def _accept(plan: Compiled, kind: str) -> None:
    if not plan.accepts(kind):
        raise InvalidArg(f"plan expects {plan.input_kind} items but receives {kind}")


#: The longest value of a row.
_LONGEST = (1 << 31) - (1 << 16)


def _read(df: DataFrame, kernels: list[Kernel]) -> DataFrame:
    """(item_index, value, unread) of (item_index, path): files read and put through kernels one after another.

    A worker holds one file, and results of AT_ONCE bytes; not even the file where the first kernel can stream it.
    """
    gives = kernels[-1].gives if kernels else "binary"

    def one(path: str | None) -> tuple:
        if path is None:
            return None, None
        try:
            if kernels and kernels[0].stream is not None:
                with open(path, "rb") as f:
                    values, rest = [kernels[0].stream(f)], kernels[1:]
            else:
                values, rest = [read_file(path)], kernels
        except OSError as e:
            return None, f"readFile '{path}': {e.strerror or e}"
        errors = [None]
        if rest:
            values, errors = run_items(rest, values)
        if isinstance(values[0], (bytes, str)) and len(values[0]) > _LONGEST // 4 and len(as_bytes(values[0])) > _LONGEST:
            return None, f"readFile '{path}': a value of {len(as_bytes(values[0]))} bytes is too long for a row"
        return values[0], errors[0]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for i, path in zip(*(c.to_pylist() for c in batch.columns)):
                value, error = one(path)
                size = len(value) if isinstance(value, (bytes, str)) else 0
                if rows and held + size > AT_ONCE:
                    yield packed(rows)
                    rows, held = [], 0
                rows.append((i, value, error))
                held += size + 64
            if rows:
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        index, values, errors = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(values, ARROW[gives]), pa.array(errors, pa.string())], ["item_index", "value", "unread"])

    return df.select("item_index", "path").mapInArrow(read, f"item_index bigint, value {gives}, unread string")


def _raise_first(df: DataFrame) -> None:
    """Raise the failure of the lowest index, if there is one."""
    low = df.where(F.col("error").isNotNull()).agg(F.min(F.struct("item_index", "error")).alias("m")).first()["m"]
    if low is not None:
        raise ItemError(low["item_index"], low["error"])


def _plain(v):
    return bytes(v) if isinstance(v, bytearray) else v


def run_collect(plan: Compiled, source: Source, spark: SparkSession | None = None) -> list:
    """Values in the order of items; the failing item of the lowest index is raised."""
    rows = sorted(settled_frame(source, plan, spark).select("item_index", "value", "error").collect(), key=lambda r: r[0])
    for r in rows:
        if r["error"] is not None:
            raise ItemError(r["item_index"], r["error"])
    return [_plain(r["value"]) for r in rows]


def run_settled(plan: Compiled, source: Source, spark: SparkSession | None = None) -> list[dict]:
    """For each item {ok, value} or {ok, error}."""
    rows = sorted(settled_frame(source, plan, spark).select("item_index", "value", "error").collect(), key=lambda r: r[0])
    return [{"ok": True, "value": _plain(r["value"])} if r["error"] is None else {"ok": False, "error": f"item {r['item_index']}: {r['error']}"} for r in rows]


def run_count(plan: Compiled, source: Source, spark: SparkSession | None = None) -> int:
    """Number of items, every stage of each evaluated; in settled mode that of successes."""
    df = settled_frame(source, plan, spark)
    index = F.col("item_index") if "item_index" in df.columns else F.lit(0).cast("bigint")
    # the sums depend on value and error, so that no stage is pruned away
    n = df.agg(
        F.count(F.when(F.col("error").isNull(), 1)).alias("ok"),
        F.min(F.when(F.col("error").isNotNull(), F.struct(index.alias("i"), F.col("error").alias("e")))).alias("bad"),
        F.count("value").alias("seen"),
    ).first()
    if plan.mode == "failFast" and n["bad"] is not None:
        raise ItemError(n["bad"]["i"], n["bad"]["e"])
    return n["ok"]


def writing_frame(plan: Compiled, source: Source, spark: SparkSession | None = None) -> DataFrame:
    """(item_index, path, error): a lazy frame whose rows are there once their files are. Nothing is gathered on the driver.

    Item i is written at {dir}/{i}{ext} on a file system that all executors share, under another name first, so that a
    task may run twice.
    """
    if plan.terminal.get("kind") != "writeFiles":
        raise InvalidArg("runPipelineWriteFiles needs a plan whose terminal is writeFiles, with a dir")
    folder, ext = plan.terminal["dir"], plan.terminal.get("ext", "")
    try:
        os.makedirs(folder, exist_ok=True)
    except OSError as e:
        raise RuntimeError(f"writeFiles: cannot create dir '{folder}': {e}") from None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in slices(batch.column(1)):
                index, values, errors = (c.slice(*at).to_pylist() for c in batch.columns)
                paths: list[str | None] = [None] * len(index)
                for n, (i, value) in enumerate(zip(index, values)):
                    if errors[n] is not None or value is None:
                        continue
                    path = os.path.join(folder, f"{i}{ext}")
                    try:
                        with tempfile.NamedTemporaryFile(dir=folder, prefix=".", delete=False) as f:
                            f.write(as_bytes(value))
                        os.chmod(f.name, 0o644)
                        os.replace(f.name, path)
                        paths[n] = path
                    except OSError as e:
                        errors[n] = f"writeFiles: {e}"
                yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(paths, pa.string()), pa.array(errors, pa.string())], ["item_index", "path", "error"])

    df = settled_frame(source, plan, spark).select(F.col("item_index").cast("bigint").alias("item_index"), "value", "error")
    return df.mapInArrow(write, "item_index bigint, path string, error string")


def run_write_files(plan: Compiled, source: Source, spark: SparkSession | None = None) -> list[str]:
    """Write the items as :func:`writing_frame` says; the paths written, in the order of items."""
    rows = sorted(writing_frame(plan, source, spark).collect(), key=lambda r: r[0])
    if plan.mode == "failFast":
        for r in rows:
            if r["error"] is not None:
                raise ItemError(r["item_index"], r["error"])
    return [r["path"] for r in rows if r["path"] is not None]


def run_stream(plan: Compiled, source: Source, spark: SparkSession | None = None) -> Iterator[dict]:
    """Items as they are done, whichever partition is first: {index, value}, in settled mode {index, ok, value or error}.

    As many partitions are under way as tasks run at a time; the next begins when one has been taken.
    """
    rows = settled_frame(source, plan, spark).select("item_index", "value", "error").rdd
    context, todo = rows.context, iter(range(rows.getNumPartitions()))
    pool, running = ThreadPoolExecutor(max(1, context.defaultParallelism)), set()
    try:
        while True:
            running |= {pool.submit(context.runJob, rows, list, [p]) for p in islice(todo, context.defaultParallelism - len(running))}
            if not running:
                return
            done, running = wait(running, return_when=FIRST_COMPLETED)
            for r in chain.from_iterable(f.result() for f in done):
                if r["error"] is None:
                    yield {"index": r["item_index"], "value": _plain(r["value"])} | ({"ok": True} if plan.mode == "settled" else {})
                elif plan.mode == "settled":
                    yield {"index": r["item_index"], "ok": False, "error": f"item {r['item_index']}: {r['error']}"}
                else:
                    raise ItemError(r["item_index"], r["error"])
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


@dataclass(frozen=True)
class Pipeline:
    """An immutable chain of stages; every method gives a new pipeline.

    Kinds are checked as stages are added: ``kind`` is the kind of the chain's end, ``inputs`` those it accepts.
    """

    stages: tuple[Stage, ...] = ()
    mode: str = "failFast"

    def stage(self, op: str, *args, **options) -> Pipeline:
        """Add a stage by its plan name; options by their plan or Python names, in order when positional."""
        spec = STAGES.get(op)
        if spec is None:
            raise InvalidArg(f"unknown op '{op}'")
        if len(args) > len(spec.options):
            raise InvalidArg(f"{op}: too many arguments")
        given = {plan: a for (plan, _), a in zip(spec.options, args) if a is not None}
        names = {py: plan for plan, py in spec.options} | {plan: plan for plan, _ in spec.options}
        for k, v in options.items():
            if k not in names:
                raise InvalidArg(f"{op}: unknown option '{k}'")
            if v is not None:
                given[names[k]] = v
        made = replace(self, stages=(*self.stages, Stage(op, given)))
        made.compiled()
        return made

    def settled(self) -> Pipeline:
        """Errors as data, for the whole chain."""
        return replace(self, mode="settled")

    def to_plan(self, terminal: dict | None = None) -> dict:
        return {"stages": [s.to_json() for s in self.stages], "mode": self.mode, "terminal": terminal or {"kind": "collect"}}

    def to_json(self, terminal: dict | None = None) -> str:
        return json.dumps(self.to_plan(terminal))

    def compiled(self, terminal: dict | None = None) -> Compiled:
        try:
            first = self.stages[0].kernel().takes if self.stages else ANY
        except InvalidArg:
            first = ANY  # compile_plan says which stage is wrong
        return compile_plan(self.to_plan(terminal), {BYTES: "bytes", STR: "str"}.get(first, "either"))

    def _ready(self, terminal: dict | None = None) -> Compiled:
        if not self.stages:
            raise InvalidArg("a pipeline needs a stage before it can run")
        return self.compiled(terminal)

    # terminals
    def run(self, source: Source, spark: SparkSession | None = None) -> list:
        return (run_settled if self.mode == "settled" else run_collect)(self._ready(), source, spark)

    def count(self, source: Source, spark: SparkSession | None = None) -> int:
        return run_count(self._ready({"kind": "count"}), source, spark)

    def _writing(self, dir: str, ext: str) -> Compiled:  # noqa: A002
        if not isinstance(dir, str) or not dir:
            raise InvalidArg("writeFiles: dir must be a non-empty string")
        if not isinstance(ext, str):
            raise InvalidArg("writeFiles: ext must be a string")
        return self._ready({"kind": "writeFiles", "dir": dir, "ext": ext})

    def write_files(self, source: Source, dir: str, ext: str = "", spark: SparkSession | None = None) -> list[str]:  # noqa: A002
        return run_write_files(self._writing(dir, ext), source, spark)

    def written_files(self, source: Source, dir: str, ext: str = "", spark: SparkSession | None = None) -> DataFrame:  # noqa: A002
        """write_files for more items than the driver can list: (item_index, path, error), written as it is read."""
        return writing_frame(self._writing(dir, ext), source, spark)

    def stream(self, source: Source, spark: SparkSession | None = None) -> Iterator[dict]:
        return run_stream(self._ready(), source, spark)

    def to_df(self, source: Source, spark: SparkSession | None = None, column: str = "value") -> DataFrame:
        """Lazy form, also of a streaming DataFrame: the columns of the source with the new value, and error in settled mode.

        In fail-fast mode reading the value of a failing item fails the query.
        """
        plan = self._ready()
        df = settled_frame(source, plan, spark, column)
        if self.mode == "settled":
            return df
        index = F.col("item_index") if "item_index" in df.columns else F.lit("?")
        kind = SPARK_TYPE.get(plan.output_kind, plan.output_kind)
        return df.withColumn(column, strict(F.col(column), F.col("error"), index, kind)).drop("error")


def _add(op: str):
    def method(self: Pipeline, *args, **options) -> Pipeline:
        return self.stage(op, *args, **options)

    method.__doc__ = f"Add the stage {op}."
    return method


for _op in STAGES:
    _name = "".join(f"_{c.lower()}" if c.isupper() else c for c in _op)
    setattr(Pipeline, _name, _add(_op))


def pipeline() -> Pipeline:
    """An empty pipeline."""
    return Pipeline()
