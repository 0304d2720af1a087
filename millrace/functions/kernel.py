"""What every function of the engine is made of: an item function, and native Spark where it has the same meaning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Fault

BYTES, STR, ANY = "Bytes", "Str", "Any"
SPARK_TYPE = {BYTES: "binary", STR: "string"}
ARROW = {"binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "int": pa.int32(), "double": pa.float64()}


@dataclass(frozen=True)
class Kernel:
    """A configured function of one value (or of a pair).

    item maps Python values to a Python value and raises Fault. native, where Spark has an expression of
    the same meaning, maps columns to (value, error) columns, error being None where it cannot fail.
    """

    op: str
    takes: str
    gives: str  # a Spark type name
    item: Callable
    native: Callable[..., tuple[Column, Column | None]] | None = None
    arity: int = 1
    batch: Callable[..., list] | None = None  # the item function over lists, where that is faster; cannot fail
    stream: Callable | None = None  # the item function over an open file, in bounded memory
    config: dict = field(default_factory=dict, compare=False)

    @property
    def out_kind(self) -> str:
        return {"binary": BYTES, "string": STR}.get(self.gives, self.gives)


def as_bytes(v: bytes | str) -> bytes:
    return v.encode("utf-8", "surrogatepass") if isinstance(v, str) else v


def as_text(v: bytes | str) -> str:
    """Text of bytes that must be UTF-8."""
    if isinstance(v, str):
        return v
    try:
        return v.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Fault(f"invalid utf-8: {e}") from None


def run_items(kernels: list[Kernel], *columns: list) -> tuple[list, list]:
    """Values and errors ("op: cause") of rows of values, all rows through one kernel after another; null in, null out."""
    n = len(columns[0])
    values: list = [None] * n
    errors: list[str | None] = [None] * n
    live = [i for i, row in enumerate(zip(*columns)) if all(v is not None for v in row)]
    for step, k in enumerate(kernels):
        if step:
            live = [i for i in live if values[i] is not None]
        args = [[c[i] for i in live] for c in (columns if step == 0 else (values,))]
        if k.batch is not None:
            for i, v in zip(live, k.batch(*args)):
                values[i] = v
            continue
        item = k.item
        for i, row in zip(live, zip(*args)):
            try:
                values[i] = item(*row)
            except Fault as e:
                values[i], errors[i] = None, f"{k.op}: {e}"
    return values, errors


#: Bytes of input whose Python values are held at a time; Arrow batches are many times that.
AT_ONCE = 4 << 20


def slices(*arrays: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of runs of rows of up to AT_ONCE bytes, one row at least."""
    size = np.full(len(arrays[0]), 16, np.int64)
    for a in arrays:
        if pa.types.is_string(a.type) or pa.types.is_binary(a.type) or pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type):
            size += pc.fill_null(pc.binary_length(a), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        yield start, stop - start
        start = stop


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts) if parts else pa.array([], kind)


def settled_udf(kernels: list[Kernel]) -> Callable[..., Column]:
    """One Arrow UDF for a run of kernels: columns -> struct(value, error).

    It is marked non-deterministic, so that filters on the error do not make Spark run it twice.
    """
    gives = kernels[-1].gives

    def fields(*arrays: pa.Array) -> pa.Array:
        parts = []
        for at in slices(*arrays):
            values, errors = run_items(kernels, *(a.slice(*at).to_pylist() for a in arrays))
            parts.append(pa.StructArray.from_arrays([pa.array(values, ARROW[gives]), pa.array(errors, pa.string())], ["value", "error"]))
        return _joined(parts, pa.struct([("value", ARROW[gives]), ("error", pa.string())]))

    return _typed(fields, kernels[0].arity, f"struct<value {gives}, error string>").asNondeterministic()


def strict_udf(kernel: Kernel) -> Callable[..., Column]:
    """An Arrow UDF that fails the query at the first item that fails."""

    def values(*arrays: pa.Array) -> pa.Array:
        parts = []
        for at in slices(*arrays):
            out, errors = run_items([kernel], *(a.slice(*at).to_pylist() for a in arrays))
            for e in errors:
                if e is not None:
                    raise RuntimeError(e)
            parts.append(pa.array(out, ARROW[kernel.gives]))
        return _joined(parts, ARROW[kernel.gives])

    return _typed(values, kernel.arity, kernel.gives)


def _typed(function: Callable, arity: int, returns: str):
    """An Arrow UDF of one or two arguments, typed as Spark wants it."""
    if arity == 1:

        def one(a: pa.Array) -> pa.Array:
            return function(a)

        one.__annotations__ = {"a": pa.Array, "return": pa.Array}
        return F.arrow_udf(one, returns)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return function(a, b)

    two.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf(two, returns)


def column(kernel: Kernel, *cols: Column | str) -> Column:
    """The kernel as a column: native where possible; a failing item fails the query with its cause."""
    cols = tuple(F.col(c) if isinstance(c, str) else c for c in cols)
    if kernel.native is None:
        return strict_udf(kernel)(*cols)
    value, error = kernel.native(*cols)
    return value if error is None else F.when(error.isNotNull(), F.raise_error(error).cast(kernel.gives)).otherwise(value)


def faulty(op: str, ok: Column, value: Column, cause: str, *inputs: Column) -> tuple[Column, Column]:
    """(value, error) of an expression that fails where ok does not hold."""
    given = inputs[0].isNotNull()
    return F.when(ok, value), F.when(given & ~F.coalesce(ok, F.lit(False)), F.lit(f"{op}: {cause}"))
