"""From a plan to Spark columns: static kind checks, native expressions at both ends, one fused Arrow UDF between."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidArg
from ..functions.kernel import ANY, BYTES, SPARK_TYPE, STR, Kernel, settled_udf
from .stages import Stage

MODES = ("failFast", "settled")
INPUT_KINDS = {"bytes": (BYTES,), "str": (STR,), "either": (BYTES, STR)}


@dataclass(frozen=True)
class Compiled:
    """Checked kernels, with the mode, the terminal and the kinds that go in and come out."""

    kernels: tuple[Kernel, ...]
    mode: str
    terminal: dict
    input_kind: str  # Bytes, Str or Either
    output_kind: str

    def accepts(self, kind: str) -> bool:
        return self.input_kind in (kind, "Either")


def _checked(stages: list[Stage], kind: str) -> tuple[tuple[Kernel, ...], str]:
    kernels = []
    for i, stage in enumerate(stages):
        try:
            k = stage.kernel()
        except InvalidArg as e:
            raise InvalidArg(f"stage {i} ({stage.op}): {str(e).removeprefix(f'{stage.op}: ')}") from None
        if k.takes not in (ANY, kind):
            raise InvalidArg(f"stage {i} ({stage.op}) expects {k.takes} input but receives {kind}")
        kernels.append(k)
        kind = k.out_kind
    return tuple(kernels), kind


def compile_plan(plan: str | dict | Compiled, input_kind: str = "either") -> Compiled:
    """Check a plan (JSON text or object) for items of a kind: 'bytes', 'str', or 'either' for what fits."""
    if isinstance(plan, Compiled):
        return plan
    if isinstance(plan, str):
        try:
            plan = json.loads(plan)
        except ValueError as e:
            raise InvalidArg(f"invalid plan JSON: {e}") from None
    if not isinstance(plan, dict) or not isinstance(plan.get("stages"), list) or not all(isinstance(s, dict) and "op" in s for s in plan["stages"]):
        raise InvalidArg("invalid plan JSON: expected an object with a list of stages")
    mode, terminal = plan.get("mode", "failFast"), plan.get("terminal", {"kind": "collect"})
    if mode not in MODES:
        raise InvalidArg(f"invalid plan JSON: unknown mode '{mode}'")
    if not isinstance(terminal, dict) or terminal.get("kind") not in ("collect", "count", "writeFiles") or (terminal["kind"] == "writeFiles" and not isinstance(terminal.get("dir"), str)):
        raise InvalidArg(f"invalid plan JSON: unknown terminal {terminal}")
    stages = [Stage(s["op"], {k: v for k, v in s.items() if k != "op"}) for s in plan["stages"]]
    found, first = {}, None
    for kind in INPUT_KINDS.get(input_kind, ()):
        try:
            found[kind] = _checked(stages, kind)
        except InvalidArg as e:
            first = first or e
    if input_kind not in INPUT_KINDS:
        raise InvalidArg(f"inputKind must be one of {', '.join(INPUT_KINDS)}, got '{input_kind}'")
    if not found:
        raise first
    kind = next(iter(found))
    kernels, out = found[kind]
    return Compiled(kernels, mode, terminal, "Either" if len(found) == 2 else kind, out)


def settled_columns(df: DataFrame, value: str, kernels: tuple[Kernel, ...], kind: str, error: str | None = None) -> DataFrame:
    """df with the column ``value`` put through the kernels and a column ``error``: null, or ``{op}: {cause}``.

    The native stages at the beginning and the end are Catalyst expressions; the rest is a single
    Arrow UDF, so that a row crosses to Python once at most. ``error`` names a column of earlier errors.
    """
    at = [i for i, k in enumerate(kernels) if k.native is None]
    first, last = (at[0], at[-1] + 1) if at else (len(kernels), len(kernels))
    failed = F.lit(None).cast("string") if error is None else F.col(error)
    df = df.select("*", failed.alias("__failed")) if error is None else df.withColumnRenamed(error, "__failed")

    def native(some: tuple[Kernel, ...]) -> None:
        nonlocal df
        for k in some:
            v, e = k.native(F.col(value))
            df = df.withColumns({value: v, "__failed": F.col("__failed") if e is None else F.coalesce("__failed", e)})

    native(kernels[:first])
    if first < last:
        df = df.withColumn("__r", settled_udf(list(kernels[first:last]))(F.col(value)))
        df = df.withColumns({value: F.col("__r.value"), "__failed": F.coalesce("__failed", "__r.error")}).drop("__r")
    native(kernels[last:])
    kind = kernels[-1].gives if kernels else SPARK_TYPE[kind]
    return df.withColumn(value, F.when(F.col("__failed").isNull(), F.col(value)).cast(kind)).withColumnRenamed("__failed", "error")


def strict(value: Column, error: Column, index: Column, kind: str) -> Column:
    """The value, failing the query with the item's index where there is an error."""
    return F.when(error.isNotNull(), F.raise_error(F.concat(F.lit("item "), index.cast("string"), F.lit(": "), error)).cast(kind)).otherwise(value)
