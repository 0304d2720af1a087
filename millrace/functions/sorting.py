"""Total orders of numbers and strings, as sort keys and as sorted DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number_key(col: Column | str) -> Column:
    """A BIGINT whose order is the total order of doubles: -NaN, -inf ... -0, +0 ... +inf, +NaN."""

    def bits(v: pa.Array) -> pa.Array:
        b = v.to_numpy(zero_copy_only=False).astype(np.float64).view(np.int64)
        key = b ^ ((b >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))
        return pa.array(key, mask=v.is_null().to_numpy(zero_copy_only=False))

    bits.__annotations__ = {"v": pa.Array, "return": pa.Array}
    return F.arrow_udf(bits, "bigint")(F.col(col) if isinstance(col, str) else col)


def sort_numbers(df: DataFrame, col: str) -> DataFrame:
    """df in the total order of a double column."""
    return df.orderBy(number_key(col))


def sort_strings(df: DataFrame, col: str) -> DataFrame:
    """df in the order of Unicode scalar values, which is that of UTF-8 bytes."""
    return df.orderBy(F.col(col))
