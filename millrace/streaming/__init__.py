"""Pipelines over Structured Streaming.

Every stage looks at one item alone, so a plan is a projection of a streaming DataFrame as it is of a batch one: no
watermark, no state and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.pipeline import Pipeline


def apply(stream: DataFrame, chain: Pipeline, column: str = "value") -> DataFrame:
    """The stream with ``column`` put through the chain; in settled mode with a column error."""
    return chain.to_df(stream, column=column)


def write_parquet(stream: DataFrame, chain: Pipeline, path: str, checkpoint: str, column: str = "value") -> StreamingQuery:
    """Run the chain over a stream into Parquet files, exactly once, for all that is there now."""
    return apply(stream, chain, column).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
