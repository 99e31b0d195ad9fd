"""Scoring a wide table as it arrives, a bounded number of files at a time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tablewright.operators.boosting import BoostedModel
from tablewright.operators.score import score_wide


def wide_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def score_stream(
    stream: DataFrame,
    model: BoostedModel,
    key: Sequence[str],
    features: Sequence[str],
    output: str,
    checkpoint: str,
    alias_map: Mapping[str, str] | None = None,
    fill: float | None = None,
    text: Sequence[str] = (),
) -> StreamingQuery:
    """Score what has arrived and append it to ``output``. Rows are independent: no state is kept.

    Runs until the present files are done; started again with the same checkpoint
    it scores only new ones.
    """
    scored = score_wide(stream, model, key, features, alias_map, fill, text)
    return (
        scored.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
