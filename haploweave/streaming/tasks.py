"""A stream of task files, answered batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from .. import schemas


def stream_results(spark: SparkSession, engine, source: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every new JSON file of tasks in ``source`` is one micro-batch; ``sink`` gets its results. The checkpoint makes a batch repeatable."""
    tasks = spark.readStream.schema(schemas.TASKS).json(source)
    return tasks.writeStream.foreachBatch(lambda df, n: sink(engine.results(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
