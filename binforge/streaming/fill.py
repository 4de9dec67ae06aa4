"""Incremental histograms: the batch plan as a Structured Streaming query over a folder of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from binforge.sources.store import HistogramStore, file_of


def fill_stream(spark: SparkSession, folder: str, schema: StructType, plan: Callable[[DataFrame], DataFrame], *, name: str, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Aggregate new files as they appear; all sums only grow, so the complete result is the batch result so far.

    ``plan`` is a batch aggregation; the result is the in-memory table ``name``, a few thousand rows.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return plan(events).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_stream(spark: SparkSession, folder: str, schema: StructType, store: HistogramStore, plan: Callable[[DataFrame], DataFrame], *, checkpoint: str, files_per_trigger: int = 16) -> StreamingQuery:
    """Fill new files into ``store`` as they appear. The state is the store's files, not the stream's memory.

    ``plan`` makes a partial histogram of events. Batches that come again, also after a lost checkpoint, add nothing.
    """
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).select("*", file_of())
    return events.writeStream.foreachBatch(lambda df, _: store.add(df, plan)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
