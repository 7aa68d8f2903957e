"""Incremental counting of reads with Structured Streaming.

Reads are counted by sequence and individual with the running state that Spark keeps and checkpoints, so a restarted query
goes on where it stopped and no read counts twice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from markerloom.functions.sequences import normalised
from markerloom.sources.readers import from_long
from markerloom.table import MarkerTable
from markerloom.types import MAX_DEPTH


def running_counts(reads: DataFrame) -> DataFrame:
    """``sequence, individual, depth`` of a stream (or table) of ``individual, sequence``."""
    each = reads.select("individual", normalised(F.col("sequence")).alias("sequence"))
    return each.groupBy("sequence", "individual").agg(F.least(F.count("*"), F.lit(MAX_DEPTH)).cast("int").alias("depth"))


def ingest(reads: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query that writes changed counts of each batch to ``path/batch=N`` (a batch that is tried again replaces
    itself); ``trigger`` is passed on, e.g. ``availableNow=True``."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return running_counts(reads).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def ingested(spark, path: str, individuals: Sequence[str], popmap: Sequence[tuple[str, str]] = (), compact: str | None = None) -> MarkerTable:
    """The marker table of all batches so far; counts only grow, so the largest is the latest. ``compact`` writes it there."""
    rows = spark.read.parquet(path).groupBy("sequence", "individual").agg(F.max("depth").alias("depth"))
    if compact:
        rows.write.mode("overwrite").parquet(compact)
        rows = spark.read.parquet(compact)
    return from_long(rows.select(F.col("sequence").alias("id"), "sequence", "individual", "depth"), individuals, popmap)
