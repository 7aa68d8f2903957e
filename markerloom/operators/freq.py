"""Histogram of the number of individuals that have a marker."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.table import MarkerTable


def freq(table: MarkerTable, *, min_depth: int = 1) -> DataFrame:
    """``Frequency, Count`` for 1 to all individuals, empty bins included."""
    seen = table.counts(min_depth).where("n_ind > 0").groupBy("n_ind").agg(F.count("*").alias("n"))
    bins = table.spark.range(1, table.n_individuals + 1).select(F.col("id").cast("int").alias("Frequency"))
    return bins.join(seen, F.col("Frequency") == F.col("n_ind"), "left").select("Frequency", F.coalesce("n", F.lit(0)).alias("Count"))
