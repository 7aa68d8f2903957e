"""Sequencing depth of each individual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.plans.lineage import stored
from markerloom.table import MarkerTable
from markerloom.types import MarkerError, least_individuals


def depth(table: MarkerTable, *, min_frequency: float = 0.75, strict: bool = False) -> DataFrame:
    """``Sample, Group, Reads, Markers, Retained, Min_depth, Max_depth, Median_depth, Average_depth`` for each individual.

    Retained markers are those in ``min_frequency`` of the individuals; their statistics include depths of 0. The median
    is the upper one and the average is rounded down. Depths are first counted by individual and value, of which there are
    65,536 at most, so that no task holds the depths of an individual. ``strict`` refuses a table that retains nothing."""
    least = least_individuals(min_frequency, table.n_individuals)
    n_ind = F.col("n_ind")
    if table.layout == "bits":
        raise MarkerError("a packed table has no depths")
    if table.layout == "long":
        # How many have a marker, and its first row, come with the rows themselves: one shuffle of the table by marker.
        same = W.partitionBy("id", "sequence")
        each = table.df.where("depth > 0").select("individual", "depth", F.count("*").over(same).alias("n_ind"), F.row_number().over(same.orderBy("individual")).alias("place"))
        rows = each.select("individual", "depth", (n_ind >= least).alias("retained"), (F.col("place") == 1).cast("bigint").alias("first"))
        total = None
    else:
        counted = table.counts()
        # With a threshold of 0, markers that nobody has are retained too, where the layout has rows for them.
        total = counted.agg(F.count_if(n_ind >= least).alias("n_retained"))
        if table.layout == "array":
            each = table.df.select(F.size(F.filter("depths", lambda d: d >= 1)).alias("n_ind"), F.posexplode("depths").alias("pos", "depth")).where("depth > 0")
        else:
            each = table.df.select(F.size("entries").alias("n_ind"), F.explode("entries").alias("e")).select("n_ind", F.col("e.col").alias("pos"), "e.depth")
        rows = each.select(F.col("pos").alias("individual"), "depth", (n_ind >= least).alias("retained"), F.lit(0).cast("bigint").alias("first"))
    values = stored(rows.groupBy("individual", "depth", "retained").agg(F.count("*").alias("n"), F.sum("first").alias("first")), "depth-counts")  # 131,072 rows an individual at most
    total = values.agg(F.coalesce(F.sum(F.when(F.col("retained"), F.col("first"))), F.lit(0)).alias("n_retained")) if total is None else total
    sums = values.groupBy("individual").agg(F.sum(F.col("n") * F.col("depth")).alias("Reads"), F.sum("n").alias("Markers"))
    running = F.sum("n").over(W.partitionBy("individual").orderBy("depth").rowsBetween(W.unboundedPreceding, 0))
    ranked = values.where("retained").withColumn("upto", running).join(F.broadcast(total))
    present = F.sum("n").over(W.partitionBy("individual"))
    ranked = ranked.withColumn("zeros", F.col("n_retained") - present)
    middle = F.expr("n_retained div 2")
    stats = ranked.groupBy("individual").agg(
        F.when(F.first("zeros") > 0, 0).otherwise(F.min("depth")).alias("Min_depth"),
        F.max("depth").alias("Max_depth"),
        F.coalesce(F.min(F.when(F.col("upto") + F.col("zeros") > middle, F.col("depth"))), F.lit(0)).alias("above"),
        F.first(F.col("zeros") > middle).alias("low"),
        F.sum(F.col("n") * F.col("depth")).alias("sum"),
    )
    group = dict(table.popmap)
    people = table.spark.createDataFrame([(i, x, group.get(x, "")) for i, x in enumerate(table.individuals)], "pos int, Sample string, Group string")
    who = F.col("Sample" if table.layout == "long" else "pos")
    out = people.join(sums, who == sums["individual"], "left").drop("individual").join(stats, who == stats["individual"], "left").join(F.broadcast(total))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    out = out.select(
        "pos",
        "Sample",
        "Group",
        number(F.col("Reads")).alias("Reads"),
        number(F.col("Markers")).alias("Markers"),
        F.col("n_retained").alias("Retained"),
        number(F.col("Min_depth")).alias("Min_depth"),
        number(F.col("Max_depth")).alias("Max_depth"),
        number(F.when(F.col("low"), 0).otherwise(F.col("above"))).alias("Median_depth"),
        number(F.expr("sum div greatest(n_retained, 1)")).alias("Average_depth"),
    )
    if strict and table.individuals and out.where("Retained = 0").limit(1).count():
        raise MarkerError("no marker is frequent enough to be retained")
    return out.drop("pos")
