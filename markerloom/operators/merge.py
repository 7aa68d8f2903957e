"""Union of marker tables by sequence."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.functions.sequences import normalised
from markerloom.plans.lineage import stored
from markerloom.plans.presence import gathered
from markerloom.table import MarkerTable
from markerloom.types import MAX_DEPTH, MarkerError


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``ord`` from 0 in a total order, without a single-task sort: range partitions are sorted, counted and stored (their
    bounds are sampled, so they must be made once), and the partitions' sizes (one number each) make the offsets."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("within", F.monotonically_increasing_id() - F.shiftleft(F.col("part").cast("bigint"), 33))
    ordered = stored(ordered, "ordered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n")).collect()  # a row for each partition
    offset, offsets = 0, []
    for r in sorted(sizes, key=lambda r: r.part):
        offsets += [F.lit(r.part), F.lit(offset)]
        offset += r.n
    start = F.element_at(F.create_map(*offsets), F.col("part")) if offsets else F.lit(0)
    return ordered.withColumn("ord", (start + F.col("within")).cast("bigint")).drop("part", "within")


def merged_long(tables: Sequence[MarkerTable]) -> DataFrame:
    """``sequence, col, depth`` with depths of equal (normalised) sequences summed and clamped; columns keep their places,
    one after another, even where two tables have an individual of the same name."""
    if not tables:
        raise MarkerError("nothing to merge")
    parts, at = [], 0
    for t in tables:
        parts.append(t.depths("sequence").select(normalised(F.col("sequence")).alias("sequence"), (F.col("col") + at).alias("col"), "depth"))
        at += t.n_individuals
    return reduce(DataFrame.unionAll, parts).groupBy("sequence", "col").agg(F.least(F.sum("depth"), F.lit(MAX_DEPTH)).cast("int").alias("depth"))


def packed_order() -> list[Column]:
    """The order of merged markers: by the remainder of the length by 4, then by sequence."""
    return [F.length("sequence") % 4, F.col("sequence")]


def as_table(long: DataFrame, individuals: Sequence[str], order: Sequence[Column], layout: str) -> MarkerTable:
    """A table of markers that are numbered in this order, from ``sequence, col, depth``."""
    rows = numbered(gathered(long, "sequence"), *order).select("ord", F.col("ord").cast("string").alias("id"), "sequence", "entries")
    table = MarkerTable(rows, individuals, layout="sparse")
    return table if layout == "sparse" else table.arrays()


def merge(tables: Sequence[MarkerTable], layout: str = "array") -> MarkerTable:
    """One table of all individuals; ``layout`` is ``"array"`` or ``"sparse"``."""
    individuals = [x for t in tables for x in t.individuals]
    return as_table(merged_long(tables), individuals, packed_order(), layout)
