"""Statistics by cell.

Everything that is computed for a marker depends only on its cell ``(g1, g2)``, so markers are counted by cell, statistics
are computed once for each cell, and a join brings them back to the markers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.functions import cell_columns
from markerloom.plans.lineage import stored
from markerloom.types import Correction, Groups, Test

#: A table of cells is broadcast up to so many possible cells (some 100 bytes each).
BROADCAST_CELLS = 500_000


def cells(counts: DataFrame) -> DataFrame:
    """``g1, g2, markers, n_markers`` of markers present anywhere; ``n_markers`` is the number of all of them. Cell (0, 0)
    holds markers of other groups only, and counts among the tests."""
    sums = counts.where("n_ind > 0").groupBy("g1", "g2").agg(F.count("*").alias("markers"))
    return sums.join(F.broadcast(sums.agg(F.sum("markers").alias("n_markers"))))  # one row


def with_statistics(rows: DataFrame, groups: Groups, *, test: Test | str = Test.CHISQ, prior: float | None = None, linked: float = 0.9) -> DataFrame:
    """``rows`` (with g1, g2, n_markers) with ``p``, ``bonferroni``, ``bias``, and ``bayes_factor`` and ``posterior`` where
    a prior is given. Rows should be cells, as Fisher's test takes a step for each table of the same margins."""
    t1, t2 = groups.total1, groups.total2
    share1, share2 = (F.col(c) / float(t) if t else F.lit(0.0) for c, t in (("g1", t1), ("g2", t2)))
    out = cell_columns.with_p(rows, t1, t2, Test.of(test)).withColumn("bias", share1 - share2)
    if prior is not None:
        out = cell_columns.with_bayes(out, t1, t2, prior, linked)
    return out.withColumn("bonferroni", F.least(F.lit(1.0), F.col("p") * F.col("n_markers")))


def with_fdr(stats: DataFrame) -> DataFrame:
    """Benjamini and Hochberg's q by cell: equal p-values share a rank, the number of markers up to them.

    Distinct p-values are sorted by range over all tasks; the ranks and minima of a task begin with what the tasks before
    (or after) it come to, one row for each task."""
    by_p = stats.groupBy("p").agg(F.sum("markers").alias("m"), F.first("n_markers").alias("n"))
    parts = stored(by_p.repartitionByRange("p").withColumn("part", F.spark_partition_id()), "p-values")
    own, tasks = W.partitionBy("part"), W.partitionBy(F.lit(0)).orderBy("part")  # a row for each task
    before = parts.groupBy("part").agg(F.sum("m").alias("sum")).select("part", (F.sum("sum").over(tasks) - F.col("sum")).alias("before"))
    rank = F.sum("m").over(own.orderBy("p").rowsBetween(W.unboundedPreceding, 0)) + F.col("before")
    ranked = parts.join(F.broadcast(before), "part").withColumn("q", F.try_divide(F.col("p") * F.col("n"), rank))  # no marker up to here has none
    after = ranked.groupBy("part").agg(F.min("q").alias("least")).select("part", F.min("least").over(tasks.rowsBetween(1, W.unboundedFollowing)).alias("after"))
    lowest = F.min("q").over(own.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, 0))
    q = stored(ranked.join(F.broadcast(after), "part").select(F.col("p").alias("p_of_q"), F.least(F.lit(1.0), lowest, F.col("after")).alias("fdr")), "q-values")
    small = q.count() <= BROADCAST_CELLS
    return stats.join(F.broadcast(q) if small else q, F.col("p") == F.col("p_of_q")).drop("p_of_q")


def corrected(correction: Correction) -> Column:
    return {Correction.BONFERRONI: F.col("bonferroni"), Correction.FDR: F.col("fdr"), Correction.NONE: F.col("p")}[correction]


def to_markers(counts: DataFrame, stats: DataFrame, groups: Groups) -> DataFrame:
    """Markers that are present anywhere, with the statistics of their cell."""
    small = (groups.total1 + 1) * (groups.total2 + 1) <= BROADCAST_CELLS
    return counts.where("n_ind > 0").join(F.broadcast(stats) if small else stats, ["g1", "g2"])
