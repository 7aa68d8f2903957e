"""Distribution of markers between two groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.plans.cells import BROADCAST_CELLS, cells, corrected, with_fdr, with_statistics
from markerloom.plans.lineage import stored
from markerloom.table import MarkerTable
from markerloom.types import Correction, Groups, Test, single


#: Cells of a row of the grid that are made together; cells of a task, about.
BLOCK, TASK_CELLS = 1 << 12, 4_000_000


def with_empty_cells(seen: DataFrame, groups: Groups) -> DataFrame:
    """``seen`` (g1, g2, markers, n_markers) and all other cells of two groups, which have no markers.

    The grid is as large as the product of both groups, so none of its cells is stored or shuffled: what is joined are blocks of
    cells with the cells seen in them, and a block's others are made where they are used. Nor are the blocks, a cell in ``BLOCK``,
    unless so many cells were seen that they can't be broadcast."""
    seen, spark = stored(seen, "cells"), seen.sparkSession
    few = seen.count() <= BROADCAST_CELLS
    total = seen.agg(F.coalesce(F.max("n_markers"), F.lit(0).cast("bigint")).alias("n_markers"))
    each, cells_of = groups.total2 // BLOCK + 1, (groups.total1 + 1) * (groups.total2 + 1)
    tasks = min(max(spark.sparkContext.defaultParallelism, cells_of // TASK_CELLS), 10_000)
    blocks = spark.range(0, (groups.total1 + 1) * each, 1, tasks).select(F.expr(f"cast(id div {each} as int)").alias("g1"), (F.col("id") % each).cast("int").alias("block"))
    taken = seen.groupBy("g1", F.expr(f"g2 div {BLOCK}").cast("int").alias("block")).agg(F.collect_list("g2").alias("taken"))  # a block's at most
    first = F.col("block") * BLOCK
    others = F.array_except(F.sequence(first, F.least(first + (BLOCK - 1), F.lit(groups.total2))), F.coalesce("taken", F.array().cast("array<int>")))
    met = blocks.join(F.broadcast(taken), ["g1", "block"], "left") if few else blocks.repartition(tasks, "g1", "block").join(taken, ["g1", "block"], "left")
    empty = met.select("g1", F.explode(others).alias("g2"), F.lit(0).cast("bigint").alias("markers"))
    return seen.unionByName(empty.join(F.broadcast(total)))


def distrib(table: MarkerTable, *, group1: str | None = None, group2: str | None = None, min_depth: int = 1, threshold: float = 0.05, test: Test | str = "chisq", correction: Correction | str = "bonferroni", empty_cells: bool = True) -> DataFrame:
    """``<group1>, <group2>, Markers, P, CorrectedP, Signif, Bias`` for each cell but (0, 0); ``empty_cells`` adds those
    without markers. FDR is what it says here: Benjamini and Hochberg's q over all markers."""
    groups, correction = table.groups(group1, group2), Correction.of(correction)
    seen = cells(table.counts(min_depth, groups))
    if empty_cells:
        seen = with_empty_cells(seen, groups)
    stats = with_statistics(seen, groups, test=test)
    limit = F.lit(single(threshold))
    if correction is Correction.FDR:
        stats = with_fdr(stats)
        called = F.col("fdr") < limit
    elif correction is Correction.BONFERRONI:
        called = F.col("p") < limit / F.greatest("n_markers", F.lit(1))
    else:
        called = F.col("p") < limit
    out = stats.where("g1 > 0 OR g2 > 0")
    return out.select(F.col("g1").alias(groups.group1), F.col("g2").alias(groups.group2), F.col("markers").alias("Markers"), F.col("p").alias("P"), corrected(correction).alias("CorrectedP"), called.alias("Signif"), F.col("bias").alias("Bias"))
