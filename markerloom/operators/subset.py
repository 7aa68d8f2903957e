"""Markers by how many individuals of each group have them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.plans.cells import cells, corrected, to_markers, with_fdr, with_statistics
from markerloom.table import MarkerTable
from markerloom.types import Correction, Test


def subset(table: MarkerTable, *, group1: str | None = None, group2: str | None = None, min_depth: int = 1, range1=(0, 9999), range2=(0, 9999), total=(0, 9999), statistics: bool = False, depths: bool = False, test: Test | str = "chisq", correction: Correction | str = "bonferroni") -> DataFrame:
    """Markers whose counts lie in the ranges (both ends included); ``statistics`` adds ``p, p_corrected``, which filter
    nothing, and ``depths`` keeps the arrays."""
    groups, correction = table.groups(group1, group2), Correction.of(correction)
    counts = table.counts_twice(min_depth, groups, depths) if statistics else table.counts(min_depth, groups, depths)
    inside = F.col("g1").between(*range1) & F.col("g2").between(*range2) & F.col("n_ind").between(*total)
    if not statistics:
        return counts.where("n_ind > 0").where(inside)
    stats = with_statistics(cells(counts), groups, test=test)
    stats = with_fdr(stats) if correction is Correction.FDR else stats
    kept = [c for c in ("ord", "id", "sequence", "depths", "entries") if c in counts.columns]
    return to_markers(counts.where(inside), stats, groups).select(*kept, "g1", "g2", "n_ind", "p", corrected(correction).alias("p_corrected"))
