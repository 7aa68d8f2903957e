"""Markers that are associated with a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.plans.cells import cells, corrected, to_markers, with_fdr, with_statistics
from markerloom.table import MarkerTable
from markerloom.types import Correction, Test, single

PRIOR, LINKED = 0.01, 0.9


def signif(table: MarkerTable, *, group1: str | None = None, group2: str | None = None, min_depth: int = 1, threshold: float = 0.05, correction: Correction | str = "bonferroni", test: Test | str = "chisq", bayes: bool = False, depths: bool = True) -> DataFrame:
    """Markers below the threshold with ``g1, g2, p, p_corrected`` (and ``Bayes_Factor, Posterior_SexLinked``), and their
    depths if the table is of arrays. p-values are compared in single precision, q-values in double."""
    groups, correction = table.groups(group1, group2), Correction.of(correction)
    counts = table.counts_twice(min_depth, groups, depths)
    stats = with_statistics(cells(counts), groups, test=test, prior=PRIOR if bayes else None, linked=LINKED)
    limit = single(threshold)
    if correction is Correction.FDR:
        stats = with_fdr(stats).where(F.col("fdr") < limit)
    elif correction is Correction.BONFERRONI:
        stats = stats.where(F.col("p").cast("float") < (F.lit(limit) / F.greatest("n_markers", F.lit(1))).cast("float"))
    else:
        stats = stats.where(F.col("p").cast("float") < F.lit(limit).cast("float"))
    kept = [c for c in ("ord", "id", "sequence", "depths", "entries") if c in counts.columns]
    more = [F.col("bayes_factor").alias("Bayes_Factor"), F.col("posterior").alias("Posterior_SexLinked")] if bayes else []
    return to_markers(counts, stats, groups).select(*kept, "g1", "g2", F.col("p"), corrected(correction).alias("p_corrected"), *more)
