"""Candidates: markers that a strict test, a posterior probability or a Bayes factor calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.plans.cells import cells, to_markers, with_statistics
from markerloom.table import MarkerTable
from markerloom.types import single

#: Classes in the order of a ranking.
CLASSES = ("strict+posterior", "posterior_only", "strict_only", "bayes_factor_only", "exploratory")


def candidate_class(strict: Column, posterior: Column, factor: Column) -> Column:
    return F.when(strict & posterior, "strict+posterior").when(strict, "strict_only").when(posterior, "posterior_only").when(factor, "bayes_factor_only").otherwise("exploratory")


def triage(table: MarkerTable, *, group1: str | None = None, group2: str | None = None, min_depth: int = 1, threshold: float = 0.05, posterior_threshold: float = 0.9, bayes_factor_threshold: float = 10.0, prior: float = 0.01, linked: float = 0.9) -> DataFrame:
    """Twenty columns for each marker with at least one call; the strict one is chi-squared with Bonferroni's correction."""
    g = table.groups(group1, group2)
    counts = table.counts_twice(min_depth, g)
    stats = with_statistics(cells(counts), g, prior=prior, linked=linked)
    share1, share2 = (F.col(c) / F.lit(float(t)) if t else F.lit(0.0) for c, t in (("g1", g.total1), ("g2", g.total2)))
    strict = F.col("p") < F.lit(single(threshold)) / F.greatest("n_markers", F.lit(1))
    posterior, factor = F.col("posterior") > posterior_threshold, F.col("bayes_factor") > bayes_factor_threshold
    called = stats.where(strict | posterior | factor).select(
        "g1",
        "g2",
        F.lit(g.group1).alias("Group1"),
        F.col("g1").alias("Group1_Present"),
        F.lit(g.total1).alias("Group1_Total"),
        share1.alias("Group1_Penetrance"),
        F.lit(g.group2).alias("Group2"),
        F.col("g2").alias("Group2_Present"),
        F.lit(g.total2).alias("Group2_Total"),
        share2.alias("Group2_Penetrance"),
        F.when(share1 > share2, f"{g.group1}-biased").when(share2 > share1, f"{g.group2}-biased").otherwise("balanced").alias("Bias_Direction"),
        F.col("bias").alias("Bias"),
        F.col("p").alias("P"),
        F.col("bonferroni").alias("CorrectedP"),
        F.col("bayes_factor").alias("Bayes_Factor"),
        F.col("posterior").alias("Posterior_SexLinked"),
        strict.alias("Strict_Call"),
        posterior.alias("Posterior_Call"),
        factor.alias("Bayes_Factor_Call"),
        candidate_class(strict, posterior, factor).alias("Candidate_Class"),
    )
    return to_markers(counts, called, g).drop("g1", "g2", "n_ind", "ord")


def ranked(candidates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates with their ``rank`` from 1: by class, posterior, Bayes factor, difference of penetrance,
    then id."""
    place = F.array_position(F.lit(list(CLASSES)), F.col("Candidate_Class"))
    gap = F.abs(F.col("Group1_Penetrance") - F.col("Group2_Penetrance"))
    order = [place, F.desc("Posterior_SexLinked"), F.desc("Bayes_Factor"), gap.desc(), F.try_to_number("id", F.lit("9999999999999999999")).asc_nulls_last(), F.col("id")]
    best = candidates.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)))  # k rows
