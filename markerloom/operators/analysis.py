"""Summaries over the results of the other operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.functions import kernels
from markerloom.plans.cells import cells, with_statistics
from markerloom.table import MarkerTable
from markerloom.types import Groups


def evidence(stats: DataFrame) -> DataFrame:
    """One row over cells with statistics: markers, posterior mass, markers beyond thresholds, and the best cell."""
    n = F.col("markers")
    best = F.max_by(F.struct("g1", "g2", "markers", "posterior", "bayes_factor"), F.struct("posterior", "bayes_factor", "markers"))
    over = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    out = stats.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_markers"),
        F.coalesce(F.sum(n * F.col("posterior")), F.lit(0.0)).alias("posterior_mass"),
        over(F.col("bayes_factor") > 10).alias("bf_over_10"),
        over(F.col("bayes_factor") > 100).alias("bf_over_100"),
        over(F.col("posterior") > 0.5).alias("posterior_over_50"),
        over(F.col("posterior") > 0.9).alias("posterior_over_90"),
        best.alias("best"),
    )
    return out.select("*", *[F.col(f"best.{c}").alias(f"best_{c}") for c in ("g1", "g2", "markers", "posterior", "bayes_factor")]).drop("best")


def table_evidence(table: MarkerTable, *, group1: str | None = None, group2: str | None = None, min_depth: int = 1, prior: float = 0.01, linked: float = 0.9) -> DataFrame:
    groups = table.groups(group1, group2)
    return evidence(with_statistics(cells(table.counts(min_depth, groups)), groups, prior=prior, linked=linked))


def prior_sensitivity(cell_table: DataFrame, groups: Groups, priors: Sequence[float] = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1), linked: Sequence[float] = (0.7, 0.8, 0.9, 0.95), threshold: float = 0.9) -> DataFrame:
    """``prior, linked, n_over`` markers above the posterior threshold, for each pair of parameters; cells are read once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prior"), F.lit(float(q)).alias("linked")) for p in priors for q in linked]))
    rows = cell_table.select("g1", "g2", "markers", pairs.alias("x")).select("g1", "g2", "markers", "x.*")

    def posteriors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g1, g2, p, q = (b.column(c).to_pylist() for c in ("g1", "g2", "prior", "linked"))
            over = [kernels.posterior_linked(*x[:2], groups.total1, groups.total2, *x[2:]) > threshold for x in zip(g1, g2, p, q)]
            yield pa.RecordBatch.from_arrays([b.column("prior"), b.column("linked"), b.column("markers"), pa.array(over, pa.bool_())], ["prior", "linked", "markers", "over"])

    found = rows.mapInArrow(posteriors, "prior double, linked double, markers long, over boolean")
    return found.groupBy("prior", "linked").agg(F.coalesce(F.sum(F.when(F.col("over"), F.col("markers"))), F.lit(0)).alias("n_over"))


def prior_by_em(table: MarkerTable, *, group1: str | None = None, group2: str | None = None, min_depth: int = 1, linked: float = 0.9) -> float:
    """The empirical-Bayes prior of linkage, from cells weighted by their markers."""
    groups = table.groups(group1, group2)
    rows = cells(table.counts(min_depth, groups)).select("g1", "g2", "markers").collect()  # cells
    return kernels.expectation_maximisation([tuple(r) for r in rows], groups.total1, groups.total2, linked)[0]


def freq_summary(freq: DataFrame) -> DataFrame:
    """``n_markers, singletons, singleton_fraction`` of a histogram."""
    one = F.coalesce(F.sum(F.when(F.col("Frequency") == 1, F.col("Count"))), F.lit(0))
    return freq.agg(F.sum("Count").alias("n_markers"), one.alias("singletons"), F.coalesce(F.try_divide(one, F.sum("Count")), F.lit(0.0)).alias("singleton_fraction"))


def depth_summary(depth: DataFrame) -> DataFrame:
    """``Group, n_samples, mean_reads, mean_retained``."""
    return depth.groupBy("Group").agg(F.count("*").alias("n_samples"), F.avg("Reads").alias("mean_reads"), F.avg("Retained").alias("mean_retained"))


def distrib_summary(distrib: DataFrame) -> DataFrame:
    """``cells, significant_cells, significant_markers``."""
    return distrib.agg(F.count("*").alias("cells"), F.count_if("Signif").alias("significant_cells"), F.coalesce(F.sum(F.when(F.col("Signif"), F.col("Markers"))), F.lit(0)).alias("significant_markers"))


def signif_summary(signif: DataFrame) -> DataFrame:
    """``n_markers, bf_over_10, posterior_over_90`` of markers with Bayesian columns."""
    return signif.agg(F.count("*").alias("n_markers"), F.count_if(F.col("Bayes_Factor") > 10).alias("bf_over_10"), F.count_if(F.col("Posterior_SexLinked") > 0.9).alias("posterior_over_90"))


def depth_stability(runs: dict[int, DataFrame], modes: Sequence[str] = ("n_markers", "strict", "posterior", "bayes_factor")) -> DataFrame:
    """``min_depth`` and a column for each mode, from ``{min_depth: triage rows}``."""
    long = None
    for d, rows in runs.items():
        counts = rows.agg(F.count("*").alias("n_markers"), F.count_if("Strict_Call").alias("strict"), F.count_if("Posterior_Call").alias("posterior"), F.count_if("Bayes_Factor_Call").alias("bayes_factor"))
        part = counts.unpivot([], list(modes), "mode", "n").withColumn("min_depth", F.lit(d))
        long = part if long is None else long.unionByName(part)
    return long.groupBy("min_depth").pivot("mode", list(modes)).agg(F.first("n"))


def call_sets(candidates: DataFrame) -> DataFrame:
    """``both, strict_only, posterior_only, bayes_factor_only``: markers by which calls they have."""
    s, p, b = F.col("Strict_Call"), F.col("Posterior_Call"), F.col("Bayes_Factor_Call")
    return candidates.agg(F.count_if(s & p).alias("both"), F.count_if(s & ~p).alias("strict_only"), F.count_if(p & ~s).alias("posterior_only"), F.count_if(b & ~s & ~p).alias("bayes_factor_only"))


def joined_calls(strict: DataFrame, candidates: DataFrame) -> DataFrame:
    """Strict markers and candidates by id and sequence, with the strict flag of either."""
    a = strict.select("id", "sequence", F.lit(True).alias("strict_a"))
    b = candidates.select("id", "sequence", F.col("Strict_Call").alias("strict_b"), "Candidate_Class")
    return a.join(b, ["id", "sequence"], "full").select("id", "sequence", (F.coalesce("strict_a", F.lit(False)) | F.coalesce("strict_b", F.lit(False))).alias("Strict_Call"), "Candidate_Class")


def sex_system(candidates: DataFrame, male: str = "M", female: str = "F", ratio: float = 3.0) -> DataFrame:
    """``male_biased, female_biased, system``: XY where markers of males prevail ``ratio`` times, ZW where those of females
    do, whatever the groups are called."""
    m, f = F.count_if(F.col("Bias_Direction") == f"{male}-biased"), F.count_if(F.col("Bias_Direction") == f"{female}-biased")
    out = candidates.agg(m.alias("male_biased"), f.alias("female_biased"))
    m, f = F.col("male_biased"), F.col("female_biased")
    return out.withColumn("system", F.when((m == 0) & (f == 0), "none").when(m >= ratio * f, "XY").when(f >= ratio * m, "ZW").otherwise("ambiguous"))


def newest(rows: DataFrame, keys: Sequence[str], stamp: str) -> DataFrame:
    """Of rows with equal keys the one with the latest stamp."""
    order = W.partitionBy(*keys).orderBy(F.desc(stamp))
    return rows.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")


def loading_means(loadings: DataFrame, popmap: DataFrame) -> DataFrame:
    """Mean loading of each component by group."""
    pcs = [c for c in loadings.columns if c != "individual"]
    return loadings.join(F.broadcast(popmap), "individual").groupBy("grp").agg(*[F.avg(c).alias(c) for c in pcs])


def speedups(timings: DataFrame) -> DataFrame:
    """``command, n, wins, geomean`` from ``command, case, tool, seconds`` with the tools ``ours`` and ``theirs``."""
    wide = timings.groupBy("command", "case").pivot("tool", ["ours", "theirs"]).agg(F.min("seconds"))
    ratio = F.col("theirs") / F.col("ours")
    return wide.groupBy("command").agg(F.count("*").alias("n"), F.count_if(ratio > 1).alias("wins"), F.exp(F.avg(F.log(ratio))).alias("geomean"))


def elapsed(timings: DataFrame, *keys: str) -> DataFrame:
    """Runs and their total seconds by ``keys`` (the tool, if none is named)."""
    return timings.groupBy(*(keys or ("tool",))).agg(F.count("seconds").alias("runs"), F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"))


def prior_sweep(shards: Sequence[tuple[str, float, float, int, DataFrame]], posterior: float = 0.9, factor: float = 10.0) -> DataFrame:
    """``dataset, prior, linked, stamp, n_posterior, n_factor, n_strict`` of shards ``(dataset, prior, linked, stamp, triage
    rows)``: how many candidates each kind of call has; of shards with the same dataset and parameters the newest counts."""
    parts = [
        rows.agg(F.count_if(F.col("Posterior_SexLinked") > posterior).alias("n_posterior"), F.count_if(F.col("Bayes_Factor") > factor).alias("n_factor"), F.count_if("Strict_Call").alias("n_strict")).select(
            F.lit(dataset).alias("dataset"), F.lit(float(prior)).alias("prior"), F.lit(float(linked)).alias("linked"), F.lit(stamp).alias("stamp"), "n_posterior", "n_factor", "n_strict"
        )
        for dataset, prior, linked, stamp, rows in shards
    ]
    return newest(reduce(DataFrame.unionByName, parts), ["dataset", "prior", "linked"], "stamp")


def metadata(line: Column) -> Column:
    """The map of a ``#key:value;key:value`` line."""
    return F.str_to_map(F.regexp_replace(line, "^#", ""), F.lit(";"), F.lit(":"))
