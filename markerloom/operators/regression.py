"""Logistic regression over markers, cells or any rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.plans.lineage import stored
from markerloom.types import MarkerError

# Distance of a probability from 0 and 1, and the largest move of a coefficient at which steps end.
NEAR, LEAST_MOVE = 1e-10, 1e-8
INTERCEPT = "(intercept)"


@dataclass
class LogisticModel:
    """``terms`` (the intercept first), their ``coefficients`` and standard ``errors``, the log likelihood, the summed weight
    of the rows, and whether the steps came to rest."""

    terms: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    log_likelihood: float
    weight: float
    converged: bool

    def probability(self) -> Column:
        """The probability of label 1 for rows that have the features."""
        return _probability(self.terms[1:], self.coefficients)

    def to_dataframe(self, spark) -> DataFrame:
        """``term, coefficient, error``."""
        return spark.createDataFrame([(t, float(b), float(e)) for t, b, e in zip(self.terms, self.coefficients, self.errors)], "term string, coefficient double, error double")


def _columns(features: Sequence[str]) -> list[Column]:
    return [F.lit(1.0), *[F.col(x).cast("double") for x in features]]


def _probability(features: Sequence[str], beta: np.ndarray) -> Column:
    odds = sum((F.lit(float(b)) * x for b, x in zip(beta[1:], _columns(features)[1:])), F.lit(float(beta[0])))
    return F.least(F.greatest(1 / (1 + F.exp(-odds)), F.lit(NEAR)), F.lit(1 - NEAR))


def logistic(rows: DataFrame, label: str, features: Sequence[str], weight: str | None = None, *, steps: int = 100) -> LogisticModel:
    """The model of ``label`` (boolean, or 0 and 1) by ``features``, by Newton's method.

    Rows that agree in label and features are one row with their summed weight (so markers come to cells where features are
    those of cells), which is stored; a step sums the gradient and the upper triangle of the Hessian over them in the JVM, and
    the driver solves a system of as many equations as there are terms. A step that lowers the likelihood is halved. Of
    collinear features the shortest solution is taken; where a feature separates the labels the steps end at ``steps`` or
    where probabilities reach their bounds. Rows with a null in any of the columns, and those without weight, take no part;
    without rows the coefficients are 0 and the errors NaN."""
    if label in features or len(set(features)) != len(features):
        raise MarkerError("label and features must be distinct")
    if weight is None:
        rows, weight = rows.select(label, *features).withColumn("_weight", F.lit(1.0)), "_weight"
    y = F.col(label).cast("double")
    kept = rows.where(F.col(weight).cast("double") > 0).dropna(subset=[label, *features])
    alike = stored(kept.groupBy(y.alias("_y"), *[F.col(x).cast("double").alias(f"_x{k}") for k, x in enumerate(features)]).agg(F.sum(F.col(weight).cast("double")).alias("_w")), "logistic")
    names = [f"_x{k}" for k in range(len(features))]
    size, xs = len(names) + 1, _columns(names)
    upper = [(i, j) for i in range(size) for j in range(i, size)]

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
        mu, own = _probability(names, beta), F.col("_w")
        at = alike.select("*", mu.alias("_mu"))
        held, slope = own * (F.col("_y") - F.col("_mu")), own * F.col("_mu") * (1 - F.col("_mu"))
        fit = own * F.when(F.col("_y") > 0.5, F.log("_mu")).otherwise(F.log1p(-F.col("_mu")))
        found = at.agg(F.sum(fit), F.sum(own), *[F.sum(held * x) for x in xs], *[F.sum(slope * xs[i] * xs[j]) for i, j in upper]).first()
        values = np.array([x or 0.0 for x in found])
        hessian = np.zeros((size, size))
        for (i, j), v in zip(upper, values[2 + size :]):
            hessian[i, j] = hessian[j, i] = v
        return values[0], values[2 : 2 + size], hessian, values[1]

    bad = alike.where("_y NOT IN (0D, 1D)").limit(1).count()
    if bad:
        raise MarkerError("labels must be 0 and 1")
    beta, move, converged = np.zeros(size), np.zeros(size), False
    best, gradient, hessian, total = sums(beta)
    for _ in range(steps):
        move = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        now = sums(beta + move)
        while now[0] < best - 1e-12 * abs(best) and np.abs(move).max() >= LEAST_MOVE:
            move = move / 2
            now = sums(beta + move)
        beta = beta + move
        best, gradient, hessian, total = now
        if converged := bool(np.abs(move).max() < LEAST_MOVE):
            break
    errors = np.sqrt(np.diag(np.linalg.pinv(hessian))) if total else np.full(size, np.nan)
    return LogisticModel([INTERCEPT, *features], beta, errors, float(best), float(total), converged and total > 0)
