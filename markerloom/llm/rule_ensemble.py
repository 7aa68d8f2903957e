"""Quality classifier: paths of small trees as conjunctive rules, weighted by a lasso logistic regression.

Statistics of a text are Spark column expressions. Boosted trees over a bounded sample of labelled rows yield candidate
rules (each path from a root), proximal gradient descent keeps few of them with a weight each, and the weighted rules are
compiled into one column expression, so that scoring is a projection without Python or a shuffle.

Defined cases: a null or empty text has the statistics of an empty one and gets a score; texts are read whole; of repeated
labels of a document the largest counts; null labels and null ids aren't learned from; without labelled rows, or with one
class only, the score is the share of label 1 (0.5 without any); repeated rows are scored each; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.line_rules import BLANKS, SYMBOLS, count_of
from markerloom.llm.shared import only, remainder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÆÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"
DEPTH, TREES, BINS, SHRINK = 3, 24, 32, 0.3


def statistics(docs: DataFrame, *kept: str) -> tuple[DataFrame, list[str]]:
    """The columns ``kept`` and the statistics of ``text``, whose names are returned too."""
    rows = docs.select(*kept, F.coalesce("text", F.lit("")).alias("text"))
    parts = rows.select(*kept, "text", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    chars, n, lines = F.greatest(F.length("text"), F.lit(1)), F.greatest(F.size("words"), F.lit(1)), F.greatest(F.size("lines"), F.lit(1))
    named = {
        "symbols": count_of(F.col("text"), SYMBOLS) / chars,
        "bars": count_of(F.col("text"), "|") / chars,
        "shouts": count_of(F.col("text"), "!") / chars,
        "upper": count_of(F.col("text"), UPPER) / chars,
        "digits": count_of(F.col("text"), "0123456789") / chars,
        "stops": count_of(F.col("text"), ".?!…") / n,
        "commas": count_of(F.col("text"), ",;:") / n,
        "word_length": F.length(F.array_join("words", "")) / n,
        "words": F.log1p(F.size("words").cast("double")),
        "distinct_words": F.size(F.array_distinct("words")) / n,
        "words_a_line": F.size("words") / lines,
        "distinct_lines": F.size(F.array_distinct("lines")) / lines,
        "ended_lines": F.size(F.filter("lines", lambda x: x.rlike("[.!?…\"'”»)]\\s*$"))) / lines,
    }
    return parts.select(*kept, *[c.cast("double").alias(f"s_{k}") for k, c in named.items()]), [f"s_{k}" for k in named]


@dataclass(frozen=True)
class Rule:
    """All of ``(statistic, at_most, value)`` hold: ``<= value`` if ``at_most``, else ``> value``."""

    terms: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for k, at_most, value in self.terms:
            out &= (x[:, k] <= value) if at_most else (x[:, k] > value)
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for k, at_most, value in self.terms:
            out = out & ((F.col(names[k]) <= value) if at_most else (F.col(names[k]) > value))
        return out


@dataclass
class Ensemble:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]]

    def column(self) -> Column:
        """The score as a column expression over the statistics."""
        total = F.lit(self.bias)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(self.names), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def grow(x: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, depth: int, terms: tuple = ()) -> tuple[list[Rule], list[tuple[np.ndarray, float]]]:
    """Rules for all nodes below the root of a regression tree, and the leaves as (rows, mean)."""
    best, where = 1e-9, None
    total, n = residual.sum(), len(residual)
    for k in range(x.shape[1]) if depth and n >= 8 else ():
        at = np.searchsorted(cuts[k], x[:, k], side="left")  # rows with x <= cuts[k][at]
        sums, sizes = (np.cumsum(np.bincount(at, weights=w, minlength=len(cuts[k]) + 1))[:-1] for w in (residual, None))
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((sizes > 3) & (n - sizes > 3), sums**2 / sizes + (total - sums) ** 2 / (n - sizes) - total**2 / n, 0)
        if len(gain) and gain.max() > best:
            best, where = gain.max(), (k, float(cuts[k][gain.argmax()]))
    if where is None:
        return [], [(np.arange(n), residual.mean() if n else 0.0)]
    k, value = where
    rules, leaves = [], []
    for at_most in (True, False):
        mine = np.flatnonzero((x[:, k] <= value) == at_most)
        own = (*terms, (k, at_most, value))
        rules.append(Rule(own))
        more, ends = grow(x[mine], cuts, residual[mine], depth - 1, own)
        rules += more
        leaves += [(mine[rows], v) for rows, v in ends]
    return rules, leaves


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Bias and weights that minimise the mean logistic loss plus ``penalty * |weights|_1`` (accelerated proximal gradient)."""
    n, p = z.shape
    full = np.hstack([np.ones((n, 1)), z])
    step = 4 * n / max(np.linalg.norm(full, 2) ** 2, 1e-9)
    w = np.zeros(p + 1)
    v, t = w, 1.0
    for _ in range(steps):
        u = v - step * full.T @ (1 / (1 + np.exp(-np.clip(full @ v, -50, 50))) - y) / n
        u[1:] = np.sign(u[1:]) * np.maximum(np.abs(u[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t2 * (u - w), u, t2
    return float(w[0]), w[1:]


def learn(x: np.ndarray, y: np.ndarray, names: list[str], *, penalty: float = 3e-4, seed: int = 7) -> Ensemble:
    """A rule ensemble from statistics and 0/1 labels."""
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
        return Ensemble(names, float(np.log(share / (1 - share))), [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, BINS))) for k in range(x.shape[1])]
    found: dict[Rule, None] = {}
    margin = np.zeros(len(y))
    for _ in range(TREES):
        rows = rng.permutation(len(y))[: max(8, len(y) * 7 // 10)]
        rules, _ = grow(x[rows], cuts, (y - 1 / (1 + np.exp(-margin)))[rows], DEPTH)
        found |= dict.fromkeys(rules)
        _, leaves = grow(x, cuts, y - 1 / (1 + np.exp(-margin)), DEPTH)
        for mine, value in leaves:
            margin[mine] += SHRINK * 4 * value
    rules = list(found)
    z = np.stack([r.holds(x) for r in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    bias, weights = lasso_logistic(z, y, penalty)
    return Ensemble(names, bias, [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, *, folds: int = 5, train_rows: int = 20_000) -> Ensemble:
    """Learn ``labels.quality`` of documents outside fold 0 from at most about ``train_rows`` labelled documents (the
    documented bound of the sample), which a hash of their id chooses."""
    known = only(labels, doc_id=F.col("doc_id").cast("long"), quality=F.col("quality")).where((remainder(F.col("doc_id"), folds) != 0) & F.col("quality").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, train_rows / max(n, 1))))
    rows = only(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).join(F.broadcast(drawn), "doc_id")  # about train_rows rows at most
    stats, names = statistics(rows, "doc_id", "quality")
    table = np.array([tuple(r) for r in stats.drop("doc_id").collect()], float).reshape(-1, len(names) + 1)
    table = table[np.lexsort(table.T)]  # the same model for any order of the rows
    return learn(table[:, 1:], table[:, 0], names)


def score(docs: DataFrame, model: Ensemble, *, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row."""
    rows = only(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    stats, _ = statistics(rows, "doc_id")
    scored = stats.select("doc_id", (remainder(F.col("doc_id"), folds) == 0).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, model: Ensemble, *, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with their columns, that score at least ``threshold``."""
    names = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").alias("text"))
    stats, _ = statistics(whole, "row")
    return stats.where(model.column() >= threshold).select("row.*")
