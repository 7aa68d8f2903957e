"""A user's own folds, logistic regression and Arrow streams, against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from markerloom.functions import kernels
from markerloom.operators.folding import filter_map, fold
from markerloom.operators.pca import gram
from markerloom.operators.regression import INTERCEPT, logistic
from markerloom.results import Result
from markerloom.sources.stream import reader
from markerloom.table import MarkerTable
from markerloom.types import MarkerError
from tests import brute

PEOPLE = [("asp", "hill"), ("birch", "bog"), ("cedar", "hill"), ("elm", "bog"), ("fir", "bog")]


def made(n=90, seed=17):
    rng = random.Random(seed)
    return [(f"k{m}", "".join(rng.choice("ACGT") for _ in range(8)), [rng.choice((0, 0, 1, 3, 9)) for _ in PEOPLE]) for m in range(n)]


ROWS = made()


@pytest.fixture(scope="module")
def trees(spark):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "ord long, id string, sequence string, depths array<int>")
    return MarkerTable(df.repartitionByRange(11, "ord"), [x for x, _ in PEOPLE], PEOPLE)


def matrix(batch):
    return batch.column("depths").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(PEOPLE)).astype(np.int64)


@pytest.mark.parametrize("width", [2, 3, 16])
def test_fold_is_freq(trees, width):
    finish = lambda state: pa.table({"k": range(1, len(PEOPLE) + 1), "n": state[1:]})
    step = lambda state, b: state + np.bincount((matrix(b) > 0).sum(1), minlength=len(PEOPLE) + 1)
    got = fold(trees, lambda: np.zeros(len(PEOPLE) + 1, np.int64), step, np.add, finish, "k long, n long", width=width)
    assert sorted(map(tuple, got.collect())) == brute.freq(ROWS, len(PEOPLE))


def test_fold_is_gram(trees):
    i, j = np.triu_indices(len(PEOPLE))
    finish = lambda state: pa.table({"i": i, "j": j, "products": state[i, j]})
    got = trees.fold(lambda: 0, lambda s, b: s + matrix(b).T @ matrix(b), np.add, finish, "i long, j long, products long")
    assert {tuple(r) for r in got.collect()} == {(r.i, r.j, int(r.products)) for r in gram(trees).where("j >= 0").collect()}


@pytest.mark.parametrize("width", [2, 4])
def test_fold_keeps_the_order(trees, width):
    """Lists of ids, whose order shows that of the partitions."""
    finish = lambda state: pa.table({"id": pa.array(state, pa.string())})
    got = fold(trees, list, lambda s, b: s + b.column("id").to_pylist(), lambda a, b: a + b, finish, "id string", width=width)
    assert [r.id for r in got.collect()] == [i for i, *_ in ROWS]


def test_fold_of_nothing(spark, trees):
    none = MarkerTable(trees.df.where("ord < 0"), trees.individuals, trees.popmap)
    empty = MarkerTable(spark.createDataFrame([], trees.df.schema), trees.individuals, trees.popmap)
    for t in (none, empty):
        assert [r.n for r in t.fold(int, lambda s, b: s + b.num_rows, int.__add__, lambda s: pa.table({"n": [s]}), "n long").collect()] == [0]
        assert t.filter_map(lambda b: b.select(["id"]), "id string").count() == 0
    with pytest.raises(MarkerError):
        fold(trees, int, lambda s, b: s, int.__add__, lambda s: None, "n long", width=1)


def test_filter_map(trees):
    def f(batch):
        sums = matrix(batch).sum(1)
        return pa.table({"id": batch.column("id"), "total": sums}).filter(pa.array(sums > 12)) if len(sums) else None

    assert sorted(map(tuple, filter_map(trees, f, "id string, total long").collect())) == sorted((i, sum(d)) for i, _, d in ROWS if sum(d) > 12)
    assert trees.filter_map(lambda b: None, "id string").count() == 0


def weighted(n=400, seed=23):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a, b = rng.randint(0, 9), rng.random() * 3
        out.append((int(rng.random() < 1 / (1 + math.exp(1.5 - 0.4 * a + 0.7 * b))), a, b, rng.randint(1, 4)))
    return out


def test_logistic(spark):
    rows = weighted()
    df = spark.createDataFrame(rows, "y int, a int, b double, n int").repartition(5)
    model = logistic(df, "y", ["a", "b"], "n")
    x, y, w = np.array([r[1:3] for r in rows], float), np.array([r[0] for r in rows], float), np.array([r[3] for r in rows], float)
    assert model.terms == [INTERCEPT, "a", "b"] and model.converged and model.weight == w.sum()
    assert model.coefficients == pytest.approx(kernels.logistic_regression(x, y, w), abs=1e-8)
    full = np.hstack([np.ones((len(x), 1)), x])
    mu = 1 / (1 + np.exp(-full @ model.coefficients))
    assert full.T @ (w * (y - mu)) == pytest.approx(np.zeros(3), abs=1e-6)
    assert model.errors == pytest.approx(np.sqrt(np.diag(np.linalg.inv(full.T @ (full * (w * mu * (1 - mu))[:, None])))), rel=1e-6)
    assert model.log_likelihood == pytest.approx((w * np.log(np.where(y == 1, mu, 1 - mu))).sum())
    assert [r.p for r in df.select("a", model.probability().alias("p")).sort("a").limit(1).collect()][0] > 0
    repeated = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "y int, a int, b double")
    assert logistic(repeated, "y", ["a", "b"]).coefficients == pytest.approx(model.coefficients, abs=1e-8)
    assert {r.term: r.coefficient for r in model.to_dataframe(spark).collect()} == dict(zip(model.terms, model.coefficients))


def test_logistic_cases(spark):
    """Nulls and rows without weight stay out; no rows, one label, separated and collinear features end."""
    rows = [(y == 1, float(a), b, n) for y, a, b, n in weighted()]
    schema = "y boolean, a double, b double, n int"
    clean = logistic(spark.createDataFrame(rows, schema), "y", ["a", "b"], "n")
    dirty = [*rows, (None, 1.0, 1.0, 1), (True, None, 1.0, 1), (True, 1.0, None, 1), (True, 90.0, 1.0, None), (True, 90.0, 1.0, 0)]
    assert logistic(spark.createDataFrame(dirty, schema), "y", ["a", "b"], "n").coefficients == pytest.approx(clean.coefficients, abs=1e-8)
    none = logistic(spark.createDataFrame([], schema), "y", ["a", "b"], "n")
    assert none.coefficients.tolist() == [0, 0, 0] and not none.converged and np.isnan(none.errors).all()
    apart = logistic(spark.createDataFrame([(a > 5, float(a), 0.0, 1) for a in range(11)], schema), "y", ["a"], steps=25)
    assert np.isfinite(apart.coefficients).all() and apart.coefficients[1] > 0 and apart.log_likelihood > -0.1
    twice = spark.createDataFrame([(*r, r[1]) for r in rows], schema + ", c double")
    both = logistic(twice, "y", ["a", "c", "b"], "n")
    assert both.coefficients[1] + both.coefficients[2] == pytest.approx(clean.coefficients[1], abs=1e-6)
    for bad in (["a", "a"], ["y"]):
        with pytest.raises(MarkerError):
            logistic(twice, "y", bad)
    with pytest.raises(MarkerError):
        logistic(spark.createDataFrame([(2, 1.0)], "y int, a double"), "y", ["a"])


def test_streams(spark, trees):
    df = spark.range(0, 1000, 1, 7).selectExpr("id", "cast(id as string) AS s", "array(id) AS a", "timestamp_seconds(id) AS t")
    stream = reader(df, rows=64)
    sizes, ids = [], []
    for b in stream:
        sizes.append(b.num_rows)
        ids += b.column("id").to_pylist()
    assert ids == list(range(1000)) and max(sizes) <= 64 and stream.schema.names == df.columns
    assert pa.RecordBatchReader.from_stream(Result(df)).read_all().num_rows == 1000
    assert reader(df.where("id < 0")).read_all().num_rows == 0
    got = pa.RecordBatchReader.from_stream(trees).read_all()
    assert sorted(got.column("asp").to_pylist()) == sorted(d[0] for *_, d in ROWS)
    assert pa.RecordBatchReader.from_stream(trees.pca(components=2)).read_all().num_rows == len(PEOPLE)
