"""Layouts of a table agree in everything, and wide tables need no entry for each individual in a plan."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.operators.merge import merge
from markerloom.operators.pca import gram, pca, pca_by_passes, subspace
from markerloom.operators.process import process
from markerloom.plans import presence
from markerloom.table import MarkerTable
from markerloom.types import MarkerError

N = 130
PEOPLE = [(f"i{k:03d}", ["M", "F", "other"][k % 3]) for k in range(N)]


@pytest.fixture(scope="module")
def layouts(spark):
    rng = random.Random(3)
    rows = []
    for m in range(40):
        depths = [0] * N
        for k in rng.sample(range(N), rng.choice([0, 1, 64, 100, N])):
            depths[k] = rng.choice([1, 2, 9])
        rows.append((m, str(m), "ACGT"[m % 4] * (m + 1), depths))
    rows.append((40, "40", "AC", [0] * 63 + [5, 7] + [0] * (N - 65)))
    rows += [(m, str(m), "T" * m, [3 if k % 3 == 0 and k % 7 else 0 for k in range(N)]) for m in (41, 42, 43)]
    names = [x for x, _ in PEOPLE]
    array = MarkerTable(spark.createDataFrame(rows, "ord long, id string, sequence string, depths array<int>").repartition(3).cache(), names, PEOPLE)
    long = MarkerTable(array.long().cache(), names, PEOPLE, "long")
    return {"array": array, "long": long, "sparse": array.sparse(), "sparse from long": long.sparse(), "array from sparse": array.sparse().arrays()}


def rows_of(df, drop=("ord", "depths", "entries")):
    return sorted(repr(tuple(r)) for r in df.select(*sorted(c for c in df.columns if c not in drop)).collect())


@pytest.mark.parametrize("min_depth", [1, 2])
def test_layouts_agree(layouts, min_depth):
    both = {"group1": "M", "group2": "F", "min_depth": min_depth}
    calls = {
        "freq": lambda t: t.freq(min_depth=min_depth),
        "distrib": lambda t: t.distrib(**both, correction="fdr"),
        "signif": lambda t: t.signif(**both, correction="none", threshold=0.5),
        "subset": lambda t: t.subset(group1="M", group2="F", min_depth=min_depth, range1=(20, 60)),
        "triage": lambda t: t.triage(**both),
    }
    packed = {"packed": layouts["array"].packed(min_depth), "packed from long": layouts["long"].packed(min_depth)}
    for name, call in calls.items():
        expected = rows_of(call(layouts["array"]))
        assert expected, name
        for layout, t in (layouts | packed).items():
            assert rows_of(call(t)) == expected, (name, layout)


def test_depths_agree(layouts):
    expected = rows_of(layouts["array"].depth(min_frequency=0.4))
    for t in layouts.values():
        assert rows_of(t.depth(min_frequency=0.4)) == expected
    wide = {tuple(r.depths) for r in layouts["array"].df.collect()}
    assert {tuple(r.depths) for r in layouts["sparse"].arrays().df.collect()} == wide
    assert {tuple(r.depths) for r in layouts["long"].arrays().df.collect()} == {x for x in wide if any(x)}


def test_a_packed_table_has_one_depth_only(layouts):
    packed = layouts["array"].packed(2)
    with pytest.raises(MarkerError):
        packed.freq(min_depth=1)
    with pytest.raises(MarkerError):
        packed.depth()
    with pytest.raises(MarkerError):
        layouts["array"].packed(0)


def test_merge_and_process_in_both_layouts(spark, layouts):
    a, b = (merge([layouts["array"], layouts["sparse from long"]], layout) for layout in ("array", "sparse"))
    assert rows_of(a.df, ()) == rows_of(b.arrays().df, ()) and a.n_individuals == 2 * N
    rng = random.Random(5)
    reads = spark.createDataFrame([(f"p{rng.randrange(70):02d}", "".join(rng.choice("ACGT") for _ in range(3))) for _ in range(900)], "individual string, sequence string")
    a, b = (process(reads, min_depth=2, layout=layout) for layout in ("array", "sparse"))
    assert rows_of(a.df, ()) == rows_of(b.arrays().df, ()) and a.individuals == b.individuals


def test_components_by_passes_are_those_of_the_gram_matrix(layouts):
    dense, passes = pca(layouts["array"]), pca_by_passes(layouts["long"], components=5)
    expected, got = dense.components.limit(5).toPandas(), passes.components.toPandas()
    assert np.allclose(got["eigenvalue"], expected["eigenvalue"], rtol=1e-6) and np.allclose(got["variance_fraction"], expected["variance_fraction"], rtol=1e-6)
    assert passes.n_markers == dense.n_markers and np.isclose(passes.total_variance, dense.total_variance)
    a, b = (x.loadings.toPandas().set_index("individual").loc[[i for i, _ in PEOPLE]].to_numpy()[:, :3] for x in (dense, passes))
    assert np.abs(a - b).max() < 1e-5
    empty = MarkerTable(layouts["long"].df.limit(0), layouts["long"].individuals, PEOPLE, "long")
    assert [r.eigenvalue for r in pca_by_passes(empty, components=2).components.collect()] == [0.0, 0.0]


def test_gram_matrix_of_each_layout_takes_one_python_worker_a_task(layouts):
    expected = rows_of(gram(layouts["array"], 2))
    for name in ("array", "long", "sparse", "sparse from long"):
        got = gram(layouts[name], 2)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert rows_of(got) == expected, name


@pytest.mark.parametrize(("n", "r"), [(1, 1), (7, 7), (40, 3), (300, 5)])
def test_subspace_iteration(n, r):
    x = np.random.default_rng(n).normal(size=(n, n)) * np.linspace(2, 0.1, n)
    matrix = x.T @ x
    values, vectors = subspace(lambda v: matrix @ v, n, r)
    assert np.allclose(values, np.linalg.eigvalsh(matrix)[::-1][:r], rtol=1e-8)
    assert np.allclose(vectors.T @ vectors, np.eye(r), atol=1e-8) and np.abs(matrix @ vectors - vectors * values).max() < 1e-6 * values[0]


def test_masks_and_bits(spark):
    places = [0, 63, 64, 127, 129]
    row = spark.range(1).select(presence.mask(places, 130).alias("w")).select("w", *[presence.is_set(F.col("w"), F.lit(i)).alias(f"b{i}") for i in range(130)], presence.count_bits(F.col("w")).alias("n"), presence.count_bits(F.col("w"), presence.mask([63, 64, 65], 130)).alias("both")).first()
    assert [i for i in range(130) if row[f"b{i}"]] == places and (row.n, row.both) == (5, 2)


def test_a_hundred_thousand_individuals(spark):
    n = 100_000
    people = [(f"i{k}", "M" if k % 2 else "F") for k in range(n)]
    long = spark.range(600).select((F.col("id") % 3).cast("string").alias("id"), F.lit("ACGT").alias("sequence"), F.concat(F.lit("i"), F.floor(F.col("id") / 3) * 400 + F.col("id") % 3).alias("individual"), F.lit(2).alias("depth"))
    table = MarkerTable(long, [x for x, _ in people], people, "long").sparse(ordered=False)
    got = {r.Marker_id if "Marker_id" in r else r.id: (r.g1, r.g2) for r in table.counts(groups=table.groups()).collect()}
    assert got == {"0": (200, 0), "1": (0, 200), "2": (200, 0)}
    assert table.freq().where("Count > 0").collect() == [(200, 3)]
