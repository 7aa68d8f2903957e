"""Commands and kernels against worked values."""

import gzip
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from markerloom.functions import cell_columns, kernels
from markerloom.functions.sequences import kmer_signature, normalised, reverse_complement
from markerloom.operators import analysis
from markerloom.operators.align import hits
from markerloom.operators.merge import merge
from markerloom.operators.process import process
from markerloom.operators.triage import ranked
from markerloom.sources import readers, writers
from markerloom.table import MarkerTable
from markerloom.types import Correction, MarkerError, Test, least_individuals, resolve_groups, single
from tests import brute

GROUPS = ("north", "south")
PEOPLE = [("kea", "north"), ("tui", "south"), ("moa", "north"), ("weka", "south"), ("ruru", "north"), ("pipit", "south"), ("kaka", "north")]


def made(n=24, seed=31):
    """Markers of this file: some biased, some rare, one that nobody has, with ids that are no numbers."""
    rng = random.Random(seed)
    rows = []
    for m in range(n):
        share = rng.choice([(0.95, 0.05), (0.1, 0.9), (0.5, 0.5), (1.0, 1.0)])
        depths = [rng.randint(1, 40) if rng.random() < share[g == "south"] else 0 for _, g in PEOPLE]
        rows.append((f"mk{m:02d}", "".join(rng.choice("ACGT") for _ in range(rng.randint(6, 11))), depths))
    return [*rows, ("mk-none", "TGCATGCA", [0] * len(PEOPLE))]


ROWS = made()


def table(spark, rows, popmap):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord long, id string, sequence string, depths array<int>")
    return MarkerTable(df, [x for x, _ in popmap], popmap)


@pytest.fixture(scope="module")
def small(spark):
    return table(spark, ROWS, PEOPLE)


EIGHT = [(f"{g[0]}{i}", g) for i in range(8) for g in ("reef", "lake")]
SPLIT = [("both", "ACCA", [7] * 16), ("reefers", "CATT", [4, 0] * 8), ("lakers", "GGTA", [0, 6] * 8), ("some", "TTTA", [3, 3, 0, 0] * 4)]


@pytest.fixture(scope="module")
def split(spark):
    """Two markers that one group alone has, and two that both have."""
    return table(spark, SPLIT, EIGHT)


def as_long(t, spark):
    return readers.from_long(t.long(), t.individuals, t.popmap)


# -- kernels ---------------------------------------------------------------------------------------------------------------


def test_cell_statistics():
    rng = random.Random(4)
    cells = [(0, 0, 4, 3), (4, 3, 4, 3), (1, 0, 1, 1), (4, 0, 4, 6), (25, 1, 30, 40)]
    for _ in range(150):
        t1, t2 = rng.randint(1, 30), rng.randint(1, 30)
        cells.append((rng.randint(0, t1), rng.randint(0, t2), t1, t2))
    close = lambda x: pytest.approx(x, rel=1e-6, abs=2e-16)
    for c in cells:
        x = brute.chi(*c)
        assert math.isnan(kernels.chi_squared_yates(*c)) if x is None else kernels.chi_squared_yates(*c) == close(x)
        assert kernels.p_chi_squared(*c) == pytest.approx(brute.p_chi(*c), rel=1e-6, abs=1e-14)
        assert kernels.p_g_test(*c) == pytest.approx(brute.p_g(*c), rel=1e-6, abs=1e-14)
        assert kernels.p_fisher(*c) == close(brute.p_exact(*c))
        assert kernels.bayes_factor(*c) == close(brute.factor(*c))
        assert kernels.posterior_linked(*c) == close(brute.posterior(*c))
        a, b, t1, t2 = c
        for f in (kernels.p_chi_squared, kernels.p_g_test, kernels.p_fisher, kernels.bayes_factor, kernels.posterior_linked):
            assert f(b, a, t2, t1) == pytest.approx(f(*c), rel=1e-9)


def test_general_format():
    # The format of C's %g.
    assert [kernels.general(x) for x in (2 / 3, 3.14e-7 / 3, 5.0, 0.0, -0.25, 123456789.0)] == ["0.666667", "1.04667e-07", "5", "0", "-0.25", "1.23457e+08"]


def test_p_values_have_a_floor_and_fall_with_bias():
    assert kernels.p_chi_squared(1000, 0, 1000, 1000) == 1e-16
    p = [kernels.p_chi_squared(k, 0, 20, 20) for k in range(21)]
    assert p == sorted(p, reverse=True)


def test_benjamini_hochberg():
    rng = random.Random(8)
    p = [rng.choice([rng.random(), 0.25]) for _ in range(40)]
    assert kernels.benjamini_hochberg(p) == pytest.approx(brute.adjusted(p)) and kernels.benjamini_hochberg([]) == []


def test_em_and_logistic():
    cells = [(9, 1, 8), (4, 5, 60), (0, 7, 3)]
    prior, found = kernels.expectation_maximisation(cells, 10, 8)
    # A fixed point: the mean posterior under the prior is the prior.
    mean = sum(n * brute.posterior(a, b, 10, 8, prior) for a, b, n in cells) / 71
    assert mean == pytest.approx(prior, abs=1e-6) and found == pytest.approx([brute.posterior(a, b, 10, 8, prior) for a, b, _ in cells])
    x, y, w = np.array([[0.0], [0.0], [2.0], [2.0]]), np.array([1, 0, 1, 0]), np.array([2, 6, 5, 1])
    beta = kernels.logistic_regression(x, y, w)  # saturated: the odds of each x are those that were seen
    assert [math.exp(beta[0]), math.exp(beta[0] + 2 * beta[1])] == pytest.approx([2 / 6, 5 / 1])


def test_upper_median():
    assert kernels.upper_median([]) == 0 and kernels.upper_median([1, 2, 3, 4]) == 3 and kernels.upper_median([3, 1, 2]) == 2


def test_names():
    assert Test.of("Chi2") is Test.CHISQ and Test.of("G") is Test.GTEST and Correction.of("BH") is Correction.FDR and Correction.of("disabled") is Correction.NONE
    for kind in (Test, Correction):
        with pytest.raises(MarkerError):
            kind.of("other")
    assert single(0.05) == 0.05000000074505806 and least_individuals(0.5, 5) == 2


# -- groups ----------------------------------------------------------------------------------------------------------------


def test_groups():
    g = resolve_groups(PEOPLE)
    assert (g.group1, g.group2, g.total1, g.total2) == ("north", "south", 4, 3)
    assert resolve_groups(PEOPLE, "south", "north").total1 == 3
    for bad in ([("a", "x")], [("a", "x"), ("b", "y"), ("c", "z")], [("a", "x"), ("a", "y")]):
        with pytest.raises(MarkerError):
            resolve_groups(bad)
    for names in (("north", "nowhere"), ("north", None), ("south", "south")):
        with pytest.raises(MarkerError):
            resolve_groups(PEOPLE, *names)


# -- commands --------------------------------------------------------------------------------------------------------------


def test_freq(small, spark):
    for t in (small, as_long(small, spark)):
        for least in (1, 12):
            assert [tuple(r) for r in t.freq(min_depth=least).orderBy("Frequency").collect()] == brute.freq(ROWS, len(PEOPLE), least)


def test_min_depth_is_checked(small):
    with pytest.raises(MarkerError):
        small.freq(min_depth=0)


@pytest.mark.parametrize("frequency", [0.2, 0.5, 0.9])
def test_depth(small, spark, frequency):
    for t in (small, as_long(small, spark)):
        assert sorted(tuple(r) for r in t.depth(min_frequency=frequency).collect()) == sorted(brute.depth(ROWS, PEOPLE, frequency))


def test_depth_without_a_threshold_or_a_marker(small, spark):
    assert sorted(tuple(r) for r in small.depth(min_frequency=0).collect()) == sorted(brute.depth(ROWS, PEOPLE, 0))
    lonely = table(spark, [("x", "A", [1, *[0] * 6])], PEOPLE)
    assert {(r.Retained, r.Median_depth) for r in lonely.depth(min_frequency=0.9).collect()} == {(0, 0)}
    with pytest.raises(MarkerError):
        lonely.depth(min_frequency=0.9, strict=True)


def test_depth_of_a_formula(spark):
    n = 20000
    depths = [F.pmod(F.col("id") * 5 + 3 * i * i, F.lit(17)).cast("int") for i in range(6)]
    rows = spark.range(n).select(F.col("id").alias("ord"), F.col("id").cast("string").alias("id"), F.lit("A").alias("sequence"), F.array(*depths).alias("depths"))
    people = [(f"p{i}", GROUPS[i % 2]) for i in range(6)]
    t = MarkerTable(rows, [x for x, _ in people], people)
    assert sorted(tuple(r) for r in t.depth(min_frequency=0.7).collect()) == sorted(brute.depth([(m, "A", [(5 * m + 3 * i * i) % 17 for i in range(6)]) for m in range(n)], people, 0.7))


def of_markers(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("test,p_of", [("chisq", brute.p_chi), ("gtest", brute.p_g), ("fisher", brute.p_exact)])
def test_distrib(small, spark, test, p_of):
    expected = brute.tested(ROWS, PEOPLE, GROUPS, 1, p_of)
    n = len(expected)
    for correction, place in (("none", 3), ("bonferroni", 4), ("fdr", 5)):
        by_cell = {}
        for x in expected.values():
            by_cell.setdefault(x[:2], []).append(x)
        for t in (small, as_long(small, spark)):
            got = {(r.north, r.south): r for r in t.distrib(test=test, correction=correction).collect()}
            assert len(got) == 5 * 4 - 1 and {c for c, r in got.items() if r.Markers} == set(by_cell) - {(0, 0)}
            for c, r in got.items():
                assert r.Markers == len(by_cell.get(c, [])) and r.Bias == pytest.approx(c[0] / 4 - c[1] / 3) and r.P == pytest.approx(p_of(*c, 4, 3))
                if c in by_cell:
                    assert r.CorrectedP == pytest.approx(by_cell[c][0][place])
                assert r.Signif == ((r.CorrectedP if correction == "fdr" else r.P) < single(0.05) / (n if correction == "bonferroni" else 1))
    swapped = {(r.south, r.north): r for r in small.distrib(group1="south", group2="north", test=test).collect()}
    assert all(swapped[r.south, r.north].P == pytest.approx(r.P) and swapped[r.south, r.north].Bias == pytest.approx(-r.Bias) for r in small.distrib(test=test).collect())


def test_fdr_over_many_p_values(spark):
    """Ranks and minima that go on from task to task."""
    people = [(f"p{i}", GROUPS[i % 2]) for i in range(60)]
    rng = random.Random(3)
    rows = [(str(m), "A", [int(rng.random() < (a, b)[i % 2]) for i in range(60)]) for m in range(300) for a, b in [(rng.random(), rng.random())]]
    expected = brute.tested(rows, people, GROUPS)
    for r in table(spark, rows, people).signif(correction="fdr", threshold=0.6, depths=False).repartition(7).collect():
        assert r.p_corrected == pytest.approx(expected[r.id][5])
    assert table(spark, rows, people).signif(correction="fdr", threshold=0.6).count() == sum(x[5] < single(0.6) for x in expected.values())


def test_signif(small, spark):
    for test, p_of in (("chisq", brute.p_chi), ("gtest", brute.p_g)):
        expected = brute.tested(ROWS, PEOPLE, GROUPS, 1, p_of)
        for correction, place in (("none", 3), ("bonferroni", 4), ("fdr", 5)):
            for t in (small, as_long(small, spark)):
                got = of_markers(t.signif(correction=correction, test=test, threshold=0.3), "g1", "g2", "p", "p_corrected")
                assert set(got) == {i for i, x in expected.items() if x[place] < 0.3}
                assert all(got[i] == (*expected[i][:2], pytest.approx(expected[i][3]), pytest.approx(expected[i][place])) for i in got)
    rows = small.signif(correction="none", test="gtest", threshold=0.3, bayes=True).collect()
    assert rows and all(r.Bayes_Factor == pytest.approx(brute.factor(r.g1, r.g2, 4, 3)) and r.Posterior_SexLinked == pytest.approx(brute.posterior(r.g1, r.g2, 4, 3)) for r in rows)
    assert all(r.depths == dict((i, d) for i, _, d in ROWS)[r.id] for r in rows)


def test_a_third_group_counts_among_the_tests(spark):
    from markerloom.plans.cells import cells

    people = [*PEOPLE, ("alien", "west")]
    t = table(spark, [*[(i, s, [*d, 0]) for i, s, d in ROWS], ("theirs", "T", [0] * 7 + [5])], people)
    n = sum(any(d) for _, _, d in ROWS) + 1
    assert {(r.markers, r.n_markers) for r in cells(t.counts(1, t.groups(*GROUPS))).where("g1 = 0 AND g2 = 0").collect()} == {(1, n)} and t.n_markers() == n


def test_subset(small, spark):
    inside = lambda x: 2 <= x[0] <= 4 and x[1] <= 2 and 3 <= x[2] <= 6
    expected = {i: x for i, x in brute.tested(ROWS, PEOPLE, GROUPS, 3).items() if inside(x)}
    for t in (small, as_long(small, spark)):
        assert of_markers(t.subset(min_depth=3, range1=(2, 4), range2=(0, 2), total=(3, 6)), "g1", "g2", "n_ind") == {i: x[:3] for i, x in expected.items()}
        got = of_markers(t.subset(min_depth=3, range1=(2, 4), range2=(0, 2), total=(3, 6), statistics=True, correction="fdr"), "p", "p_corrected")
        assert got == {i: (pytest.approx(x[3]), pytest.approx(x[5])) for i, x in expected.items()} and expected


def test_triage(split, spark):
    limits = {"threshold": 0.02, "posterior_threshold": 0.5, "bayes_factor_threshold": 4.0}
    for t in (split, as_long(split, spark)):
        rows = {r.id: r for r in t.triage(**limits).collect()}
        assert set(rows) == {"reefers", "lakers"} and len(t.triage().columns) == 20
        for i, (a, b) in (("reefers", (8, 0)), ("lakers", (0, 8))):
            r, p = rows[i], brute.p_chi(a, b, 8, 8)
            assert (r.P, r.CorrectedP, r.Bayes_Factor, r.Posterior_SexLinked) == tuple(pytest.approx(x) for x in (p, 4 * p, brute.factor(a, b, 8, 8), brute.posterior(a, b, 8, 8)))
            assert (r.Bias, r.Group1_Penetrance, r.Bias_Direction) == ((1, 1, "reef-biased") if a else (-1, 0, "lake-biased"))
            assert (r.Strict_Call, r.Posterior_Call, r.Bayes_Factor_Call, r.Candidate_Class) == (True, True, True, "strict+posterior")
    assert {r.Candidate_Class for r in split.triage(threshold=1e-9, posterior_threshold=0.5).collect()} == {"posterior_only"}
    assert {r.Candidate_Class for r in split.triage(threshold=1e-9, posterior_threshold=0.9999).collect()} == {"bayes_factor_only"}
    assert split.triage(threshold=1e-9, posterior_threshold=0.9999, bayes_factor_threshold=1e9).count() == 0
    first = ranked(split.triage(), 2).collect()
    assert [(r.rank, r.id) for r in first] == [(1, "lakers"), (2, "reefers")]


def test_layouts_agree(spark):
    rng = np.random.default_rng(1)
    pop = [(f"i{k}", "M" if k % 2 else "F") for k in range(12)]
    t = table(spark, [(str(m), "ACGT"[m % 4] * (m % 5 + 1) + str(m), (rng.integers(0, 9, 12) * (rng.random(12) < 0.6)).tolist()) for m in range(200)], pop)
    long = as_long(t, spark)
    for name, kw in (("freq", {}), ("distrib", {"test": "fisher"}), ("signif", {"correction": "fdr", "threshold": 0.9, "depths": False}), ("triage", {}), ("subset", {"range1": (2, 4)})):
        a, b = getattr(t, name)(**kw), getattr(long, name)(**kw)
        a, b = a.drop("ord"), b.drop("ord")
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect())), name
    back = long.arrays().df.orderBy("ord").collect()
    assert sorted((r.id, r.depths) for r in back) == sorted((r.id, r.depths) for r in t.df.where("exists(depths, d -> d > 0)").collect())
    assert [r.id for r in back] == sorted(r.id for r in back) and [r.ord for r in back] == list(range(len(back)))


def test_pca(small):
    result = small.pca()
    rows = result.components.orderBy("component").collect()
    x = np.array([d for _, _, d in ROWS if any(d)], float)
    values = np.sort(np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2)[::-1]
    assert result.n_markers == len(x) and result.total_variance == pytest.approx(((x - x.mean(axis=0)) ** 2).sum())
    assert [r.eigenvalue for r in rows] == pytest.approx(values.tolist()) and [r.cumulative for r in rows] == pytest.approx((np.cumsum(values) / values.sum()).tolist())
    loadings = np.array([[r[f"PC{k + 1}"] for k in range(len(PEOPLE))] for name, _ in PEOPLE for r in result.loadings.collect() if r.individual == name])
    assert loadings.T @ loadings == pytest.approx(np.eye(len(PEOPLE)), abs=1e-9)
    centred = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    assert centred @ loadings[:, 0] == pytest.approx(values[0] * loadings[:, 0])
    assert small.pca(components=2).loadings.columns == ["individual", "PC1", "PC2"]


def test_merge(small, spark):
    again = [("x", ROWS[3][1].lower(), [11, 2]), ("y", "NNCC", [0, 1]), ("z", "AACC", [65000, 0]), ("w", "TACC"[1:], [4, 4])]
    more = [("p", "AACC", [65000])]
    t = merge([small, table(spark, again, [("one", "m"), ("two", "f")]), table(spark, more, [("kea", "north")])])
    assert t.individuals == [*[x for x, _ in PEOPLE], "one", "two", "kea"]
    expected = {s: d for s, d in brute.merged([(ROWS, 7), (again, 2), (more, 1)]).items() if any(d)}
    rows = [(r.ord, r.sequence, r.depths) for r in t.df.orderBy("ord").collect()]
    assert rows == [(k, s, expected[s]) for k, s in enumerate(sorted(expected, key=lambda s: (len(s) % 4, s)))]
    assert merge([table(spark, more * 2, [("a", "b")])]).df.first().depths == [65535]
    with pytest.raises(MarkerError):
        merge([])


def test_ids_are_in_order_over_many_partitions(spark):
    from markerloom.operators.merge import numbered

    df = spark.range(60000, numPartitions=20).select(F.xxhash64("id").alias("k"), F.lit("x" * 50).alias("filler"))
    rows = [(r.ord, r.k) for r in numbered(df, F.col("k")).collect()]
    assert [k for _, k in sorted(rows)] == sorted(k for _, k in rows) and sorted(o for o, _ in rows) == list(range(60000))


# -- reads -----------------------------------------------------------------------------------------------------------------


READS = {"kea": ["CCATGGTTAAC", "TTACCA", "CCATGGTTAAC"], "moa": ["TTACCA", "ccatggttaac"], "weka": ["GATTACA"] * 4}


@pytest.fixture()
def read_folder(tmp_path):
    for k, (name, reads) in enumerate(READS.items()):
        fastq = "".join(f"@{name}{n}\n{s}\n+{name}\n{'@' * len(s)}\n" for n, s in enumerate(reads))
        fasta = "".join(f">{name}{n} x\r\n{s[:4]}\r\n{s[4:]}\r\n" for n, s in enumerate(reads))
        (tmp_path / f"{name}.{('fq.gz', 'FASTA', 'fastq')[k]}").write_bytes((gzip.compress(fastq.encode()), fasta.encode(), fastq.encode())[k])
    (tmp_path / "list.txt").write_text("no reads in here")
    return str(tmp_path)


def test_process(spark, read_folder):
    people = readers.individuals_of(spark, read_folder)
    assert people == sorted(READS)
    reads = readers.read_fastx(spark, read_folder)
    counts = Counter((s.upper(), name) for name, own in READS.items() for s in own)
    expected = [(s, [counts[s, x] for x in people]) for s in sorted({s for s, _ in counts})]
    assert [(r.sequence, r.depths) for r in process(reads, people).df.orderBy("ord").collect()] == expected
    assert [(r.sequence, r.depths) for r in process(reads, people, min_depth=2).df.orderBy("ord").collect()] == [x for x in expected if max(x[1]) > 1]
    assert {r.depths[-1] for r in process(reads, [*people, "silent"]).df.collect()} == {0}


def test_reads_that_splits_cut(spark, tmp_path):
    """Small splits, quality lines that look like headers, and sequences over several splits."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    fastq = [(f"r{k}", word(rng.randint(1, 90))) for k in range(400)]
    (tmp_path / "a b.fastq").write_text("".join(f"@{n}\n{s}\n+\n{rng.choice('@+>I') * len(s)}\n" for n, s in fastq))
    fasta = [(f"c{k}", word(rng.choice([3, 70, 5000]))) for k in range(30)]
    (tmp_path / "g.fa").write_text("".join(f">{n}\n" + "".join(s[i : i + 60] + "\n" for i in range(0, len(s), 60)) for n, s in fasta))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "1000")
        got = readers.read_fastx(spark, str(tmp_path)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted((r.name, r.sequence) for r in got if r.individual == "a b") == sorted(fastq)
    assert sorted((r.name, r.sequence) for r in got if r.individual == "g") == sorted(fasta)


def test_tiles_are_those_of_slices(spark):
    from markerloom.operators.align import tiles

    text = "".join(random.Random(0).choice("ACGTn") for _ in range(1037))
    got = {(r.contig, r.tile_start): r.tile for r in tiles(spark.createDataFrame([("x", text), ("y", "AC"), ("z", "")], "contig string, sequence string"), 100, 7).collect()}
    assert got == {("x", at): text.upper()[at : at + 107] for at in range(0, 1037, 100)} | {("y", 0): "AC"}


def test_no_reads(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("x")
    with pytest.raises(MarkerError):
        readers.read_fastx(spark, str(tmp_path))


def test_kmer_dedup(spark):
    rng = random.Random(2)
    counts = {"".join(rng.choice("ACGT") for _ in range(rng.randint(3, 9))): rng.randint(1, 5) for _ in range(40)}
    reads = spark.createDataFrame([("p", s) for s, n in counts.items() for _ in range(n)], "individual string, sequence string")
    best = {}
    for s in sorted(counts, key=lambda s: (-counts[s], s)):
        best.setdefault(brute.signature(s, 5), s)
    assert sorted(r.sequence for r in process(reads, kmer_dedup=5).df.collect()) == sorted(best.values()) and len(best) < len(counts)


def test_sequences(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("ACGT") for _ in range(rng.randint(1, 14))) for _ in range(50)]
    for r in spark.createDataFrame([(s,) for s in words], "s string").select("s", kmer_signature(F.col("s"), 6).alias("k"), reverse_complement(F.col("s")).alias("r")).collect():
        assert (r.k, r.r) == (brute.signature(r.s, 6), brute.reverse_complement(r.s))
    assert [r[0] for r in spark.createDataFrame([("gatNXc",), ("-",)], "s string").select(normalised(F.col("s"))).collect()] == ["GATAAC", "A"]


def test_map(spark, tmp_path):
    rng = np.random.default_rng(5)
    chr1, chr2 = ("".join(rng.choice(list("ACGT"), n)) for n in (25000, 400))
    (tmp_path / "g.fa").write_text(f">chr1 first\n{chr1[:12000]}\n{chr1[12000:]}\n>chr2\n{chr2}\n")
    genome = readers.read_genome(spark, str(tmp_path))
    assert sorted((r.contig, r.length) for r in genome.collect()) == [("chr1", 25000), ("chr2", 400)]
    comp = str.maketrans("ACGT", "TGCA")
    near = chr1[9990:10080]
    rows = [("exact", chr1[101:191], [5] * 7), ("edge", near[:40] + ("A" if near[40] != "A" else "C") + near[41:], [5] * 7), ("reverse", chr2[50:140].translate(comp)[::-1], [5] * 7), ("absent", "".join(rng.choice(list("ACGT"), 90)), [5] * 7), ("rare", chr1[300:390], [0] * 7)]
    got = {r.Marker_id: (r.Contig, r.Position, r.Length) for r in table(spark, rows, PEOPLE).map(genome).collect()}
    assert got == {"exact": ("chr1", 101, 25000), "edge": ("chr1", 9990, 25000), "reverse": ("chr2", 50, 400)}


def test_hits_of_long_markers(spark):
    rng = np.random.default_rng(12)
    chr1 = "".join(rng.choice(list("ACGT"), 25000))
    spans = {"at the bound": (9800, 500), "over": (9800, 501), "over a tile's end": (9500, 900), "three tiles": (8000, 13000), "inside": (3000, 2000)}
    sequences = {i: chr1[at : at + n] for i, (at, n) in spans.items()}
    sequences["mismatch"] = chr1[9700:10150] + {"A": "C"}.get(chr1[10150], "A") + chr1[10151:10400]
    sequences["past the end"] = chr1[24300:] + "A" * 10
    df = spark.createDataFrame([*sequences.items(), *[(i + " back", x.translate(str.maketrans("ACGT", "TGCA"))[::-1]) for i, x in sequences.items() if i in ("over", "over a tile's end")]], "id string, sequence string")
    best = {}
    for r in hits(df, spark.createDataFrame([("chr1", chr1)], "contig string, sequence string")).collect():
        best[r.id] = max(best.get(r.id, (-(10**9),)), (r.score, r.position, r.strand))
    expected = {i: (2 * n, at, "+") for i, (at, n) in spans.items()} | {"mismatch": (2 * 699 - 8, 9700, "+"), "past the end": (2 * 700 - 80, 24300, "+")}
    assert best == expected | {i + " back": (*expected[i][:2], "-") for i in ("over", "over a tile's end")}


# -- sources and sinks -------------------------------------------------------------------------------------------------------


def test_tsv_round_trip(small, spark, tmp_path):
    path = f"{tmp_path}/t.tsv"
    writers.write_markers(small, path)
    back = readers.read_marker_tsv(spark, path, PEOPLE)
    assert back.individuals == small.individuals and [(r.id, r.sequence, r.depths) for r in back.df.orderBy("ord").collect()] == ROWS
    assert open(path).readline() == f"#Number of markers : {len(ROWS)}\n"
    writers.write_marker_rows(small, f"{tmp_path}/rows")
    assert sorted((r.id, r.sequence, r.depths) for r in readers.read_marker_tsv(spark, f"{tmp_path}/rows", PEOPLE, [x for x, _ in PEOPLE]).df.collect()) == sorted(ROWS)


def test_tsv_details(spark, tmp_path):
    lines = [b"# written by hand", b"Locus\tseq\tx\tx\ty", b"id\tCA\t70000\t12345678\t3", b"", b"cut\tshort", b"7\tGG\t5\t\tmany\tmore"]
    (tmp_path / "t.tsv").write_bytes(b"\r\n".join(lines) + b"\r\n")
    t = readers.read_marker_tsv(spark, f"{tmp_path}/t.tsv")
    assert t.individuals == ["x", "x", "y"] and [(r.id, r.depths) for r in t.df.orderBy("ord").collect()] == [("id", [65535, 65535, 3]), ("7", [5, 0, 0])]
    (tmp_path / "e.tsv").write_text("#nothing\n")
    with pytest.raises(MarkerError):
        readers.read_marker_tsv(spark, f"{tmp_path}/e.tsv")
    (tmp_path / "p.tsv").write_text("kea\tnorth\r\n\nlonely\ntui\tsouth\tx\nmoa\tnorth\n")
    assert readers.read_popmap(spark, f"{tmp_path}/p.tsv") == [("kea", "north"), ("moa", "north")]
    (tmp_path / "q.tsv").write_text("".join(f"i{k}\tg\n" for k in range(65536)))
    with pytest.raises(MarkerError):
        readers.read_popmap(spark, f"{tmp_path}/q.tsv")


def test_frames(spark, small, tmp_path):
    wide = pa.table({"id": ["a1", "2"], "sequence": ["AC", "GT"], "i": [70000, -3], "f": [1.6, float("nan")], "s": ["70000", "x"], "n": pa.array([None, 4], pa.int32())})
    t = readers.from_arrow(spark, wide, pa.table({"x": ["i"], "y": ["M"]}))
    assert [r.depths for r in t.df.orderBy(F.desc("id")).collect()] == [[65535, 2, 65535, 0], [0, 0, 0, 4]] and t.popmap == [("i", "M")]
    with pytest.raises(MarkerError):
        readers.from_frame(spark.createDataFrame([("0", "A")], "id string, sequence string"))
    writers.write_parquet(small, f"{tmp_path}/m.parquet")
    back = readers.read_marker_parquet(spark, f"{tmp_path}/m.parquet", PEOPLE)
    assert sorted((r.id, r.sequence, r.depths) for r in back.df.collect()) == sorted(ROWS)
    assert sorted(r.id for r in small.to_dataframe().collect()) == sorted(i for i, _, _ in ROWS) and all(v is not None for r in small.to_dataframe().collect() for v in r)
    numbers = table(spark, [("10", "A", [1] * 7), ("9", "C", [0] * 7)], PEOPLE).to_dataframe()
    assert dict(numbers.dtypes)["id"] == "bigint" and sorted(r.id for r in numbers.collect()) == [9, 10]
    assert {r.id for r in table(spark, [("010", "A", [1] * 7)], PEOPLE).to_dataframe().collect()} == {"010"}


def test_text_sinks(split, spark, tmp_path):
    path = f"{tmp_path}/d.tsv"
    writers.write_tsv(split.distrib(empty_cells=False), path, metadata={"source": "distrib", "min_depth": 1}, order=["reef", "lake"])
    lines = open(path).read().splitlines()
    assert lines[0] == "#source:distrib;min_depth:1" and lines[1].split("\t") == ["reef", "lake", "Markers", "P", "CorrectedP", "Signif", "Bias"]
    p = brute.p_chi(8, 0, 8, 8)
    assert lines[-2] == f"8\t0\t1\t{p:g}\t{4 * p:g}\tTrue\t1"
    assert spark.createDataFrame([(lines[0],)], "l string").select(analysis.metadata(F.col("l")).alias("m")).first().m == {"source": "distrib", "min_depth": "1"}
    frame, meta = readers.read_result_tsv(spark, path)
    assert meta == {"source": "distrib", "min_depth": "1"} and frame.columns == lines[1].split("\t")
    assert sorted((r.reef, r.lake, r.Markers, r.Signif) for r in frame.collect()) == sorted((r.reef, r.lake, r.Markers, r.Signif) for r in split.distrib(empty_cells=False).collect())
    found = writers.fasta(split.signif(), split.groups(), 1).collect()
    assert any(r.value.startswith(">reefers_lake:0_reef:8_p:") and r.value.endswith("_mindepth:1\nCATT") for r in found)
    writers.write_pca(split.pca(components=2), f"{tmp_path}/pca")
    assert (tmp_path / "pca" / "eigenvalues.tsv").read_text().startswith("component\teigenvalue\tvariance_fraction\tcumulative\n1\t")


# -- analysis ----------------------------------------------------------------------------------------------------------------


def test_analysis(split, spark):
    from markerloom.plans.cells import cells

    tri = split.triage()
    assert analysis.sex_system(tri, "reef", "lake").first().system == "ambiguous"
    assert analysis.sex_system(tri.where("id = 'reefers'"), "reef", "lake").first().system == "XY"
    assert analysis.sex_system(tri.where("id = 'lakers'"), "reef", "lake").first().system == "ZW"
    assert analysis.call_sets(tri).first().both == 2
    e = analysis.table_evidence(split).first()
    assert (e.n_markers, e.bf_over_10, e.posterior_over_90) == (4, 2, 2) and e.posterior_mass == pytest.approx(sum(brute.posterior(a, b, 8, 8) for a, b in ((8, 8), (8, 0), (0, 8), (4, 4))))
    prior = analysis.prior_by_em(split)
    assert prior == pytest.approx(sum(brute.posterior(a, b, 8, 8, prior) for a, b in ((8, 8), (8, 0), (0, 8), (4, 4))) / 4, abs=1e-6)
    g = split.groups()
    assert {(r.prior, r.n_over) for r in analysis.prior_sensitivity(cells(split.counts(1, g)), g, priors=[0.01, 1e-9], linked=[0.9]).collect()} == {(0.01, 2), (1e-9, 0)}
    assert analysis.depth_stability({1: tri, 5: split.triage(min_depth=5)}).where("min_depth = 5").first().n_markers == 1
    assert analysis.freq_summary(split.freq()).first().singletons == 0
    assert {r.Group: r.mean_reads for r in analysis.depth_summary(split.depth()).collect()} == {"reef": (7 + 4 + 1.5) * 1, "lake": 7 + 6 + 1.5}
    assert analysis.distrib_summary(split.distrib()).first().significant_markers == 2
    assert analysis.signif_summary(split.signif(bayes=True)).first().bf_over_10 == 2
    assert analysis.joined_calls(split.signif(), tri).count() == 2
    assert analysis.loading_means(split.pca(components=1).loadings, split.popmap_frame()).count() == 2
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "one")], "k string, t int, v string")
    assert sorted(r.v for r in analysis.newest(rows, ["k"], "t").collect()) == ["new", "one"]
    times = spark.createDataFrame([("f", "1", "ours", 1.0), ("f", "1", "theirs", 4.0), ("f", "2", "ours", 1.0), ("f", "2", "theirs", 1.0)], "command string, case string, tool string, seconds double")
    assert tuple(analysis.speedups(times).first()) == ("f", 2, 1, pytest.approx(2.0))
    assert {(r.tool, r.seconds, r.runs) for r in analysis.elapsed(times).collect()} == {("ours", 2.0, 2), ("theirs", 5.0, 2)}
    shards = [("s1", 0.01, 0.9, 1, tri.limit(0)), ("s1", 0.01, 0.9, 2, tri), ("s1", 0.2, 0.9, 1, tri.limit(0))]
    assert {(r.prior, r.stamp, r.n_posterior, r.n_factor, r.n_strict) for r in analysis.prior_sweep(shards).collect()} == {(0.01, 2, 2, 2, 2), (0.2, 1, 0, 0, 0)}


def test_statistics_run_on_cells_only(small):
    plan = small.signif()._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in plan and "transform(" not in plan[: plan.index("Join Inner")]  # statistics are below the join


def test_statistics_stay_in_the_jvm(small):
    for frame in (small.distrib(), small.distrib(test="fisher"), small.signif(test="gtest", bayes=True), small.triage(), small.subset()):
        plan = frame._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("MapInArrow", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"))


@pytest.mark.parametrize("t1,t2", [(1, 1), (4, 3), (30, 40), (0, 5), (300, 211), (40_000, 30_000)])
def test_columns_of_cells(spark, t1, t2):
    rng = random.Random(t1)
    if t1 < 100:
        some = [(a, b) for a in range(t1 + 1) for b in range(t2 + 1)]
    elif t1 < 1_000:
        some = [(rng.randint(0, t1), rng.randint(0, t2)) for _ in range(200)]
    else:
        some = [(rng.randint(0, 40), rng.randint(0, 40)) for _ in range(60)] + [(t1 // 2 + k, t2 // 2) for k in range(3)]
    cells = spark.createDataFrame(some, "g1 int, g2 int")
    rel = 1e-12 if t1 < 1_000 else 1e-8  # log factorials of tens of thousands have fewer digits to spare
    for test, p_of in ((Test.CHISQ, kernels.p_chi_squared), (Test.GTEST, kernels.p_g_test), (Test.FISHER, kernels.p_fisher)):
        if t1 > 1_000 and test is Test.GTEST:
            continue  # a difference of large terms
        for r in cell_columns.with_p(cells, t1, t2, test).collect():
            assert r.p == pytest.approx(p_of(r.g1, r.g2, t1, t2), rel=max(rel, 1e-11), abs=1e-15), (test, r)
    for prior, linked in ((0.01, 0.9), (0.3, 1.0), (0.0, 0.9), (1.0, 0.5)):
        for r in cell_columns.with_bayes(cells, t1, t2, prior, linked).collect():
            assert r.bayes_factor == pytest.approx(kernels.bayes_factor(r.g1, r.g2, t1, t2), rel=max(rel, 1e-10))
            assert r.posterior == pytest.approx(kernels.posterior_linked(r.g1, r.g2, t1, t2, prior, linked), rel=max(rel, 1e-10), abs=1e-13)


def test_erfc_and_log_factorials(spark):
    x = [k / 500 for k in range(13_000)] + [0.46875, 4.0, 1e-12]
    for r in spark.createDataFrame([(v,) for v in x], "x double").select("x", cell_columns.erfc(F.col("x")).alias("e")).collect():
        assert r.e == pytest.approx(math.erfc(r.x), rel=2e-13 if r.x < 26 else 1e-12)
    n = [*range(300), 65_535, 10**6]
    for r in spark.createDataFrame([(v,) for v in n], "n long").select("n", cell_columns.log_factorial(F.col("n")).alias("l")).collect():
        assert r.l == pytest.approx(math.lgamma(r.n + 1), rel=1e-14, abs=1e-14)
