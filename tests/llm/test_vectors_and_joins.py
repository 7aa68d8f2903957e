"""Vector codes, the PartEnum join, links within buckets and hard negatives, each against a brute-force version."""

import hashlib
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markerloom.llm import bucket_links, hard_negatives, partenum, suffix_dedup, vector_codes
from tests.llm.corpus import DOCS, awkward, frame, prose, word
from tests.llm.test_operators import components_by_force

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), *[T.StructField(c, T.StringType()) for c in ("row", "code", "norm", "vector", "chunk")]])


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "y", "z", None, "c") for i, v, label in rows], VECTORS)


def some_vectors(seed, n, d, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(x) for x in rng.normal(size=d) * spread ** rng.normal()], int(rng.integers(0, 4))) for i in rng.permutation(n)]


ODD = [
    (500, None, 1),
    (501, [1.0, None] + [0.0] * 14, 1),
    (502, [1.0, float("nan")] + [0.0] * 14, 1),
    (503, [float("inf")] + [0.0] * 15, 1),
    (504, [0.25] * 16, None),
    (505, [0.25] * 16, None),
    (505, [0.25] * 16, None),
    (506, [-0.001] * 16, 2),
    (None, [0.5] * 16, 2),
    (507, [0.5] * 7, 2),
    (508, [], 2),
    (509, [1e12] + [0.0] * 15, 2),
]


# -- 11 ------------------------------------------------------------------------------------------------------------------


def codes_by_force(rows, parts=16, entries=64, rounds=2):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((i, v) for i, v, _ in kept if i is not None)[:entries]
    d = len(first[0][1])
    width = -(-d // parts)
    cut = lambda v: [(v + [0] * (parts * width - d))[p * width : (p + 1) * width] for p in range(parts)]
    usable = [(i, cut(v), label) for i, v, label in kept if len(v) == d and max(map(abs, v)) <= 2**29 / d**0.5]
    books = [[cut(v)[p] for _, v in first if len(v) == d] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, y)), k) for k, y in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = defaultdict(list)
            for _, v, _ in usable:
                mine[near(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(mine[k]) for c in zip(*mine[k])] if k in mine else y for k, y in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for y in b for x in y).encode()).hexdigest()
    out, errors = [], defaultdict(int)
    for i, v, label in usable:
        found = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(e for e, _ in found)))
        errors[label] += out[-1][3]
    known = {(i, label): (code, error, errors[label], sha) for i, label, code, error in out}
    return [(i, label, *known.get((i, label), (None, None, errors.get(label), sha))) for i, _, label in kept]


@pytest.mark.parametrize("d", [16, 20, 64])
def test_vector_codes(spark, d):
    rows = some_vectors(d, 300, d, 1.5) + [(i, v if v is None or len(v) != 16 else (v * d)[:d], label) for i, v, label in ODD]
    got = vector_codes.compress(vectors(spark, rows).repartition(3)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, codes_by_force(rows)))


def test_vector_codes_of_few_rows_and_of_none(spark):
    rows = some_vectors(3, 5, 16)
    got = vector_codes.compress(vectors(spark, rows)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, codes_by_force(rows)))
    assert vector_codes.compress(vectors(spark, [])).count() == 0
    without = vector_codes.compress(vectors(spark, [(None, [0.5] * 16, 1)])).first()
    assert without.code is None and without.error is None and without.codebooks_sha256 is None


def test_many_labels_share_their_sums_by_salt(spark, monkeypatch):
    rows = some_vectors(8, 200, 16)
    expected = sorted(map(repr, codes_by_force(rows)))
    monkeypatch.setattr(vector_codes, "BROADCAST_ROWS", 2)
    monkeypatch.setattr(vector_codes, "SALT", 7)
    got = vector_codes.compress(vectors(spark, rows)).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()
    assert sorted(map(repr, map(tuple, got))) == expected


@pytest.mark.parametrize(("d", "size"), [(4, 60), (6, 10**6), (8, 3), (1, 50), (16, 2**26)])
def test_nearest_entries_and_how_few_are_measured(d, size):
    rng = np.random.default_rng(d)
    x, book = rng.integers(-size, size + 1, (500, d)), rng.integers(-size, size + 1, (64, d))
    book[40] = book[3]
    x[:60] = book[rng.integers(0, 64, 60)]
    at, dist, measured = vector_codes.nearest(x, book, vector_codes.levels(book))
    exact = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert dist.tolist() == exact.min(axis=1).tolist() and at.tolist() == [int(np.argmin(r)) for r in exact]
    assert measured <= 500 * 64 * {4: 0.5, 6: 0.7, 8: 0.5}.get(d, 1)  # uniform vectors; those near an entry leave fewer


# -- 13 ------------------------------------------------------------------------------------------------------------------


def negatives_by_force(rows, anchor, positives=5, negatives=3):
    kept = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v], label))
    out = []
    for a in (x for x in kept if anchor(x[0])):
        score = [(max(-(2**63) + 1, min(2**63 - 1, sum(p * q for p, q in zip(a[1], b[1])))), b) for b in kept if b is not a and len(b[1]) == len(a[1])]
        order = sorted(score, key=lambda x: (-x[0], x[1][0]))
        for s, p in [x for x in order if x[1][2] == a[2]][:positives]:
            near = [(t, n) for t, n in order if n[2] != a[2] and 50 * s <= 100 * t <= 95 * s][:negatives]
            out += [(a[0], p[0], k + 1, n[0], s, t) for k, (t, n) in enumerate(near)]
    return out


@pytest.mark.parametrize(("spread", "bucket"), [(1.0, 4096), (1.0, 16), (3.0, 8)])
def test_hard_negatives(spark, monkeypatch, spread, bucket):
    monkeypatch.setattr(hard_negatives, "BUCKET", bucket)
    monkeypatch.setattr(hard_negatives, "SORTED", 150)
    monkeypatch.setattr(hard_negatives, "CHUNK", 2)
    rows = some_vectors(5, 400, 16, spread)
    rows += [(1000 + i, v, 3) for i, v, _ in rows[:60]] + rows[:9] + ODD  # ties, repeats, odd ones
    got = hard_negatives.mine(vectors(spark, rows).repartition(3), F.col("vec_id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(negatives_by_force(rows, lambda i: i % 10 == 0))
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 10 == 0).count() == 0


def test_buckets_that_norms_rule_out_are_not_scored(spark, monkeypatch):
    """With norms of many sizes, few buckets can reach what anchors need."""
    rng = np.random.default_rng(1)
    block = [(k, rng.normal(size=8) * 1000) for k in range(40)]
    shorter = [(100 + k, rng.normal(size=8) * 0.5 ** (k // 20)) for k in range(400)]

    def packed_row(rows, least=None, **more):
        norms = [float(np.linalg.norm(v)) for _, v in rows]
        ids = np.array([i for i, _ in rows], "<i8")
        return {"n": len(rows), "norm": max(norms), "rows": ids.tobytes(), "ids": ids.tobytes(), "labels": np.zeros(len(rows), "<i8").tobytes(), "vectors": np.array([np.floor(v) for _, v in rows], "<f8").tobytes(), "kind": "<f8", **more}

    seen = []
    state = hard_negatives.Positives(packed_row(block), 3)
    norms = np.hypot.reduce(state.vectors, axis=1)
    for at in range(0, 440, 20):
        r = packed_row((block + shorter)[at : at + 20])
        alive = np.flatnonzero(norms * r["norm"] * hard_negatives.ABOVE >= state.need)
        seen.append(len(alive))
        if len(alive):
            b = hard_negatives.unpacked(r)
            state.take(alive, hard_negatives.products(state.vectors[alive], b[3], 1.0), b)
    assert seen[0] == 40 and sum(x == 0 for x in seen) >= 18


def test_inner_products_of_large_integers_are_exact():
    a, b = np.array([[2.0**40, 3.0], [1.0, 2.0**45]]), np.array([[2.0**20, 1.0], [2.0**40, 2.0**40]])
    got = hard_negatives.products(a, b, 2.0**86)
    assert got.tolist() == [[2**60 + 3, hard_negatives.LARGEST], [2**20 + 2**45, hard_negatives.LARGEST]]


# -- 12 ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (2, 70)])
def test_similar_sets(spark, k, percent):
    texts = awkward()
    got = partenum.similar_sets(frame(spark, texts).repartition(3), k=k, percent=percent).collect()
    expected = components_by_force(texts, k, percent)
    assert len(got) == len(texts)
    for r in got:
        assert r.component_id is None if r.doc_id is None else (r.n_shingles, r.component_id) == expected[r.doc_id]
    assert partenum.similar_sets(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("percent", [60, 80, 90, 95])
def test_similar_sets_share_a_signature(percent):
    """Any two sets at the bound, of any sizes, share one."""
    rng = np.random.default_rng(percent)
    for n in [*range(2, 60), 200, 999]:
        for _ in range(4):
            x = rng.integers(0, 2**63, n, np.uint64)
            gone = int(rng.integers(0, n))
            added = 0
            while 100 * (n - gone) < percent * (n + added):
                gone -= 1
            while 100 * (n - gone) >= percent * (n + added + 1):
                added += 1
            y = np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, added, np.uint64)])
            if set(x.tolist()) != set(y.tolist()):
                a, b = partenum.signatures([np.sort(x), np.sort(y)], percent)
                assert set(a.tolist()) & set(b.tolist())
    assert [len(s) for s in partenum.signatures([np.zeros(0, np.uint64)], percent)] == [0]


def test_sets_that_are_far_apart_seldom_share_a_signature():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**63, 400, np.uint64)) for _ in range(60)]
    half = [np.unique(np.append(s[:200], rng.integers(0, 2**63, 200, np.uint64))) for s in sets]
    own = [set(x.tolist()) for x in partenum.signatures([*sets, *half], 90)]
    assert sum(bool(a & b) for a, b in itertools.combinations(own, 2)) <= 3


def test_signatures_are_fewer_than_a_third_of_the_shingles():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, np.uint64)) for n in range(60, 1500, 7)]
    assert 3 * sum(map(len, partenum.signatures(sets, 90))) < sum(map(len, sets))


def test_signatures_are_shuffled_once(spark, monkeypatch):
    """Also where the keys that several sets have are too many to be broadcast."""
    rows = [(k, r, 10) for k, r in [(1, 5), (1, 6), (2, 6), (3, 7), (3, 7), (4, 5), (4, 6), (4, 7)]]
    found = partenum.shared(spark.createDataFrame(rows, "key long, rep long, n int"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert sorted(map(tuple, found.collect())) == [(1, 5, 10), (1, 6, 10), (4, 5, 10), (4, 6, 10), (4, 7, 10)]
    monkeypatch.setattr("markerloom.llm.shared.BROADCAST_ROWS", 0)
    texts = awkward()
    expected = components_by_force(texts, 3, 90)
    for r in partenum.similar_sets(frame(spark, texts)).collect():
        assert r.doc_id is None or (r.n_shingles, r.component_id) == expected[r.doc_id]


def test_a_family_of_many_copies_costs_rows_in_proportion(spark):
    """Copies that differ in an eighth of their words: prefixes grow with the members, and hardly any two meet."""
    rng = random.Random(3)
    base = [word(rng) + str(i) for i in range(60)]

    def of(n):
        texts = {}
        for i in range(n):
            own = list(base)
            for at in rng.sample(range(1, 58, 3), 8):
                own[at] = f"{word(rng)}{rng.random()}"
            texts[i] = " ".join(own)
        groups = spark.createDataFrame([(1, i, i, 59, i == 0) for i in texts], "grp long, rep long, component long, n int, main boolean").repartition(4).cache()
        held = spark.createDataFrame(list(texts.items()), "rep long, text string")
        prefixes = bucket_links._prefixes(groups, held, 2, 80).cache()
        shared = prefixes.groupBy("tk").agg(F.count("*").alias("rows")).where("rows > 1")
        return prefixes.count(), shared.agg(F.coalesce(F.sum(F.col("rows") * (F.col("rows") - 1) / 2), F.lit(0.0))).first()[0]

    (few, met_few), (many, met_many) = of(300), of(2400)
    assert many <= 8.5 * few and met_many <= 3 * 2400 and met_few <= 3 * 300


def test_prefixes_of_linked_sets_meet(spark):
    rng = random.Random(6)
    base = [word(rng) + str(i) for i in range(70)]
    texts = {i: " ".join(w for w in base if rng.random() > 0.07) + "".join(f" own{i}x{j}" for j in range(rng.randint(0, 4))) for i in range(60)}
    groups = spark.createDataFrame([(1, i, i, 60, i == 0) for i in texts], "grp long, rep long, component long, n int, main boolean").cache()
    rows = bucket_links._prefixes(groups, spark.createDataFrame(list(texts.items()), "rep long, text string"), 2, 80).collect()
    small, large = defaultdict(set), defaultdict(set)
    for r in rows:
        large[r.rep].add(r.tk)
        if r.small:
            small[r.rep].add(r.tk)
    sets = {i: bucket_links.shingles(t, 2) for i, t in texts.items()}
    linked = [(x, y) for x, y in itertools.combinations(texts, 2) if bucket_links.similar(sets[x], sets[y], 80)]
    assert len(linked) > 20
    for x, y in linked:
        x, y = sorted((x, y), key=lambda i: len(sets[i]))
        assert small[x] & large[y]


def test_the_hub_of_a_bucket_is_what_most_resemble(spark):
    members = spark.createDataFrame([(k, r, 10, n) for k, r, n in [(1, 5, 3), (1, 6, 3), (1, 7, 3), (2, 6, 2), (2, 8, 2), (3, 6, 2), (3, 9, 2)]], "key long, rep long, n int, rows long").cache()
    assert sorted(map(tuple, bucket_links.hub_pairs(members).collect())) == [(6, 5), (6, 7), (6, 8), (6, 9)]


@pytest.mark.parametrize("few", [0, 3, 16])
def test_every_way_to_close_a_group_finds_all_links(spark, monkeypatch, few):
    monkeypatch.setattr(bucket_links, "FEW", few)
    monkeypatch.setattr(bucket_links, "BLOCK", 15)
    rng = random.Random(11)
    base = [word(rng) for _ in range(90)]
    texts = [(i, " ".join(w if rng.random() > 0.025 else word(rng) for w in base)) for i in range(70)] + [(200 + i, prose(rng, 30)) for i in range(10)]
    expected = components_by_force(texts, 3, 90)
    assert 1 < len({c for _, c in expected.values()}) < 80
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in partenum.similar_sets(frame(spark, texts)).collect()}
    assert got == expected


# -- 2 -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [5, 6, 17, 99, 100, 1000])
def test_least_places_of_more_keys_than_a_slice_holds(most):
    rng = np.random.default_rng(most)
    for n in (3, 5, 6, 100, 101, 257):
        keys = rng.integers(0, 2**63, n, np.uint64)
        keys[n // 2 :] = keys[: n - n // 2]
        assert suffix_dedup.least_places(keys, 5, most).tolist() == suffix_dedup.least_places(keys, 5).tolist()
