"""Places of markers that reach a score, against full matrices; copies of markers and genome aren't paired."""

import glob
import itertools
import random

import duckdb
import numpy as np
import pytest

from markerloom.functions import banded
from markerloom.operators import genome, placed
from tests.test_mapping import COMPLEMENT, bases, edited, full_matrix
from tests.test_query_sizes import same_as_sql


def test_scores_are_those_of_the_alignment(monkeypatch):
    rng = random.Random(1)
    queries, targets, width = [], [], 17
    for k in range(120):
        target = bases(rng, (size := rng.randint(20, 90)) + width - 1)
        own = edited(rng, target[8 : 8 + size], ["inserted", "deleted", "changed"][k % 3], 1 + k % 7, size // 2) if k % 4 else target[8 : 8 + size]
        queries.append(own.encode())
        targets.append((target + bases(rng, 20))[: len(own) + width - 1].encode())
    monkeypatch.setattr(banded, "CELLS", 16 * width * 50)
    score, begin, span = banded.score_batch(queries, targets, width)
    assert score.tolist() == banded.align_batch(queries, targets, width)[0].tolist()
    for q, t, s, b, n in zip(queries, targets, score.tolist(), begin.tolist(), span.tolist()):
        assert full_matrix(q.decode(), t[b : b + n].decode()) == s


def test_windows_of_the_least_cost():
    rng = np.random.default_rng(2)
    for _ in range(60):
        cost, size, n = rng.integers(0, 9, rng.integers(1, 14)), int(rng.integers(1, 6)), int(rng.integers(1, 5))
        got = placed.disjoint(cost, size, n)
        fits = [x for x in itertools.combinations(range(len(cost)), len(got)) if all(b - a >= size for a, b in zip(x, x[1:]))]
        assert tuple(got) in fits and cost[got].sum() == min(cost[list(x)].sum() for x in fits)
        assert len(got) == n or not [x for x in itertools.combinations(range(len(cost)), len(got) + 1) if all(b - a >= size for a, b in zip(x, x[1:]))]


@pytest.mark.parametrize("hot", [1, 50_000])
def test_all_places_that_reach_the_score(spark, monkeypatch, hot):
    monkeypatch.setattr(placed, "HOT_PAIRS", hot)
    rng = random.Random(3)
    passage, contigs, there, markers = bases(rng, 110), {}, [], {}

    def changed(n):
        s = passage
        for _ in range(n):
            s = edited(rng, s, rng.choice(["inserted", "deleted", "changed"]), rng.randint(1, 4), rng.randint(5, len(s) - 10))
        return s

    for c in ("a", "b"):
        text = bases(rng, 20)
        for k in range(7):
            s = changed(k % 4)
            there.append((c, len(text), "+-"[k % 2]))
            text += (s if k % 2 == 0 else s.translate(COMPLEMENT)[::-1]) + bases(rng, rng.randint(60, 200))
        contigs[c] = text[:-50] if c == "a" else text.lower()
    for k in range(12):
        s = changed(k % 3)
        markers[k] = (s if k % 2 else s.translate(COMPLEMENT)[::-1], 2 * len(s) - [0, 25, 47, 60][k % 4])
    rows = [(k, *x) for k, x in markers.items()] + [(100, markers[0][0], 5 * len(passage)), (101, None, 10), (102, "ACG", 1), (103, "N" * 60, 10), (104, passage, 0)]
    index = genome.genome_index(spark.createDataFrame(list(contigs.items()), "contig string, sequence string"), k=9, w=4, size=128)
    found = placed.placed(spark.createDataFrame(rows, "id int, sequence string, least int"), index)
    got = {}
    for r in found.everywhere().collect():
        got.setdefault((r.id, r.contig, r.strand), []).append((r.position, r.score))
    expected = 0
    for (k, (s, least)), (c, at, strand) in itertools.product(markers.items(), there):
        for own, sign in ((s, "+"), (s.translate(COMPLEMENT)[::-1], "-")):
            best = full_matrix(own, contigs[c].upper()[max(0, at - 20) : at + 140])
            near = [score for position, score in got.get((k, c, sign), []) if abs(position - at) <= 24]
            assert max(near, default=None) == (best if best >= least else None)
            expected += best >= least
    assert expected > 60 and {k for k, _, _ in got} <= set(markers)
    for (k, c, sign), rows in got.items():
        own = markers[k][0] if sign == "+" else markers[k][0].translate(COMPLEMENT)[::-1]
        for position, score in rows:
            text = "-" * 30 + contigs[c].upper()
            assert score >= markers[k][1] and score <= full_matrix(own, text[position + 30 : position + 30 + len(own) + 25])
    best = {k: max(x[1] for key, rows in got.items() if key[0] == k for x in rows) for k in {key[0] for key in got}}
    assert {r.id: r.score for r in found.best().collect()} == best
    wanted = spark.createDataFrame([(k, "b") for k in markers], "id int, contig string")
    assert {(r.id, r.position, r.strand, r.score) for r in found.on_contigs(wanted).collect()} == {(k, p, sign, s) for (k, c, sign), rows in got.items() if c == "b" for p, s in rows}


def test_copies_of_documents_are_not_paired(spark, tmp_path):
    """What the query stores grows with the documents, not with markers times copies of their passage."""
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/*"))
    rng = random.Random(4)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(460))
    n = 120
    rows = same_as_sql(spark, tmp_path, "map_gapped_dna", documents=[{"doc_id": k, "text": text} for k in range(n)] + [{"doc_id": n, "text": "too short"}, {"doc_id": n + 1, "text": None}])
    assert len(rows) == n
    made = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')[7:]}/*")) - before
    assert made and max(duckdb.connect().execute(f"SELECT count(*) FROM '{x}/*.parquet'").fetchall()[0][0] for x in made) < n * n
