"""Gapped places of markers, the index of minimisers, and genomes in pieces, against full matrices and plain searches."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerloom.functions import banded
from markerloom.operators import gapped, genome
from markerloom.operators.align import hits
from markerloom.sources import readers

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def bases(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def full_matrix(query, target):
    """The best score of the whole query with free ends of the target."""
    low = -(10**9)
    h, e = [0] * (len(target) + 1), [low] * (len(target) + 1)
    for q in query:
        new, f = [], low
        up = [max(a + banded.OPEN, b) + banded.EXTEND for a, b in zip(h, e)]
        for j in range(len(target) + 1):
            f = max(new[j - 1] + banded.OPEN, f) + banded.EXTEND if j else low
            diagonal = h[j - 1] + (banded.MATCH if q == target[j - 1] and q in "ACGT" else banded.MISMATCH) if j else low
            new.append(max(diagonal, up[j], f))
        h, e = new, up
    return max(h)


def rescored(query, target, begin, cigar):
    i, j, total = 0, begin, 0
    for n, kind in re.findall(r"(\d+)([MID])", cigar):
        n = int(n)
        if kind == "M":
            total += sum(banded.MATCH if 0 <= j + x < len(target) and query[i + x] == target[j + x] and query[i + x] in "ACGT" else banded.MISMATCH for x in range(n))
            i, j = i + n, j + n
        else:
            total += banded.OPEN + banded.EXTEND * n
            i, j = (i + n, j) if kind == "I" else (i, j + n)
    assert i == len(query)
    return total


def edited(rng, s, kind, n, at):
    if kind == "deleted":
        return s[:at] + s[at + n :]
    if kind == "inserted":
        return s[:at] + bases(rng, n) + s[at:]
    return s[:at] + {"A": "C", "C": "G", "G": "T", "T": "A"}[s[at]] + s[at + 1 :]


def test_banded_alignment_is_that_of_the_full_matrix():
    rng = random.Random(1)
    queries, targets, width = [], [], 61
    for k in range(150):
        size = rng.randint(30, 110)
        target = bases(rng, size + width - 1)
        query = target[30 : 30 + size]
        if k % 3:
            query = edited(rng, query, ["inserted", "deleted"][k % 2], 1 + k % 10, size // 2)
        if k % 5 == 0:
            query = edited(rng, query, "changed", 1, 3)
        if k % 7 == 0:
            query = query[:12] + "N" + query[13:]
        queries.append(query)
        targets.append((target + bases(rng, 20))[: len(query) + width - 1])
    score, begin, cigar = banded.align_batch([q.encode() for q in queries], [t.encode() for t in targets], width)
    for q, t, s, b, c in zip(queries, targets, score.tolist(), begin.tolist(), cigar):
        assert s == full_matrix(q, t) == rescored(q, t, b, c)


def test_batches_of_any_size_align_alike(monkeypatch):
    rng = random.Random(2)
    pairs = [((t := bases(rng, n + 20))[10 : 10 + n], t) for n in (5, 300, 17, 17, 90)]
    whole = banded.align_batch([q.encode() for q, _ in pairs], [t.encode() for _, t in pairs], 21)
    monkeypatch.setattr(banded, "CELLS", 1)
    one = banded.align_batch([q.encode() for q, _ in pairs], [t.encode() for _, t in pairs], 21)
    assert whole[0].tolist() == one[0].tolist() == [2 * len(q) for q, _ in pairs] and whole[2] == one[2] and whole[1].tolist() == [10] * 5


@pytest.mark.parametrize("w", [1, 4, 10])
def test_a_window_of_a_marker_has_its_minimisers_in_the_genome(w):
    rng = random.Random(w)
    whole = bases(rng, 3000) + "N" * 20 + "ACACACACACACACACACACACACACACACACACACACACACACACAC" + bases(rng, 500)
    at, seed, _ = genome.minimisers(whole.encode(), 11, w)
    index = {}
    for p, s in zip(at.tolist(), seed.tolist()):
        index.setdefault(s, set()).add(p)
    for _ in range(200):
        n = rng.randint(11 + w - 1, 90)
        begin = rng.randint(0, len(whole) - n)
        marker = whole[begin : begin + n]
        if "N" in marker:
            continue
        for own, place in ((marker, lambda p: begin + p), (marker.translate(COMPLEMENT)[::-1], lambda p: begin + n - 11 - p)):
            p, s, _ = genome.minimisers(own.encode(), 11, w)
            assert len(p) and all(place(x) in index[y] for x, y in zip(p.tolist(), s.tolist()))


def test_tiles_and_index_of_contigs_of_any_size(spark):
    rng = random.Random(3)
    contigs = {"a": bases(rng, 1000), "b": bases(rng, 64), "c": bases(rng, 12), "d": "", "e": bases(rng, 5) + "nnn" + bases(rng, 300).lower()}
    df = spark.createDataFrame(list(contigs.items()), "contig string, sequence string")
    index = genome.genome_index(df, k=9, w=4, size=64)
    for r in index.tiles.collect():
        assert r.bases == contigs[r.contig].upper()[r.tile * 64 : r.tile * 64 + 64 + index.overlap]
    got = {(r.contig, r.pos, r.seed, r.rev) for r in index.seeds.collect()}
    expected = {(c, int(p), int(s), bool(v)) for c, x in contigs.items() for p, s, v in zip(*genome.minimisers(x.upper().encode(), 9, 4))}
    assert got == expected
    cut = [(c, at, x[at : at + 37]) for c, x in contigs.items() for at in range(0, len(x), 37)]
    again = genome.genome_index(spark.createDataFrame(cut, "contig string, start long, bases string"), k=9, w=4, size=64)
    assert {(r.contig, r.pos, r.seed, r.rev) for r in again.seeds.collect()} == expected
    assert {r.contig: r.length for r in again.lengths.collect()} == {c: len(x) for c, x in contigs.items() if x}


def test_genome_in_pieces_over_several_splits(spark, tmp_path):
    rng = random.Random(4)
    contigs = {f"chr{i}": bases(rng, n) for i, n in enumerate((9000, 3, 0, 20000, 700))}
    text = "".join(f">{c} more words\n" + "".join(f"{x[at : at + 61]}\n" for at in range(0, len(x), 61)) for c, x in contigs.items())
    (tmp_path / "g.fa").write_text(text)
    (tmp_path / "h.fna").write_text(">other\r\nACGT\r\nAC\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        rows = readers.read_genome_pieces(spark, str(tmp_path), most=500).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    joined = {}
    for r in sorted(rows, key=lambda r: (r.contig, r.start)):
        assert len(r.bases) <= 561 and r.start == len(joined.get(r.contig, ""))
        joined[r.contig] = joined.get(r.contig, "") + r.bases
    assert joined == {c: x for c, x in contigs.items() if x} | {"other": "ACGTAC"} and len(rows) > 50


def test_planted_gaps_are_found_at_their_place(spark, monkeypatch):
    monkeypatch.setattr(gapped, "RARE", 50)
    rng = random.Random(5)
    contigs = {"c1": bases(rng, 9000), "c2": bases(rng, 4000)}
    markers, planted = [], {}
    for k in range(60):
        contig = "c1" if k % 3 else "c2"
        at = rng.randint(0, len(contigs[contig]) - 130)
        s = edited(rng, contigs[contig][at : at + 120], ["inserted", "deleted", "changed"][k % 3], 1 + k % 10, 55 + k % 9)
        strand = "+-"[k % 2]
        markers.append((k, s if strand == "+" else s.translate(COMPLEMENT)[::-1]))
        planted[k] = (contig, at, strand, s)
    markers += [(100, contigs["c1"][-100:] + "ACGT"), (101, "AC"), (102, None), (103, "N" * 50), (104, contigs["c2"][:40].lower())]
    index = genome.genome_index(spark.createDataFrame(list(contigs.items()), "contig string, sequence string"), k=13, w=6, size=512)
    rows = gapped.gapped_hits(spark.createDataFrame(markers, "id int, sequence string"), index).collect()
    best = {}
    for r in rows:
        best.setdefault(r.id, []).append(r)
    for k, (contig, at, strand, s) in planted.items():
        r = max(best[k], key=lambda r: r.score)
        assert (r.contig, r.position, r.strand) == (contig, at, strand)
        assert r.score == full_matrix(s, contigs[contig][max(0, at - 40) : at + 180]) == rescored(s, contigs[contig], r.position, r.cigar)
        assert ("I" in r.cigar, "D" in r.cigar) == (k % 3 == 0, k % 3 == 1)
    assert [(r.contig, r.position, r.score) for r in best[104]] == [("c2", 0, 80)] and best[100][0].position == 8900
    assert not {101, 102, 103} & set(best)


def test_exact_places_are_those_of_the_ungapped_search_even_in_repeats(spark, monkeypatch):
    monkeypatch.setattr(gapped, "HOT", 300)
    rng = random.Random(6)
    repeat = bases(rng, 50)
    contig = "".join(repeat + bases(rng, rng.randint(40, 60)) for _ in range(1500))
    df = spark.createDataFrame([("c", contig)], "contig string, sequence string")
    markers = spark.createDataFrame([("repeat", repeat), ("unique", contig[30:110]), ("back", contig[1000:1060].translate(COMPLEMENT)[::-1])], "id string, sequence string")
    got = gapped.gapped_hits(markers, genome.genome_index(df, k=15, w=10))
    exact = {(r.id, r.contig, r.position, r.strand) for r in got.where(F.col("cigar").rlike("^[0-9]+M$") & F.col("score").isin(100, 160, 120)).collect()}
    plain = {(r.id, r.contig, r.position, r.strand) for r in hits(markers, df).where(F.col("score").isin(100, 160, 120)).collect()}
    places = {m.start() for m in re.finditer(f"(?={repeat})", contig)}
    assert exact == plain and {p for i, _, p, _ in exact if i == "repeat"} == places and len(places) == 1500


def test_of_close_places_the_best_stay(spark):
    rng = np.random.default_rng(7)
    rows = sorted({int(p): int(s) for p, s in zip(rng.integers(0, 20000, 800), rng.integers(1, 90, 800))}.items())
    df = spark.createDataFrame([(1, "c", "+", p, s, "1M") for p, s in rows], "id int, contig string, strand string, position long, score long, cigar string")
    got = {(r.position, r.score) for r in gapped.nearest_best(df).collect()}
    assert got == {(p, s) for p, s in rows if not any(abs(p - q) < gapped.NEAR and t > s for q, t in rows)}


def places(spark, contigs, markers):
    index = genome.genome_index(spark.createDataFrame(contigs, "contig string, sequence string"))
    found = gapped.gapped_hits(spark.createDataFrame(markers, "id string, sequence string"), index)
    return {(r.id, r.contig, r.position) for r in found.collect()}


def test_a_seed_of_the_change_that_is_rarer_than_those_of_the_place(spark, monkeypatch):
    """The passage of a marker is frequent, what was put into it is elsewhere in the genome, but rare."""
    monkeypatch.setattr(gapped, "RARE", 2)
    rng = random.Random(8)
    passage = bases(rng, 120)
    marker = passage[:60] + "GATTACA" + passage[60:]
    contigs = [(f"c{i}", bases(rng, 90) + passage + bases(rng, 90)) for i in range(5)] + [("other", bases(rng, 50) + marker[42:84] + bases(rng, 50))]
    assert {(c, p) for _, c, p in places(spark, contigs, [("m", marker)])} >= {(f"c{i}", 90) for i in range(5)}


@pytest.mark.parametrize("unit", ["A", "GTAA", "TCGCCG"])
def test_places_of_a_tandem_repeat_are_all_near_one(spark, monkeypatch, unit):
    monkeypatch.setattr(gapped, "RARE", 2)
    repeat = unit * (228 // len(unit))
    contig, own = repeat + bases(random.Random(5), 200), (repeat * 2)[:120]
    exact = [x for x in range(len(repeat) - 119) if contig.startswith(own, x)]
    for marker in (own, own.translate(COMPLEMENT)[::-1]):
        found = [p for _, _, p in places(spark, [("c", contig)], [("m", marker)])]
        assert all(min(abs(x - p) for p in found) < 24 for x in exact)
