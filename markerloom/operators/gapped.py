"""Places of markers on a genome with gaps: minimisers, seeds chained by diagonal, banded alignment.

1. The minimisers of a marker are looked up in the index of the genome: the rarest of each of its ``STRETCHES`` always, however
   frequent, and of the rarest ``SEEDS`` those with up to ``RARE`` places. A place that has all of some stretch as it is, and so the
   minimisers of its windows, is found, whatever seeds the changes of the marker have elsewhere.
2. Places of a frequent seed are dealt out by salt, so a repeat is as many tasks as its copies need.
3. Seeds of one marker, contig and strand whose diagonals differ by little are one candidate.
4. The genome around a candidate is put together from its tiles, and aligned in a band that is wide enough for gaps of 24 bases.
5. A candidate is the best place of its band, of equally good ones that nearest to its own diagonals. Of places that begin
   within a few bases of each other, the best stay: equally good ones of several candidates, as in tandem repeats, all do.

Defined cases: a marker that is shorter than a seed, or has no seed without other letters than ACGT, has no places; letters
other than ACGT and places beyond the ends of a contig are mismatches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.functions.banded import align_batch
from markerloom.functions.sequences import reverse_complement
from markerloom.operators.genome import GenomeIndex, minimisers
from markerloom.plans.lineage import few_rows, stored

#: Seeds of a marker that are looked up; places of all of them but the rarest of a stretch; places of a seed that one salt takes.
SEEDS, RARE, HOT = 8, 1000, 10_000
#: Stretches of a marker, each of a window of seeds at least: fewer for short ones.
STRETCHES = 3
#: Diagonals of a candidate, those around it that a gap may lead to, and how close two places of one alignment may begin.
DIAGONALS, AROUND, NEAR = 16, 24, 32


def _seeds(bases: bytes, k: int, w: int) -> list[tuple[int, int, bool, int]]:
    """Place, seed, strand and stretch of the minimisers of a marker, -1 for those of windows across stretches only."""
    at, seed, rev = minimisers(bases, k, w)
    n = max(1, min(STRETCHES, len(bases) // (k + w - 1)))
    stretch = np.full(len(at), -1)
    for i in range(n):
        begin, end = len(bases) * i // n, len(bases) * (i + 1) // n
        stretch[np.isin(at, minimisers(bases[begin:end], k, w)[0] + begin)] = i
    return list(zip(at.tolist(), seed.tolist(), rev.tolist(), stretch.tolist()))


def seeds_of(markers: DataFrame, k: int, w: int) -> DataFrame:
    """``id, bases, at, seed, rev, stretch`` of the minimisers of markers (id, sequence)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *x) for i, s in enumerate(b.column("sequence").to_pylist()) if s for x in _seeds(s.encode(), k, w)]
            row, at, seed, rev, stretch = zip(*rows) if rows else ((), (), (), (), ())
            bases = pa.array([len(b.column("sequence")[i].as_py()) for i in row], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row, pa.int64())), bases, pa.array(at, pa.int32()), pa.array(seed, pa.int64()), pa.array(rev, pa.bool_()), pa.array(stretch, pa.int32())], ["id", "bases", "at", "seed", "rev", "stretch"])

    kind = dict(markers.dtypes)["id"]
    return markers.select("id", "sequence").mapInArrow(find, f"id {kind}, bases int, at int, seed long, rev boolean, stretch int").distinct()


def candidates(markers: DataFrame, index: GenomeIndex) -> DataFrame:
    """``id, contig, strand, diagonal``: where alignments may begin, in steps of ``DIAGONALS``; each once."""
    own = stored(seeds_of(markers, index.k, index.w), "marker-seeds")
    places = index.seeds.groupBy("seed").agg(F.count("*").alias("n")).join(own.select("seed").distinct(), "seed", "left_semi")
    places = stored(places, "seed-places")
    rank = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("n", "seed", "at"))  # noqa: E731  # of the minimisers of one marker
    ranked = own.join(places, "seed").withColumns({"rank": rank("id"), "first": (rank("id", "stretch") == 1) & (F.col("stretch") >= 0)})
    chosen = ranked.where(F.col("first") | (F.col("rank") == 1) | ((F.col("rank") <= SEEDS) & (F.col("n") <= RARE)))
    salts = F.ceil(F.col("n") / F.lit(HOT)).cast("int")
    hot = few_rows(stored(places.where(salts > 1).select(F.col("seed").alias("hot"), salts.alias("salts")), "hot-seeds"))  # a row for HOT places at least
    asked = chosen.select("id", "bases", "at", "seed", "rev", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    there = index.seeds.join(hot, F.col("seed") == F.col("hot"), "left")
    there = there.select("seed", "contig", "pos", F.col("rev").alias("there_rev"), F.pmod(F.xxhash64("contig", "pos"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    met = asked.join(there, ["seed", "salt"])
    same = F.col("rev") == F.col("there_rev")
    start = F.col("pos") - F.when(same, F.col("at")).otherwise(F.col("bases") - index.k - F.col("at"))
    return met.select("id", "contig", F.when(same, "+").otherwise("-").alias("strand"), (F.floor(start / DIAGONALS) * DIAGONALS).cast("long").alias("diagonal")).distinct()


def gapped_hits(markers: DataFrame, index: GenomeIndex) -> DataFrame:
    """``id, contig, position, strand, score, cigar`` of the places of markers (id, sequence) whose score is above 0."""
    found = stored(candidates(markers, index), "candidates")
    width = DIAGONALS + 2 * AROUND
    upper = F.upper("sequence")
    asked = found.join(markers.select("id", upper.alias("sequence")), "id").select("id", "contig", "strand", "diagonal", F.when(F.col("strand") == "+", F.col("sequence")).otherwise(reverse_complement(F.col("sequence"))).alias("query"))
    first, bases = F.col("diagonal") - AROUND, F.length("query") + width - 1
    # The window may begin before its contig, and end after it.
    tile = F.explode(F.sequence(F.greatest(F.lit(0), F.floor(first / index.size)).cast("int"), F.greatest(F.lit(0), F.floor((first + bases - 1) / index.size)).cast("int")))
    touched = asked.select("*", first.cast("long").alias("first"), (first + bases).cast("long").alias("upto"), tile.alias("tile"))
    base = F.col("tile").cast("long") * index.size
    begin, end = F.greatest("first", base), F.least(F.col("upto"), base + index.size)
    parts = touched.join(index.tiles, ["contig", "tile"]).select("id", "contig", "strand", "diagonal", "query", "first", F.struct(begin.alias("at"), F.substring("bases", (begin - base + 1).cast("int"), (end - begin).cast("int")).alias("part")).alias("x"))
    whole = parts.groupBy("id", "contig", "strand", "diagonal", "query", "first").agg(F.sort_array(F.collect_list("x")).alias("parts"))  # one marker's window
    window = F.concat(F.repeat(F.lit("-"), F.greatest(F.lit(0), -F.col("first")).cast("int")), F.array_join(F.transform("parts", lambda x: x["part"]), ""))
    pairs = whole.select("id", "contig", "strand", "first", "query", window.alias("window"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, begin, cigars = align_batch([q.encode() for q in b.column("query").to_pylist()], [t.encode() for t in b.column("window").to_pylist()], width)
            at = pa.array(b.column("first").to_numpy() + begin)
            yield pa.RecordBatch.from_arrays([*b.select(["id", "contig", "strand"]).columns, at, pa.array(values), pa.array(cigars, pa.string())], ["id", "contig", "strand", "position", "score", "cigar"])

    kind = dict(markers.dtypes)["id"]
    scored = pairs.mapInArrow(score, f"id {kind}, contig string, strand string, position long, score long, cigar string").where("score > 0")
    best = scored.groupBy("id", "contig", "strand", "position").agg(F.max(F.struct("score", "cigar")).alias("x")).select("id", "contig", "strand", "position", "x.*")
    return nearest_best(stored(best, "places"))


def nearest_best(places: DataFrame) -> DataFrame:
    """Places but for those that begin within less than ``NEAR`` bases of a better one.

    Places are compared by stretches of a contig, with copies of those near a bound, so a marker of many places is many rows
    of small partitions."""
    stretch = lambda x: F.shiftright(x, 12)
    own = stretch(F.col("position"))
    around = F.array_distinct(F.array(own, stretch(F.col("position") - (NEAR - 1)), stretch(F.col("position") + (NEAR - 1))))
    each = places.withColumn("stretch", F.explode(around))
    close = W.partitionBy("id", "contig", "strand", "stretch").orderBy("position").rangeBetween(-(NEAR - 1), NEAR - 1)
    kept = each.withColumn("top", F.max("score").over(close)).where((F.col("stretch") == own) & (F.col("top") == F.col("score")))
    return kept.select("id", "contig", "position", "strand", F.col("score").cast("int").alias("score"), "cigar")
