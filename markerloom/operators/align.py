"""Places of markers on a genome, by k-mer seeds and ungapped extension.

Seeds of the markers meet those of the contigs in an equi-join; hits vote for a strand, contig and diagonal; the best
diagonals are scored without gaps, tile by tile, so a marker may be of any length (:func:`hits`). :func:`align` takes places
with gaps, from :mod:`markerloom.operators.gapped`, unless it is asked for those without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.functions.sequences import reverse_complement
from markerloom.operators.gapped import gapped_hits
from markerloom.operators.genome import GenomeIndex, genome_index
from markerloom.plans.cells import cells, corrected, with_statistics
from markerloom.table import MarkerTable
from markerloom.types import Correction, least_individuals, single

MATCH, MISMATCH = 2, -8
#: Bases of a tile of a contig, without its overlap.
TILE = 2000


def seeds(df: DataFrame, sequence: str, k: int, step: int) -> DataFrame:
    """``pos`` from 0 and ``seed`` for each k-mer of pure bases."""
    places = F.when(F.length(sequence) >= k, F.sequence(F.lit(0), F.length(sequence) - k, F.lit(step))).otherwise(F.array().cast("array<int>"))
    each = df.withColumn("pos", F.explode(places))
    return each.withColumn("seed", F.substring(F.col(sequence), F.col("pos") + 1, F.lit(k))).where(F.col("seed").rlike("^[ACGT]+$"))


def tiles(genome: DataFrame, size: int, overlap: int) -> DataFrame:
    """``contig, tile_start, tile``: contigs cut in pieces that overlap, in one walk over each contig."""
    parts = genome.select("contig", F.regexp_extract_all(F.upper("sequence"), F.lit("(?s).{1,%d}" % size), F.lit(0)).alias("parts"))
    with_next = F.transform("parts", lambda x, i: F.concat(x, F.substring(F.coalesce(F.get("parts", i + 1), F.lit("")), 1, overlap)))
    return parts.select("contig", F.posexplode(with_next).alias("nth", "tile")).select("contig", (F.col("nth") * size).alias("tile_start"), "tile")


def hits(markers: DataFrame, genome: DataFrame, *, k: int = 15) -> DataFrame:
    """``id, contig, position, strand, score`` of each marker's diagonals, scored without gaps over the whole marker."""
    both = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.upper("sequence").alias("query")), F.struct(F.lit("-").alias("strand"), reverse_complement(F.upper("sequence")).alias("query"))))
    query = markers.select("id", both.alias("x")).select("id", "x.strand", "x.query")
    marker_seeds = seeds(query, "query", k, 1).select("id", "strand", "query", F.col("pos").alias("q"), "seed")
    cut = tiles(genome, TILE, k)
    # Half of the seeds of a tile suffice: those that begin in its own part and at an even place.
    genome_seeds = seeds(cut, "tile", k, 2).where(F.col("pos") < TILE).select("contig", "tile_start", F.col("pos").alias("t"), "seed")
    places = marker_seeds.join(genome_seeds, "seed").select("id", "strand", "query", "contig", (F.col("tile_start") + F.col("t") - F.col("q")).alias("position")).where("position >= 0").distinct()
    # What a place has in each tile that it touches; bases beyond the end of a contig have none, and count as mismatches.
    last = F.col("position") + F.length("query") - 1
    touched = places.withColumn("tile_start", F.explode(F.sequence((F.col("position") - F.col("position") % TILE).cast("int"), last.cast("int"), F.lit(TILE))))
    begin, end = F.greatest("position", "tile_start"), F.least(last + 1, F.col("tile_start") + TILE)
    pieces = touched.select("id", "contig", "position", "strand", "tile_start", F.length("query").alias("bases"), F.substring("query", begin - F.col("position") + 1, end - begin).alias("query"), (begin - F.col("tile_start") + 1).alias("at"))
    found = pieces.join(cut, ["contig", "tile_start"]).withColumn("target", F.substring("tile", F.col("at"), F.length("query")))
    same = F.size(F.filter(F.sequence(F.lit(1), F.length("query")), lambda i: F.substring("query", i, F.lit(1)) == F.substring("target", i, F.lit(1))))
    whole = found.select("id", "contig", "position", "strand", "bases", same.alias("same")).groupBy("id", "contig", "position", "strand", "bases").agg(F.sum("same").alias("same"))
    return whole.select("id", "contig", "position", "strand", (F.col("same") * (MATCH - MISMATCH) + F.col("bases") * MISMATCH).cast("int").alias("score"))


def index_for(markers: DataFrame, genome: DataFrame, k: int, w: int = 10) -> GenomeIndex:
    """An index whose windows fit in the shortest of these markers that has a seed at all."""
    shortest = markers.where(F.length("sequence") >= k).agg(F.min(F.length("sequence"))).first()[0]
    return genome_index(genome, k, max(1, min(w, (shortest or k + w) - k + 1)))


def align(table: MarkerTable, genome: DataFrame | GenomeIndex, *, group1: str | None = None, group2: str | None = None, min_depth: int = 1, min_quality: int = 20, min_frequency: float = 0.1, threshold: float = 0.05, correction: Correction | str = "bonferroni", k: int = 15, gapped: bool = True) -> DataFrame:
    """``Contig, Position, Length, Marker_id, Bias, P, CorrectedP, Signif`` of markers with a unique best place whose quality
    (60 for no second place, less the closer the second one scores) is at least ``min_quality``. ``genome`` has ``contig,
    sequence``, or ``contig, start, bases`` (pieces of contigs), or is an index made before."""
    groups, correction = table.groups(group1, group2), Correction.of(correction)
    counts = table.counts_twice(min_depth, groups)
    stats = with_statistics(cells(counts), groups).drop("markers")
    enough = counts.where(F.col("n_ind") >= max(1, least_individuals(min_frequency, len(table.popmap))))
    markers = enough.select("id", "sequence")
    if gapped or isinstance(genome, GenomeIndex):
        index = genome if isinstance(genome, GenomeIndex) else index_for(markers, genome, k)
        scored, contigs = gapped_hits(markers, index), index.lengths
    else:
        scored, contigs = hits(markers, genome, k=k).where("score > 0"), genome.select("contig", F.length("sequence").cast("bigint").alias("length"))
    # Places are counted by score first, so that a marker with very many places is no hot key; of equally good ones none is the best.
    by_score = scored.groupBy("id", "score").agg(F.count("*").alias("n"), F.max(F.struct("contig", "position")).alias("place"))
    down = W.partitionBy("id").orderBy(F.desc("score"))
    best = by_score.select("id", "score", "n", "place", F.lead("score").over(down).alias("second"), F.row_number().over(down).alias("k")).where("k = 1")
    quality = F.floor(60 * (1 - F.coalesce("second", F.lit(0)) / F.col("score")))
    unique = best.where((quality >= min_quality) & (F.col("n") == 1)).select("id", "place.contig", "place.position")
    lengths = contigs.select("contig", F.col("length").alias("Length"))
    limit = F.lit(single(threshold)) / (F.greatest("n_markers", F.lit(1)) if correction is Correction.BONFERRONI else F.lit(1))
    out = unique.join(enough, "id").join(F.broadcast(stats), ["g1", "g2"]).join(lengths, "contig", "left")
    p = F.col("p") if correction is Correction.NONE else corrected(Correction.BONFERRONI)
    return out.select(F.col("contig").alias("Contig"), F.col("position").cast("bigint").alias("Position"), "Length", F.col("id").alias("Marker_id"), F.col("bias").alias("Bias"), F.col("p").alias("P"), p.alias("CorrectedP"), (F.col("p") < limit).alias("Signif"))
