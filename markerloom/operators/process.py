"""From reads to a marker table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.functions.sequences import kmer_signature, normalised
from markerloom.operators.merge import numbered
from markerloom.plans.lineage import stored
from markerloom.table import MarkerTable
from markerloom.types import MAX_DEPTH, MarkerError


def read_counts(reads: DataFrame) -> DataFrame:
    """``sequence, individual, depth`` from ``individual, sequence``: equal normalised reads are counted, up to 65535."""
    each = reads.select("individual", normalised(F.col("sequence")).alias("sequence"))
    return each.groupBy("sequence", "individual").agg(F.least(F.count("*"), F.lit(MAX_DEPTH)).cast("int").alias("depth"))


def representatives(totals: DataFrame, k: int) -> DataFrame:
    """``sequence`` of the marker with the most reads in each group of equal k-mer signatures (the first in order of ties);
    ``totals`` has ``sequence, total``."""
    best = F.min_by("sequence", F.struct(-F.col("total"), F.col("sequence")))
    return totals.groupBy(kmer_signature(F.col("sequence"), k).alias("signature")).agg(best.alias("sequence")).select("sequence")


def process(reads: DataFrame, individuals: Sequence[str] | None = None, *, min_depth: int = 1, kmer_dedup: int | None = None, layout: str = "array") -> MarkerTable:
    """Markers with ``min_depth`` reads or more in some individual; ``individuals`` fixes the columns (an individual without
    reads is all zeros), else they are those that occur, by name. ``n_before_filter`` is the number of distinct sequences;
    ``layout`` is ``"array"`` or ``"sparse"``.

    Reads are shuffled as counts, by sequence and individual and then by sequence, where the depths of a marker meet; markers
    are only sorted after that."""
    if min_depth < 1:
        raise MarkerError("min_depth must be 1 or more")
    counts = read_counts(reads)
    if individuals is None:
        counts = stored(counts, "read-counts")
        individuals = [r.individual for r in counts.select("individual").distinct().orderBy("individual").collect()]  # the columns
    places = MarkerTable(counts, individuals).places()
    entry = F.struct(F.col("col"), F.col("depth"))
    markers = counts.join(F.broadcast(places), "individual").groupBy("sequence").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.max("depth").alias("most"), F.sum("depth").alias("total"))
    markers = markers.where(F.col("most") >= min_depth)
    if kmer_dedup:
        markers = stored(markers, "markers")
        markers = markers.join(representatives(markers.select("sequence", "total"), kmer_dedup), "sequence", "left_semi")
    rows = numbered(markers.select("sequence", "entries"), F.col("sequence"))
    table = MarkerTable(rows.select("ord", F.col("ord").cast("string").alias("id"), "sequence", "entries"), list(individuals), layout="sparse")
    return table if layout == "sparse" else table.arrays()
