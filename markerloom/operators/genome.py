"""A genome in tiles of a fixed size and an index of its minimisers, both stored.

No cell holds a contig: pieces of any size (``contig, start, bases``) are dealt to tiles that overlap by a little more than a
window of seeds. Of each window of ``w`` k-mers the one with the least hash is kept, on the strand that is smaller (all of
them, where several are equal), so a marker that has a window in common with the genome has a minimiser in common with it,
on either strand."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.plans.lineage import stored

#: Bases of a tile without its overlap; those of a piece of a contig that comes whole.
TILE, PIECE = 1 << 14, 1 << 20
_CODE = np.full(256, 4, np.uint8)
for _i, _b in enumerate(b"ACGT"):
    _CODE[_b] = _CODE[_b + 32] = _i


@dataclass(frozen=True)
class GenomeIndex:
    """``tiles``: contig, tile, bases. ``seeds``: seed, contig, pos, rev. ``lengths``: contig, length. All stored."""

    tiles: DataFrame
    seeds: DataFrame
    lengths: DataFrame
    k: int
    w: int
    size: int
    overlap: int


def kmers(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the smaller of its k-mer and the reverse complement as a number, which of them it is, and whether all of it
    is bases."""
    code = _CODE[bases]
    n = len(code) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, bool)
    bad = np.cumsum(np.append(0, code > 3))
    forward, backward = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        base = (code[j : j + n] & 3).astype(np.uint64)
        forward |= base << np.uint64(2 * (k - 1 - j))
        backward |= (np.uint64(3) - base) << np.uint64(2 * j)
    return np.minimum(forward, backward), backward < forward, bad[k:] == bad[:n]


def order_of(seed: np.ndarray, good: np.ndarray) -> np.ndarray:
    """What the least seed of a window is chosen by; those of other letters come last."""
    h = seed * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return np.where(good, h, np.uint64(0xFFFFFFFFFFFFFFFF))


def minimisers(bases: bytes, k: int, w: int, windows: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places, seeds and strands of the minimisers of windows of ``w`` k-mers (of one window, if there are fewer k-mers); of
    the first ``windows`` of them only, if given."""
    seed, rev, good = kmers(np.frombuffer(bases, np.uint8), k)
    if not len(seed):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), rev
    h = order_of(seed, good)
    w = min(w, len(h))
    least = np.lib.stride_tricks.sliding_window_view(h, w).min(axis=1)[:windows]
    # A place is kept if it is the least of one of the windows that it is in.
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(max(0, len(h) - len(least)), np.uint64)])
    top = np.lib.stride_tricks.sliding_window_view(around, w).max(axis=1)[: len(h)]
    at = np.flatnonzero((top == h) & good)
    return at, seed[at].astype(np.int64), rev[at]


def pieces(genome: DataFrame) -> DataFrame:
    """``contig, start, bases`` of a genome that has them, or ``contig, sequence``."""
    if "bases" in genome.columns:
        return genome.select("contig", F.col("start").cast("long").alias("start"), F.upper("bases").alias("bases"))
    cut = F.regexp_extract_all(F.upper("sequence"), F.lit("(?s).{1,%d}" % PIECE), F.lit(0))
    return genome.select("contig", F.posexplode(cut).alias("nth", "bases")).select("contig", (F.col("nth").cast("long") * PIECE).alias("start"), "bases")


def tiles_of(parts: DataFrame, size: int, overlap: int) -> DataFrame:
    """``contig, tile, bases``: tiles that begin at every ``size`` bases and end ``overlap`` bases after the next one begins."""
    end = F.col("start") + F.length("bases")
    first = F.greatest(F.lit(0), F.floor((F.col("start") - overlap) / size)).cast("int")
    each = parts.where(F.length("bases") > 0).select("*", F.explode(F.sequence(first, F.floor((end - 1) / size).cast("int"))).alias("tile"))
    begin = F.greatest("start", F.col("tile").cast("long") * size)
    upto = F.least(end, (F.col("tile").cast("long") + 1) * size + overlap)
    cut = each.where(begin < upto).select("contig", "tile", begin.alias("at"), F.substring("bases", (begin - F.col("start") + 1).cast("int"), (upto - begin).cast("int")).alias("part"))
    # One tile's at most.
    return cut.groupBy("contig", "tile").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda x: x["part"]), "").alias("bases"))


def genome_index(genome: DataFrame, k: int = 15, w: int = 10, size: int = TILE) -> GenomeIndex:
    """The tiles and the index of a genome: ``contig, sequence``, or pieces of contigs as ``contig, start, bases``."""
    overlap = k + w - 2
    parts = pieces(genome)
    tiles = stored(tiles_of(parts, size, overlap), "tiles")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, (tile, bases) in enumerate(zip(b.column("tile").to_pylist(), b.column("bases").to_pylist())):
                at, seed, rev = minimisers(bases.encode(), k, w, size)
                out.append((seed, np.full(len(at), i), at + tile * size, rev))
            if out:
                seed, row, pos, rev = (np.concatenate(c) for c in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(seed), b.column("contig").take(pa.array(row)), pa.array(pos), pa.array(rev)], ["seed", "contig", "pos", "rev"])

    seeds = stored(tiles.mapInArrow(find, "seed long, contig string, pos long, rev boolean"), "minimisers")
    lengths = stored(tiles.groupBy("contig").agg(F.max(F.col("tile").cast("long") * size + F.length("bases")).alias("length")), "contigs")
    return GenomeIndex(tiles, seeds, lengths, k, w, size, overlap)
