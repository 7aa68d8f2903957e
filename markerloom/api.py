"""Functions from files, Arrow tables or frames to Arrow tables or files, for users who don't hold DataFrames.

``markers`` is a path (TSV or Parquet), an Arrow table, a pandas frame or a Spark frame with an id, a sequence and a column
for each individual; ``popmap`` a path, an Arrow table or (individual, group) pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from markerloom.operators.merge import merge as merge_tables
from markerloom.operators.process import process as process_reads
from markerloom.results import TriageResult
from markerloom.sources import readers, writers
from markerloom.table import MarkerTable


@dataclass(frozen=True)
class TriageParams:
    """Parameters of :func:`triage_to_arrow` that go together."""

    group1: str = "M"
    group2: str = "F"
    min_depth: int = 10
    threshold: float = 0.05
    posterior_threshold: float = 0.9
    bayes_factor_threshold: float = 10.0
    prior: float = 0.01
    linked: float = 0.9

    def __call__(self, table: MarkerTable) -> DataFrame:
        return table.triage(**asdict(self))


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("markerloom").getOrCreate()


def pairs(popmap) -> list[tuple[str, str]]:
    if popmap is None:
        return []
    if isinstance(popmap, str):
        return readers.read_popmap(session(), popmap)
    if isinstance(popmap, pa.Table):
        return readers.popmap_pairs(popmap)
    return [tuple(x) for x in popmap]


def marker_table(markers, popmap=None) -> MarkerTable:
    """A :class:`MarkerTable` from any form of ``markers``."""
    spark, people = session(), pairs(popmap)
    if isinstance(markers, MarkerTable):
        return markers.with_popmap(people) if people else markers
    if isinstance(markers, str):
        return readers.read_marker_parquet(spark, markers, people) if markers.rstrip("/").endswith(".parquet") else readers.read_marker_tsv(spark, markers, people)
    if isinstance(markers, DataFrame):
        return readers.from_frame(markers, people)
    return readers.from_frame(spark.createDataFrame(markers), people)


def _to_arrow(name: str) -> Callable[..., pa.Table]:
    def call(markers, popmap=None, **parameters) -> pa.Table:
        return getattr(marker_table(markers, popmap), name)(**parameters).toArrow()

    call.__name__, call.__doc__ = f"{name}_to_arrow", f"The rows of ``MarkerTable.{name}`` as an Arrow table."
    return call


freq_to_arrow, distrib_to_arrow, signif_to_arrow, subset_to_arrow, triage_to_arrow, depth_to_arrow = map(_to_arrow, ("freq", "distrib", "signif", "subset", "triage", "depth"))


def triage(markers, popmap=None, params: TriageParams | None = None) -> TriageResult:
    """Candidates with conversions and a summary."""
    return TriageResult((params or TriageParams())(marker_table(markers, popmap)))


def map_to_arrow(markers, genome: str, popmap=None, **parameters) -> pa.Table:
    """Places of markers on the FASTA files of ``genome``."""
    return marker_table(markers, popmap).map(readers.read_genome_pieces(session(), genome), **parameters).toArrow()


def pca_to_arrow(markers, **parameters) -> tuple[pa.Table, pa.Table]:
    """Components and loadings."""
    result = marker_table(markers).pca(**parameters)
    return result.components.toArrow(), result.loadings.toArrow()


def process(input_dir: str, output_file: str, min_depth: int = 1, kmer_dedup: int | None = None) -> None:
    """A folder of reads to a marker table."""
    spark = session()
    writers.write_markers(process_reads(readers.read_fastx(spark, input_dir), readers.individuals_of(spark, input_dir), min_depth=min_depth, kmer_dedup=kmer_dedup), output_file)


def merge(inputs: Sequence[str], output: str) -> None:
    """Marker tables to one, as Parquet if ``output`` ends so."""
    table = merge_tables([marker_table(x) for x in inputs])
    (writers.write_parquet if output.endswith(".parquet") else writers.write_markers)(table, output)
