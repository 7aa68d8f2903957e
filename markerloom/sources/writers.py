"""Writers of text, FASTA, FASTQ and Parquet."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.functions.kernels import general
from markerloom.operators.pca import PcaResult
from markerloom.sources import block_gzip
from markerloom.sources.single_file import tsv_lines, write_lines
from markerloom.table import MAX_INDIVIDUALS, MarkerTable
from markerloom.types import Groups, MarkerError


def metadata_line(metadata: dict | None) -> str:
    return "#" + ";".join(f"{k}:{general(v) if isinstance(v, float) else v}" for k, v in metadata.items()) + "\n" if metadata else ""


def write_tsv(df: DataFrame, path: str, *, metadata: dict | None = None, order: list[str] | None = None, lower_booleans: bool = False, columns: list[str] | None = None, decimals: int | None = None) -> None:
    """One file: a ``#key:value;...`` line if there are metadata, a header (``columns``, where arrays are spread over several),
    and rows as they come (or ordered)."""
    rows = df.orderBy(*order) if order else df
    write_lines(tsv_lines(rows, decimals=decimals, lower_booleans=lower_booleans), path, metadata_line(metadata) + "\t".join(columns or df.columns) + "\n")


def marker_lines(table: MarkerTable) -> DataFrame:
    """``value``: markers in order, with the depths of all individuals."""
    line = F.concat_ws("\t", "id", "sequence", F.array_join(F.transform("depths", lambda d: d.cast("string")), "\t"))
    return table.arrays().df.orderBy("ord").select(line.alias("value"))


def write_markers(table: MarkerTable, path: str) -> None:
    """A marker table as one file, with its comment line (how many markers there are) and header."""
    if table.n_individuals > MAX_INDIVIDUALS:
        raise MarkerError(f"the format holds {MAX_INDIVIDUALS} individuals at most")
    header = "\t".join(["id", "sequence", *table.individuals])
    write_lines(marker_lines(table), path, lambda n: f"#Number of markers : {n}\n{header}\n")


def write_popmap(popmap: DataFrame, path: str) -> None:
    """``individual, group`` rows (the first two columns) as one file, by individual."""
    first, second = (F.col(f"`{c}`") for c in popmap.columns[:2])
    write_lines(popmap.orderBy(first).select(F.concat_ws("\t", first, second).alias("value")), path)


def write_marker_rows(table: MarkerTable, path: str) -> None:
    """A marker table as a folder of text files, without a header, written by the executors."""
    line = F.concat_ws("\t", "id", "sequence", F.array_join(F.transform("depths", lambda d: d.cast("string")), "\t"))
    table.arrays().df.select(line.alias("value")).write.text(path)


def fasta(df: DataFrame, groups: Groups, min_depth: int) -> DataFrame:
    """``value``: two lines for each marker of ``id, sequence, g1, g2, p, p_corrected``; groups are named in order."""
    pairs = sorted([(groups.group1, "g1"), (groups.group2, "g2")])
    head = F.concat(F.lit(">"), F.col("id"), *[F.concat(F.lit(f"_{g}:"), F.col(c).cast("string")) for g, c in pairs], F.lit("_p:"), F.col("p").cast("string"), F.lit("_pcorr:"), F.col("p_corrected").cast("string"), F.lit(f"_mindepth:{min_depth}"))
    return df.select(F.concat(head, F.lit("\n"), F.col("sequence")).alias("value"))


def write_fasta(df: DataFrame, path: str, groups: Groups, min_depth: int) -> None:
    fasta(df, groups, min_depth).write.text(path)


def write_fasta_file(df: DataFrame, path: str, groups: Groups, min_depth: int) -> None:
    """The same as one file, in the order of markers."""
    write_lines(fasta(df.orderBy("ord"), groups, min_depth), path)


def write_fastq(reads: DataFrame, path: str) -> None:
    """``name, sequence`` rows as a folder of block-gzip FASTQ files, all bases of the best quality."""
    block_gzip.register(reads.sparkSession)
    line = F.concat(F.lit("@"), F.coalesce("name", F.lit("")), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("sequence")))
    reads.where("sequence IS NOT NULL").select(line.alias("line")).write.format("block_gzip_lines").option("extension", "fastq").mode("append").save(path)


def write_reads(reads: DataFrame, path: str, width: int = 60) -> None:
    """``name, sequence`` rows as a folder of FASTA files (``.fna``), written by the executors, ``width`` bases in a line."""
    lines = F.concat(F.array(F.concat(F.lit(">"), "name")), F.regexp_extract_all("sequence", F.lit(".{1,%d}" % width), F.lit(0)))
    reads.select(F.explode(lines).alias("value")).write.option("extension", "fna").option("quote", "\u0000").csv(path)


def wide(table: MarkerTable) -> DataFrame:
    """A column for each individual; 0 is null. The id is a number where all ids are (and look like it), else text. For
    exchange only: the engine itself never has a column for each."""
    names, seen = [], {}
    for x in table.individuals:
        seen[x] = seen.get(x, 0) + 1
        names.append(x if seen[x] == 1 else f"{x}_{seen[x]}")
    cols = [F.nullif(F.get("depths", F.lit(i)), F.lit(0)).alias(n) for i, n in enumerate(names)]
    rows = table.arrays().df
    number = F.col("id").try_cast("bigint")
    numbers = rows.where(F.col("id").isNotNull() & (number.isNull() | (number.cast("string") != F.col("id")))).isEmpty()
    return rows.select((number if numbers else F.col("id")).alias("id"), "sequence", *cols)


def write_parquet(table: MarkerTable, path: str) -> None:
    wide(table).write.option("compression", "zstd").parquet(path)


def write_pca(result: PcaResult, folder: str) -> None:
    """``eigenvalues.tsv``, ``loadings.tsv`` and ``summary.txt`` with six decimals."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    for name, df, key in (("eigenvalues.tsv", result.components, "component"), ("loadings.tsv", result.loadings, None)):
        rows = df.orderBy(key).collect() if key else df.collect()  # individuals or components
        lines = ["\t".join(df.columns), *["\t".join(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows]]
        (out / name).write_text("\n".join(lines) + "\n")
    (out / "summary.txt").write_text(f"markers: {result.n_markers}\ntotal variance: {result.total_variance:.6f}\n")
