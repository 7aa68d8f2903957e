"""Readers of marker tables, population maps, reads and genomes."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.plans.lineage import stored
from markerloom.sources import block_gzip
from markerloom.table import MAX_INDIVIDUALS, MarkerTable, clamped
from markerloom.types import MarkerError

READ_FILE = re.compile(r"^(.*)\.(fq|fastq|fasta|fa|fna)(\.gz)?$", re.I)


def read_popmap(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """``(individual, group)`` pairs of a tab-separated file without header; lines without two fields are left out. More
    than the format's ``MAX_INDIVIDUALS`` are an error."""
    fields = F.split(F.regexp_replace("value", "\r$", ""), "\t", -1)
    lines = spark.read.text(path).select(fields.alias("f"), F.monotonically_increasing_id().alias("at")).where(F.size("f") == 2)
    found = lines.orderBy("at").select("f").limit(MAX_INDIVIDUALS + 1).collect()
    if len(found) > MAX_INDIVIDUALS:
        raise MarkerError(f"more than {MAX_INDIVIDUALS} individuals in {path}")
    return [tuple(r.f) for r in found]


def read_marker_tsv(spark: SparkSession, path: str, popmap: Sequence[tuple[str, str]] = (), individuals: Sequence[str] | None = None) -> MarkerTable:
    """A marker table with optional comment lines and a header (the first other line): id, sequence (whatever they are
    called), and the individuals. Blank lines and lines with less than two tabs are skipped, missing depths are 0 and depths
    are clamped; duplicate names keep their columns. With ``individuals`` there is no header (a folder of rows, say)."""
    raw = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("line"), F.col("_metadata.file_block_start").alias("block"))
    raw = raw.where("line NOT LIKE '#%' AND line <> ''")
    if individuals is None:
        head = raw.where("block = 0").limit(1).collect()
        if not head or "\t" not in head[0].line:
            raise MarkerError(f"{path} has no header")
        individuals = head[0].line.split("\t")[2:]
        raw = raw.where(F.col("line") != head[0].line)
    parts = raw.where(F.col("line").rlike("\t.*\t")).select(F.split("line", "\t", -1).alias("f"), F.monotonically_increasing_id().alias("ord"))
    depths = F.transform(F.sequence(F.lit(2), F.lit(len(individuals) + 1)), lambda i: clamped(F.try_to_number(F.get("f", i), F.lit("999999999999"))))
    if not individuals:
        depths = F.array().cast("array<int>")
    return MarkerTable(parts.select("ord", F.get("f", F.lit(0)).alias("id"), F.get("f", F.lit(1)).alias("sequence"), depths.alias("depths")), list(individuals), popmap)


def read_result_tsv(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """A table that a command has written, and the metadata of its comment line (if there is one)."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0").limit(1).collect()
    line = first[0].value if first and first[0].value.startswith("#") else ""
    return spark.read.csv(path, sep="\t", header=True, inferSchema=True, comment="#"), dict(x.split(":", 1) for x in line[1:].split(";") if ":" in x)


def marker_count(spark: SparkSession, path: str) -> int | None:
    """The number in a marker file's comment line, if it has one; no marker is read."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0 AND value LIKE '#%'").limit(1).collect()
    found = re.match(r"#Number of markers : (\d+)\s*$", first[0].value) if first else None
    return int(found[1]) if found else None


def from_frame(df: DataFrame, popmap: Sequence[tuple[str, str]] = ()) -> MarkerTable:
    """A wide frame: id, sequence, and a column of any type for each individual; what isn't a number is 0."""
    if len(df.columns) < 3:
        raise MarkerError("a marker frame has an id, a sequence and one individual at least")
    first, second, *rest = df.columns
    types = dict(df.dtypes)

    def depth(c: str):
        col = F.col(f"`{c}`")
        if types[c] in ("float", "double"):
            col = F.when(F.isnan(col) | (F.abs(col) > 1e18), None).otherwise(F.round(col))
        elif types[c] == "string":
            col = F.try_to_number(col, F.lit("999999999999"))
        elif not re.match("(tiny|small|big)?int|decimal", types[c]):
            col = F.lit(0)
        return clamped(col)

    rows = df.select(F.monotonically_increasing_id().alias("ord"), F.col(f"`{first}`").cast("string").alias("id"), F.col(f"`{second}`").alias("sequence"), F.array(*[depth(c) for c in rest]).alias("depths"))
    return MarkerTable(rows, rest, popmap)


def from_arrow(spark: SparkSession, table: pa.Table, popmap: pa.Table | Sequence[tuple[str, str]] = ()) -> MarkerTable:
    """An Arrow table of markers, with a population map as pairs or as a table whose first two columns are used."""
    return from_frame(spark.createDataFrame(table), popmap_pairs(popmap) if isinstance(popmap, pa.Table) else popmap)


def popmap_pairs(popmap: pa.Table) -> list[tuple[str, str]]:
    """The first two columns of an Arrow table."""
    if popmap.num_columns < 2 or not popmap.num_rows:
        raise MarkerError("a population map has two columns and rows")
    return list(zip(popmap.column(0).to_pylist(), popmap.column(1).to_pylist()))


def from_long(df: DataFrame, individuals: Sequence[str], popmap: Sequence[tuple[str, str]] = ()) -> MarkerTable:
    """``id, sequence, individual, depth`` rows."""
    return MarkerTable(df.select("id", "sequence", "individual", clamped(F.col("depth")).alias("depth")), individuals, popmap, "long")


def read_marker_parquet(spark: SparkSession, path: str, popmap: Sequence[tuple[str, str]] = ()) -> MarkerTable:
    """A wide Parquet table (null is 0)."""
    return from_frame(spark.read.parquet(path), popmap)


class Records:
    """(name, sequence) records of the lines of a split of a FASTA or FASTQ file, whose first and last may be cut.

    ``head`` has the lines before the first record that surely begins here (``synced``: there is one), ``tail`` those of the
    last record if it may go on. FASTQ records have four lines; one begins where a line with @ is two before one with +, as no
    sequence begins with +."""

    def __init__(self, fastq: bool, whole: bool = False):
        self.fastq, self.synced, self.head, self.tail = fastq, whole, [], []

    def add(self, line: str) -> tuple[str, str] | None:
        """The record that ends with (FASTQ) or before (FASTA) this line."""
        if not self.synced:
            self.head.append(line)
            if self.fastq and len(self.head) > 2 and line.startswith("+") and self.head[-3].startswith("@"):
                self.head, self.tail, self.synced = self.head[:-3], self.head[-3:], True
            elif not self.fastq and line.startswith(">"):
                self.head, self.tail, self.synced = self.head[:-1], [line], True
            return None
        done = None
        if not self.fastq and line.startswith(">"):
            done, self.tail = self.last(), []
        if line or (self.fastq and self.tail):
            self.tail.append(line)
        if self.fastq and len(self.tail) == 4:
            done, self.tail = (self.tail[0][1:], self.tail[1]), []
        return done

    def add_run(self, lines: list[str]) -> tuple[list[str], list[str]]:
        """Names and sequences of the records that :meth:`add` gives for these lines, those of FASTQ by slices of the list."""
        names, sequences, at = [], [], 0
        while at < len(lines):
            if self.fastq and self.synced and not self.tail:
                whole = len(lines) - (len(lines) - at) % 4
                first = lines[at:whole:4]
                if first and all(first):  # no blank line between records
                    names += [x[1:] for x in first]
                    sequences += lines[at + 1 : whole : 4]
                    at = whole
                    continue
            if found := self.add(lines[at]):
                names.append(found[0])
                sequences.append(found[1])
            at += 1
        return names, sequences

    def last(self) -> tuple[str, str] | None:
        """The record of ``tail``, if it is one."""
        if not self.tail or self.tail[0][:1] != ("@" if self.fastq else ">") or (self.fastq and len(self.tail) < 4):
            return None
        return self.tail[0][1:], self.tail[1] if self.fastq else "".join(self.tail[1:])


def _lines(spark: SparkSession, path: str, pattern: str, split_bytes: int, runs: bool = False) -> DataFrame:
    """``path, block, line`` of the files whose names match; those of block-gzip come from their own source, in splits, with
    ``runs`` as runs of lines."""
    name = F.col("_metadata.file_name")
    text = spark.read.text(path).where(name.rlike(pattern))
    found = [f.rsplit("/", 1)[-1] for f, _ in block_gzip.block_files(path)]
    if found:
        text = text.where(~name.isin([quote(f) for f in found] + found))
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("line"))
    if not found:
        return lines
    block_gzip.register(spark)
    blocks = spark.read.format("block_gzip_lines").option("splitBytes", split_bytes).option("runs", runs).load(path)
    return lines.unionAll(blocks.where(F.col("path").rlike(pattern)))


def read_fastx(spark: SparkSession, path: str, records: int = 20_000, split_bytes: int = block_gzip.SPLIT_BYTES) -> DataFrame:
    """``individual, name, sequence`` of all FASTA and FASTQ files of a folder (or of one file), gzip included.

    Lines are streamed, whatever the size of a file; plain files and those of block-gzip (``split_bytes``) are split, and the
    records that are cut by the bounds of splits are put together again. Other gzip can't be split, so such a file is one
    task's."""
    pattern = r"(?i)\.(fq|fastq|fasta|fa|fna)(\.gz)?$"
    if not individuals_of(spark, path):
        raise MarkerError(f"no read files in {path}")
    lines = _lines(spark, path, pattern, split_bytes, runs=True)
    names = ["individual", "name", "sequence", "path", "block", "synced", "head", "tail"]

    def individual(path: str) -> str:
        return READ_FILE.match(unquote(path.rsplit("/", 1)[-1]))[1]

    def fastq(path: str) -> bool:
        return READ_FILE.match(path.rsplit("/", 1)[-1])[2].lower() in ("fq", "fastq")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, ...] = ([], [], [])
        ends: list[tuple] = []
        at, now = None, None

        def out() -> pa.RecordBatch:
            n = len(found[0])
            batch = pa.RecordBatch.from_arrays([*[pa.array(c, pa.string()) for c in found], *[pa.nulls(n, t) for t in _SPLIT_TYPES[3:]]], names)
            for c in found:
                c.clear()
            return batch

        def ended() -> None:
            ends.append((None, None, None, *at, now.synced, "\n".join(now.head), "\n".join(now.tail)))

        for b in batches:
            for path, block, rows in _by_split(b):
                if at != (path, block):
                    if at is not None:
                        ended()
                    at, now, who = (path, block), Records(fastq(path)), individual(path)
                for lines in _some_lines(rows):
                    new, sequences = now.add_run(lines)
                    for c, more in zip(found, ([who] * len(new), new, sequences)):
                        c.extend(more)
                    if new and len(found[0]) >= records:
                        yield out()
        if at is not None:
            ended()
        if found[0]:
            yield out()
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*ends), _SPLIT_TYPES)], names)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, text in zip(b.column("path").to_pylist(), b.column("text").to_pylist()):
                cut = Records(fastq(path), whole=True)
                each = [cut.add(line) for line in text.split("\n")]
                found += [(individual(path), *r) for r in (*each, None if cut.fastq else cut.last()) if r]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.string()) for k in range(3)], names[:3])

    parsed = stored(lines.mapInArrow(parse, "individual string, name string, sequence string, path string, block long, synced boolean, head string, tail string"), "reads")
    splits = parsed.where("path IS NOT NULL").select("path", "block", "synced", "head", "tail")
    begun = F.count_if("synced").over(W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, 0))  # a row for each split
    ends = F.explode(F.array(F.struct((F.col("begun") - F.col("synced").cast("int")).alias("record"), F.col("head").alias("part")), F.struct(F.col("begun").alias("record"), F.col("tail").alias("part"))))
    pieces = splits.withColumn("begun", begun).select("path", "block", ends.alias("x")).select("path", "block", "x.record", "x.part").where("part <> ''")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("block", "part"))), lambda x: x["part"])  # of one record
    cut = pieces.groupBy("path", "record").agg(F.array_join(ordered, "\n").alias("text"))
    return parsed.where("path IS NULL").select("individual", "name", "sequence").unionAll(cut.mapInArrow(join, "individual string, name string, sequence string"))


#: Lines of a split that are parsed at once.
LINES = 10_000


def _by_split(batch: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """Path, block and ``line`` of the rows of each split in turn."""
    if not batch.num_rows:
        return
    path, block = batch.column("path"), batch.column("block").to_numpy()
    other = pc.not_equal(path[1:], path[:-1]).to_numpy(zero_copy_only=False) | (block[1:] != block[:-1])
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    for begin, end in zip(cuts, cuts[1:]):
        yield path[begin].as_py(), int(block[begin]), batch.column("line").slice(begin, end - begin)


def _some_lines(rows: pa.Array) -> Iterator[list[str]]:
    """Lines of rows that hold one or a run of them, about ``LINES`` at a time."""
    held: list[str] = []
    for x in rows:
        held += x.as_py().split("\n")
        if len(held) >= LINES:
            yield held
            held = []
    if held:
        yield held


_SPLIT_TYPES = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.string()]


def individuals_of(spark: SparkSession, path: str) -> list[str]:
    """Individuals by name: the read files of a folder without their extensions."""
    names = [r.path.rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    return sorted(m[1] for n in names if (m := READ_FILE.match(n)))


def read_genome(spark: SparkSession, path: str) -> DataFrame:
    """``contig, sequence, length``; a contig is named by the first word of its line."""
    reads = read_fastx(spark, path)
    return reads.select(F.regexp_extract("name", r"^(\S*)", 1).alias("contig"), "sequence", F.length("sequence").cast("bigint").alias("length"))


def read_genome_pieces(spark: SparkSession, path: str, most: int = 1 << 16, split_bytes: int = block_gzip.SPLIT_BYTES) -> DataFrame:
    """``contig, start, bases`` of FASTA files, in pieces of ``most`` bases or a little more: no contig is ever one cell or one task.

    Lines of a split become pieces with places from the split's begin; a contig that began in an earlier split goes on where
    the splits before (one row each) end. Files are told apart; a compressed file is one split unless it is block-gzip."""
    lines = _lines(spark, path, r"(?i)\.(fasta|fa|fna)(\.gz)?$", split_bytes)
    names = ["path", "block", "contig", "start", "bases", "ends"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, contig, place, parts, size = None, None, 0, [], 0

        def close() -> None:
            nonlocal place, parts, size
            if parts:
                held.append((*at, contig, place, "".join(parts), False))
            place, parts, size = place + size, [], 0

        for b in batches:
            for key, line in zip(zip(b.column("path").to_pylist(), b.column("block").to_pylist()), b.column("line").to_pylist()):
                if key != at:
                    if at is not None:
                        close()
                        held.append((*at, contig, place, None, True))
                    at, contig, place = key, None, 0
                if line.startswith(">"):
                    close()
                    contig, place = (line[1:].split() or [""])[0], 0
                elif line := line.strip():
                    parts.append(line)
                    size += len(line)
                    if size >= most:
                        close()
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _PIECE_TYPES)], names)
                held.clear()
        if at is not None:
            close()
            held.append((*at, contig, place, None, True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _PIECE_TYPES)], names)

    pieces = stored(lines.mapInArrow(cut, "path string, block long, contig string, start long, bases string, ends boolean"), "pieces")
    by_file = W.partitionBy("path").orderBy("block")  # a row for each split
    ends = pieces.where("ends").select("path", "block", F.col("contig").alias("last"), F.col("start").alias("bases"))
    ends = ends.withColumn("upto", F.count("last").over(by_file.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy("path", "upto").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    ends = ends.select("path", F.lead("block").over(by_file).alias("block"), F.first("last", ignorenulls=True).over(run).alias("open"), F.sum("bases").over(run).alias("before"))
    joined = pieces.where("NOT ends").join(F.broadcast(ends.where("block IS NOT NULL")), ["path", "block"], "left")
    continued = F.col("contig").isNull()
    return joined.select(F.when(continued, F.col("open")).otherwise(F.col("contig")).alias("contig"), (F.col("start") + F.when(continued, F.coalesce("before", F.lit(0))).otherwise(0)).alias("start"), "bases")


_PIECE_TYPES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
