"""One text file that executors write.

Rows become lines in tasks and are written as parts by Spark's own commit; what the parts come to (sizes and a count of rows)
gives the head of the file and the place of each part in it. Then tasks copy pieces of parts to their places, each at its own
bytes, so a task that runs twice writes the same; at last the file gets its name. Until then, and after any failure, nothing
has that name (or what had it stays). Where executors don't share the folder of the file (it isn't in ``spark.checkpoint.dir``
and the session is no local one) the bytes of the parts, never rows, are copied by the driver piece by piece.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from markerloom.functions.kernels import general
from markerloom.plans.lineage import new_path
from markerloom.sources.block_gzip import file_system
from markerloom.types import MarkerError

#: Bytes of a piece, which is what a task holds.
PIECE = 16 << 20


def tsv_lines(df: DataFrame, *, decimals: int | None = None, lower_booleans: bool = False) -> DataFrame:
    """``value``: rows as they come, with tabs. Numbers that aren't whole have six significant digits, or ``decimals``; arrays
    are spread over columns, and null is None."""

    def text(x) -> str:
        if isinstance(x, float):
            return general(x) if decimals is None else f"{x:.{decimals}f}"
        if isinstance(x, list):
            return "\t".join(map(text, x))
        return str(x).lower() if lower_booleans and isinstance(x, bool) else str(x)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [list(map(text, c.to_pylist())) for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array(map("\t".join, zip(*columns)), pa.string())], ["value"])

    return df.mapInArrow(rows, "value string")


def _parts(path: str) -> list[tuple[str, int]]:
    """Parts of a folder of text in their order, with their sizes."""
    fs, root = file_system(path)
    found = [f for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("part-")]
    return [(f.path, f.size) for f in sorted(found, key=lambda f: (int(f.base_name.split("-")[1]), f.base_name))]


def _local(path: str) -> str | None:
    """The path of a file on a mounted file system."""
    if path.startswith("file:"):
        return unquote(path.removeprefix("file:").replace("//", "/", 1) if path.startswith("file://") else path.removeprefix("file:"))
    return None if "://" in path else os.path.abspath(path)


def _shared(spark: SparkSession, path: str) -> bool:
    root = spark.conf.get("spark.checkpoint.dir", None)
    root = root and _local(root)
    return spark.sparkContext.master.startswith("local") or bool(root and os.path.commonpath([root, path]) == root)


def _place(spark: SparkSession, folder: str, pieces: list[tuple[str, int, int, int]], target: str) -> None:
    """Copies pieces (part, from, bytes, to) into a file that is there already."""

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        done = 0
        for b in batches:
            for part, begin, size, to in zip(*(c.to_pylist() for c in b.columns)):
                with fs.open_input_file(part) as source:
                    data = source.read_at(size, begin)
                file = os.open(target, os.O_WRONLY)
                try:
                    while data:
                        n = os.pwrite(file, data, to)
                        data, to = data[n:], to + n
                        done += n
                    os.fsync(file)
                finally:
                    os.close(file)
        yield pa.RecordBatch.from_pydict({"n": [done]})

    rows = spark.createDataFrame(pieces, "part string, begin long, size long, at long")
    tasks = max(1, min(len(pieces), 4 * spark.sparkContext.defaultParallelism))
    copied = rows.repartition(tasks).mapInArrow(copy, "n long").agg(F.sum("n")).first()[0] or 0
    if copied != sum(p[2] for p in pieces):
        raise MarkerError(f"{copied} bytes were written in place of {sum(p[2] for p in pieces)}")


def write_lines(lines: DataFrame, path: str, head: Callable[[int], str] | str = "") -> int:
    """Writes ``value`` lines in their order, after ``head`` (of the number of rows), to one file; that number comes back."""
    spark, seen = lines.sparkSession, Observation()
    folder = new_path(spark, "parts")
    lines.select(F.coalesce("value", F.lit("")).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.text(folder)
    n, parts = seen.get["n"], _parts(folder)
    first = (head if isinstance(head, str) else head(n)).encode()
    fs, root = file_system(path)
    hidden = f"{root.rpartition('/')[0]}/.{root.rpartition('/')[2]}-{uuid.uuid4().hex}"
    local = _local(path)
    fs.create_dir(root.rpartition("/")[0], recursive=True)
    try:
        if local and _shared(spark, local):
            pieces, at = [], len(first)
            for part, size in parts:
                pieces += [(part, k, min(PIECE, size - k), at + k) for k in range(0, size, PIECE)]
                at += size
            with open(hidden, "wb") as out:
                out.write(first)
                out.truncate(at)
            if pieces:
                _place(spark, folder, pieces, hidden)
        else:
            source, _ = file_system(folder)
            with fs.open_output_stream(hidden) as out:
                out.write(first)
                for part, size in parts:
                    with source.open_input_file(part) as file:
                        for k in range(0, size, PIECE):
                            out.write(file.read_at(min(PIECE, size - k), k))
        fs.move(hidden, root)
    except BaseException:
        if fs.get_file_info(hidden).type != pafs.FileType.NotFound:
            fs.delete_file(hidden)
        raise
    finally:
        source, inside = file_system(folder)
        source.delete_dir(inside)
    return n
