"""Lines of block-gzip files, which are read in splits, and a sink of such files, as a Spark data source.

A block-gzip file is a chain of gzip members of at most 64 KiB, each with its own size in an extra field of its header, so that
a task can begin at any member. As ordinary gzip tools read and name them like any other, they are told apart by their head.

    register(spark)
    spark.read.format("block_gzip_lines").option("splitBytes", 32 << 20).load("reads/")     # path, block, line
    lines.write.format("block_gzip_lines").option("extension", "fastq").mode("append").save("reads/")

With the option ``runs`` a row holds a run of whole lines, joined by newlines: about what a block has, or one longer line.

A line belongs to the split in which it begins, after the split's first byte (or at it, in the first split); a task reads on
until its last line ends. Writing: each task makes a hidden file, and the commit of the job gives all of them their names
(``part-00000.fastq.gz``); a failed or repeated task leaves nothing that is read, and what it has left goes with the job.

Defined cases: empty files and blocks have no lines, a last line may lack its newline, ``\\r`` before a newline goes, a damaged
block is an error, a null line is an empty one. Paths go through ``pyarrow.fs``.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from os.path import abspath
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from markerloom.types import MarkerError

SCHEMA = "path string, block bigint, line string"
# Fixed values of the format: how a block begins, and the most bytes of one; a block holds a little less than that.
MAGIC, MOST, HELD = b"\x1f\x8b\x08\x04", 1 << 16, 65_280
SPLIT_BYTES = 32 << 20
#: Lines that the sink joins at once.
LINES = 1000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if re.match(r"^\w+:/", path) else abspath(path))


def block_size(data: bytes, at: int = 0) -> int | None:
    """Size of the block whose header is here; None where there is none (or not all of it)."""
    if data[at : at + 4] != MAGIC or len(data) < at + 12:
        return None
    (extra,) = struct.unpack_from("<H", data, at + 10)
    place, end = at + 12, at + 12 + extra
    while place + 6 <= min(end, len(data)):
        name, length = data[place : place + 2], struct.unpack_from("<H", data, place + 2)[0]
        if name == b"BC" and length == 2:
            return struct.unpack_from("<H", data, place + 4)[0] + 1
        place += 4 + length
    return None


def inflated(block: bytes) -> bytes:
    """What a block holds."""
    (extra,) = struct.unpack_from("<H", block, 10)
    try:
        data = zlib.decompress(block[12 + extra : -8], wbits=-15)
    except zlib.error as e:
        raise MarkerError(f"a damaged block: {e}") from e
    if struct.unpack("<II", block[-8:]) != (zlib.crc32(data), len(data)):
        raise MarkerError("a damaged block: its checksum is wrong")
    return data


def deflated(data: bytes, level: int = 6) -> bytes:
    """A block of at most ``HELD`` bytes; that of none ends a file."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    return MAGIC + struct.pack("<IBBH2sHH", 0, 0, 255, 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def first_block(file: pa.NativeFile, at: int, size: int) -> int | None:
    """Place of the first block that begins here or later. Bytes that only look like a header have no chain of blocks behind
    them."""
    if at == 0:
        return 0
    data = file.read_at(min(3 * MOST, size - at), at)
    place = data.find(MAGIC)
    while 0 <= place < MOST:
        if _chained(data, place, at + len(data) == size):
            return at + place
        place = data.find(MAGIC, place + 1)
    return None


def _chained(data: bytes, at: int, ends: bool) -> bool:
    """Whether a whole block is here, and headers of blocks one after another up to the end of the data."""
    n = block_size(data, at)
    if not n or at + n > len(data):
        return False
    try:
        inflated(data[at : at + n])
    except MarkerError:
        return False
    while n and at + n < len(data):
        at += n
        n = block_size(data, at)
        if not n and not ends and len(data) - at < 256:  # a header that the data cut
            return True
    return bool(n) and (not ends or at + n == len(data))


def blocks(file: pa.NativeFile, at: int, size: int, read: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Place and contents of each block from here to the end of the file."""
    while at < size:
        data, used = file.read_at(min(read, size - at), at), 0
        while (n := block_size(data, used)) and used + n <= len(data):
            yield at + used, inflated(data[used : used + n])
            used += n
        if not used:
            raise MarkerError(f"no block at byte {at}")
        at += used


def split_lines(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[list[bytes]]:
    """Lines that belong to the split of these bytes, in lists."""
    for run in split_runs(file, start, end, size):
        yield run.split(b"\n")


def split_runs(file: pa.NativeFile, start: int, end: int, size: int) -> Iterator[bytes]:
    """The same as runs of lines, each without its last newline."""
    begin = first_block(file, start, size)
    if begin is None or begin >= end:
        return
    skipping, rest = start > 0, []
    for place, data in blocks(file, begin, size):
        last = place >= end
        if skipping:
            if last:
                return
            cut = data.find(b"\n") + 1
            if not cut:
                continue
            data, skipping = data[cut:], False
        cut = data.find(b"\n") + 1 if last else data.rfind(b"\n") + 1
        if not cut:
            rest.append(data)
            continue
        yield b"".join([*rest, data[: cut - 1]])
        if last:
            return
        rest = [data[cut:]]
    if left := b"".join(rest):
        yield left


def text_of(run: bytes) -> str:
    """A run of lines as text, without the ``\\r`` before newlines."""
    text = run.decode("utf-8", "replace")
    return text.replace("\r\n", "\n").removesuffix("\r") if "\r" in text else text


def block_files(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the block-gzip files of a folder (or of one file); only heads are read."""
    fs, root = file_system(path)
    info = fs.get_file_info(root)
    if info.type == pafs.FileType.NotFound:
        return []
    found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
    zipped = [f for f in found if f.type == pafs.FileType.File and f.base_name.lower().endswith(".gz") and f.base_name[0] not in "._"]

    def is_block(f: pafs.FileInfo) -> bool:
        with fs.open_input_file(f.path) as file:
            return block_size(file.read(256)) is not None

    with ThreadPoolExecutor(16) as pool:
        return sorted((f.path, f.size) for f, yes in zip(zipped, pool.map(is_block, zipped)) if yes)


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int
    size: int


class LinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.bytes = options["path"], int(options.get("splitBytes", SPLIT_BYTES))
        self.runs = str(options.get("runs", "false")).lower() == "true"
        if self.bytes < 1:
            raise MarkerError("splitBytes must be 1 or more")

    def partitions(self) -> list[Split]:
        return [Split(f, at, min(at + self.bytes, size), size) for f, size in block_files(self.path) for at in range(0, size, self.bytes)] or [Split("", 0, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.path)
        path = quote(partition.path)
        with fs.open_input_file(partition.path) as file:
            for run in split_runs(file, partition.start, partition.end, partition.size):
                text = text_of(run)
                line = pa.array([text] if self.runs else text.split("\n"), pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(path, len(line)), pa.repeat(pa.scalar(partition.start, pa.int64()), len(line)), line], ["path", "block", "line"])


@dataclass
class Written(WriterCommitMessage):
    file: str
    task: int


class LinesWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.extension, self.job = options["path"], options.get("extension", "txt"), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.path)
        context = TaskContext.get()
        task = context.partitionId()
        fs.create_dir(root, recursive=True)
        file = f"{root}/.{self.job}-{task}-{context.taskAttemptId()}"
        with fs.open_output_stream(file) as out:
            held = bytearray()
            for batch in iterator:
                lines = batch.column(batch.num_columns - 1)
                for at in range(0, len(lines), LINES):
                    held += "".join([f"{x or ''}\n" for x in lines.slice(at, LINES).to_pylist()]).encode()
                    whole = len(held) - len(held) % HELD
                    for k in range(0, whole, HELD):
                        out.write(deflated(bytes(held[k : k + HELD])))
                    del held[:whole]
            if held:
                out.write(deflated(bytes(held)))
            out.write(deflated(b""))
        return Written(file, task)

    def _clear(self, fs: pafs.FileSystem, root: str) -> None:
        for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f".{self.job}-"):
                fs.delete_file(f.path)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = file_system(self.path)
        for m in messages:
            if m is not None:
                fs.move(m.file, f"{root}/part-{m.task:05d}-{self.job[:8]}.{self.extension}.gz")
        self._clear(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*file_system(self.path))


class BlockGzipLines(DataSource):
    """``path, block, line`` of block-gzip files; frames to be written have one column of lines (the last one is taken)."""

    @classmethod
    def name(cls) -> str:
        return "block_gzip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LinesReader:
        return LinesReader(self.options)

    def writer(self, schema, overwrite: bool) -> LinesWriter:
        if overwrite:
            raise MarkerError("block_gzip_lines appends files and replaces none")
        return LinesWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlockGzipLines)
