"""Block-gzip files in splits, and files that executors write as one."""

import gzip
import io
import random

import pyarrow as pa
import pytest

from markerloom.sources import block_gzip, readers, single_file, writers
from markerloom.table import MarkerTable
from markerloom.types import MarkerError


def made(data: bytes, sizes, level=6) -> bytes:
    """Blocks of these sizes in turn."""
    out, at, k = [], 0, 0
    while at < len(data):
        n = sizes[k % len(sizes)]
        out.append(block_gzip.deflated(data[at : at + n], level))
        at, k = at + n, k + 1
    return b"".join([*out, block_gzip.deflated(b"")])


def in_splits(blob: bytes, width: int) -> list[bytes]:
    got = []
    for at in range(0, len(blob), width):
        file = pa.PythonFile(io.BytesIO(blob), "r")
        for lines in block_gzip.split_lines(file, at, min(at + width, len(blob)), len(blob)):
            got += lines
    return got


@pytest.mark.parametrize("sizes", [(1,), (7, 300, 2), (65_280,), (5_000, 1)])
@pytest.mark.parametrize("width", [1, 40, 1_000, 1 << 20])
def test_each_line_belongs_to_one_split(sizes, width):
    draw = random.Random(str((sizes, width)))
    longest = 30 if sizes == (1,) else 700
    lines = ["".join(draw.choices("ACGT@+>é", k=draw.choice([0, 1, 5, draw.randrange(longest)]))) for _ in range(40)]
    for end in ("\n", ""):
        data = ("\n".join(lines) + end).encode()
        blob = made(data, sizes, draw.choice([0, 6]))
        assert gzip.decompress(blob) == data
        want = data.split(b"\n")
        assert in_splits(blob, width) == (want[:-1] if want[-1] == b"" else want)


def test_what_looks_like_a_header_is_no_block():
    decoy = block_gzip.deflated(b"no block of this file\n")
    data = b"\n".join([decoy[:18], decoy, decoy + decoy[:18]] * 40)
    blob = made(data, (900,), level=0)  # stored, so the decoys are in the file as they are
    assert blob.count(block_gzip.MAGIC) > 100
    begins = [at for at, _ in block_gzip.blocks(pa.PythonFile(io.BytesIO(blob), "r"), 0, len(blob))]
    file = pa.PythonFile(io.BytesIO(blob), "r")
    for at in range(0, len(blob), 13):
        found = block_gzip.first_block(file, at, len(blob))
        assert found == next((b for b in begins if b >= at), None)


def test_damage_is_an_error():
    blob = bytearray(made(b"ACGT\n" * 3_000, (4_000,)))
    blob[30] ^= 255
    with pytest.raises(MarkerError, match="damaged"):
        in_splits(bytes(blob), 1 << 20)
    with pytest.raises(MarkerError, match="no block"):
        list(block_gzip.blocks(pa.PythonFile(io.BytesIO(b"x" * 99), "r"), 0, 99))


def test_reads_of_block_gzip_are_those_of_plain_files(spark, tmp_path):
    draw = random.Random(3)
    plain, blocked = tmp_path / "plain", tmp_path / "blocked"
    for d in (plain, blocked):
        d.mkdir()
    for name, kind in (("a b.fastq", "@"), ("c%.fa", ">"), ("e.fq", "@")):
        reads = []
        for k in range(draw.randrange(200, 400)):
            s = "".join(draw.choices("ACGT", k=draw.randrange(1, 300)))
            q = "@+" * len(s)  # qualities that look like names
            reads.append(f"@r{k}\n{s}\n+\n{q[: len(s)]}\n" if kind == "@" else f">r{k}\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n")
        text = "".join(reads).encode()
        (plain / name).write_bytes(text)
        (blocked / f"{name}.gz").write_bytes(made(text, (draw.randrange(500, 3_000), 9_000)))
    (plain / "z.fa.gz").write_bytes(gzip.compress(b">one\nACGT\n"))  # ordinary gzip beside them
    (blocked / "z.fa.gz").write_bytes(gzip.compress(b">one\nACGT\n"))
    (blocked / "empty.fq.gz").write_bytes(block_gzip.deflated(b""))
    want = sorted(tuple(r) for r in readers.read_fastx(spark, str(plain)).collect())
    got = readers.read_fastx(spark, str(blocked), split_bytes=1_024)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 600
    block_gzip.register(spark)
    parts = spark.read.format("block_gzip_lines").option("splitBytes", 1_024).load(str(blocked))
    assert parts.select("path", "block").distinct().count() > 10
    assert parts.where("path LIKE '%z.fa.gz'").isEmpty()


def test_contigs_of_block_gzip(spark, tmp_path):
    bases = "".join(random.Random(8).choices("ACGT", k=30_000))
    text = (">one first\n" + "\n".join(bases[i : i + 70] for i in range(0, len(bases), 70)) + "\n>two\nACGT\n").encode()
    (tmp_path / "g.fa.gz").write_bytes(made(text, (2_000,), level=1))
    pieces = readers.read_genome_pieces(spark, str(tmp_path), most=500, split_bytes=1_500).orderBy("contig", "start").collect()
    assert len({p.start for p in pieces}) > 10
    assert "".join(p.bases for p in pieces if p.contig == "one") == bases
    assert all(bases[p.start : p.start + len(p.bases)] == p.bases for p in pieces if p.contig == "one")
    assert [(p.start, p.bases) for p in pieces if p.contig == "two"] == [(0, "ACGT")]


def test_block_gzip_sink(spark, tmp_path):
    lines = [f"{k}\t" + "é" * (k % 50) for k in range(20_000)] + [""]
    frame = spark.createDataFrame([(x,) for x in lines] + [(None,)], "line string").repartition(3)
    block_gzip.register(spark)
    frame.write.format("block_gzip_lines").option("extension", "txt").mode("append").save(str(tmp_path / "out"))
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) == 3 and all(f.name.startswith("part-") and f.name.endswith(".txt.gz") for f in files)
    back = spark.read.format("block_gzip_lines").option("splitBytes", 5_000).load(str(tmp_path / "out"))
    assert sorted(r.line for r in back.select("line").collect()) == sorted([*lines, ""])


def test_a_failed_block_gzip_job_leaves_nothing(spark, tmp_path):
    block_gzip.register(spark)
    frame = spark.range(0, 1_000, 1, 2).selectExpr("CASE WHEN id = 999 THEN raise_error('no') ELSE cast(id AS string) END AS line")
    with pytest.raises(Exception, match="no"):
        frame.write.format("block_gzip_lines").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


@pytest.fixture
def little_pieces(monkeypatch):
    monkeypatch.setattr(single_file, "PIECE", 97)


@pytest.mark.parametrize("here", [True, False])
def test_one_file_of_many_tasks(spark, tmp_path, monkeypatch, little_pieces, here):
    if not here:
        monkeypatch.setattr(single_file, "_shared", lambda spark, path: False)
    n = 5_000
    frame = spark.range(0, n, 1, 7).selectExpr("id", "array(id, 2 * id) AS two", "id / 8 AS eighth", "id % 2 = 0 AS even", "CASE WHEN id = 3 THEN NULL ELSE 'é' END AS s")
    path = tmp_path / "a b.tsv"
    path.write_text("what was there")
    writers.write_tsv(frame, str(path), metadata={"source": "x", "threshold": 0.05, "test": "chisq"}, order=["id"], lower_booleans=True, columns=["id", "one", "two", "eighth", "even", "s"])
    head, names, *rows = path.read_text().splitlines()
    assert (head, names) == ("#source:x;threshold:0.05;test:chisq", "id\tone\ttwo\teighth\teven\ts")
    assert rows == [f"{i}\t{i}\t{2 * i}\t{i / 8:g}\t{str(i % 2 == 0).lower()}\t{'é' if i != 3 else None}" for i in range(n)]
    assert single_file.write_lines(frame.limit(0).selectExpr("s AS value"), f"file://{tmp_path}/none.txt", lambda n: f"{n}\n") == 0
    assert (tmp_path / "none.txt").read_text() == "0\n"
    assert sorted(f.name for f in tmp_path.iterdir()) == ["a b.tsv", "none.txt"]


def test_what_fails_leaves_what_was_there(spark, tmp_path, monkeypatch, little_pieces):
    path = tmp_path / "t.tsv"
    path.write_text("old\n")
    with pytest.raises(Exception, match="no"):
        writers.write_tsv(spark.range(0, 99, 1, 3).selectExpr("CASE WHEN id = 98 THEN raise_error('no') ELSE id END AS x"), str(path))
    monkeypatch.setattr(single_file, "_place", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        writers.write_tsv(spark.range(99), str(path))
    assert [f.name for f in tmp_path.iterdir()] == ["t.tsv"] and path.read_text() == "old\n"


def test_marker_and_popmap_files(spark, tmp_path, little_pieces):
    rows = [(k, str(k), "ACGT"[k % 4] * (k % 9 + 1), [k % 3, k, 65_535]) for k in range(300)]
    df = spark.createDataFrame(rows, "ord long, id string, sequence string, depths array<int>").repartition(5)
    writers.write_markers(MarkerTable(df, ["a", "b", "c"]), str(tmp_path / "t.tsv"))
    assert (tmp_path / "t.tsv").read_text().splitlines()[:3] == ["#Number of markers : 300", "id\tsequence\ta\tb\tc", "0\tA\t0\t0\t65535"]
    back = readers.read_marker_tsv(spark, str(tmp_path / "t.tsv"))
    assert [(r.id, r.sequence, r.depths) for r in back.df.orderBy("ord").collect()] == [tuple(r[1:]) for r in rows]
    assert readers.marker_count(spark, str(tmp_path / "t.tsv")) == 300 and readers.marker_count(spark, str(tmp_path)) == 300
    pairs = [("b", "x"), ("a", "y"), ("c d", "x")]
    writers.write_popmap(spark.createDataFrame(pairs, "i string, g string"), str(tmp_path / "p.tsv"))
    assert readers.read_popmap(spark, str(tmp_path / "p.tsv")) == sorted(pairs)


@pytest.mark.parametrize("fastq", [True, False])
def test_runs_of_lines_are_the_records_of_their_lines(fastq):
    draw = random.Random(21)
    for _ in range(300):
        lines = []
        for k in range(draw.randrange(12)):
            s = "".join(draw.choices("ACGT", k=draw.randrange(4)))
            lines += [f"@r{k}", s, "+", draw.choice(["@", "+", "I", ""]) * len(s)] if fastq else [f">r{k}", s, s]
            lines += [""] * draw.choice([0, 0, 0, 1])
        lines = lines[draw.randrange(5) :]
        one, runs, got, at = readers.Records(fastq, draw.random() < 0.3), None, [], 0
        runs = readers.Records(fastq, one.synced)
        want = [r for r in map(one.add, lines) if r]
        while at < len(lines):
            n = draw.randrange(1, 20)
            got += zip(*runs.add_run(lines[at : at + n]))
            at += n
        assert (got, runs.synced, runs.head, runs.tail) == (want, one.synced, one.head, one.tail)


def test_a_row_of_the_scan_of_reads_is_a_run_of_lines(spark, tmp_path):
    blob = b"".join(f"@r{k}\r\nACGT\r\n+\r\nI\xc3I\xe9\r\n".encode("latin-1") for k in range(5_000)) + b"last\r"
    (tmp_path / "a.fq.gz").write_bytes(made(blob, (9_000, 777)))
    block_gzip.register(spark)
    lines = spark.read.format("block_gzip_lines").option("splitBytes", 2_000).load(str(tmp_path))
    want = [x.removesuffix(b"\r").decode("utf-8", "replace") for x in blob.split(b"\n")]
    assert sorted(r.line for r in lines.select("line").collect()) == sorted(want)
    runs = readers._lines(spark, str(tmp_path), "fq", 2_000, runs=True).select("line").collect()
    assert len(runs) < 100 and sorted(x for r in runs for x in r.line.split("\n")) == sorted(want)
    assert readers.read_fastx(spark, str(tmp_path), split_bytes=2_000).where("sequence = 'ACGT'").distinct().count() == 5_000


def test_fastq_sink(spark, tmp_path):
    reads = [(f"r{k}", "ACGT" * (k % 70 + 1)) for k in range(3_000)]
    writers.write_fastq(spark.createDataFrame(reads, "name string, sequence string").repartition(2), str(tmp_path / "r"))
    got = readers.read_fastx(spark, str(tmp_path / "r"), split_bytes=700)
    assert sorted((r.name, r.sequence) for r in got.collect()) == sorted(reads)
