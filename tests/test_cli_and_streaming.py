"""Commands from files to files, and reads that arrive in batches."""

import gzip

import pytest
from pyspark.sql import functions as F

from markerloom.cli import main
from markerloom.streaming.ingest import ingest, ingested


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    people = [f"{g}{i}" for i in range(9) for g in ("oak", "elm")]
    depths = {"TTAC": [5] * 18, "CGCGA": [8, 0] * 9, "GATTC": [0, 3] * 9}
    (d / "t.tsv").write_text("# made here\nid\tsequence\t" + "\t".join(people) + "\n" + "".join(f"{k}\t{s}\t" + "\t".join(map(str, v)) + "\n" for k, (s, v) in enumerate(depths.items())))
    (d / "p.tsv").write_text("".join(f"{x}\t{x[:3]}\n" for x in people))
    (d / "reads").mkdir()
    for i in (1, 2):
        (d / "reads" / f"i{i}.fa.gz").write_bytes(gzip.compress(b"".join(b">r\n" + s + b"\n" for s in [b"CATTGACC"] * i + [b"TTGG"])))
    (d / "g").mkdir()
    (d / "g" / "g.fa").write_text(">chr1\n" + "ACGT" * 20 + "\n")
    return d


def lines(path):
    return path.read_text().splitlines()


@pytest.mark.parametrize(
    "command,more,header,n",
    [
        ("freq", [], "Frequency\tCount", 20),
        ("distrib", ["-p", "p.tsv"], "oak\telm\tMarkers\tP\tCorrectedP\tSignif\tBias", 101),
        ("signif", ["-p", "p.tsv", "--bayes"], None, 4),
        ("subset", ["-p", "p.tsv", "-m", "9", "-N", "0"], None, 3),
        ("triage", ["-p", "p.tsv", "-G", "elm,oak"], None, 4),
        ("depth", ["-p", "p.tsv", "-f", "0.5"], "Sample\tGroup\tReads\tMarkers\tRetained\tMin_depth\tMax_depth\tMedian_depth\tAverage_depth", 19),
        ("map", ["-p", "p.tsv", "-g", "g"], "Contig\tPosition\tLength\tMarker_id\tBias\tP\tCorrectedP\tSignif", 2),
    ],
)
def test_commands(spark, files, command, more, header, n):
    out = files / f"{command}.out"
    more = [str(files / x) if (files / x).exists() else x for x in more]
    assert main([command, "-t", str(files / "t.tsv"), "-o", str(out), *more], spark) == 0
    got = [x for x in lines(out) if not x.startswith("#")]
    assert len(got) + (command != "depth") == n and (header is None or got[0] == header)


def test_fasta_pca_process_merge(spark, files):
    t, p = str(files / "t.tsv"), str(files / "p.tsv")
    assert main(["signif", "-t", t, "-p", p, "-o", str(files / "s.fa"), "-a", "--correction", "fdr"], spark) == 0
    assert [x for x in lines(files / "s.fa") if x[0] != ">"] == ["CGCGA", "GATTC"]
    assert main(["pca", "-t", t, "-o", str(files / "pca"), "-r", "2"], spark) == 0
    assert len(lines(files / "pca" / "loadings.tsv")) == 19
    assert main(["process", "-i", str(files / "reads"), "-o", str(files / "r.tsv")], spark) == 0
    assert lines(files / "r.tsv")[1:] == ["id\tsequence\ti1\ti2", "0\tCATTGACC\t1\t2", "1\tTTGG\t1\t1"]
    assert main(["merge", str(files / "r.tsv"), str(files / "r.tsv"), "-o", str(files / "m.tsv")], spark) == 0
    assert lines(files / "m.tsv")[2:] == ["0\tCATTGACC\t1\t2\t1\t2", "1\tTTGG\t1\t1\t1\t1"]


def test_errors(spark, files, capsys):
    assert main(["distrib", "-t", str(files / "t.tsv"), "-p", str(files / "p.tsv"), "-o", str(files / "x"), "-G", "oak"], spark) == 1
    assert "two names" in capsys.readouterr().err


def test_streaming(spark, tmp_path):
    schema = "individual string, sequence string"
    for k, rows in enumerate(([("a", "ACGT"), ("a", "acgt")], [("a", "ACGT"), ("b", "NNNN")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        ingest(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    got = ingested(spark, f"{tmp_path}/out", ["a", "b"], compact=f"{tmp_path}/c")
    assert sorted(tuple(r) for r in got.df.select("sequence", "individual", F.col("depth")).collect()) == [("AAAA", "b", 1), ("ACGT", "a", 3)]
