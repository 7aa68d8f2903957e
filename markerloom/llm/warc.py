"""WARC archives: written with an index of their records, read back by coalesced byte ranges.

Writing: digests of payloads are compared in a narrow plan that knows nothing of the payloads, then one pass writes a
gzip member for each record into a file for each task and returns an index row (file, offset, length, URL, digest). Which
records are revisits is broadcast; of a table of more than ``BROADCAST_ROWS`` revisits, only the rows that a Bloom filter of
them lets through are shuffled to it, and the payloads of all others stay where they are.
Files of tasks that were tried again are named anew and never indexed. Reading starts from the index: ranges of the
selected records are sorted by file and offset, neighbours join in one read, and reads are dealt out by file and block.

Paths go through ``pyarrow.fs``, so the shared folder may be local, HDFS or an object store.

Defined cases: a null html is an empty payload; payloads below ``least`` bytes are all responses; with a null id a record
is a response that none revisits; repeated rows with the smallest id of their payload are each a response, other repeated
rows revisit it; a null URL is an empty one; an empty table gives an empty index; further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.shared import only, small_batches, work_path, written

INDEX = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"
#: Reads join where at most so many bytes lie between them, up to a read of so many bytes.
GAP, SPAN = 64 << 10, 8 << 20
#: A revisit table of at most so many rows is broadcast; a larger one is joined by shuffling.
BROADCAST_ROWS = 500_000
#: Bits of the filter of a larger one, and how many of them a record sets.
FILTER_BITS, FILTER_HASHES = 1 << 27, 3


def member(page_id, url, payload: bytes, digest: str, size: int, kind: str, refers_to, level: int = 6) -> bytes:
    """One record as a gzip member; a revisit has no payload of its own."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{uuid.UUID(hashlib.sha256(f'{page_id} {digest} {kind}'.encode()).hexdigest()[:32])}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub('[\r\n]+', ' ', url or '')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Page-Number: {'' if page_id is None else page_id}",
        f"WARC-Payload-Length: {size}",
        *([f"WARC-Refers-To-Page-Number: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if kind == "revisit" else []),
        "Content-Type: text/html; charset=utf-8",
        f"Content-Length: {len(body)}",
    ]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", level, mtime=0)


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(x.partition(": ")[::2] for x in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("the length of a WARC record is wrong")
    return headers, rest[:n]


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """``page_id, payload_digest, refers_to`` of records that repeat an earlier payload; no payload is moved."""
    rows = pages.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest", "payload_bytes").distinct()
    firsts = rows.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(firsts, ["payload_digest", "payload_bytes"]).where(F.col("page_id") != F.col("refers_to")).select("page_id", "payload_digest", "refers_to")


def may_be(again: DataFrame) -> Column:
    """True for all rows (page_id, payload_digest) of ``again`` and few others: a Bloom filter of a fixed size."""
    places = F.array(*[F.pmod(F.xxhash64("page_id", "payload_digest", F.lit(k)), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)])
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    words = again.select(F.explode(places).alias("at")).select(F.expr("at div 64").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_BITS / 64 rows at most
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    held = again.sparkSession.sparkContext.broadcast(filled.view(np.uint8))

    @F.pandas_udf("boolean")
    def known(at: pd.Series) -> pd.Series:
        at = np.stack(at.to_numpy()) if len(at) else np.zeros((0, 1), np.int64)
        return pd.Series((held.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(axis=1))

    return known(places)


def write(pages: DataFrame, path: str, *, least: int = 100) -> DataFrame:
    """Archive ``pages`` (page_id, url, html) under ``path``; returns the index, which is a table in the shared folder."""
    small_batches(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = only(pages, page_id=F.col("page_id").cast("long"), url=F.col("url"), html=F.col("html"))
    rows = rows.select("page_id", "url", payload.alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    again = written(revisits(rows, least), "revisits")
    columns = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to"]
    if again.count() <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(again), ["page_id", "payload_digest"], "left").select(*columns)
    else:
        maybe = may_be(again)
        likely = rows.where(maybe).join(again, ["page_id", "payload_digest"], "left").select(*columns)
        marked = likely.unionByName(rows.where(~maybe).withColumn("refers_to", F.lit(None).cast("long")).select(*columns))

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        file, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        for b in batches:
            made = []
            for r in b.to_pylist():
                kind = "response" if r["refers_to"] is None else "revisit"
                data = member(r["page_id"], r["url"], r["payload"], r["payload_digest"], r["payload_bytes"], kind, r["refers_to"])
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(f"{root}/{file}", compression=None)
                out.write(data)
                made.append((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], kind, r["refers_to"], file, at, len(data)))
                at += len(data)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*made)) or [()] * 9, _INDEX_TYPES)], _INDEX_NAMES)
        if out is not None:
            out.close()

    return written(marked.mapInArrow(archive, INDEX), "warc-index")


_INDEX_NAMES = [x.split(" ")[0] for x in INDEX.split(", ")]
_INDEX_TYPES = [{"long": pa.int64(), "string": pa.string()}[x.split(" ")[1]] for x in INDEX.split(", ")]


def ranges(places: list[tuple[int, int]], gap: int = GAP, span: int = SPAN) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) pairs as reads: begin, end, and how many of the pairs each read serves."""
    out: list[list[int]] = []
    for offset, length in places:
        if out and offset - out[-1][1] <= gap and offset + length - out[-1][0] <= span:
            out[-1][1] = max(out[-1][1], offset + length)
            out[-1][2] += 1
        else:
            out.append([offset, offset + length, 1])
    return [tuple(x) for x in out]


def read(index: DataFrame, path: str, *, payloads: bool = True) -> DataFrame:
    """Records that ``index`` (or any selection of its rows) names, as read from the archives, their digests verified."""
    spark = index.sparkSession
    small_batches(spark)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path)
        handle, name = None, None
        for b in batches:
            rows = list(zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()))
            first, cols = 0, ([], [], [], [], [], [], [])
            while first < len(rows):
                last = first
                while last < len(rows) and rows[last][0] == rows[first][0]:
                    last += 1
                if name != rows[first][0]:
                    if handle is not None:
                        handle.close()
                    name = rows[first][0]
                    handle = store.open_input_file(f"{root}/{name}")
                for begin, end, n in ranges([x[1:] for x in rows[first:last]]):
                    data = memoryview(handle.read_at(end - begin, begin))
                    for _, offset, length in rows[first : first + n]:
                        headers, body = parsed(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                        kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha256:")
                        if kind == "response" and (hashlib.sha256(body).hexdigest() != digest or len(body) != int(headers["WARC-Payload-Length"])):
                            raise ValueError(f"{name} at {offset}: the payload isn't what was written")
                        page, ref = headers["WARC-Page-Number"], headers.get("WARC-Refers-To-Page-Number")
                        for c, v in zip(cols, (int(page) if page else None, int(headers["WARC-Payload-Length"]), digest, kind, int(ref) if ref else None, headers["WARC-Target-URI"], body if payloads else None)):
                            c.append(v)
                    first += n
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _RECORD_TYPES)], _RECORD_NAMES)
        if handle is not None:
            handle.close()

    placed = index.select("file", "offset", "length", F.expr(f"offset div {SPAN}").alias("block"))
    each = 4 * SPAN  # a task reads about so many bytes
    n = max(spark.sparkContext.defaultParallelism, -(-(index.agg(F.sum("length")).first()[0] or 0) // each))
    dealt = placed.repartition(n, "file", "block").sortWithinPartitions("file", "offset").drop("block")
    return dealt.mapInArrow(fetch, RECORD)


_RECORD_NAMES = [x.split(" ")[0] for x in RECORD.split(", ")]
_RECORD_TYPES = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split(" ")[1]] for x in RECORD.split(", ")]


def round_trip(pages: DataFrame, *, least: int = 100) -> DataFrame:
    """Archive all pages, read every record back: ``page_id, payload_bytes, payload_digest, record_type, refers_to``."""
    path = work_path(pages.sparkSession, "warc")
    index = write(pages, path, least=least)
    return read(index, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def oracle(least: int = 100) -> str:
    """DuckDB SQL for :func:`round_trip` over ``pages``."""
    return f"""
WITH p AS (SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
m AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= {least} GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id < page_id THEN first_id END AS refers_to FROM d LEFT JOIN m ON d.payload_digest = m.payload_digest AND payload_bytes >= {least}"""
