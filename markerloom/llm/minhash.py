"""Near-duplicate detection: universal hash minima, banding, signature verification, exact confirmation, components.

1. One pass makes, for each document, the size of its shingle set, a 128-bit key of the set (equal sets are one class, of
   which only the first document goes on), ``bands * rows`` hash minima and a key for each band.
2. Buckets of a band are split by the size of the sets (similar sets are in the same or the next class of size).
3. Links within buckets are found as :mod:`markerloom.llm.bucket_links` says. Pairs whose signatures agree too little are
   dropped; the others are confirmed on the full sets. Components of the links.

So no bucket is gathered in one task, no group's pairs are written out, and no link between different texts that share a
bucket is lost; a pair of similarity 0.8 shares none with a probability of 1.3e-7 (40 bands of 5 rows).

Defined cases: a null text is an empty one; an empty set is linked with nothing; fewer words than a shingle has are one
shingle; texts are read whole; a null ``doc_id`` is linked with nothing; rows with one ``doc_id`` but different texts are documents
of their own, which are compared each; an empty table gives no rows; further columns are ignored. :func:`deduplicate` keeps
one of several equal rows (by id and text; any of them, where they differ in other columns), and all without an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.bucket_links import Texts, beside_pivots, bucket_members, classes_of, links_within, named, set_keys, shingle_hashes
from markerloom.llm.shared import hinted, only, small_batches, written
from markerloom.llm.textvec import mixed, words

SKETCH = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"


def minima(sets: list[np.ndarray], n: int, seed: int = 11) -> np.ndarray:
    """``n`` minima of universal hashes (multiply and add, modulo 2**32) of each set."""
    rng = np.random.default_rng(seed)
    a = (rng.integers(0, 1 << 31, (n, 1), np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)
    b = rng.integers(0, 1 << 32, (n, 1), np.uint64).astype(np.uint32)
    out = np.full((len(sets), n), np.uint32(0xFFFFFFFF))
    room = np.empty((n, 256), np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(x), 256):
            part = x[None, at : at + 256]
            view = room[:, : part.shape[1]]
            np.multiply(a, part, out=view)
            view += b
            np.minimum(out[i], view.min(axis=1), out=out[i])
    return out


def sketches(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column("text"))
            sets = shingle_hashes(w.hashes(), w.bounds, k)
            sig = minima(sets, bands * rows)
            keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), 1))
            for j in range(rows):
                keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows])
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), flat)
            low = (sig & np.uint32(0xFFFF)).astype("<u2")
            cols = [batch.column("doc_id"), batch.column("text_key"), *set_keys(sets), lists, pa.array([r.tobytes() for r in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_key", "n_shingles", "set_a", "set_b", "bands", "signature"])

    small_batches(docs.sparkSession)
    return only(docs, doc_id=F.col("doc_id").cast("long"), text_key=F.xxhash64(F.col("text")), text=F.col("text")).mapInArrow(sketch, SKETCH)


def agreeing(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs of which at least this share of the minima is equal, from signatures as :func:`_beside_pivots` orders them."""
    pivot = None
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("data").to_pylist()), "<u2").reshape(b.num_rows, -1)
        member = b.column("b").is_valid().to_numpy(zero_copy_only=False)
        own = np.maximum.accumulate(np.where(member, -1, np.arange(b.num_rows)))
        left = sig[own]
        if pivot is not None:
            left[own < 0] = pivot
        pivot = left[-1].copy()
        yield b.filter(pa.array(member & ((left == sig).mean(axis=1) >= least))).select(["a", "b"])


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_key`` for each row: documents are linked if 100 * |A & B| >= percent *
    |A | B| for their sets of ``k``-word shingles; the component is named by its smallest id, which is kept. ``text_key`` is
    the xxhash64 of the text."""
    share = percent / 100
    slack = share - 5 * (share * (1 - share) / (bands * rows)) ** 0.5  # signatures of linked sets agree in this share, but for five deviations
    all_docs = written(sketches(docs, k, bands, rows), "sketches")
    linkable = all_docs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = classes_of(linkable)
    nodes = classes.select("rep", "doc_id", "text_key")
    sketched = linkable.join(hinted(nodes), ["doc_id", "text_key"])
    buckets = sketched.select("rep", F.col("n_shingles").cast("int").alias("n"), F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo != hi").select("band")
    size = F.floor(F.log("n") / F.lit(np.log(1.04 / share)))
    by_size = buckets.join(shared, "band").select(F.explode(F.array(F.xxhash64("band", size), F.xxhash64("band", size + 1))).alias("key"), "rep", "n")
    members = bucket_members(by_size)
    several = hinted(written(members.select("rep").distinct(), "named"))
    signatures = written(sketched.select("rep", F.col("signature").alias("data")).join(several, "rep", "left_semi").dropDuplicates(["rep"]), "signatures")

    def likely(pairs: DataFrame) -> DataFrame:
        return written(beside_pivots(pairs, signatures).mapInArrow(lambda batches: agreeing(batches, slack), "a long, b long"), "likely")

    out = named(all_docs, classes, links_within(members, Texts(docs, nodes), k, percent, likely))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_key")


def deduplicate(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs``, with their columns, that :func:`near_duplicates` keeps, and of equal rows (by id and text) one."""
    found = written(near_duplicates(docs, **parameters).where("doc_id IS NOT NULL").select("doc_id", "text_key", "kept").toDF("dup_id", "dup_text", "kept"), "found")
    several = found.where("kept").groupBy("dup_id", "dup_text").agg(F.count("*").alias("n")).where("n > 1").select("dup_id", "dup_text", F.lit(True).alias("again"))
    marks = hinted(written(found.where("NOT kept").select("dup_id", "dup_text", F.lit(False).alias("again")).distinct().unionByName(several), "marks"))
    text_key = F.xxhash64(docs["text"])
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("row_id"), text_key.alias("row_text")).join(marks, (F.col("row_id") == F.col("dup_id")) & (F.col("row_text") == F.col("dup_text")), "left")
    once = marked.where("again").groupBy("row_id", "row_text").agg(F.first("row").alias("row"))
    return marked.where("again IS NULL").select("row.*").unionAll(once.select("row.*"))
