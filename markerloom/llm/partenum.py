"""Exact similarity join of shingle sets by PartEnum signatures.

1. Sets are classed by size in bands: a set's band and the next one hold all sets that are larger and similar enough. Two
   similar sets of a band differ in at most ``k`` shingles, which follows from the band's largest size. Bands are two such
   steps wide, so about half of the sets have no similar ones in the next band.
2. For a band, the domain of shingles is cut by hash in ``(k + 1) / 2`` partitions (rounded up), so that two similar sets
   differ by at most one shingle in one of them; each is cut in three parts, of which at least two are then equal. Every set
   enumerates the subsets of two parts of each partition; what it has in a subset is a signature. So similar sets share one,
   whatever they are, and sets share one by chance only if they agree on about twelve shingles.
3. A set has signatures for its own band, and for the next if similar sets may be in it. All signatures are shuffled once, to
   leave those that several sets have. Links within buckets of equal signatures are found, and confirmed on the full sets, as
   :mod:`markerloom.llm.bucket_links` says. Components of the links.

Signatures grow in number with the shingles of a set (about one for three), and no set is left out or cut.

Defined cases: a null text is an empty one; an empty set is linked with nothing; fewer words than a shingle has are one
shingle; texts are read whole; a null ``doc_id`` is linked with nothing; rows with one ``doc_id`` but different texts are documents
of their own, which are compared each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.llm.bucket_links import Texts, bucket_members, classes_of, links_within, named, set_keys, shingle_hashes
from markerloom.llm.shared import hinted, only, small_batches, written
from markerloom.llm.textvec import mixed, words

SETS = "doc_id long, text_key long, n_shingles long, set_a long, set_b long, signatures array<long>"
#: Parts of a partition, and the subsets of them that are enumerated: one may differ.
PARTS, SUBSETS = 3, ((0, 1), (0, 2), (1, 2))
#: From a band's smallest size to its largest, so many times as far as similar sets are from one another.
STEPS = 2
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands(percent: int, upto: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest and largest sizes of the bands as far as ``upto`` and one further, and how many shingles similar sets of two
    neighbouring bands or one can differ in, by the larger band."""
    low, high, at = [], [], 1
    while not low or low[-1] <= upto:
        top = at
        for _ in range(STEPS):
            top = max(top, 100 * top // percent)
        low.append(at)
        high.append(top)
        at = top + 1
    most = np.array(high, np.int64)
    return np.array(low, np.int64), most, 2 * most * (100 - percent) // (100 + percent)


def signatures(sets: list[np.ndarray], percent: int) -> list[np.ndarray]:
    """The signatures of each set of hashes, for its own band, and for the next one if a similar set may be in it."""
    sizes = np.array([len(s) for s in sets], np.int64)
    low, high, differ = bands(percent, int(sizes.max(initial=1)))
    own = np.searchsorted(low, sizes, "right") - 1
    band = np.stack([own, own + 1], axis=1)
    if band.size and band.max() >= len(low):
        low, high, differ = bands(percent, int(low[-1]))
    asked = np.stack([sizes > 0, (sizes > 0) & (100 * sizes // percent > high[own])], axis=1)
    partitions = np.where(asked & (differ[band] > 0), (differ[band] + 2) // 2, 0)  # where none may differ, equal sets are one class
    each = partitions.ravel()
    base = np.cumsum(each) - each
    if not each.sum():
        return [np.zeros(0, np.uint64)] * len(sets)
    flat = np.concatenate(sets)
    cells, values = [], []
    for j in (0, 1):
        n = np.repeat(partitions[:, j], sizes).astype(np.uint64)
        some = n > 0
        h = flat[some]
        cells.append((np.repeat(base[j::2], sizes)[some] + (h % n[some]).astype(np.int64)) * PARTS + ((h >> np.uint64(32)) % np.uint64(PARTS)).astype(np.int64))
        values.append(mixed(h + _ODD))
    cell, value = np.concatenate(cells), np.concatenate(values)
    order = np.argsort(cell, kind="stable")
    used, begin = np.unique(cell[order], return_index=True)
    sums = np.zeros(int(each.sum()) * PARTS, np.uint64)
    sums[used] = np.add.reduceat(value[order], begin)
    sums = sums.reshape(-1, PARTS)
    nth = np.arange(len(sums)) - np.repeat(base, each)
    place = mixed(np.repeat(band.ravel(), each).astype(np.uint64) * np.uint64(1 << 32) + nth.astype(np.uint64) + np.uint64(1))
    found = np.stack([mixed(mixed(sums[:, a] + place) * _ODD + mixed(sums[:, b] + np.uint64(i + 1)) + np.uint64(i)) for i, (a, b) in enumerate(SUBSETS)], axis=1)
    ends = np.cumsum(partitions.sum(axis=1))
    return [found[e - n : e].ravel() for e, n in zip(ends.tolist(), partitions.sum(axis=1).tolist())]


def signed_sets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = words(batch.column("text"))
            sets = shingle_hashes(w.hashes(), w.bounds, k)
            own = signatures(sets, percent)
            ends = np.cumsum([0, *[len(x) for x in own]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((np.concatenate(own) if own else np.zeros(0, np.uint64)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), *set_keys(sets), lists], [x.split(" ")[0] for x in SETS.split(", ")])

    small_batches(docs.sparkSession)
    return only(docs, doc_id=F.col("doc_id").cast("long"), text_key=F.xxhash64(F.col("text")), text=F.col("text")).mapInArrow(sign, SETS)


def shared(buckets: DataFrame) -> DataFrame:
    """Rows of ``buckets`` (key, rep, n) whose key several have. The rows are shuffled once, whatever their number: to join them with
    a table of such keys takes a second shuffle as soon as that table is too large to be broadcast."""
    of_key = W.partitionBy("key")
    several = F.min("rep").over(of_key) != F.max("rep").over(of_key)
    return buckets.withColumn("several", several).where("several").select("key", "rep", "n")


def similar_sets(docs: DataFrame, *, k: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_key`` for each row: documents are linked if 100 * |A & B| >= percent * |A | B|
    for their sets of ``k``-word shingles; the component is named by its smallest id. ``text_key`` is the text's xxhash64."""
    all_docs = written(signed_sets(docs, k, percent), "signed")
    linkable = all_docs.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = classes_of(linkable)
    nodes = classes.select("rep", "doc_id", "text_key")
    buckets = linkable.join(hinted(nodes), ["doc_id", "text_key"]).select(F.explode("signatures").alias("key"), "rep", F.col("n_shingles").cast("int").alias("n"))
    known = links_within(bucket_members(written(shared(buckets), "shared")), Texts(docs, nodes), k, percent)
    return named(all_docs, classes, known).select("doc_id", "n_shingles", "component_id", "text_key")


def oracle(k: int = 3, percent: int = 90) -> str:
    """The same in SQL, from the common shingles of all pairs."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) >= {k} THEN w[i:i + {k - 1}] ELSE w END) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - {k - 2}))) AS i FROM w WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
e AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id WHERE 100 * x.n >= {percent} * y.n AND 100 * y.n >= {percent} * x.n
  GROUP BY 1, 2 HAVING 100 * count(*) >= {percent} * (any_value(x.n) + any_value(y.n) - count(*))),
l AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT l.b, r.seen FROM r JOIN l ON l.a = r.node WHERE r.seen < l.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY 1) c ON c.node = d.doc_id"""
