"""Hard negatives by norm-bucketed search: candidates in buckets of similar norm, pruned by the Cauchy-Schwarz bound.

1. Vectors become integers; equal rows are one. Rows are sorted by range, by the longest norm first, and packed to buckets of
   a bounded number of rows: by label for the positives, over all labels for the negatives.
2. Anchors are packed to blocks. A block meets a chunk of buckets only if the longest norm of the chunk can reach what an
   anchor of the block still needs: an inner product is at most the product of both norms.
3. In a task, one block goes through the buckets of one chunk, longest norms first. What an anchor needs is the score of its
   kth best so far; for negatives, the lower limit of its windows, or the kth best of each window so far, if that is higher.
   Anchors that the bucket can't serve are left out; if none is left, so is the rest of the chunk.
4. The chunks of the longest norms go first, as a job of their own; what they find is what the others have to beat.

Anchors are a stated share of the rows, and every anchor is compared with all rows that the bounds leave: where all norms
are equal they leave all of them. Blocks and chunks have bounded sizes, so a label of any number of rows is many tasks.

Defined cases: rows with a null id, a null label, a null vector, or a null or non-finite component (or one whose 256-fold isn't
finite) take no part; equal rows (id, label and vector) are one, rows of one id that differ are rows of their own; vectors of
different lengths are never compared; scores are exact integers, those beyond a long count as the largest one; a positive with
a negative score has no negatives, one with 0 those of score 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from markerloom.llm.shared import hinted, only, small_batches, tasks, whole_groups, written
from markerloom.llm.vector_codes import finite

#: Rows of a bucket or a block; buckets of a chunk; rows that one task sorts or packs, about.
BUCKET, CHUNK, SORTED = 4096, 4, 20_000
#: Tasks of a search at most; each takes blocks and chunks one after another.
TASKS = 50_000
#: Anchors whose scores with a bucket are held at once.
SLAB = 256
LARGEST = 2**63 - 1
#: Norms are floats; a bound is taken to be a little higher than it comes out.
ABOVE = 1 + 1e-9
PACK = "n int, norm double, rows binary, ids binary, labels binary, vectors binary, kind string"


def as_integers(vectors: DataFrame, vector: str, label: Column, is_anchor: Column) -> DataFrame:
    """``row, vec_id, label, anchor, dim, norm, kind, ints``: distinct rows, stored; ``ints`` has the integers as ``kind`` says."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("vector")
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            with np.errstate(over="ignore"):
                whole = [np.floor(256 * x) for x in np.split(flat, ends[:-1])] if len(ends) else []
            good = np.array([bool(np.isfinite(x).all()) for x in whole], bool)
            whole = [x for x, g in zip(whole, good.tolist()) if g]
            kinds = ["<i2" if (t := np.abs(x).max(initial=0)) < 2**15 else "<i4" if t < 2**31 else "<f8" for x in whole]
            norms = [float(np.hypot.reduce(x)) if k == "<f8" else float(x @ x) ** 0.5 for x, k in zip(whole, kinds)]
            cols = [*b.filter(pa.array(good)).select(["vec_id", "label", "anchor"]).columns, pa.array([len(x) for x in whole], pa.int32()), pa.array(norms, pa.float64()), pa.array(kinds, pa.string()), pa.array([x.astype(k).tobytes() for x, k in zip(whole, kinds)], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["vec_id", "label", "anchor", "dim", "norm", "kind", "ints"])

    small_batches(vectors.sparkSession)
    rows = only(vectors, vec_id=F.col("vec_id").cast("long"), label=label.cast("long"), anchor=F.coalesce(is_anchor, F.lit(False)), vector=F.col(vector)).where(finite("vector") & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    out = rows.mapInArrow(convert, "vec_id long, label long, anchor boolean, dim int, norm double, kind string, ints binary").distinct()
    return written(out.select(F.monotonically_increasing_id().alias("row"), "*"), "integers")


def packed(rows: DataFrame, keys: list[str], *extra: str, size: int = BUCKET) -> DataFrame:
    """Rows in order of ``keys`` and norm (the longest first), ``size`` of one key at most to a row: the keys, ``chunk``,
    ``bucket`` and ``PACK``; ``extra`` binary columns of the rows are joined end to end, ``need`` is the least of its column."""
    order = [*[F.asc(k) for k in keys], F.desc("norm"), F.asc("vec_id"), F.asc("row")]
    has_need = "need" in rows.columns
    kept = list(dict.fromkeys([*keys, "row", "vec_id", "label", "norm", "kind", "ints", *extra, *(["need"] if has_need else [])]))
    part = F.spark_partition_id()
    ordered = rows.select(*kept).repartitionByRange(max(1, -(-rows.count() // SORTED)), *order).sortWithinPartitions(*order)
    ordered = written(ordered.select("*", part.alias("part"), (F.monotonically_increasing_id() - F.shiftleft(part.cast("long"), 33)).alias("nth")), "ordered")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = ordered.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row for each partition
    bucket = F.floor((F.col("nth") + F.col("before")) / F.lit(size)).cast("int")
    placed = ordered.join(hinted(written(offsets, "offsets")), "part").withColumn("bucket", bucket).drop("part", "before")
    placed = placed.repartition(tasks(rows, SORTED), *keys, "bucket").sortWithinPartitions(*keys, "bucket", *order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, [*keys, "bucket"]):
            if t.num_rows:
                kinds, ints = t.column("kind").to_pylist(), t.column("ints").to_pylist()
                kind = max(kinds, key=["<i2", "<i4", "<f8"].index)
                data = b"".join(v if k == kind else np.frombuffer(v, k).astype(kind).tobytes() for k, v in zip(kinds, ints))
                column = lambda c: t.column(c).to_numpy().astype("<i8").tobytes()
                values = {**{k: t.column(k)[0].as_py() for k in keys}, "chunk": t.column("bucket")[0].as_py() // CHUNK, "bucket": t.column("bucket")[0].as_py(), "n": t.num_rows, "norm": t.column("norm")[0].as_py(), "rows": column("row"), "ids": column("vec_id"), "labels": column("label"), "vectors": data, "kind": kind}
                values |= {x: b"".join(t.column(x).to_pylist()) for x in extra}
                if has_need:
                    norm, need = t.column("norm").to_numpy(), t.column("need").to_numpy()
                    # The shortest norm that any of these rows can do with.
                    values["least"] = float(np.where(need <= 0, 0.0, need / np.maximum(norm, 1e-300)).min())
                yield pa.RecordBatch.from_pylist([values], schema)

    types = dict(rows.dtypes)
    spec = [*[(k, types[k]) for k in keys], ("chunk", "int"), ("bucket", "int"), *[tuple(x.split(" ")) for x in PACK.split(", ")], *[(x, "binary") for x in extra], *([("least", "double")] if has_need else [])]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string()}
    schema = pa.schema([(n, arrow[k]) for n, k in spec])
    return written(placed.mapInArrow(pack, ", ".join(f"{n} {k}" for n, k in spec)).withColumn("block", F.monotonically_increasing_id()), "packed")


def unpacked(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers, ids, labels and vectors (as floats, which hold the integers exactly) of a row of :func:`packed`."""
    rows, ids, labels = (np.frombuffer(r[c], "<i8") for c in ("rows", "ids", "labels"))
    return rows, ids, labels, np.frombuffer(r["vectors"], r["kind"]).reshape(r["n"], -1).astype(np.float64)


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products, as longs (those beyond are the largest long); ``bound`` is the product of the longest norms."""
    if bound < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in row] for row in a], object).reshape(a.shape) @ np.array([[int(x) for x in row] for row in b], object).reshape(b.shape).T
    return np.array([[max(-LARGEST, min(LARGEST, int(v))) for v in row] for row in exact], np.int64).reshape(len(a), len(b))


class Best:
    """The first ``k`` rows of each of ``n`` lists: higher scores first, then smaller ids, then smaller row numbers."""

    def __init__(self, n: int, k: int):
        self.k, self.list, self.score, self.id, self.row = k, *(np.zeros(0, np.int64) for _ in range(4))
        self.kth = np.full(n, -np.inf)

    def add(self, lists: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        if not len(lists):
            return
        lists, score, ids, row = (np.concatenate(x) for x in ((self.list, lists), (self.score, score), (self.id, ids), (self.row, row)))
        order = np.lexsort((row, ids, -score, lists))
        lists = lists[order]
        first = np.flatnonzero(np.append(True, lists[1:] != lists[:-1]))
        nth = np.arange(len(lists)) - np.repeat(first, np.diff(np.append(first, len(lists))))
        keep = order[nth < self.k]
        self.list, self.score, self.id, self.row = lists[nth < self.k], score[keep], ids[keep], row[keep]
        last = np.flatnonzero(nth == self.k - 1)
        self.kth[lists[last]] = score[order[last]]


class Positives:
    """The best rows of the same label; buckets and blocks have one label."""

    def __init__(self, block: dict, k: int):
        self.rows, _, _, self.vectors = unpacked(block)
        self.need = np.full(block["n"], -np.inf)
        if block.get("kths"):
            self.need = np.frombuffer(block["kths"], "<f8").copy()
        self.floor, self.best = self.need.copy(), Best(block["n"], k)

    def take(self, at: np.ndarray, scores: np.ndarray, bucket: tuple) -> None:
        rows, ids, _, _ = bucket
        keep = (scores >= self.need[at][:, None]) & (rows != self.rows[at][:, None])
        x, y = np.nonzero(keep)
        self.best.add(at[x], scores[x, y], ids[y], rows[y])
        self.need = np.maximum(self.floor, self.best.kth)


class Negatives:
    """The best rows of other labels in each window of an anchor; the windows are those of its positives."""

    def __init__(self, block: dict, k: int):
        self.rows, _, self.labels, self.vectors = unpacked(block)
        self.k, n = k, block["n"]
        limits = np.frombuffer(block["windows"], "<i8").reshape(n, -1, 2)
        self.low, self.high = limits[:, :, 0], limits[:, :, 1]
        self.floor = self.low.astype(float)
        if block.get("kths"):
            self.floor = np.maximum(self.floor, np.frombuffer(block["kths"], "<f8").reshape(self.floor.shape))
        self.floor[self.low > self.high] = np.inf
        self.best = Best(self.low.size, k)
        self.need, self.top = self.floor.min(axis=1), self.high.max(axis=1)

    def take(self, at: np.ndarray, scores: np.ndarray, bucket: tuple) -> None:
        rows, ids, labels, _ = bucket
        keep = (scores >= self.need[at][:, None]) & (scores <= self.top[at][:, None]) & (labels != self.labels[at][:, None])
        x, y = np.nonzero(keep)
        score, windows = scores[x, y], self.low.shape[1]
        own, kth = at[x], np.maximum(self.floor, self.best.kth.reshape(self.floor.shape))
        for j in range(windows):
            inside = np.flatnonzero((score >= kth[own, j]) & (score >= self.low[own, j]) & (score <= self.high[own, j]))
            self.best.add(own[inside] * windows + j, score[inside], ids[y[inside]], rows[y[inside]])
        self.need = np.maximum(self.floor, self.best.kth.reshape(self.floor.shape)).min(axis=1)


def search(blocks: DataFrame, buckets: DataFrame, keys: list[str], kind: type, k: int, extra: list[str]) -> DataFrame:
    """``list_row, list, found_row, found_id, score``: what each chunk of ``buckets`` finds for each list of the anchors of
    ``blocks``; ``list`` numbers the windows of an anchor."""
    chunks = buckets.groupBy(*keys, "chunk").agg(F.max("norm").alias("longest"))
    few = hinted(written(blocks.select(*keys, "block", "least"), "block-limits"))
    meetings = written(chunks.join(few, keys).where(F.col("longest") * ABOVE >= F.col("least")).select("block", "chunk"), "meetings")
    own = blocks.drop("chunk", "bucket").join(hinted(meetings), "block").select("block", "chunk", F.lit(-1).alias("bucket"), *[c.split(" ")[0] for c in PACK.split(", ")], *extra)
    others = buckets.drop("block").join(few, keys).where(F.col("norm") * ABOVE >= F.col("least")).select("block", "chunk", "bucket", *[c.split(" ")[0] for c in PACK.split(", ")])
    rows = own.unionByName(others, allowMissingColumns=True)
    rows = rows.repartition(min(TASKS, max(1, meetings.count())), "block", "chunk").sortWithinPartitions("block", "chunk", "bucket")

    def found(state) -> pa.RecordBatch:
        best, lists = state.best, state.low.shape[1] if kind is Negatives else 1
        cols = [state.rows[best.list // lists], best.list % lists, best.row, best.id, best.score]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["list_row", "list", "found_row", "found_id", "score"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = norms = None
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] < 0:
                    if state is not None:
                        yield found(state)
                    state = kind(r, k)
                    norms = np.hypot.reduce(state.vectors, axis=1) if state.vectors.shape[1] else np.zeros(r["n"])
                    continue
                at = np.flatnonzero(norms * r["norm"] * ABOVE >= state.need)
                if not len(at):
                    continue
                bucket = unpacked(r)
                for begin in range(0, len(at), SLAB):
                    part = at[begin : begin + SLAB]
                    state.take(part, products(state.vectors[part], bucket[3], float(norms[part].max()) * r["norm"] * ABOVE), bucket)
        if state is not None:
            yield found(state)

    return rows.mapInArrow(scan, "list_row long, list long, found_row long, found_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each list, ``rank`` from 1; a list has ``k`` rows of each chunk at most."""
    order = W.partitionBy("list_row", "list").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _waves(anchors: DataFrame, rows: DataFrame, keys: list[str], kind: type, k: int, lists: int, extra: list[str]) -> DataFrame:
    """The first ``k`` rows of each list, stored: the chunks of the longest norms first, then all others that can still matter."""
    buckets = packed(rows, keys)
    first = hinted(written(buckets.groupBy(*keys).agg(F.min("chunk").alias("first")), "first-chunks"))  # a row for each key
    both = buckets.join(first, keys)
    one = written(_first(search(packed(anchors, keys, *extra), both.where(F.col("chunk") == F.col("first")).drop("first"), keys, kind, k, extra), k), "first-wave")
    others = both.where(F.col("chunk") > F.col("first")).drop("first")
    if others.isEmpty():
        return one
    kths = one.where(F.col("rank") == k).groupBy("list_row").agg(F.map_from_entries(F.collect_list(F.struct("list", "score"))).alias("kth"))  # a row for each list of one anchor
    again = anchors.join(kths, F.col("row") == F.col("list_row"), "left").drop("list_row")

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, need = [], b.column("need").to_numpy(zero_copy_only=False).copy()
            low = [np.frombuffer(w, "<i8").reshape(-1, 2)[:, 0].astype(float) for w in b.column("windows").to_pylist()] if "windows" in extra else [np.full(1, -np.inf)] * b.num_rows
            for i, (own, kth) in enumerate(zip(low, b.column("kth").to_pylist())):
                x = np.full(lists, -np.inf)
                for j, score in kth or ():
                    x[j] = score
                out.append(x.astype("<f8").tobytes())
                need[i] = max(need[i], np.maximum(own, x).min())
            keep = [c for c in b.schema.names if c not in ("kth", "need")]
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(need), pa.array(out, pa.binary())], [*keep, "need", "kths"])

    schema = ", ".join(f"{n} {t}" for n, t in again.dtypes if n not in ("kth", "need")) + ", need double, kths binary"
    again = written(again.mapInArrow(limits, schema), "limited")
    more = search(packed(again, keys, *extra, "kths"), others, keys, kind, k, [*extra, "kths"])
    return written(_first(one.drop("rank").unionByName(more), k), "both-waves")


def mine(vectors: DataFrame, is_anchor: Column, *, vector: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: for each anchor and each of its first
    ``positives`` other rows of the same label, the first ``negatives`` rows of other labels whose score is from ``low`` to
    ``high`` percent of the positive's."""
    rows = as_integers(vectors, vector, F.col("label") if label is None else label, is_anchor)
    anchors = rows.where("anchor").withColumn("need", F.lit(float("-inf")))
    near = _waves(anchors, rows, ["dim", "label"], Positives, positives, 1, [])
    pairs = near.select(F.col("list_row").alias("row"), (F.col("rank") - 1).alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    by_anchor = pairs.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("near"))  # ``positives`` of each

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            need, out = np.full(b.num_rows, np.inf), []
            for i, near in enumerate(b.column("near").to_pylist()):
                limits = np.tile(np.array([1, 0], "<i8"), (positives, 1))  # nothing is in a window of a place without a positive
                for x in near:
                    s = x["positive_score"]
                    limits[x["place"]] = -(-low * s // 100), high * s // 100
                good = limits[limits[:, 0] <= limits[:, 1], 0]
                need[i] = good.min(initial=np.iinfo(np.int64).max)
                out.append(limits.tobytes())
            keep = [c for c in b.schema.names if c not in ("near", "need")]
            yield pa.RecordBatch.from_arrays([*b.select(keep).columns, pa.array(need), pa.array(out, pa.binary())], [*keep, "need", "windows"])

    ready = anchors.drop("need").join(by_anchor, "row")
    schema = ", ".join(f"{n} {t}" for n, t in ready.dtypes if n != "near") + ", need double, windows binary"
    ready = written(ready.mapInArrow(windows, schema), "windowed")
    hard = _waves(ready, rows, ["dim"], Negatives, negatives, positives, ["windows"])
    found = hard.select(F.col("list_row").alias("row"), F.col("list").cast("int").alias("place"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(pairs, ["row", "place"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle(share: int = 50, positives: int = 5, negatives: int = 3) -> str:
    """The query in SQL, of all anchors with all rows."""
    return f"""WITH k AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM k a JOIN k b ON a.vec_id % {share} = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= {positives})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= {negatives}"""
