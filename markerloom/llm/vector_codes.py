"""Codes of vectors by integer codebooks, their nearest entries found through lower bounds of segment means.

1. A component x becomes the integer floor(256 * x). Vectors are cut into equal parts; each part position has a codebook,
   which begins as that part of the vectors with the smallest ids.
2. Each of some rounds assigns every part to its nearest entry (ties to the lower index) and replaces an entry by the floor
   of the mean of its parts. Tasks add up counts and sums of their rows, one row for each entry and component.
3. To find the nearest entry, a part and all entries are compared coarse to fine, by the means of one block, of two, of four
   and so on, and by the norms of what the means leave: the sum of both differences is never above the true distance. The
   entry of the least bound of each level gives an exact distance; entries whose bound is above it go; survivors are measured
   exactly, in integers.

Codebooks are ``entries`` vectors, whatever the number of rows, so they travel with the tasks; vectors are never shuffled.

Defined cases: rows whose vector is null or holds a null or a non-finite component are dropped; repeated rows count each; rows
with a null id are coded but start no codebook, and of rows with one id the smaller vector comes first; with fewer rows than
``entries``, codebooks have as many entries as there are rows. The smallest id's vector sets the number of components (a
number that the parts don't divide is filled up with zeros): vectors of another length, or with a component whose square
could overflow a sum (2**29 over the root of that number), keep null codes and errors and count nowhere. Without an id
anywhere, all do. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from markerloom.llm.shared import BROADCAST_ROWS, hinted, only, small_batches, written

#: Rows of one label that share a row of the labels' sums, where these can't be broadcast.
SALT = 100_000


def finite(vector: str) -> Column:
    """Whether an array column is there, and all its components are finite."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    return F.col(vector).isNotNull() & F.forall(F.col(vector).cast("array<double>"), good)


def integers(vectors: pa.Array, n: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Which lists have ``n`` components none of which is larger than ``most`` once it is an integer, and the integers of these."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    right = np.asarray(vectors.value_lengths().fill_null(-1)) == n
    flat = vectors.filter(pa.array(right)).flatten().to_numpy(zero_copy_only=False)
    whole = np.floor(256 * flat.astype(np.float64)).reshape(-1, n)
    small = (np.abs(whole) <= most).all(axis=1)
    right[right] = small
    return right, whole[small].astype(np.int64)


def levels(x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """From one block to blocks of two components: the means of each block, by the root of its length, and the norm of what
    is left. A block that can't be halved evenly ends the list."""
    out, width = [], x.shape[1]
    while width > 1:
        blocks = x.reshape(len(x), -1, width).astype(np.float64)
        means = blocks.mean(axis=2)
        rest = ((blocks - means[:, :, None]) ** 2).sum(axis=(1, 2)) ** 0.5
        out.append((means * width**0.5, rest))
        if width % 2:
            break
        width //= 2
    return out


def nearest(x: np.ndarray, book: np.ndarray, of_book: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` its nearest row of ``book`` and the squared distance, and how many were measured exactly."""
    n, m = len(x), len(book)
    if not n or not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    size = (x.astype(np.float64) ** 2).sum(axis=1)[:, None] + (book.astype(np.float64) ** 2).sum(axis=1)
    rows, cols, limit = np.repeat(np.arange(n), m), np.tile(np.arange(m), n), None
    for (means, rest), (book_means, book_rest) in zip(levels(x), of_book):
        if limit is None:
            bound = (rest[:, None] - book_rest) ** 2
            for j in range(means.shape[1]):
                bound += (means[:, j, None] - book_means[:, j]) ** 2
            first = bound.argmin(axis=1)
            limit = ((x - book[first]) ** 2).sum(axis=1) * (1 + 1e-9)
            rows, cols = np.nonzero(bound <= limit[:, None] + 1e-9 * size)
        else:
            bound = (rest[rows] - book_rest[cols]) ** 2 + ((means[rows] - book_means[cols]) ** 2).sum(axis=1)
            begin = np.searchsorted(rows, np.arange(n))
            hits = np.flatnonzero(bound == np.minimum.reduceat(bound, begin)[rows])
            first = cols[hits[np.searchsorted(rows[hits], np.arange(n))]]
            limit = np.minimum(limit, ((x - book[first]) ** 2).sum(axis=1) * (1 + 1e-9))
            keep = bound <= limit[rows] + 1e-9 * size[rows, cols]
            rows, cols = rows[keep], cols[keep]
    exact = ((x[rows] - book[cols]) ** 2).sum(axis=1)
    begin = np.searchsorted(rows, np.arange(n))
    least = np.minimum.reduceat(exact, begin)
    hits = np.flatnonzero(exact == least[rows])
    at = hits[np.searchsorted(rows[hits], np.arange(n))]
    return cols[at], least, len(rows)


class Codebooks:
    """Integer entries of each part: ``books`` has the shape (parts, entries, width)."""

    def __init__(self, books: np.ndarray, n: int):
        self.books, self.n, self.most = books, n, 2**29 / max(n, 1) ** 0.5
        self.levels = [levels(b) for b in books]

    def ready(self, vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which vectors can be coded, and their parts: (rows, parts, width)."""
        parts, _, width = self.books.shape
        right, x = integers(vectors, self.n, self.most)
        return right, np.pad(x, ((0, 0), (0, parts * width - self.n))).reshape(len(x), parts, width)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances: (rows, parts) each."""
        found = [nearest(x[:, p], book, self.levels[p]) for p, book in enumerate(self.books)]
        return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def first_codebooks(kept: DataFrame, parts: int, entries: int) -> Codebooks | None:
    """The parts of the vectors with the smallest ids; ``None`` without any."""
    top = kept.where("vec_id IS NOT NULL").orderBy("vec_id", "vector").limit(entries).collect()  # ``entries`` rows
    if not top:
        return None
    n = len(top[0].vector)
    _, x = integers(pa.array([r.vector for r in top], pa.list_(pa.float64())), n, 2**29 / max(n, 1) ** 0.5)
    if not len(x):
        return None
    width = -(-n // parts)
    x = np.pad(x, ((0, 0), (0, parts * width - n))).reshape(len(x), parts, width)
    return Codebooks(np.ascontiguousarray(x.transpose(1, 0, 2)), n)


def next_codebooks(kept: DataFrame, books: Codebooks) -> Codebooks:
    """The floors of the means of what is assigned to each entry; unused entries stay."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = books.books.shape
        counts, sums = np.zeros(parts * entries, np.int64), np.zeros((parts * entries, width), np.int64)
        for b in batches:
            _, x = books.ready(b.column("vector"))
            for p, index in enumerate(books.assign(x)[0].T):
                order = np.argsort(index, kind="stable")
                used, begin = np.unique(index[order], return_index=True)
                if len(used):
                    counts[p * entries + used] += np.diff(np.append(begin, len(order)))
                    sums[p * entries + used] += np.add.reduceat(x[order, p], begin)
        used = np.flatnonzero(counts)
        cell = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.repeat(counts[used], width)), pa.array(sums[used].ravel())], ["cell", "n", "total"])

    sums = kept.select("vector").mapInArrow(partial, "cell long, n long, total long")
    rows = sums.groupBy("cell").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # a row for each component of an entry
    new = books.books.copy().ravel()
    for r in rows:
        new[r.cell] = int(r.total) // r.n
    return Codebooks(new.reshape(books.books.shape), books.n)


def _with_sums(codes: DataFrame) -> DataFrame:
    """``codes`` with ``label_error``. Few labels are broadcast; else those of many rows have a row for each salt."""
    sums = written(codes.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("sum"), F.count("*").alias("n")), "label-errors")
    total = F.least(F.col("sum"), F.lit(2**63 - 1)).cast("long").alias("label_error")
    if sums.count() <= BROADCAST_ROWS:
        return codes.join(F.broadcast(sums.select("of", total)), codes["label"].eqNullSafe(F.col("of")), "left").drop("of")
    salts = F.ceil(F.col("n") / F.lit(SALT)).cast("int")
    each = sums.select("of", total, F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    many = hinted(written(sums.where(salts > 1).select(F.col("of").alias("many"), salts.alias("salts")), "hot-labels"))  # a row for SALT rows at most
    marked = codes.join(many, codes["label"].eqNullSafe(F.col("many")), "left").withColumn("own", F.pmod(F.xxhash64("vec_id", "code"), F.coalesce("salts", F.lit(1))).cast("int")).drop("many", "salts")
    return marked.join(each, marked["label"].eqNullSafe(F.col("of")) & (F.col("own") == F.col("salt")), "left").drop("of", "own", "salt")


def compress(vectors: DataFrame, *, vector: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` for each vector that has finite components only."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    small_batches(vectors.sparkSession)
    kept = only(vectors, vec_id=F.col("vec_id"), label=F.col("label"), vector=F.col(vector)).where(finite("vector"))
    books = first_codebooks(kept, parts, entries)
    for _ in range(rounds if books else 0):
        books = next_codebooks(kept, books)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            right = np.zeros(b.num_rows, bool)
            codes, errors = np.full(b.num_rows, None, object), np.zeros(b.num_rows, np.int64)
            if books:
                right, x = books.ready(b.column("vector"))
                index, error = books.assign(x)
                text = index.astype(np.uint8).tobytes().hex()
                codes[right] = [text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                errors[right] = error.sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(errors, mask=~right)], ["vec_id", "label", "code", "error"])

    kind = {f.name: f.dataType.simpleString() for f in kept.schema}
    codes = written(kept.mapInArrow(code, f"vec_id {kind['vec_id']}, label {kind['label']}, code string, error long"), "codes")
    return _with_sums(codes).withColumn("codebooks_sha256", F.lit(books.sha256() if books else None).cast("string"))


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """The same in SQL, for vectors whose length the parts divide."""
    ctes = [
        """k AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "size AS (SELECT max(len(v)) AS d FROM k)",
        f"""x AS (SELECT vec_id, CAST(floor(i / (d / {parts})) AS INTEGER) AS part, i % (d // {parts}) AS pos, v[i + 1] AS val FROM (SELECT vec_id, v, d, unnest(range(0, d)) AS i FROM k, size))""",
        f"e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k QUALIFY entry < {entries})",
        "b0 AS (SELECT part, entry, pos, val FROM x JOIN e USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes += [
            f"d{r} AS (SELECT vec_id, x.part, b.entry, sum((x.val - b.val) * (x.val - b.val)) AS dist FROM x JOIN b{r} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL)",
            f"a{r} AS (SELECT vec_id, part, arg_min(entry, dist * {entries} + entry) AS entry, min(dist) AS dist FROM d{r} GROUP BY ALL)",
        ]
        if r < rounds:
            ctes += [
                f"m{r} AS (SELECT a.part, a.entry, pos, CAST(floor(CAST(sum(val) AS DOUBLE) / count(*)) AS BIGINT) AS val FROM a{r} a JOIN x ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL)",
                f"b{r + 1} AS (SELECT b.part, b.entry, b.pos, coalesce(m.val, b.val) AS val FROM b{r} b LEFT JOIN m{r} m USING (part, entry, pos))",
            ]
    return "WITH " + ",\n".join(ctes) + f""",
c AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, label, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN k USING (vec_id)"""
