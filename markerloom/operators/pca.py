"""Principal components of individuals."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.plans.lineage import stored
from markerloom.plans.presence import entries_of
from markerloom.sources.stream import reader
from markerloom.table import MarkerTable
from markerloom.types import MarkerError

#: The Gram matrix of so many individuals is held on the driver (8 bytes times its square).
MAX_DENSE = 2000
#: Individuals whose sums travel together; markers whose entries are multiplied at once.
SLICE, ROWS = 1024, 500


@dataclass(frozen=True)
class PcaResult:
    """``components``: component, eigenvalue, variance_fraction, cumulative. ``loadings``: individual, PC1 to PCr."""

    components: DataFrame
    loadings: DataFrame
    total_variance: float
    n_markers: int

    def summary(self) -> dict:
        return {"n_markers": self.n_markers, "total_variance": self.total_variance}

    def to_pandas(self):
        """Components and loadings."""
        return self.components.toPandas(), self.loadings.toPandas()

    def to_arrow(self):
        """Components and loadings."""
        return self.components.toArrow(), self.loadings.toArrow()

    def to_polars(self):
        """Components and loadings."""
        import polars

        return tuple(polars.from_arrow(x) for x in self.to_arrow())

    def __arrow_c_stream__(self, requested_schema=None):
        """The loadings, a row for each individual."""
        return reader(self.loadings).__arrow_c_stream__(requested_schema)


def gram(table: MarkerTable, min_depth: int = 1) -> DataFrame:
    """``i, j, products, n`` for i <= j: sums of products of the raw depths of two individuals over markers present anywhere
    (n counts them); ``j = -1`` has the sum of each individual's depths. Each partition adds up dense blocks of ``ROWS`` markers
    first, in one Python worker, which holds a batch, a block and the sums, however many markers there are."""
    n = table.n_individuals
    if n > MAX_DENSE:
        raise MarkerError(f"more than {MAX_DENSE} individuals")

    dense = table.layout == "array"
    column = "depths" if dense else "entries"

    def block(lists: pa.Array) -> np.ndarray:
        if dense:
            return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), n).astype(float)
        row, col, depth = entries_of(lists)
        x = np.zeros((len(lists), n))
        x[row, col] = depth
        return x

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, sums, rows = np.zeros((n, n)), np.zeros(n), 0
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                x = block(b.column(column).slice(at, ROWS))
                products += x.T @ x
                sums += x.sum(axis=0)
            rows += b.num_rows
        i, j = np.triu_indices(n)
        i, j, v = np.append(i, np.arange(n)), np.append(j, np.full(n, -1)), np.append(products[i, j], sums)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v), pa.array(np.full(len(i), rows))], ["i", "j", "v", "m"])

    if dense:
        kept = table.df.where(F.exists("depths", lambda d: d >= min_depth)).select("depths")
    else:
        kept = table.sparse(ordered=False).df.where(F.exists("entries", lambda e: e["depth"] >= min_depth)).select("entries")
    parts = kept.mapInArrow(partial, "i int, j int, v double, m long")
    return parts.groupBy("i", "j").agg(F.sum("v").alias("products"), F.sum("m").alias("n"))


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues from the largest, floored at 0, and vectors whose largest entry is positive."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(-values, kind="stable")
    return np.maximum(values[order], 0.0), signed(vectors[:, order])


def _result(table: MarkerTable, values: np.ndarray, vectors: np.ndarray, total: float, m: int) -> PcaResult:
    spark, share = table.spark, values / total if total else values
    first = spark.createDataFrame([(k + 1, float(v), float(share[k]), float(share[: k + 1].sum())) for k, v in enumerate(values)], "component int, eigenvalue double, variance_fraction double, cumulative double")
    second = spark.createDataFrame([(x, *map(float, vectors[q])) for q, x in enumerate(table.individuals)], "individual string" + "".join(f", PC{k + 1} double" for k in range(len(values))))
    return PcaResult(first, second, total, m)


def signed(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose largest entry is positive."""
    top = np.abs(vectors).argmax(axis=0)
    return vectors * np.where(vectors[top, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)


def products(kept: DataFrame, block: np.ndarray) -> np.ndarray:
    """``X' X block`` for the depths ``X`` of markers (stored rows of ``entries``): one pass, in which each task adds up a matrix of
    the size of ``block``; those of tasks are added in two rounds, by slices of individuals."""
    n, q = block.shape
    given, spark = kept.sparkSession.sparkContext.broadcast(block), kept.sparkSession

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, out = given.value, np.zeros((n, q))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                row, col, depth = entries_of(b.column("entries").slice(at, ROWS))
                if not len(row):
                    continue
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                scores = np.add.reduceat(v[col] * depth[:, None], first)
                each = np.repeat(scores, np.diff(np.append(first, len(row))), axis=0) * depth[:, None]
                order = np.argsort(col, kind="stable")
                begin = np.flatnonzero(np.append(True, col[order][1:] != col[order][:-1]))
                out[col[order][begin]] += np.add.reduceat(each[order], begin)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(0, n, SLICE, dtype=np.int32) // SLICE), pa.array([out[i : i + SLICE].tobytes() for i in range(0, n, SLICE)], pa.binary())], ["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, data in zip(b.column("slice").to_pylist(), b.column("sums").to_pylist()):
                x = np.frombuffer(data)
                held[k] = held[k] + x if k in held else x
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "sums"])

    parts = kept.mapInArrow(partial, "slice int, sums binary").withColumn("salt", F.spark_partition_id())
    rounds = max(1, int(kept.rdd.getNumPartitions() ** 0.5))
    some = parts.repartition(max(1, min(rounds * (-(-n // SLICE)), 10_000)), "slice", F.col("salt") % rounds).select("slice", "sums").mapInArrow(add, "slice int, sums binary")
    whole = some.repartition(max(1, min(-(-n // SLICE), spark.sparkContext.defaultParallelism)), "slice").mapInArrow(add, "slice int, sums binary")
    out = np.zeros((n, q))
    for r in whole.collect():  # a block's size in all
        x = np.frombuffer(r.sums).reshape(-1, q)
        out[r.slice * SLICE : r.slice * SLICE + len(x)] = x
    given.unpersist()
    return out


def subspace(apply, n: int, r: int, *, extra: int = 8, blocks: int = 6, passes: int = 60, tolerance: float = 1e-9, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The first ``r`` eigenvalues and vectors of the symmetric matrix that ``apply`` multiplies a block of vectors with.

    A subspace grows by one block a pass, the matrix times the newest one; its best vectors are the guess, and a full subspace
    starts again from these. It ends where the guess solves the equation to ``tolerance`` of the largest eigenvalue."""
    width = min(n, r + extra)
    basis, image = np.zeros((n, 0)), np.zeros((n, 0))
    new = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, width)))[0]
    for _ in range(passes):
        basis, image = np.hstack([basis, new]), np.hstack([image, apply(new)])
        small = basis.T @ image
        values, z = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[: min(width, basis.shape[1])]
        values, z = values[order], z[:, order]
        guess, times = basis @ z, image @ z
        rest = times - guess * values
        if basis.shape[1] >= n or np.linalg.norm(rest[:, :r], axis=0).max(initial=0) <= tolerance * max(abs(values[0]), 1e-300):
            break
        if basis.shape[1] + width > blocks * width:
            basis, image = guess, times
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        new, size = np.linalg.qr(rest)[0], min(width, n - basis.shape[1])
        new = np.linalg.qr(new[:, :size] - basis @ (basis.T @ new[:, :size]))[0]
    return np.maximum(values[:r], 0.0), guess[:, :r]


def pca_by_passes(table: MarkerTable, *, min_depth: int = 1, components: int = 20) -> PcaResult:
    """The first components without a matrix of all pairs of individuals: some passes over the markers, each with a block of
    ``components`` and a few more vectors. What the driver holds is a few blocks, of individuals times components."""
    n = table.n_individuals
    present = F.exists("entries", lambda e: e["depth"] >= min_depth)
    kept = stored(table.sparse(ordered=False).df.where(present).select("entries"), "pca-rows")
    sums, squares = np.zeros(n), np.zeros(n)
    each = kept.select(F.explode("entries").alias("e")).groupBy("e.col").agg(F.sum("e.depth").alias("s"), F.sum(F.col("e.depth").cast("double") * F.col("e.depth")).alias("q"))
    for x in each.collect():  # a row for each individual
        sums[x.col], squares[x.col] = x.s, x.q
    m, r = kept.count(), min(components, n)
    total = float((squares - sums * sums / max(m, 1)).sum())
    if not m or not n:
        return _result(table, np.zeros(r), np.eye(n, r), 0.0, m)
    values, vectors = subspace(lambda v: products(kept, v) - np.outer(sums, sums @ v) / m, n, r)
    return _result(table, values, signed(vectors), total, m)


def pca(table: MarkerTable, *, min_depth: int = 1, components: int | None = None) -> PcaResult:
    """Of up to ``MAX_DENSE`` individuals all components come from their Gram matrix; of more, or where few ``components`` of many
    are asked for, the first ones (20 unless said) by passes over the markers."""
    n = table.n_individuals
    if n > MAX_DENSE or (components is not None and n > 500 and 10 * components < n):
        return pca_by_passes(table, min_depth=min_depth, components=components or 20)
    rows = gram(table, min_depth).toArrow()
    i, j, v = (rows.column(c).to_numpy() for c in ("i", "j", "products"))
    m = int(rows.column("n")[0].as_py()) if len(rows) else 0
    matrix, sums = np.zeros((n, n)), np.zeros(n)
    pairs = j >= 0
    matrix[i[pairs], j[pairs]] = matrix[j[pairs], i[pairs]] = v[pairs]
    sums[i[~pairs]] = v[~pairs]
    values, vectors = eigen(matrix - np.outer(sums, sums) / max(m, 1))
    r = min(components or n, n)
    return _result(table, values[:r], vectors[:, :r], float(values.sum()), m)
