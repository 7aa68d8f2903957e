"""Helpers that every operator of the subpackage uses: the shared folder, materialised tables, checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches given to Python stay below this many bytes and rows, whatever the length of a text.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 4000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A session that names none gets a local one if all of it runs on this
    machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="markerloom-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back."""
    spark, path = df.sparkSession, work_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A table of at most so many narrow rows (ids) may be broadcast.
BROADCAST_ROWS = 500_000


def hinted(stored: DataFrame) -> DataFrame:
    """A stored table of a few narrow columns, to be broadcast if its rows are counted to be at most ``BROADCAST_ROWS``; a
    larger one is joined by shuffling."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds; a lower number that the session has set stays."""
    for key, most in (("maxBytesPerBatch", BATCH_BYTES), ("maxRecordsPerBatch", BATCH_ROWS)):
        now = spark.conf.get(key := f"spark.sql.execution.arrow.{key}").lower().rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def tasks(stored: DataFrame, each: int) -> int:
    """How many tasks to deal a stored table's rows out to, about ``each`` to one, and no fewer than there are cores."""
    return max(stored.sparkSession.sparkContext.defaultParallelism, -(-stored.count() // each))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1) -> Iterator[pa.Table]:
    """Tables of whole groups of rows with the same keys, from batches that are ordered by them; groups join in one table
    until it has ``least`` rows."""
    held: list[pa.RecordBatch] = []
    last, n = None, 0
    for b in batches:
        cols = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        done = 0
        for begin, end in zip(cuts, cuts[1:]):
            if begin == end:
                continue
            key = tuple(c[begin] for c in cols)
            if key != last and n + begin - done >= least:
                yield pa.Table.from_batches([*held, b.slice(done, begin - done)]).combine_chunks()
                held, n, done = [], 0, begin
            last = key
        if done < b.num_rows:
            held.append(b.slice(done))
            n += b.num_rows - done
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def only(df: DataFrame, **columns) -> DataFrame:
    """Exactly the named columns, so that other columns of the input, however they are called, can't clash."""
    return df.select(*[c.alias(name) for name, c in columns.items()])


def remainder(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id has the remainder 0 (never learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % F.lit(mod), F.lit(0))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; one that has fewer splits than the session has cores is dealt out to all of them."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
