"""Tables that are computed once, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``. A session that names none gets a local folder if all of it runs on this
    machine, else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="markerloom-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as written to the shared folder and read back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: A stored table of at most so many narrow rows may be broadcast.
BROADCAST_ROWS = 500_000


def few_rows(table: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if it is counted to be small; a larger one is joined by shuffling."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table
