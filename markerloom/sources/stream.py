"""Frames as streams of Arrow batches, for consumers that hold one batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from markerloom.plans.lineage import stored

#: Rows of a batch.
STREAM_ROWS = 8192


def reader(df: DataFrame, *, rows: int = STREAM_ROWS) -> pa.RecordBatchReader:
    """The rows of ``df`` in the order of its partitions. Executors write them to the shared folder; this process opens file
    after file and holds a batch of at most ``rows``, never the whole. Columns need distinct names, as in any file."""
    table = stored(df, "stream")
    files, schema = sorted(table.inputFiles(), key=lambda x: x.rsplit("/", 1)[-1]), to_arrow_schema(table.schema)

    def batches() -> Iterator[pa.RecordBatch]:
        for file in files:
            store, path = fs.FileSystem.from_uri(file)
            with store.open_input_file(path) as data:
                for b in pq.ParquetFile(data).iter_batches(batch_size=rows):
                    yield from pa.Table.from_batches([b]).cast(schema).to_batches()

    return pa.RecordBatchReader.from_batches(schema, batches())
