"""A user's own computations over markers: ``filter_map`` and ``fold``."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.plans.lineage import stored
from markerloom.table import MarkerTable
from markerloom.types import MarkerError

#: So many states are combined by one task of a round.
WIDTH = 16


def filter_map(table: MarkerTable, f: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """What ``f`` makes of each Arrow batch of markers, as rows of ``schema``; None drops a batch. ``f`` sees the columns that
    the table's layout has, and gives any number of rows. Nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if (out := f(b)) is not None:
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return table.df.mapInArrow(each, schema)


def fold(table: MarkerTable, start: Callable[[], Any], step: Callable[[Any, pa.RecordBatch], Any], combine: Callable[[Any, Any], Any], finish: Callable[[Any], pa.Table], schema: str, *, width: int = WIDTH) -> DataFrame:
    """Rows of ``schema`` that ``finish`` makes of one state.

    Each partition begins with ``start()`` and adds its Arrow batches by ``step``; states are combined in the order of the
    partitions, ``width`` of them by a task, in rounds until one is left, so ``combine`` has to be associative but not
    commutative. States are pickled, and stored between rounds; no state goes through the driver. An empty table is
    ``finish(start())``. A state should not grow with the number of markers: the last task holds ``width`` of them."""
    if width < 2:
        raise MarkerError("width must be 2 or more")

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, place = start(), TaskContext.get().partitionId()
        for b in batches:
            state = step(state, b)
        yield pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], ["place", "state"])

    def together(states: pa.Table) -> Any:
        first, *rest = (pickle.loads(x) for x in states.sort_by("place").column("state").to_pylist())
        for x in rest:
            first = combine(first, x)
        return first

    def joined(states: pa.Table) -> pa.Table:
        return pa.table({"place": pa.array([states.column("place")[0].as_py() // width], pa.int64()), "state": pa.array([pickle.dumps(together(states))], pa.binary())})

    spark = table.spark
    states = stored(table.df.mapInArrow(partial, "place long, state binary"), "states")
    while states.count() > width:
        states = stored(states.withColumn("group", F.expr(f"place div {int(width)}")).groupBy("group").applyInArrow(joined, "place long, state binary"), "states")
    if states.isEmpty():  # a table without partitions
        states = spark.createDataFrame([(0, pickle.dumps(start()))], "place long, state binary")
    return states.withColumn("group", F.lit(0)).groupBy("group").applyInArrow(lambda t: finish(together(t)), schema)
