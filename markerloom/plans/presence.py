"""Sets of individuals as words of 64 bits, and rows of markers that hold what isn't zero.

A group is a mask, one bit for each place, so plans have an entry for 64 individuals rather than one for each; who has a marker
is a list of (place, depth), or words of bits of which ``bit_count`` counts those of a group."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "array<struct<col:int,depth:int>>"
#: Cells of dense rows that are made at once.
CELLS = 2_000_000


def mask(places: Iterable[int], n: int) -> Column:
    """Words of ``n`` bits (one word at least) of which those at ``places`` are set."""
    bits = np.zeros(max(1, -(-n // 64)) * 64, bool)
    bits[list(places)] = True
    return F.lit(np.packbits(bits, bitorder="little").view("<i8").tolist())


def is_set(words: Column, place: Column) -> Column:
    return F.getbit(F.get(words, F.shiftright(place, 6)), (place % 64).cast("int")) == 1


def count_bits(words: Column, of: Column | None = None) -> Column:
    """How many bits of ``words`` are set, or how many of them that ``of`` has, too."""
    each = F.transform(words, F.bit_count) if of is None else F.zip_with(words, of, lambda a, b: F.bit_count(a.bitwiseAND(b)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def gathered(long: DataFrame, *keys: str) -> DataFrame:
    """``keys, entries`` from ``keys, col, depth``: the entries of a row in order of their places."""
    return long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col("col").cast("int").alias("col"), "depth"))).alias("entries"))


def entries_of(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and depth of each entry."""
    flat = lists.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), flat.field("col").to_numpy(zero_copy_only=False), flat.field("depth").to_numpy(zero_copy_only=False)


def _mapped(df: DataFrame, n: int, name: str, kind: str, make) -> DataFrame:
    """``df`` with ``entries`` replaced by a list that ``make`` gives for slices of rows."""
    others = [c for c in df.columns if c != "entries"]
    each = max(1, CELLS // max(n, 1))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, each):
                part = b.slice(at, each)
                values = make(part.num_rows, *entries_of(part.column("entries")))
                ends = np.arange(part.num_rows + 1, dtype=np.int32) * values.shape[1]
                yield pa.RecordBatch.from_arrays([*part.select(others).columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()))], [*others, name])

    types = dict(df.dtypes)
    return df.mapInArrow(convert, ", ".join([*[f"`{c}` {types[c]}" for c in others], f"{name} array<{kind}>"]))


def scattered(df: DataFrame, n: int) -> DataFrame:
    """``entries`` as ``depths``, an array of all ``n`` individuals, filled in one pass."""

    def make(rows: int, row: np.ndarray, col: np.ndarray, depth: np.ndarray) -> np.ndarray:
        out = np.zeros((rows, n), np.int32)
        out[row, col] = depth
        return out

    return _mapped(df, n, "depths", "int", make)


def packed(df: DataFrame, n: int, min_depth: int) -> DataFrame:
    """``entries`` as ``words``: the bits of the individuals with ``min_depth`` or more."""

    def make(rows: int, row: np.ndarray, col: np.ndarray, depth: np.ndarray) -> np.ndarray:
        bits = np.zeros((rows, max(1, -(-n // 64)) * 64), bool)
        bits[row, col] = depth >= min_depth
        return np.packbits(bits, axis=1, bitorder="little").view("<i8")

    return _mapped(df, n, "words", "bigint", make)
