"""Hierarchical residual packing of token sequences into bins of a fixed capacity.

Round 0: each partition tokenises its documents, cuts those that are longer than a bin, and packs its pieces best-fit
(longest first). Bins that are nearly full are final. Round r: the bins that are left become items, ``fan_in`` groups
meet in one, and are packed best-fit again, up to one group. Where more bins would meet than one task should hold, all
bins that are left are packed at once by how many there are of each fill, which is the same best fit. Every underfull bin
goes on to the next round. Only a few numbers for each piece or bin are ever moved.

Defined cases: a null text is an empty one, whose sequence is the end token alone; a null ``doc_id`` is kept as null;
repeated rows are packed each; an empty table gives no rows; further columns are ignored; equal lengths keep their order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from markerloom.llm.bpe import encoder
from markerloom.llm.shared import only, small_batches, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long, grp long"
MERGED = "bin long, root long, base long, fill long, grp long"
#: A task packs at most so many items together.
BLOCK = 1_000_000
#: Bins made from counts are numbered from here, beyond those of any task.
COUNTED = 1 << 62


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each item, place of each item in its bin, and fill of each bin; the longest item goes first."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what is left in them
    mask = 0  # bit r: some bin has exactly r left
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = b, fills[b]
        fills[b] += n
        if left := room - n:
            with_room[left].append(b)
            mask |= 1 << left
    return bins, offsets, np.array(fills, np.int64)


def best_fit_of_counts(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``best_fit`` of ``counts[n]`` items of each length n, without a step for each item.

    Items of a length are numbered from 0. A row ``(length, first, bin, offset, each)`` says that the items from ``first`` on,
    up to the next row of that length, fill the bins from ``bin`` on, ``each`` in a bin, from ``offset`` on."""
    out, made = [], 0
    with_room: dict[int, list[tuple[int, int]]] = {}  # (first bin, how many) by what is left in them
    for n in sorted(counts, reverse=True):
        first, left = 0, counts[n]
        while left:
            room = min((r for r in with_room if r >= n), default=capacity)
            each = room // n  # what is left of the bin is the best fit of the next item
            if room in with_room:
                b, bins = with_room[room].pop()
                if not with_room[room]:
                    del with_room[room]
            else:
                b, bins = made, -(-left // each)
                made += bins
            out.append((n, first, b, capacity - room, each))
            whole = min(bins, left // each)
            rest = min(left - whole * each, each) if whole < bins else 0
            first, left = first + whole * each + rest, left - whole * each - rest
            untouched = bins - whole - (rest > 0)
            for now, begin, k in ((room - each * n, b, whole), (room - rest * n, b + whole, rest > 0), (room, b + bins - untouched, untouched)):
                if now and k:
                    with_room.setdefault(now, []).append((begin, int(k)))
    return out


def _scraps_apart(lengths: np.ndarray, bins: np.ndarray, offsets: np.ndarray, fills: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same packing, with each item of a bin that is at most three quarters full in a bin of its own: such bins are
    better joined item by item in the next round."""
    apart = 4 * fills[bins] <= 3 * capacity
    n = int(apart.sum())
    bins, offsets = bins.copy(), offsets.copy()
    bins[apart], offsets[apart] = len(fills) + np.arange(n), 0
    return bins, offsets, np.concatenate([fills, lengths[apart]])


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, slack: int = 4, fan_in: int = 8) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for each piece of each document.

    ``tokenizer`` is the path of a tokenizers file on every executor. Bins with ``slack`` tokens left or fewer are final."""
    small_batches(docs.sparkSession)
    tail = np.array([end_id], "<u4").tobytes()

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, made = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal made
            doc, piece, start, length, crc = zip(*held)
            bins, offsets, fills = best_fit(np.array(length), capacity)
            bins, offsets, fills = _scraps_apart(np.array(length), bins, offsets, fills, capacity)
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(bins + made + (task << 36)), pa.array(offsets), pa.array(fills[bins]), pa.array(np.full(len(bins), task))]
            made += len(fills)
            held.clear()
            return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill", "grp"])

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                held += [(doc, k, s, e - s, zlib.crc32(ids[4 * s : 4 * e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:]))]
            if len(held) >= BLOCK:
                yield packed()
        if held:
            yield packed()

    rows = only(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text"))
    pieces = written(rows.mapInArrow(pack_texts, PIECES), "packed")
    merged = _merge(pieces.where((F.col("offset") == 0) & (F.col("fill") < capacity - slack)).select("bin", "fill", "grp"), capacity, slack, fan_in)
    out = pieces if merged is None else pieces.join(merged.select("bin", "root", "base"), "bin", "left")
    root, base = (F.col("bin"), F.lit(0)) if merged is None else (F.coalesce("root", "bin"), F.coalesce("base", F.lit(0)))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", root.cast("long").alias("sequence_id"), (F.col("offset") + base).cast("long").alias("offset"))


def _merge(bins: DataFrame, capacity: int, slack: int, fan_in: int) -> DataFrame | None:
    """Pack underfull bins again, group by group; where each bin that took part has gone."""

    def packer(last: bool):
        def pack_bins(table: pa.Table) -> pa.Table:
            at, fill, grp = (table.column(c).to_numpy() for c in ("bin", "fill", "grp"))
            order = np.argsort(at)  # the same result for whatever order of the rows
            at, fill = at[order], fill[order]
            where, base, fills = best_fit(fill, capacity)
            if not last:
                where, base, fills = _scraps_apart(fill, where, base, fills, capacity)
            root = np.zeros(len(fills), np.int64)
            root[where[base == 0]] = at[base == 0]
            closed = (fills >= capacity - slack) | (np.bincount(where, minlength=len(fills)) == 0)
            return pa.table({"bin": at, "root": root[where], "base": base, "fill": fills[where], "grp": np.where(closed[where], -1, grp[0])})

        return pack_bins

    chain = None
    while True:
        met = bins.withColumn("grp", F.expr(f"grp div {fan_in}"))
        groups, most = met.groupBy("grp").count().agg(F.max("grp"), F.max("count")).first()
        if groups is None:
            break
        counted = most > BLOCK
        done = written(_merge_counted(bins, capacity) if counted else met.groupBy("grp").applyInArrow(packer(groups == 0), MERGED), "merged")
        if chain is None:
            chain = done
        else:
            later = done.select(F.col("bin").alias("at"), F.col("root").alias("to"), F.col("base").alias("more"))
            chain = chain.join(later, F.col("root") == F.col("at"), "left").select("bin", F.coalesce("to", "root").alias("root"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        if groups == 0 or counted:
            break
        bins = done.where((F.col("base") == 0) & (F.col("grp") >= 0)).select(F.col("root").alias("bin"), "fill", "grp")
    return chain


def _merge_counted(bins: DataFrame, capacity: int) -> DataFrame:
    """All of ``bins`` packed together by the numbers of each fill, so that no task holds them."""
    own = Window.partitionBy("grp", "fill").orderBy("bin")
    ranked = written(bins.withColumn("n", F.row_number().over(own) - 1), "ranked")
    counts = ranked.groupBy("grp", "fill").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("fill").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = {r.fill: r.n for r in counts.groupBy("fill").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = np.array(sorted(best_fit_of_counts(total, capacity)), np.int64).reshape(-1, 5)
    starts = {n: np.searchsorted(plan[:, 0], [n, n + 1]) for n in total}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fill, n = b.column("fill").to_numpy(), b.column("n").to_numpy()
            row = np.zeros(len(fill), np.int64)
            for f in np.unique(fill).tolist():
                i, j = starts[f]
                row[fill == f] = i + np.searchsorted(plan[i:j, 1], n[fill == f], "right") - 1
            _, first, to, offset, each = plan[row].T
            at = n - first
            yield pa.RecordBatch.from_arrays([b.column("bin"), pa.array(COUNTED + to + at // each), pa.array(offset + at % each * fill), pa.array(fill), pa.array(np.full(len(fill), -1))], ["bin", "root", "base", "fill", "grp"])

    numbered = ranked.join(counts.select("grp", "fill", before.alias("before")), ["grp", "fill"])
    return numbered.select("bin", "fill", (F.col("n") + F.col("before")).alias("n")).mapInArrow(place, MERGED)
