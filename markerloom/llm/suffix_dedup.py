"""Removal of long passages that repeat, by sparse suffixes over words that are sorted and compared with their neighbours.

1. Each document retains only suffixes that begin at minimisers: of the runs of ``key_words`` words within each window of
   ``least`` words, the one with the least hash. Content alone selects them, so two copies of a passage of ``least`` words
   retain the same suffix.
2. The retained suffixes are sorted (by range over all tasks, by the hash of their first words, then by the words of all
   windows that select them, then by place) and each is compared with its neighbours: one that shares its first words with
   none is dropped.
3. From the others, matches are extended to the left and right, over all windows of ``least`` words that select the suffix.
   Where every place of a suffix has the same words as far as these windows reach, they are one extension; else each
   window is one of its own, so that a span is cut exactly where the match ends.
4. The extensions are sorted by their words and place, and compared with their neighbours: the first stays, in the document
   with the smallest id, equal ones after it are removed. Windows join into spans.

The sort orders have the place in them, so a passage that a third of all documents have is spread over as many tasks as
its rows need; of a run of equal rows that goes on in other tasks, one row for each task says how it begins and ends.

Defined cases: a null text has no words; texts are read whole; rows with a null ``doc_id`` are never compared and stay as
they are; equal rows are one document, and rows with one ``doc_id`` but different texts are documents of their own; an
empty table gives no rows; further columns are ignored. Of passages in one document, the first stays. Words are compared
with their case, in extensions by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.shared import hinted, only, small_batches, tasks, whole_groups, written
from markerloom.llm.textvec import OTHER_BASE, Words, grams, spans_of, words

SPANS = "doc_id long, text_key long, start_word long, end_word long, keeper long, removed boolean"
SUFFIXES = "doc_id long, text_key long, suffix long, run long"
WINDOWS = "doc_id long, text_key long, start long, size long, window long, other long"
#: Rows of a sorted table that one task holds, about.
SORTED = 400_000
_PLACE = np.uint64((1 << 26) - 1)


def least_places(keys: np.ndarray, width: int, most: int = int(_PLACE)) -> np.ndarray:
    """For each window of ``width`` keys, the place of its least one (by the upper 38 bits; of equals the leftmost). More than
    ``most`` keys are taken in slices that overlap by a window."""
    n = len(keys) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    if len(keys) > most:
        return np.concatenate([least_places(keys[at : at + most], width, most) + at for at in range(0, n, most - width + 1)])
    tagged = (keys & ~_PLACE) | np.arange(len(keys), dtype=np.uint64)
    blocks = np.append(tagged, np.full(-len(keys) % width, np.uint64(0xFFFFFFFFFFFFFFFF))).reshape(-1, width)
    to_right = np.minimum.accumulate(blocks, axis=1).ravel()
    to_left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(to_left[:n], to_right[width - 1 : width - 1 + n]) & _PLACE).astype(np.int64)


@dataclass
class Extensions:
    """Maximal runs of windows that select one suffix: text, first word, place of it in the batch, number of windows, key of
    the suffix and of all words of the run; ``hashes`` are those of the words of the batch."""

    text: np.ndarray
    start: np.ndarray
    place: np.ndarray
    size: np.ndarray
    suffix: np.ndarray
    run: np.ndarray
    hashes: np.ndarray


def extensions(w: Words, least: int, key_words: int) -> Extensions:
    h = w.hashes()
    none = np.zeros(0, np.int64)
    if len(h) < least:
        return Extensions(none, none, none, none, none.view(np.uint64), none.view(np.uint64), h)
    keys = grams(h, key_words)
    place = least_places(keys, least - key_words + 1)
    text = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
    inside = text[: len(place)] == text[least - 1 :]
    first = inside & (np.append(True, place[1:] != place[:-1]) | np.append(True, ~inside[:-1]) | np.append(True, text[1 : len(place)] != text[: len(place) - 1]))
    last = inside & np.append(first[1:] | ~inside[1:], True)
    begin, end = np.flatnonzero(first), np.flatnonzero(last)
    return Extensions(text[begin], begin - w.bounds[text[begin]], begin, end - begin + 1, keys[place[begin]], spans_of(h, begin, end + least), h)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _by_range(rows: DataFrame, *order: str) -> DataFrame:
    """A stored table's rows in one order over all partitions, each of which is small enough to be held."""
    return rows.repartitionByRange(tasks(rows, SORTED), *order).sortWithinPartitions(*order)


def _runs(table: pa.Table, *keys: str) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of rows with equal keys begin, and how long they are."""
    new = np.append(True, np.zeros(table.num_rows - 1, bool))
    for k in keys:
        c = table.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, table.num_rows))


def _of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """All rows of a task of :func:`_by_range`, if it has any."""
    held = [b for b in batches if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _looked_up(places: np.ndarray, columns: list[np.ndarray], known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of ``places`` those whose values in ``columns`` are a key of ``known``, and the values there."""
    found = [known.get(k, -1) for k in zip(*(c[places].tolist() for c in columns))]
    values = np.array(found, np.int64)
    return places[values >= 0], values[values >= 0]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes that have an equal neighbour, and whether all equal ones have the same run (``alike``); null for those whose
    neighbours may be in another task."""
    for t in _of_task(batches):
        first, n = _runs(t, "suffix")
        run = t.column("run").to_numpy()
        alike = np.repeat(run[first] == run[first + n - 1], n)
        edge = np.zeros(t.num_rows, bool)
        edge[: n[0]] = edge[t.num_rows - n[-1] :] = True
        keep = pa.array(edge | (np.repeat(n, n) > 1))
        out = t.select(["doc_id", "text_key", "suffix", "run"]).append_column("alike", pa.array(alike, mask=edge)).filter(keep)
        yield from out.to_batches()


def _kept_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Extensions that have an equal neighbour; the first of them, its ``keeper``, is not ``removed``; null for those whose
    neighbours may be in another task."""
    for t in _of_task(batches):
        place = _runs(t, "window", "other", "doc_id", "text_key", "start")[0]  # equal rows of the table are one
        t = t.take(pa.array(place))
        first, n = _runs(t, "window", "other")
        doc = t.column("doc_id").to_numpy()
        edge, removed = np.zeros(t.num_rows, bool), np.ones(t.num_rows, bool)
        edge[: n[0]] = edge[t.num_rows - n[-1] :] = True
        removed[first] = False
        out = t.append_column("keeper", pa.array(np.repeat(doc[first], n), mask=edge)).append_column("removed", pa.array(removed, mask=edge))
        yield from out.filter(pa.array(edge | (np.repeat(n, n) > 1))).to_batches()


def repeated_spans(docs: DataFrame, *, least: int = 50, key_words: int = 10) -> DataFrame:
    """``doc_id, text_key, start_word, end_word, keeper, removed`` for each longest span of words (the end excluded) all of
    whose windows of ``least`` words occur elsewhere; ``keeper`` is the smallest document that has the first of them, and
    spans that are not ``removed`` are those that stay. ``text_key`` is the xxhash64 of the text."""
    small_batches(docs.sparkSession)
    rows = only(docs, doc_id=F.col("doc_id").cast("long"), text_key=F.xxhash64(F.col("text")), text=F.col("text")).where("doc_id IS NOT NULL")
    document = ["doc_id", "text_key"]

    def retain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = extensions(words(b.column("text"), lower=False), least, key_words)
            of = b.select(document).take(pa.array(v.text))
            yield pa.RecordBatch.from_arrays([*of.columns, _signed(v.suffix), _signed(v.run)], [*document, "suffix", "run"])

    suffixes = written(rows.mapInArrow(retain, SUFFIXES), "suffixes")
    near = written(_by_range(suffixes, "suffix", "run", *document).mapInArrow(_compared, SUFFIXES + ", alike boolean"), "neighbours")
    # Suffixes whose neighbours may be in another task, two of each task: those with several places, and whether all are alike.
    edges = near.where("alike IS NULL").groupBy("suffix").agg(F.count("*").alias("n"), (F.min("run") == F.max("run")).alias("same")).where("n > 1").collect()
    cut = docs.sparkSession.sparkContext.broadcast({(r.suffix,): int(r.same) for r in edges})
    keys = lambda c: F.collect_set(F.when(c, F.col("suffix")))
    of_doc = near.groupBy(*document).agg(keys(F.col("alike")).alias("whole"), keys(~F.col("alike")).alias("single"), keys(F.col("alike").isNull()).alias("cut"))
    of_doc = written(of_doc, "shared")  # one document's at most

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = extensions(words(b.column("text"), lower=False), least, key_words)
            whole, single, unsure = (np.zeros(len(v.text), bool) for _ in range(3))
            bounds, own = np.searchsorted(v.text, np.arange(b.num_rows + 1)), v.suffix.view(np.int64)
            for name, found in (("whole", whole), ("single", single), ("cut", unsure)):
                for i, known in enumerate(b.column(name)):
                    mine = slice(bounds[i], bounds[i + 1])
                    found[mine] = np.isin(own[mine], known.values.to_numpy())
            for place, alike in zip(*_looked_up(np.flatnonzero(unsure), [own], cut.value)):
                (whole if alike else single)[place] = True
            # Runs that are alike wherever they are stay whole, others go window by window.
            size = np.where(single, v.size, 1)[whole | single]
            each = np.repeat(np.flatnonzero(whole | single), size)
            nth = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
            begin, windows = v.place[each] + nth, np.where(single, 1, v.size)[each]
            of = b.select(document).take(pa.array(v.text[each]))
            cols = [spans_of(v.hashes, begin, begin + windows + least - 1, *base) for base in ((), (OTHER_BASE,))]
            yield pa.RecordBatch.from_arrays([*of.columns, pa.array(v.start[each] + nth), pa.array(windows), *map(_signed, cols)], [x.split(" ")[0] for x in WINDOWS.split(", ")])

    # Texts without a shared suffix stay out of the shuffle.
    texts = rows.join(hinted(of_doc.select("doc_id").distinct()), "doc_id", "left_semi").join(of_doc, document).select(*document, "text", "whole", "single", "cut")
    found = written(texts.mapInArrow(extend, WINDOWS), "windows")
    order = ["window", "other", *document, "start"]
    marked = written(_by_range(found, *order).mapInArrow(_kept_first, WINDOWS + ", keeper long, removed boolean"), "kept")
    place = F.struct(*document, "start")
    edges = marked.where("removed IS NULL").groupBy("window", "other").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo != hi")  # two extensions a task
    edges = edges.select("window", "other", "lo.*").collect()
    first = docs.sparkSession.sparkContext.broadcast(({tuple(r)[:2]: k for k, r in enumerate(edges)}, np.array([tuple(r)[2:] for r in edges], np.int64).reshape(-1, 3).T))

    def join_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, document, 100_000):
            doc, text, start, size = (t.column(c).to_numpy() for c in (*document, "start", "size"))
            keeper, removed = t.column("keeper").fill_null(0).to_numpy().copy(), t.column("removed").fill_null(False).to_numpy(zero_copy_only=False).copy()
            there = t.column("removed").is_valid().to_numpy(zero_copy_only=False).copy()
            known, lows = first.value
            at, row = _looked_up(np.flatnonzero(~there), [t.column(c).to_numpy() for c in ("window", "other")], known)
            there[at], keeper[at] = True, lows[0][row]
            removed[at] = (doc[at] != lows[0][row]) | (text[at] != lows[1][row]) | (start[at] != lows[2][row])
            out = []
            for flag in (False, True):
                mine = np.flatnonzero(there & (removed == flag))
                each = np.repeat(mine, size[mine])
                if not len(each):
                    continue
                s = start[each] + np.arange(len(each)) - np.repeat(np.cumsum(size[mine]) - size[mine], size[mine])
                # Windows are in order, but may come twice. Removed spans join where they meet, others only from word to word.
                new = np.append(True, (doc[each][1:] != doc[each][:-1]) | (text[each][1:] != text[each][:-1]) | (s[1:] > s[:-1] + (least if flag else 1)))
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(each)) - 1
                of = each[begin]
                out.append((doc[of], text[of], s[begin], s[end] + least, keeper[of], np.full(len(of), flag)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], [x.split(" ")[0] for x in SPANS.split(", ")])

    return marked.repartition(tasks(marked, SORTED), *document).sortWithinPartitions(*document, "start").mapInArrow(join_windows, SPANS)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without these spans of words, each with the white space that follows it."""
    w = words(pa.array([text]), lower=False)
    data, at, parts = w.data.tobytes(), 0, []
    for begin, end in sorted(spans):
        parts.append(data[at : max(at, int(w.starts[begin]))])
        at = max(at, int(w.starts[end]) if end < len(w.starts) else len(data))
    return b"".join([*parts, data[at:]]).decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` with their columns, ``text`` without removed spans (and ``n_chars``, if there, counted anew);
    rows of which nothing but white space is left go."""
    names = docs.columns
    gone = written(repeated_spans(docs, **parameters).where("removed"), "spans")
    spans = gone.groupBy(F.col("doc_id").alias("span_doc"), F.col("text_key").alias("span_text")).agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("spans"))  # of one document
    ids = hinted(written(gone.select("doc_id").distinct(), "cut-ids"))
    key = docs["doc_id"].cast("long") == ids["doc_id"]
    whole = docs.join(ids, key, "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("row_id"), F.col("text").alias("row_text"))
    marked = whole.join(spans, (F.col("row_id") == F.col("span_doc")) & (F.xxhash64("row_text") == F.col("span_text")), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [t if s is None else without(t, [(x["start_word"], x["end_word"]) for x in s]) for t, s in zip(b.column("row_text").to_pylist(), b.column("spans").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("spans").is_valid(), pa.array(out, pa.string())], ["row", "changed", "cut"])

    row_type = whole.schema["row"].dataType.simpleString()
    left = marked.mapInArrow(cut, f"row {row_type}, changed boolean, cut string").where(~F.col("changed") | (F.length(F.regexp_replace("cut", r"[\x20\x09-\x0D]+", "")) > 0))
    new = {"text": F.col("cut")}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("changed"), F.length("cut").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return docs.join(ids, key, "left_anti").unionAll(left.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in names]))
