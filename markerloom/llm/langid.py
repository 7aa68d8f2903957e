"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled documents in hashed buckets. The log-probability matrix has a row of ``buckets`` numbers
for each language; the task that makes a row writes it to the shared folder, and only the names of the rows are broadcast.
Scoring gathers a row's numbers for a whole Arrow batch in numpy, sums them by text and goes on to the next language; a
worker holds ``HELD_ROWS`` rows at most, however many languages there are.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; texts are scored whole; rows with a null
``doc_id`` are scored and never learned from; repeated rows are scored each; with no learnable row every text is ``und``;
an empty table gives no rows; every language is learned; further columns are ignored; equal posteriors go to the language
that sorts first.
"""

from __future__ import annotations

import functools
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.shared import hinted, only, remainder, small_batches, work_path

UNDETERMINED = "und"
#: Rows of the model (256 KiB each by default) that a worker keeps.
HELD_ROWS = 256


@functools.cache
def _letters() -> np.ndarray:
    """For each code point of the basic plane: its lower-case letter, or a space."""
    table = np.full(0x10000, 32, np.uint32)
    for i in range(0x10000):
        if unicodedata.category(c := chr(i))[0] == "L":
            table[i] = ord(low) if len(low := c.lower()) == 1 and ord(low) < 0x10000 else i
    return table


def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, runs of others as one space, a space before each text; and the text of each character."""
    parts = [np.frombuffer((" " + (t or "")).encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts.to_pylist()]
    text = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    chars = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    out = _letters()[np.minimum(chars, 0xFFFF)]
    if len(high := np.flatnonzero(chars > 0xFFFF)):
        values, back = np.unique(chars[high], return_inverse=True)
        out[high] = np.array([v if unicodedata.category(chr(v))[0] == "L" else 32 for v in values], np.uint32)[back]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 32) | (out[:-1] != 32) | (text[1:] != text[:-1])
    return out[keep], text[keep]


def buckets_of(chars: np.ndarray, text: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """For each character the bucket of the n-gram that begins there; ``buckets`` where it leaves its text or is a space."""
    n = max(0, len(chars) - order + 1)
    h = np.full(n, np.uint32(order * 0x27D4EB2F & 0xFFFFFFFF))
    for j in range(order):
        h ^= chars[j : n + j]
        h *= np.uint32(0x01000193)
    h ^= h >> np.uint32(15)
    h &= np.uint32(buckets - 1)
    out = np.full(len(chars), buckets, np.int32)
    out[:n] = h
    if order == 1:
        out[chars == 32] = buckets
    else:
        out[:n][text[:n] != text[order - 1 :]] = buckets
    return out


@functools.lru_cache(maxsize=HELD_ROWS)
def _row(folder: str, name: str) -> np.ndarray:
    """A language's log probabilities, and a 0 at the end that stands for no n-gram."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/{name}", compression=None) as data:
        return np.append(np.frombuffer(data.read(), "<f4"), np.float32(0))


class LanguageModel:
    """Languages with their priors, and for each the file of its row in ``folder``."""

    def __init__(self, langs: list[str], prior: np.ndarray, folder: str, files: list[str], orders: tuple[int, ...], buckets: int):
        self.langs, self.prior, self.folder, self.files, self.orders, self.buckets = langs, prior, folder, files, orders, buckets

    def score(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        n = len(texts)
        if not self.langs or not n:
            return [UNDETERMINED] * n, np.zeros(n)
        known = np.zeros(n, bool)
        chars, text = characters(texts)
        known[np.unique(text[chars != 32])] = True
        begins = np.flatnonzero(np.diff(text, prepend=-1))  # each text has a character, a space at least
        places = [buckets_of(chars, text, order, self.buckets) for order in self.orders]
        best, top, others = np.zeros(n, np.int64), np.full(n, -np.inf), np.zeros(n)  # others: sum of exp(total - top)
        for k, file in enumerate(self.files):
            row, total = _row(self.folder, file), np.full(n, self.prior[k])
            for at in places:
                total += np.add.reduceat(row.take(at), begins, dtype=np.float64)
            over = total > top
            others = np.where(over, others * np.exp(np.minimum(top - total, 0)) + 1, others + np.exp(np.minimum(total - top, 0)))
            best[over], top = k, np.maximum(top, total)
        return [self.langs[b] if ok else UNDETERMINED for b, ok in zip(best, known)], np.where(known, 1 / others, 0.0)


def fit(docs: DataFrame, *, folds: int = 5, orders=(1, 2, 3), buckets: int = 1 << 16, train_docs: int = 4000, smoothing: float = 0.5) -> LanguageModel:
    """Learn from rows outside fold 0 with a text and a ``lang``: about ``train_docs`` documents of each language at most (the
    documented bound of the sample), chosen by a hash of their id. The driver holds names and sizes of the languages."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = only(docs, doc_id=F.col("doc_id"), text=F.col("text"), lang=F.col("lang")).where((remainder(F.col("doc_id"), folds) != 0) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    langs, folder = sorted(sizes), work_path(spark, "languages")
    if not langs:
        return LanguageModel([], np.zeros(0), folder, [], tuple(orders), buckets)
    numbered = spark.createDataFrame([(x, k, sizes[x]) for k, x in enumerate(langs)], "lang string, k long, size long")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.least(F.lit(1.0), F.lit(float(train_docs)) / F.col("size")) * F.lit(1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which = b.column("k").to_numpy()
            chars, text = characters(b.column("text"))
            places = [buckets_of(chars, text, order, buckets) for order in orders]
            found, n = np.unique(np.concatenate([(which[text] * buckets + at)[at < buckets] for at in places]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // buckets), pa.array(found % buckets), pa.array(n)], ["k", "at", "n"])

    def probabilities(table: pa.Table) -> pa.Table:
        from pyarrow import fs

        held = np.full(buckets, smoothing)
        np.add.at(held, table.column("at").to_numpy(), table.column("n").to_numpy())
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        file = uuid.uuid4().hex
        with store.open_output_stream(f"{root}/{file}", compression=None) as out:
            out.write(np.log(held / held.sum()).astype("<f4").tobytes())
        return pa.table({"k": table.column("k")[:1], "file": pa.array([file])})

    known = hinted(numbered)
    counts = rows.join(known, "lang").where(drawn).select("k", "text").mapInArrow(count, "k long, at long, n long").groupBy("k", "at").agg(F.sum("n").alias("n"))
    each = counts.unionByName(numbered.select("k", F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("n")))  # languages without an n-gram, too
    files = dict(each.groupBy("k").applyInArrow(probabilities, "k long, file string").collect())  # a name for each language
    prior = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
    return LanguageModel(langs, prior, folder, [files[k] for k in range(len(langs))], tuple(orders), buckets)


def identify(docs: DataFrame, model: LanguageModel, *, folds: int = 5) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for each row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # names and priors of languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = held.value.score(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = only(docs, doc_id=F.col("doc_id").cast("long"), held_out=remainder(F.col("doc_id"), folds) == 0, text=F.col("text"))
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
