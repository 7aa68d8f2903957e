"""Language-model scoring with an Elias-Fano trie of n-grams up to a given order.

Counts come from all training documents. Words are numbered in the order of their 64-bit hash; the upper bits of the hash
name a shard of level 1, a file with the hashes and counts of its words. Level n has the n-grams as successors of those of
level n - 1. A file of it holds

* Elias-Fano pointers from each n-gram of its parent file to its successors;
* the successors of each, in order, as one monotone Elias-Fano sequence (a context's numbers are added to the last value
  before it), with their counts and quantised discounted probabilities.

Where the n-grams of a parent file have many tokens, their successors are in several files: which is where is a hash of the
successor, so no task and no file holds all successors of a context, and a query asks one file. Back-off weights, quantised,
are a file for each parent file.

A query adds the word to the base of its context and looks for that value within the context's range; where it is names the
context of the next word one level further. Files are memory-mapped where the shared folder is a local path, else copied once
for each worker to a file without a name. Files grow in number, not in size; only their names are broadcast.

P(w | u) = (c(u w) - d) / c(u) + d n(u) / c(u) P(w | u') with absolute discount d, n(u) distinct successors and the context u'
one word shorter; P(w) is the base model. A document is a path from the end token over its words to the end token; contexts
go back to the end token before its first word.

Defined cases: a null text is an empty one and has the end token alone; texts are read whole; documents with a null
``doc_id`` are scored and never learned from; repeated rows are counted and scored each; an empty table gives no rows;
without training documents the score is the base score; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.elias_fano import EliasFano
from markerloom.llm.mapped import load, nested, save
from markerloom.llm.shared import only, remainder, small_batches, work_path, written
from markerloom.llm.textvec import mixed, words

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
END = np.uint64(1)
ALPHA, DISCOUNT = 0.1, 0.75
#: Training tokens for a shard or piece, about; and the fewest bits of a hash that name a shard.
SHARD_TOKENS, LEAST_BITS = 4_000_000, 4
#: A pair is a key of 64 bits: the context within its shard, then 40 bits for the word.
_WORD = np.uint64((1 << 40) - 1)


def quantised(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a byte each, and the value of each code: half of them quantiles of the values, half at even steps, so that
    common values are exact to their rank and no value is off by more than a 256th of the range."""
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1)
    book = np.unique(np.concatenate([np.quantile(values, (np.arange(128) + 0.5) / 128), np.linspace(values.min(), values.max(), 128)]))
    return np.searchsorted((book[1:] + book[:-1]) / 2, values).astype(np.uint8), book


# -- the model -----------------------------------------------------------------------------------------------------------


class Vocabulary:
    """Level 1: words of all shards; ``files`` by shard, ``sizes`` how many words each has."""

    def __init__(self, folder: str, bits: int, files: list[str | None], sizes: list[int], tokens: int, types: int):
        self.folder, self.bits, self.files, self.tokens, self.types = folder, bits, files, tokens, types
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word (hashes in order), -1 for a word without one."""
        out = np.full(len(hashes), -1, np.int64)
        for s, begin, end in _slices((hashes >> np.uint64(64 - self.bits)).astype(np.int64)):
            if self.files[s] is None:
                continue
            own = load(self.folder, self.files[s])["hashes"]
            at = np.minimum(np.searchsorted(own, hashes[begin:end]), len(own) - 1)
            out[begin:end] = np.where(own[at] == hashes[begin:end], at + self.offsets[s], -1)
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """The count of each number, in any order; 0 for -1."""
        out = np.zeros(len(numbers), np.int64)
        shard = np.searchsorted(self.offsets, numbers, "right") - 1
        for s in np.unique(shard[numbers >= 0]).tolist():
            mine = np.flatnonzero((shard == s) & (numbers >= 0))
            out[mine] = load(self.folder, self.files[s])["counts"][numbers[mine] - self.offsets[s]]
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ALPHA) / (self.tokens + ALPHA * (self.types + 1)))


class Level:
    """N-grams of one length, in files by parent file and by a hash of the last word; ``tokens`` is how many tokens the
    n-grams of each parent file have."""

    def __init__(self, folder: str, tokens: list[int]):
        self.folder = folder
        self.pieces = np.maximum(1, -(-np.array(tokens, np.int64) // SHARD_TOKENS))
        self.first = np.concatenate([[0], np.cumsum(self.pieces)]).astype(np.int64)
        self.files: list[str | None] = [None] * int(self.first[-1])
        self.weights: list[str | None] = [None] * len(tokens)

    def piece(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The file of a successor of a context in ``parent``."""
        return self.first[parent] + (mixed(word.astype(np.uint64)) % self.pieces[parent].astype(np.uint64)).astype(np.int64)

    def look_up(self, parent: np.ndarray, local: np.ndarray, word: np.ndarray, lower: np.ndarray | None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """log10 P(word | context) from that of the shorter context, ``lower`` (if asked for), and file and place of the
        n-gram, -1 where there is none. A context is its file and place in it, -1 if it is unknown; so is a word."""
        out, piece, place = None if lower is None else lower.copy(), np.full(len(word), -1), np.full(len(word), -1)
        known = np.flatnonzero(parent >= 0)
        there = word[known] >= 0
        of = np.where(there, self.piece(parent[known], word[known]), self.first[parent[known]])
        # Files of one parent follow one another, so both back-off weights and n-grams are read file by file in this order.
        order = _sorted(of, len(self.files))
        known, of, there = known[order], of[order], there[order]
        for p, begin, end in _slices(of):
            mine, s = known[begin:end], int(parent[known[begin]])
            if out is not None and self.weights[s] is not None:
                a = load(self.folder, self.weights[s])
                out[mine] += a["backoff_book"][a["backoff"][local[mine]]]
            mine = mine[there[begin:end]]
            if self.files[p] is None or not len(mine):
                continue
            pointers, sequence, a = _opened(self.folder, self.files[p])
            distinct, back = np.unique(local[mine], return_inverse=True)
            first, last = pointers.get(distinct).astype(np.int64), pointers.get(distinct + 1).astype(np.int64)
            has = np.flatnonzero((last > first)[back])
            if not len(has):
                continue
            base = np.where(first > 0, sequence.get(np.maximum(first - 1, 0)) + np.uint64(1), np.uint64(0))
            at, hit = sequence.find(base[back[has]] + word[mine[has]].astype(np.uint64))
            hit &= at < last[back[has]]
            found, at = mine[has[hit]], at[hit]
            piece[found], place[found] = p, at
            if out is not None:
                out[found] = np.log10(a["pairs_book"][a["pairs"][at]] + np.exp(out[found] * np.log(10)))
        return out, piece, place


class Trie:
    """Words, and a level for each length of n-grams from 2 on."""

    def __init__(self, vocabulary: Vocabulary, levels: list[Level]):
        self.vocabulary, self.levels = vocabulary, levels

    def walk(self, hashes: np.ndarray, bounds: np.ndarray, scored: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray, np.ndarray]:
        """For each token its number, count, log10 of its base and model probability (if ``scored``), and its context one
        level beyond the last."""
        v = self.vocabulary
        distinct, back = np.unique(hashes, return_inverse=True)
        number = v.numbers(distinct)
        count = v.counts(number)
        token = number[back]
        shard = np.where(number >= 0, np.searchsorted(v.offsets, number, "right") - 1, -1)
        place = number - v.offsets[np.maximum(shard, 0)]
        end = np.searchsorted(distinct, END)
        first = bounds[:-1]

        def before(x: np.ndarray, at_start: int) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[first] = at_start
            return out

        parent, local = (before(x[back], int(x[end]) if len(x) else -1) for x in (shard, place))
        single = v.base(count)[back] if scored else None
        each = single
        for level in self.levels:
            each, piece, at = level.look_up(parent, local, token, each)
            parent, local = before(piece, -1), before(at, -1)
        return token, count[back], single, each, parent, local


@functools.lru_cache(maxsize=4096)
def _opened(folder: str, name: str) -> tuple:
    """Pointers, successors and the other arrays of a file of n-grams."""
    a = load(folder, name)
    return EliasFano.of(nested(a, "pointers.")), EliasFano.of(nested(a, "words.")), a


def _sorted(numbers: np.ndarray, below: int) -> np.ndarray:
    """A stable order of numbers; of few files they are short integers, which numpy sorts by their digits."""
    return np.argsort(numbers.astype(np.min_scalar_type(max(below, 1))), kind="stable")


def _slices(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal numbers: number, begin, end."""
    cuts = np.flatnonzero(np.diff(numbers, prepend=-1)).tolist()
    yield from ((int(numbers[b]), b, e) for b, e in zip(cuts, [*cuts[1:], len(numbers)]))


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end after its words; and where each text begins."""
    w = words(texts)
    n = np.diff(w.bounds)
    bounds = w.bounds + np.arange(len(w.bounds))
    out = np.full(bounds[-1], END)
    text = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(w.starts)) + text] = w.hashes()
    return out, bounds


def _unigrams(rows: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            h, n = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            order = np.argsort(h, kind="stable")
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            return h[first], np.add.reduceat(n, first)

        for b in batches:
            held.append(np.unique(_tokens(b.column("text"))[0], return_counts=True))
            if sum(len(h) for h, _ in held) > 4_000_000:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(held[0][0].view(np.int64)), pa.array(held[0][1])], ["word", "n"])
                    held = []
        if held and len(held[0][0]):
            h, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["word", "n"])

    return rows.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, *, order: int = 3, folds: int = 10) -> Trie:
    """Count the n-grams up to ``order`` of all documents outside fold 0 and write the trie to the shared folder."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = only(docs, doc_id=F.col("doc_id"), text=F.col("text")).where(remainder(F.col("doc_id"), folds) != 0).select("text")
    counted = written(_unigrams(rows), "unigrams")
    types, tokens = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(LEAST_BITS, (tokens // SHARD_TOKENS).bit_length())
    folder = work_path(spark, "trie")

    def first_level(table: pa.Table) -> pa.Table:
        h, n = table.column("word").to_numpy().view(np.uint64), table.column("n").to_numpy()
        order = np.argsort(h)
        name = save(folder, {"hashes": h[order], "counts": n[order]})
        return pa.table({"shard": pa.array([int(h[0] >> np.uint64(64 - bits))], pa.int64()), "file": [name], "size": pa.array([len(h)], pa.int64()), "tokens": pa.array([n.sum()], pa.int64())})

    of_word = F.shiftrightunsigned("word", 64 - bits)
    made = counted.withColumn("shard", of_word).groupBy("shard").applyInArrow(first_level, "shard long, file string, size long, tokens long").collect()  # a row for each shard
    files, sizes, sums = [None] * (1 << bits), [0] * (1 << bits), [0] * (1 << bits)
    for r in made:
        files[r.shard], sizes[r.shard], sums[r.shard] = r.file, r.size, r.tokens
    vocabulary, levels = Vocabulary(folder, bits, files, sizes, tokens, types), []
    parents = files
    for n in range(2, order + 1) if tokens else ():
        level = Level(folder, sums)
        made = _level(rows, Trie(vocabulary, levels), level, parents, f"{n}-grams")
        sums, parents = [0] * len(level.files), level.files
        for r in made.select("piece", "file", "tokens").collect():  # a row for each file
            level.files[r.piece], sums[r.piece] = r.file, r.tokens
        levels.append(level)
    return Trie(vocabulary, levels)


def _level(rows: DataFrame, shorter: Trie, level: Level, parents: list[str | None], name: str) -> DataFrame:
    """Count the n-grams of a level, whose contexts are found in the ``shorter`` ones, and write its files: a stored table
    of their ``parent, piece, file, tokens, successors``; ``level.weights`` is filled."""
    folder, held_all = level.folder, rows.sparkSession.sparkContext.broadcast((shorter, level, parents))  # file names

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        shorter, level, _ = held_all.value

        def packed() -> pa.RecordBatch:
            piece, keys = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(piece, kind="stable")
            piece, keys, out = piece[order], keys[order], []
            for s, begin, end in _slices(piece):
                own, n = np.unique(keys[begin:end], return_counts=True)
                planes = np.diff(own, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes() + n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
                out.append((s, len(own), pa.compress(planes, codec="zstd", asbytes=True)))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], ["piece", "n", "data"])

        for b in batches:
            hashes, bounds = _tokens(b.column("text"))
            if not len(hashes):
                continue
            token, _, _, _, parent, local = shorter.walk(hashes, bounds, False)
            mine = np.flatnonzero(parent >= 0)
            held.append((level.piece(parent[mine], token[mine]), local[mine].astype(np.uint64) << np.uint64(40) | token[mine].astype(np.uint64)))
            if sum(len(x) for x, _ in held) > 4_000_000:
                yield packed()
        if any(len(x) for x, _ in held):
            yield packed()

    def build(table: pa.Table) -> pa.Table:
        (_, level, parents), p = held_all.value, table.column("piece")[0].as_py()
        s = int(np.searchsorted(level.first, p, "right")) - 1
        keys, n = [], []
        for size, data in zip(table.column("n").to_pylist(), table.column("data")):
            raw = np.frombuffer(pa.decompress(data.as_buffer(), decompressed_size=12 * size, codec="zstd"), np.uint8)
            keys.append(np.cumsum(np.ascontiguousarray(raw[: 8 * size].reshape(8, size).T).view(np.uint64).ravel(), dtype=np.uint64))
            n.append(np.ascontiguousarray(raw[8 * size :].reshape(4, size).T).view("<u4").ravel().astype(np.int64))
        keys, n = np.concatenate(keys), np.concatenate(n)
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        keys, n = keys[first], np.add.reduceat(n, first)
        context, word = (keys >> np.uint64(40)).astype(np.int64), (keys & _WORD).astype(np.int64)
        total = load(folder, parents[s])["counts"]
        size = len(total)
        successors = np.bincount(context, minlength=size)
        pointers = np.concatenate([[0], np.cumsum(successors)])
        code, book = quantised(np.log10((n - DISCOUNT) / total[context]))
        # A context's words are added to the last value before it, plus one.
        ends = pointers[1:][successors > 0] - 1
        base = np.zeros(size, np.int64)
        base[successors > 0] = np.concatenate([[0], np.cumsum(word[ends] + 1)[:-1]])
        values = base[context] + word
        arrays = {"pairs": code, "pairs_book": 10**book, "counts": n.astype(np.min_scalar_type(int(n.max())))}
        arrays |= {f"pointers.{k}": v for k, v in EliasFano.build(pointers, len(keys) + 1).parts().items()}
        arrays |= {f"words.{k}": v for k, v in EliasFano.build(values, int(values[-1]) + 1).parts().items()}
        return pa.table({"parent": pa.array([s], pa.int64()), "piece": pa.array([p], pa.int64()), "file": [save(folder, arrays)], "tokens": pa.array([n.sum()], pa.int64()), "successors": pa.array([pa.compress(successors.astype("<i4").tobytes(), codec="zstd", asbytes=True)], pa.binary())})

    def back_off(table: pa.Table) -> pa.Table:
        """What a context's successors leave to shorter contexts, from how many successors it has in all files."""
        s = table.column("parent")[0].as_py()
        total = load(folder, held_all.value[2][s])["counts"].astype(np.float64)
        distinct = np.zeros(len(total))
        for x in table.column("successors"):
            distinct += np.frombuffer(pa.decompress(x.as_buffer(), decompressed_size=4 * len(total), codec="zstd"), "<i4")
        code, book = quantised(np.log10(np.where(distinct > 0, DISCOUNT * distinct / total, 1.0)))
        return pa.table({"parent": pa.array([s], pa.int64()), "file": [save(folder, {"backoff": code, "backoff_book": book})]})

    blobs = rows.mapInArrow(grams, "piece long, n long, data binary")
    made = written(blobs.groupBy("piece").applyInArrow(build, "parent long, piece long, file string, tokens long, successors binary"), name)
    for r in made.groupBy("parent").applyInArrow(back_off, "parent long, file string").collect():  # a row for each file of the level before
        level.weights[r.parent] = r.file
    return made


def score(docs: DataFrame, model: Trie, *, folds: int = 10) -> DataFrame:
    """Base score and model score (log10 probability) of each row."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)  # file names

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        vocabulary = model.vocabulary
        for b in batches:
            hashes, bounds = _tokens(b.column("text"))
            _, count, single, each, _, _ = model.walk(hashes, bounds, True)
            sums = lambda x, kind: np.add.reduceat(x, bounds[:-1], dtype=kind) if len(x) else np.zeros(0, kind)
            cols = [np.diff(bounds), sums(count > 0, np.int64), np.full(b.num_rows, vocabulary.tokens), sums(single, np.float64), sums(each, np.float64)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *map(pa.array, cols)], [x.split(" ")[0] for x in SCORES.split(", ")])

    rows = only(docs, doc_id=F.col("doc_id").cast("long"), held_out=remainder(F.col("doc_id"), folds) == 0, text=F.col("text"))
    return rows.mapInArrow(judge, SCORES)
