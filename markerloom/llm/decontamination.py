"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage with block-max WAND.

The test items are indexed, not the corpus: posting lists hold BM25 impacts, divided by the item's score for its own words,
so a score is the share of an item that a passage has; the largest impact of each term in each block of items bounds what
a block can reach. Every passage is a query: bounds of all passages of an Arrow batch are summed in numpy (over all items,
then over blocks), and passages that can reach the threshold go through the posting lists, document at a time, skipping
blocks. All items above the threshold are verified: enough word runs of the question, and of the answer, stand in the passage.
A longer item is found by any of its equal parts, whose score is reported, and verified as a whole: on the passage and as
many words around it as the rest of the item has. An item shorter than a run must stand in the passage as it is.

An index is a file of arrays in the shared folder that workers map, and holds ``max_items`` items at most; a larger
benchmark has several, made by tasks of their own with the statistics of all items, and every batch of documents is queried
against each: the documents are read once.

Defined cases: a null or wordless text or item matches nothing; texts are read whole; repeated items are each reported,
repeated documents too; of equally good passages of a text the first is reported; a null ``doc_id`` is reported as null; an empty table on either side gives no rows; further columns
are ignored. Words are lower-cased (A-Z) and ASCII punctuation counts as white space.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.mapped import load, save
from markerloom.llm.shared import only, small_batches, work_path, written
from markerloom.llm.textvec import PLAIN, Words, words

LEAKS = "doc_id long, item_id long, passage long, score double, question_overlap double, answer_overlap double"
K1, B = 1.2, 0.75
#: Longer items are indexed in equal parts of so many words at most; postings and items in a block.
PART, POSTINGS, RANGES, RUN = 256, 32, 64, 3


def plain_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN.tobytes()).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The last sentence is the answer; of a single sentence, the last third of its words."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if plain_words(s)]
    if len(sentences) > 1 and len(answer := plain_words(sentences[-1])) >= RUN:
        return plain_words(" ".join(sentences[:-1])), answer
    w = plain_words(text)
    cut = max(1, len(w) - max(1, len(w) // 3)) if len(w) > 1 else len(w)
    return w[:cut], w[cut:] or w


def runs(w: list[bytes]) -> Counter:
    n = min(RUN, len(w))
    return Counter(zip(*[w[i:] for i in range(n)])) if n else Counter()


def stands(item: list[bytes], passage: list[bytes]) -> bool:
    """Whether ``passage`` has the words of ``item`` one after the other."""
    return any(passage[i : i + len(item)] == item for i in range(len(passage) - len(item) + 1))


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """The share of the word runs of ``part`` that ``passage`` has."""
    own = runs(part)
    n = min(RUN, len(part))
    there = Counter(zip(*[passage[i:] for i in range(n)])) if n else Counter()
    return sum((own & there).values()) / max(1, sum(own.values()))


class ItemIndex:
    """Posting lists of impacts with the largest impact of each block, and a table of bounds by term and range of items."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.a, self.terms, self.bounds = arrays, arrays["terms"], arrays["bounds"].reshape(len(arrays["terms"]), -1)
        self.span = int(arrays["span"][0])
        self.known = np.zeros(1 << 16, bool)
        self.known[(self.terms >> np.uint64(48)).astype(np.int64)] = True
        self.item = functools.lru_cache(10_000)(self._item)

    @classmethod
    def build(cls, items: list[tuple[int | None, str]], n_items: int, mean_words: float, terms: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """The arrays of an index: ``counts`` says in how many of all ``n_items`` items each of ``terms`` (hashes in order) is."""
        w = words(pa.array([t for _, t in items], pa.string()), table=PLAIN)
        n = np.diff(w.bounds)
        n_parts = -(-n // PART)
        of = np.repeat(np.arange(len(items)), n_parts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
        begin, end = n[of] * nth // n_parts[of], n[of] * (nth + 1) // n_parts[of]
        size = end - begin
        part, hashes = np.repeat(np.arange(len(of)), size), w.hashes()  # parts follow one another as the words do
        own, term = np.unique(hashes, return_inverse=True)
        df = np.ones(len(own))
        at = np.minimum(np.searchsorted(terms, own), max(len(terms) - 1, 0))
        if len(terms):
            df = np.where(terms[at] == own, counts[at], 1)
        pairs, tf = np.unique(term * max(len(of), 1) + part, return_counts=True)
        term, part = pairs // max(len(of), 1), pairs % max(len(of), 1)
        impact = np.log1p((n_items - df[term] + 0.5) / (df[term] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[part] / mean_words))
        impact = impact / np.bincount(part, impact, len(of))[part]
        starts = np.append(0, np.cumsum(np.bincount(term, minlength=len(own))))
        place = np.arange(len(term)) - starts[term]
        blocks = np.flatnonzero(place % POSTINGS == 0)
        width = max(1, math.ceil(len(of) / RANGES))
        bounds = np.zeros((len(own), math.ceil(len(of) / width)), np.float32)
        np.maximum.at(bounds, (term, part // width), impact.astype(np.float32) + np.float32(1e-7))
        texts = [t.encode("utf-8", "surrogatepass") for _, t in items]
        return {
            "terms": own, "starts": starts, "parts": part.astype(np.int32), "impacts": impact, "bounds": bounds.ravel(), "top": bounds.max(axis=1) if bounds.size else np.zeros(0, np.float32),
            "block_starts": np.searchsorted(blocks, starts), "block_tops": np.maximum.reduceat(impact, blocks) if len(blocks) else np.zeros(0), "span": np.array([size.max() if len(size) else 1]),
            "of": of, "before": begin, "after": n[of] - end, "ids": np.array([i or 0 for i, _ in items], np.int64), "null": np.array([i is None for i, _ in items], bool),
            "texts": np.frombuffer(b"".join(texts), np.uint8), "text_ends": np.cumsum([len(t) for t in texts], dtype=np.int64),
        }

    def postings(self, term: int) -> tuple[list[int], list[float], list[float]]:
        """Parts that have a term, their impacts, and the largest impact of each block."""
        at, blocks = slice(*self.a["starts"][term : term + 2]), slice(*self.a["block_starts"][term : term + 2])
        return self.a["parts"][at].tolist(), self.a["impacts"][at].tolist(), self.a["block_tops"][blocks].tolist()

    def _item(self, k: int) -> tuple[int | None, list[bytes], list[bytes]]:
        """An item's id, question and answer."""
        begin = int(self.a["text_ends"][k - 1]) if k else 0
        text = self.a["texts"][begin : int(self.a["text_ends"][k])].tobytes().decode("utf-8", "surrogatepass")
        return None if self.a["null"][k] else int(self.a["ids"][k]), *question_and_answer(text)

    def lookup(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of words that are terms, and the terms."""
        at = np.flatnonzero(self.known[(hashes >> np.uint64(48)).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.terms, hashes[at]), len(self.terms) - 1)
        good = self.terms[t] == hashes[at]
        return at[good], t[good]

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All parts that score ``least`` or more for distinct ``terms``: block-max WAND."""
        found = []
        # Part now, place in the list, parts, impacts, largest impact of each block and of all.
        cursors = [[x[0][0], 0, *x, max(x[2])] for x in map(self.postings, terms)]
        while cursors:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[5]
                if total >= least - 1e-9:
                    pivot = i
                    break
            if pivot < 0:
                break
            goal = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == goal:
                pivot += 1
            bound, upto = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 60
            for c in cursors[: pivot + 1]:
                block = _block(c, goal)
                if block is not None:
                    bound += c[4][block]
                    upto = min(upto, c[2][min((block + 1) * POSTINGS, len(c[2])) - 1] + 1)
            if bound >= least - 1e-9:
                if cursors[0][0] == goal:
                    score = 0.0
                    for c in cursors[: pivot + 1]:
                        score += c[3][c[1]]
                        _move(c, goal + 1)
                    if score >= least - 1e-9:
                        found.append((goal, score))
                else:
                    for c in cursors[: pivot + 1]:
                        _move(c, goal)
            else:
                for c in cursors[: pivot + 1]:
                    _move(c, max(upto, goal + 1))
            cursors = [c for c in cursors if c[0] is not None]
        return found

    def leaks(self, w: Words, hashes: np.ndarray, least: float, verified: float) -> list[tuple[int, int, int, float, float, float]]:
        """(text, item, passage, score, question and answer overlap), the best passage for each text and item."""
        if not len(self.terms):
            return []
        places, terms = self.lookup(hashes)
        # Passage p of a text has its words p * span to (p + 2) * span; each word is in two of them, the first in one.
        text = np.searchsorted(w.bounds, places, "right") - 1
        own = (places - w.bounds[text]) // self.span
        base = np.zeros(len(w.bounds), np.int64)
        np.cumsum(np.diff(w.bounds) // self.span + 1, out=base[1:])
        passage = base[text] + own
        before = own > 0
        pairs = np.unique(np.concatenate([passage, passage[before] - 1]) * len(self.terms) + np.concatenate([terms, terms[before]]))
        passage, terms = pairs // len(self.terms), pairs % len(self.terms)
        for bound in (self.a["top"][:, None], self.bounds):
            if not len(passage):
                return []
            starts = np.flatnonzero(np.diff(passage, prepend=-1))
            high = np.add.reduceat(bound[terms], starts, axis=0).max(axis=1) >= least - 1e-4
            keep = np.repeat(high, np.diff(np.append(starts, len(passage))))
            passage, terms = passage[keep], terms[keep]
        best: dict[tuple[int, int], tuple] = {}  # by text and item of this index
        starts = np.flatnonzero(np.diff(passage, prepend=-1)) if len(passage) else np.zeros(0, np.int64)
        for begin, end in zip(starts.tolist(), [*starts.tolist()[1:], len(passage)]):
            p = int(passage[begin])
            found = self.search(terms[begin:end].tolist(), least)
            if not found:
                continue
            i = int(np.searchsorted(base, p, "right")) - 1
            first = int(w.bounds[i]) + (p - int(base[i])) * self.span
            around: dict[tuple[int, int], list[bytes]] = {}
            for part, score in found:
                k, lead, rest = (int(self.a[c][part]) for c in ("of", "before", "after"))
                if (i, k) in best and best[i, k][3] >= score:
                    continue
                item, question, answer = self.item(k)
                if (lead, rest) not in around:
                    around[lead, rest] = [w.text(j) for j in range(max(first - lead, int(w.bounds[i])), min(first + 2 * self.span + rest, int(w.bounds[i + 1])))]
                own_words = around[lead, rest]
                if len(question) + len(answer) < RUN and not stands(question + answer, own_words):
                    continue
                q, a = overlap(question, own_words), overlap(answer, own_words)
                row = (i, item, p - int(base[i]), score, q, a)
                if min(q, a) >= verified:
                    best[i, k] = row
        return list(best.values())


def _block(cursor: list, part: int) -> int | None:
    """The block in which ``part`` would be, from the cursor on."""
    ids, block = cursor[2], cursor[1] // POSTINGS
    while block * POSTINGS < len(ids):
        if ids[min((block + 1) * POSTINGS, len(ids)) - 1] >= part:
            return block
        block += 1
    return None


def _move(cursor: list, part: int) -> None:
    block = _block(cursor, part)
    if block is None:
        cursor[0] = None
        return
    ids, place = cursor[2], max(cursor[1], block * POSTINGS)
    while ids[place] < part:
        place += 1
    cursor[0], cursor[1] = ids[place], place


class Benchmark:
    """Names of the indexes of a benchmark in the shared folder; every worker maps them."""

    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files = folder, files

    def leaks(self, texts: pa.Array, least: float, verified: float) -> list[tuple]:
        """What :meth:`ItemIndex.leaks` finds in all indexes."""
        w = words(texts, table=PLAIN)
        hashes = w.hashes()
        return [x for name in self.files for x in _index(self.folder, name).leaks(w, hashes, least, verified)]


@functools.lru_cache(maxsize=256)
def _index(folder: str, name: str) -> ItemIndex:
    return ItemIndex(load(folder, name))


def index(items: DataFrame, max_items: int = 50_000) -> Benchmark:
    """Index a benchmark, in as many files as ``max_items`` asks for, all with the statistics of the whole of it."""
    spark = items.sparkSession
    small_batches(spark)
    rows = only(items, item_id=F.col("item_id").cast("long"), text=F.coalesce("text", F.lit("")))
    folder = work_path(spark, "benchmark")

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = words(b.column("text"), table=PLAIN)
            h, n = w.hashes(), np.diff(w.bounds)
            each = [np.unique(h[x:y]) for x, y in zip(w.bounds[:-1], w.bounds[1:])]
            shard = np.repeat(b.column("shard").to_numpy(), [len(x) for x in each])
            yield pa.RecordBatch.from_arrays([pa.array((np.concatenate(each) if each else np.zeros(0, np.uint64)).view(np.int64)), pa.array(shard)], ["term", "shard"])

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(words(b.column("text"), table=PLAIN).bounds))], ["n"])

    n, total = rows.mapInArrow(word_counts, "n long").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return Benchmark(folder, [])
    shards = math.ceil(n / max_items * (1.1 if n > max_items else 1))
    tagged = written(rows.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long")), "items")
    terms = written(tagged.mapInArrow(distinct_terms, "term long, shard long"), "terms")
    frequencies = terms.groupBy("term").agg(F.count("*").alias("n"))
    of_shard = terms.distinct().join(frequencies, "term")
    mean_words = total / n

    def build(own: pa.Table, known: pa.Table) -> pa.Table:
        listed = sorted(zip(own.column("item_id").to_pylist(), own.column("text").to_pylist()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        hashes, counts = known.column("term").to_numpy().view(np.uint64), known.column("n").to_numpy()
        order = np.argsort(hashes)
        return pa.table({"file": [save(folder, ItemIndex.build(listed, n, mean_words, hashes[order], counts[order]))]})

    files = tagged.groupBy("shard").cogroup(of_shard.groupBy("shard")).applyInArrow(build, "file string")  # a row for max_items items
    return Benchmark(folder, sorted(r.file for r in files.collect()))


def contaminated(docs: DataFrame, items: DataFrame, *, least: float = 0.5, verified: float = 0.5, max_items: int = 50_000) -> DataFrame:
    """``doc_id, item_id, passage, score, question_overlap, answer_overlap`` of each verified leak."""
    small_batches(docs.sparkSession)
    benchmark = index(items, max_items)

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = benchmark.leaks(b.column("text"), least, verified)
            cols = list(zip(*found)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(cols[0], pa.int64())), *[pa.array(c, t) for c, t in zip(cols[1:], (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))]], ["doc_id", "item_id", "passage", "score", "question_overlap", "answer_overlap"])

    return only(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).mapInArrow(query, LEAKS)


def decontaminate(docs: DataFrame, items: DataFrame, *, least: float = 0.5, verified: float = 0.5, max_items: int = 50_000) -> DataFrame:
    """The rows of ``docs``, with their columns, that hold no test item."""
    small_batches(docs.sparkSession)
    benchmark, at = index(items, max_items), docs.columns.index("text")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            keep[[x[0] for x in benchmark.leaks(b.column(at), least, verified)]] = False
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(drop, docs.schema)
