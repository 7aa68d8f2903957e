"""Token counts under a unigram model, by dynamic programming that words with a common prefix share.

Texts are split by the vocabulary's own pre-token pattern, so words, punctuation and runs of white space are all counted.
The best score of a prefix depends on the prefix alone, so distinct pre-tokens go into a trie whose nodes hold the forward
score of their prefix and the number of tokens of its best segmentation; a node is computed once, however many pre-tokens
pass it, and where a pre-token ends the node's number is its count. Each worker keeps its trie, and the counts of the
pre-tokens that it has met, from batch to batch, up to a bound of nodes.

The model is a public vocabulary in order of rank: the r-th piece has the probability ``1 / (r + 2)`` over the sum of these
for all pieces (Zipf's law), and its logarithm as score. Of equal scores the one with fewer tokens wins.

Defined cases: a null or empty text has no tokens; texts are read whole; a null ``doc_id`` is kept as null; repeated rows
are counted each; an empty table gives no rows; further columns are ignored; bytes without a piece count as one token.
"""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markerloom.llm.shared import only, small_batches

COUNTS = "doc_id long, n_pretokens long, n_tokens long"
#: A worker's trie is begun anew beyond so many nodes; longer pre-tokens are not inserted.
NODES, LONG = 1_000_000, 2048


class UnigramTrie:
    def __init__(self, scores: dict[bytes, float], nodes: int = NODES):
        self.scores, self.most = scores, nodes
        self.tails = {p[i:] for p in scores for i in range(len(p))}  # a longer piece can't end where these don't
        self.worst = min(scores.values(), default=0.0) - 10.0
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.forward, self.tokens = [0.0], [0]

    def _extend(self, word: bytes, end: int, forward: list[float], tokens: list[int]) -> tuple[float, int]:
        """Score and tokens of ``word[:end]`` from those of all shorter prefixes."""
        best, n = forward[end - 1] + self.worst, tokens[end - 1] + 1
        for begin in range(end - 1, -1, -1):
            piece = word[begin:end]
            if piece not in self.tails:
                break
            if (s := self.scores.get(piece)) is not None and ((t := forward[begin] + s) > best or (t == best and tokens[begin] < n - 1)):
                best, n = t, tokens[begin] + 1
        return best, n

    def count(self, word: bytes) -> int:
        """The number of tokens of one pre-token."""
        inserted = len(word) <= LONG
        if inserted and len(self.forward) > self.most:
            self.clear()
        node, forward, tokens, child = 0, [0.0], [0], self.child
        for end in range(1, len(word) + 1):
            key = node << 8 | word[end - 1] if inserted else -1
            at = child.get(key)
            if at is None:
                best, n = self._extend(word, end, forward, tokens)
                if inserted:
                    at = child[key] = len(self.forward)
                    self.forward.append(best)
                    self.tokens.append(n)
            else:
                best, n = self.forward[at], self.tokens[at]
            forward.append(best)
            tokens.append(n)
            node = at
        return tokens[-1]


class Counts(dict):
    """``pre-token -> number of tokens``, emptied with its trie."""

    def __init__(self, trie: UnigramTrie, most: int = 300_000):
        super().__init__()
        self.trie, self.most = trie, most

    def __missing__(self, word: str) -> int:
        n = self.trie.count(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = n
        return n


def zipf_scores(pieces: list[bytes]) -> dict[bytes, float]:
    """Log probabilities of pieces in order of rank."""
    total = math.log(sum(1 / (rank + 2) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 2) - total for rank, piece in enumerate(pieces)}


@functools.cache
def counts_of(ranks_path: str) -> Counts:
    """One for each worker process."""
    table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, Path(ranks_path).read_bytes().splitlines())}
    return Counts(UnigramTrie(zipf_scores([table[rank] for rank in sorted(table)])))


def token_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for each row; ``ranks_path`` is a vocabulary of ranks on every executor,
    ``pattern`` the regular expression of its pre-tokens."""
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, split = counts_of(ranks_path), regex.compile(pattern).findall
        for b in batches:
            n, tokens = [], []
            for text in b.column("text"):
                found = split(text.as_py() or "")
                n.append(len(found))
                tokens.append(sum(map(counts.__getitem__, found)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return only(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text")).mapInArrow(count, COUNTS)
