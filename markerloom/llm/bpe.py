"""Token ids of a public byte-level BPE vocabulary, with a bounded memo of words.

The pre-tokeniser always begins a new pre-token at a space that a non-space follows, so a text may be cut there without
changing its ids: ``ids(a + " b") = ids(a) + ids(" b")``. Each worker keeps the ids of words that it has met.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from pathlib import Path

import numpy as np

#: Special token of the vocabulary, which the JSON form maps to its own id wherever it stands in a text.
SPECIAL = "<|endoftext|>"
#: Spaces that aren't followed by a word: such texts are encoded as a whole.
ODD = re.compile(r" (?!\S)")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The file of a public vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def vocabulary_pattern() -> str:
    """The pattern of the byte-level vocabularies' pre-tokens."""
    import public_tokenizers

    return public_tokenizers.PATTERN


class Memo(dict):
    """``word -> ids of " " + word`` as little-endian bytes; emptied when it holds ``most`` words."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.most = encode, most

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.encode(" " + word), "<u4").tobytes()
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 40:
            self[word] = ids
        return ids


class ByteBpe:
    def __init__(self, json_path: str, most: int = 200_000):
        """``json_path`` is the tokenizers file; a ``.tiktoken`` file of the same stem, if there, serves for plain text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        ranks = Path(json_path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.read_bytes().splitlines())}
            self.plain = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        else:
            self.plain = lambda text: self.whole.encode(text, add_special_tokens=False).ids
        self.memo = Memo(self.plain, most)

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if SPECIAL in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if ODD.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        head = np.array(self.plain(first), "<u4").tobytes() if first else b""
        return head + b"".join(map(self.memo.__getitem__, rest))


@functools.cache
def encoder(json_path: str) -> ByteBpe:
    """One for each worker process."""
    return ByteBpe(json_path)
