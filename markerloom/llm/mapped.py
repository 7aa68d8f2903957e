"""Files of named arrays in the shared folder, memory-mapped by the workers that read them.

Where the shared folder is no local path, a worker copies a file once, to a file without a name that goes with the process.
"""

from __future__ import annotations

import functools
import json
import mmap
import os
import tempfile
import uuid

import numpy as np


def save(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Write arrays to a new file of ``folder``; returns its name."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    at, head = 0, {}
    for k, v in arrays.items():
        head[k] = (v.dtype.str, at, len(v))
        at += -(-v.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    name = f"{uuid.uuid4().hex}.trie"
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for v in arrays.values():
            out.write(np.ascontiguousarray(v).tobytes() + bytes(-v.nbytes % 64))
    return name


@functools.lru_cache(maxsize=4096)
def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        handle = os.open(path, os.O_RDONLY)
    else:
        handle, copy = tempfile.mkstemp()
        os.unlink(copy)
        with store.open_input_stream(path, compression=None) as data:
            while part := data.read(8 << 20):
                os.write(handle, part)
    data = mmap.mmap(handle, 0, prot=mmap.PROT_READ)
    os.close(handle)
    n = int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, dtype, count, 8 + n + at) for k, (dtype, at, count) in json.loads(data[8 : 8 + n]).items()}


def nested(arrays: dict[str, np.ndarray], prefix: str) -> dict[str, np.ndarray]:
    return {k.removeprefix(prefix): v for k, v in arrays.items() if k.startswith(prefix)}
