"""Raw files in the shared folder, for workers.

A path there is a URI. On file:, the folder is mounted and a file is mapped in
place; from any other store it is copied to a temporary local file, which is
unlinked once it is mapped.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def _local(uri: str) -> str | None:
    got = urlparse(uri)
    return unquote(got.path) if got.scheme in ("", "file") else None


def write_arrays(uri: str, arrays: list[np.ndarray]) -> None:
    """One file with all arrays; appears whole or not at all, so that tasks can be repeated."""
    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64)
    if path := _local(uri):
        part = f"{path}.{uuid.uuid4().hex}"
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(part, "wb") as f:
            head.tofile(f)
            for a in arrays:
                a.tofile(f)
        os.replace(part, path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(head.tobytes())
        for a in arrays:
            f.write(np.ascontiguousarray(a).data)
    store.move(part, path)


def map_arrays(uri: str, types: list[type]) -> list[np.ndarray]:
    """The arrays of a file that write_arrays made, mapped and not read."""
    path, copied = _local(uri), False
    if path is None:
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(uri)
        handle, path = tempfile.mkstemp()
        copied = True
        with os.fdopen(handle, "wb") as to, store.open_input_stream(there) as f:
            while block := f.read(1 << 22):
                to.write(block)
    raw = np.memmap(path, np.uint8, "r")
    if copied:
        os.unlink(path)
    n = int(raw[:8].view(np.int64)[0])
    at, out = 8 * (n + 1), []
    for size, kind in zip(raw[8:at].view(np.int64).tolist(), types, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind) if size else np.zeros(0, kind))
        at += size
    return out
