"""Files that executors write to and read from the shared folder, by URI."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np


def open_fs(uri: str):
    """File system and path of a URI; a bare path is local."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path)
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, write) -> int:
    """Calls write(stream) on a temporary name and moves the file into place; a task that runs again does no harm."""
    files, path = open_fs(uri)
    files.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft, compression=None) as out:
        write(out)
        size = out.tell()
    files.move(draft, path)
    return size


def save_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays in one file: a header that says what stands where, then their bytes at multiples of 64."""
    layout, at = {}, 0
    for name, a in arrays.items():
        layout[name] = [a.dtype.str, list(a.shape), at]
        at += -(-a.nbytes // 64) * 64
    head = json.dumps(layout).encode()
    head = len(head).to_bytes(8, "little") + head
    head += b" " * (-len(head) % 64)

    def write(out):
        out.write(head)
        for a in arrays.values():
            if a.size:
                out.write(np.ascontiguousarray(a).reshape(-1).view(np.uint8).data)
                out.write(b"\0" * (-a.nbytes % 64))

    write_file(uri, write)


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of one file, all views of one memory map."""
    raw = _local(uri, lambda path: np.memmap(path, np.uint8, "r"))
    size = int.from_bytes(raw[:8].tobytes(), "little")
    base = -(-(8 + size) // 64) * 64
    out = {}
    for name, (kind, shape, at) in json.loads(raw[8 : 8 + size].tobytes()).items():
        n = int(np.prod(shape)) * np.dtype(kind).itemsize
        out[name] = raw[base + at : base + at + n].view(kind).reshape(shape)
    return out


def _local(uri: str, map_file):
    """The mapped file. From a store that isn't local it is first fetched, and unlinked once mapped."""
    files, path = open_fs(uri)
    if type(files).__name__ == "LocalFileSystem":
        return map_file(path)
    with tempfile.NamedTemporaryFile() as copy:
        with files.open_input_stream(path) as src:
            while block := src.read(8 << 20):
                copy.write(block)
        copy.flush()
        return map_file(copy.name)
