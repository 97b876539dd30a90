"""Arrays in files of the shared folder, memory-mapped by the workers that read them."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow.fs as pafs


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def put(path: str, arrays: list[np.ndarray]) -> None:
    """Writes arrays to one file on any file system; a repeated task replaces it whole."""
    fs, name = filesystem(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    part = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        head = np.array([len(arrays), *[len(a) for a in arrays], *[ord(a.dtype.char) for a in arrays]], np.int64)
        out.write(head.tobytes())
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes().ljust(-(-a.nbytes // 8) * 8, b"\0"))
    fs.move(part, name)


def get(path: str) -> list[np.ndarray]:
    """Arrays of such a file, memory-mapped: in place if it is on a mounted file system, else through an unlinked local copy."""
    fs, name = filesystem(path)
    if isinstance(fs, pafs.LocalFileSystem):
        raw = np.memmap(name, np.uint8, "r")
    else:
        with tempfile.NamedTemporaryFile() as local, fs.open_input_stream(name) as source:
            while chunk := source.read(16 << 20):
                local.write(chunk)
            local.flush()
            raw = np.memmap(local.name, np.uint8, "r")
    raw = raw.view(np.ndarray)
    n = int(raw[:8].view(np.int64)[0])
    head = raw[8 : 8 + 16 * n].view(np.int64)
    out, at = [], 8 + 16 * n
    for size, char in zip(head[:n].tolist(), head[n:].tolist()):
        kind = np.dtype(chr(char))
        out.append(raw[at : at + size * kind.itemsize].view(kind))
        at += -(-size * kind.itemsize // 8) * 8
    return out
