"""Arrays in files of the shared folder, which tasks map into memory, and arrays packed for a shuffle."""

from __future__ import annotations

import json
import os
import uuid
from functools import lru_cache

import numpy as np
import zstandard


def mounted(path: str) -> str:
    """The name under which tasks open a path of the shared folder; it must be mounted alike on driver and executors."""
    scheme, colon, rest = path.partition(":")
    if not colon:
        return path
    if scheme != "file":
        raise ValueError(f"memory-mapped files need a shared folder that is mounted, not {scheme}:")
    return "/" + rest.lstrip("/")


def replaced(path: str, write) -> None:
    """Writes a file under another name and renames it, so that a task that runs again or twice leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    other = f"{path}.{uuid.uuid4().hex}"
    write(other)
    os.replace(other, path)


def save_arrays(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another at multiples of 64 bytes, behind a line that says what they are."""
    about, at = {}, 0
    for name, x in arrays.items():
        about[name] = (x.dtype.str, len(x), at)
        at += -(-x.nbytes // 64) * 64
    head = json.dumps(about).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"

    def write(to: str) -> None:
        with open(to, "wb") as f:
            f.write(head)
            for x in arrays.values():
                f.write(x.tobytes())
                f.write(bytes(-x.nbytes % 64))

    replaced(path, write)


def open_arrays(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped and not read."""
    with open(path, "rb") as f:
        head = f.readline()
    whole = np.memmap(path, np.uint8, "r")
    out = {}
    for name, (kind, n, at) in json.loads(head).items():
        kind, at = np.dtype(kind), at + len(head)
        out[name] = np.asarray(whole[at : at + n * kind.itemsize]).view(kind)
    return out


@lru_cache(maxsize=4096)
def mapped(path: str) -> dict[str, np.ndarray]:
    """open_arrays, once per worker and file."""
    return open_arrays(path)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, byte by byte of equal weight as far as any is used, compressed; the first is sorted and kept as differences."""
    first, *more = (np.asarray(x, np.int64) for x in arrays)
    head, planes = [len(first)], []
    for x in (np.diff(first, prepend=0), *more):
        used = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
        head.append(used)
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :used].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, np.int64).tobytes() + b"".join(planes))


def unpack(blob: bytes, count: int) -> list[np.ndarray]:
    flat = zstandard.ZstdDecompressor().decompress(blob)
    n, *used = np.frombuffer(flat, np.int64, count + 1).tolist()
    out, at = [], 8 * (count + 1)
    for k in used:
        x = np.zeros((n, 8), np.uint8)
        x[:, :k] = np.frombuffer(flat, np.uint8, n * k, at).reshape(k, n).T
        at += n * k
        out.append(x.reshape(-1).view(np.int64))
    return [np.cumsum(out[0]), *out[1:]]


def combined(key: np.ndarray, counts: np.ndarray | None, also: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Keys in order, equal ones as one with their counts (1 each if None) summed; `also` depends on the key."""
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    if counts is None:
        counts = np.diff(new, append=len(key))
    elif len(key):
        counts = np.add.reduceat(counts[order], new)
    return key[new], counts, [x[order[new]] for x in also]
