"""Sorted hash arrays in the shared folder, memory-mapped by workers.

A store is a set of parts; part k holds the rows whose top bits of the 64-bit hash are k: ``hash``
sorted ascending and one array per value column. Workers map a part when they first look into it, so
a lookup touches only the pages it needs. Where the shared folder is not a mounted one, a part is
read into memory instead. There are two layouts: a file per array under a name that its task chose and
returned (:func:`write_part`), for tables of few parts, and one file per part, named by its number
(:func:`write_numbered`), for tables whose parts grow with the text, where no list of names is held.
"""

from __future__ import annotations

import functools
import io
import mmap
import uuid

import numpy as np
from pyarrow import fs

#: splitmix64's constants (fixed values).
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 of each value."""
    with np.errstate(over="ignore"):
        x = x + MIX[0]
        x = (x ^ (x >> np.uint64(30))) * MIX[1]
        x = (x ^ (x >> np.uint64(27))) * MIX[2]
        return x ^ (x >> np.uint64(31))


def part_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def runs_of(parts: np.ndarray) -> list[tuple[int, int, int]]:
    """(part, begin, end) of each run of equal values of sorted ``parts``."""
    bounds = [*np.flatnonzero(np.diff(parts, prepend=-1)).tolist(), len(parts)]
    return [(int(parts[lo]), lo, hi) for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def write_part(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes one part's arrays (``hash`` sorted) under a new name, which it returns."""
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    name = uuid.uuid4().hex
    for key, values in arrays.items():
        with store.open_output_stream(f"{root}/{name}.{key}.npy") as out:
            np.lib.format.write_array(out, np.ascontiguousarray(values), allow_pickle=False)
    return name


@functools.lru_cache(maxsize=4096)
def array(folder: str, name: str, key: str) -> np.ndarray:
    store, root = fs.FileSystem.from_uri(folder)
    path = f"{root}/{name}.{key}.npy"
    if isinstance(store, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r", allow_pickle=False)
    with store.open_input_file(path) as source:
        return np.lib.format.read_array(source, allow_pickle=False)


def write_numbered(folder: str, part: int, arrays: list[np.ndarray]) -> None:
    """Writes one part's arrays, the sorted hashes first, to the file that its number names.

    The file appears whole or not at all. A second attempt of the same task has the same bytes, so either may stay.
    """
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own, final = f"{root}/.{part}-{uuid.uuid4().hex}", f"{root}/{part}"
    with store.open_output_stream(own) as out:
        for values in arrays:
            np.lib.format.write_array(out, np.ascontiguousarray(values), allow_pickle=False)
    try:
        store.move(own, final)
    except OSError:  # file systems that don't replace a file by a move
        if store.get_file_info(final).type == fs.FileType.NotFound:
            raise
        store.delete_file(own)


def arrays_in(data: bytes | mmap.mmap) -> list[np.ndarray]:
    """Views of the arrays that follow one another in a part's file."""
    found, at = [], 0
    while at < len(data):
        head = io.BytesIO(data[at : at + 256])
        np.lib.format.read_magic(head)
        (n,), _, kind = np.lib.format.read_array_header_1_0(head)
        found.append(np.frombuffer(data, kind, n, at + head.tell()))
        at += head.tell() + n * kind.itemsize
    return found


#: Mapped parts that a worker keeps; a process may hold about twice as many mappings.
MAPPED_PARTS = 32_768


@functools.lru_cache(maxsize=MAPPED_PARTS)
def mapped_part(root: str, part: int) -> list[np.ndarray] | None:
    """The arrays of a part on a mounted file system; None where the part has no rows and so no file."""
    try:
        with open(f"{root}/{part}", "rb") as file:
            return arrays_in(mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ))
    except FileNotFoundError:
        return None


def numbered_part(folder: str, part: int) -> list[np.ndarray] | None:
    store, root = fs.FileSystem.from_uri(folder)
    if isinstance(store, fs.LocalFileSystem):
        return mapped_part(root, part)
    if store.get_file_info(f"{root}/{part}").type == fs.FileType.NotFound:
        return None
    with store.open_input_file(f"{root}/{part}") as source:
        return arrays_in(source.read())


def find_numbered(folder: str, bits: int, hashes: np.ndarray, columns: int) -> list[np.ndarray]:
    """The ``columns`` value columns for sorted ``hashes``; 0 where a hash is not stored. Each part is opened once at most."""
    out = [np.zeros(len(hashes)) for _ in range(columns)]
    for part, begin, end in runs_of(part_of(hashes, bits)):
        stored = numbered_part(folder, part)
        if stored:
            at = np.searchsorted(stored[0], hashes[begin:end])
            at[at == len(stored[0])] = 0
            found = np.flatnonzero(stored[0][at] == hashes[begin:end])
            for values, own in zip(out, stored[1:], strict=True):
                values[begin + found] = own[at[found]]
    return out
