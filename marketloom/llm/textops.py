"""Vectorised text primitives shared by the corpus operators.

All functions work on flat numpy arrays over the UTF-8 bytes of many texts at
once, so one Arrow batch costs a fixed number of numpy passes, whatever the
number of words in it. A very long text is worked on in parts: ``spaced`` cuts it
at white space, and scratch arrays are as large as a part, not as the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Byte classes: ASCII white space (tab to carriage return, and blank).
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases A-Z and leaves every other byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads polynomial hashes over all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes whose powers are held at once; spans of more than SHORT bytes are hashed by themselves.
BLOCK, SHORT = 1 << 20, 256


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None:
        have = np.full(BLOCK + SHORT + 1, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


class Hasher:
    """64-bit hashes of byte spans of one flat buffer, in order of their starts.

    Spans of at most SHORT bytes get polynomial hashes, in O(1) each. Modulo a power of
    two those collide on long strings of a regular kind (Thue and Morse's has 1024
    letters), so a longer span gets a digest of its bytes.
    """

    def __init__(self, data: np.ndarray):
        self.data, self.prefix = data, None

    def _prefix(self, at: int) -> np.ndarray:
        if self.prefix is None or self.at != at:
            data = self.data[at : at + BLOCK + SHORT]
            self.prefix, self.at = np.zeros(len(data) + 1, np.uint64), at
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data)), out=self.prefix[1:])
        return self.prefix

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        for at in range(0, len(self.data), BLOCK):
            i, j = np.searchsorted(start, [at, at + BLOCK])
            if i < j:
                prefix, s = self._prefix(at), start[i:j] - at
                e = np.minimum(end[i:j] - at, s + SHORT)
                out[i:j] = (prefix[e] - prefix[s]) * _power(_BASE_INV, len(prefix))[s]
        out = mix(out)
        for k in np.flatnonzero(end - start > SHORT).tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[start[k] : end[k]].tobytes())
        return out


def spaced(data: np.ndarray, most: int, space: np.ndarray = SPACE) -> Iterator[tuple[int, int]]:
    """Parts of one text of about ``most`` bytes, each ending after white space or with the text; a longer word stays whole."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + most, n)
        if to < n:
            blank = np.flatnonzero(space[data[at:to]])
            while not len(blank) and to < n:
                back, to = to, min(to + most, n)
                blank = np.flatnonzero(space[data[back:to]])[:1] + (back - at)
            to = at + int(blank[-1]) + 1 if len(blank) else n
        yield at, to
        at = to


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column in one array, and the n + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every run of bytes outside ``space``; runs end with their text."""
    solid = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def split(data: np.ndarray, offsets: np.ndarray, most: int, space: np.ndarray = SPACE) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, bool]]:
    """The texts in parts of about ``most`` bytes: bytes, offsets, first and last text number, and whether the part ends its last text.

    A part is a run of whole texts, or a piece of one longer text that ends after white space.
    """
    for i, j in segments(offsets, most):
        part = data[offsets[i] : offsets[j]]
        if j - i > 1 or len(part) <= most:
            yield part, offsets[i : j + 1] - offsets[i], i, j, True
        else:
            for a, b in spaced(part, most, space):
                yield part[a:b], np.array([0, b - a]), i, j, b == len(part)


def segments(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of whole texts with at most ``most`` bytes, or one longer text alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: The one large object that a worker keeps from task to task, by name.
_resident: dict[str, object] = {}


def resident(name: str, make: Callable[[], object]) -> object:
    """The worker's object of that name, made if it isn't there; it takes the place of any other."""
    if name not in _resident:
        _resident.clear()
        _resident[name] = make()
    return _resident[name]


def lean(batches: Iterator[pa.RecordBatch], keep: bool = False) -> Iterator[pa.RecordBatch]:
    """The same batches; memory that Arrow no longer needs goes back before each, and what another operator kept at once."""
    if not keep:
        _resident.clear()
    for batch in batches:
        pa.default_memory_pool().release_unused()
        yield batch
    pa.default_memory_pool().release_unused()


def parts(batch: pa.RecordBatch, column: int, most: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """``batch`` in slices of about ``most`` bytes of text, with the bytes and offsets of each, so scratch arrays stay small."""
    data, offsets = flat(batch.column(column))
    for i, j in segments(offsets, most):
        yield batch.slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def gathered(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The bytes of some words in order, with a blank after each."""
    size = end - start + 1
    to = np.append(0, np.cumsum(size))
    out = np.empty(int(to[-1]), np.uint8)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(to, to[i] + BLOCK, "right")) - 1)
        if j == i + 1:
            out[to[i] : to[j] - 1] = data[start[i] : end[i]]
        else:
            at = np.repeat(start[i:j] - (to[i:j] - to[i]), size[i:j]) + np.arange(to[j] - to[i])
            out[to[i] : to[j]] = data[np.minimum(at, len(data) - 1)]
        i = j
    out[to[1:] - 1] = 32
    return out


def joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, owner: np.ndarray, n: int) -> pa.Array:
    """The texts made of some words of each of ``n``, in order, with one blank between them."""
    out = gathered(data, start, end)
    ends = np.append(0, np.cumsum(end - start + 1))[np.searchsorted(owner, np.arange(n), "right")]
    begins = np.append(0, ends[:-1])
    # The blank after a text's last word is left out.
    keep = np.ones(len(out), bool)
    keep[ends[ends > begins] - 1] = False
    offsets = np.append(0, np.cumsum(np.maximum(ends - begins - 1, 0)))
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out[keep].tobytes()))


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The sum of the values of each of ``n`` owners."""
    return np.bincount(owner, values, n)
