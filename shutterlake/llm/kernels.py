"""Vectorised hashing of words over Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_U64 = 1 << 64


def _powers(base: int) -> np.ndarray:
    out = np.full(_SLICE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_POW = _powers(_BASE)
_INV = _powers(pow(_BASE, -1, _U64))
_BYTE = np.random.default_rng(20240601).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes that end a word: space, and tab to carriage return.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Letters: of ASCII, and every byte of a longer character.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column one after another, and where each row begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def groups(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes together (a longer row is a run of its own)."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes that doesn't cross a row's end."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    inside = word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


#: Spans of more bytes are hashed one by one by the library.
_LONG = 512
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes, which depends on nothing else: eight bytes at a time are mixed in."""
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) + np.uint64(_BASE))
    if not len(out):
        return out
    low, high = int(starts.min()), int(ends.max())
    eights = np.ndarray(high - low + 1, "<u8", data[low:high].tobytes() + bytes(8), strides=(1,))
    at, left, live = starts - low, size, None
    for _ in range(0, min(int(size.max()), _LONG), 8):
        piece = eights[at] & _FIRST[np.minimum(left, 8)]
        if live is None:
            out = mix(out ^ piece)
        else:
            out[live] = mix(out[live] ^ piece)
        more = np.flatnonzero(left > 8)
        if not len(more):
            break
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), _BASE)
    return out


def words(data: np.ndarray, offsets: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and where each row's words begin and end among them."""
    starts, ends = spans(data, offsets, word)
    return hash_spans(data, starts, ends), np.searchsorted(starts, offsets)


_STEP = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x2127599BF4325C37], np.uint64)


def combined(hashes: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at the given distances from each word, as far as they all exist."""
    n = len(hashes) - max(gaps)
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, np.uint64(len(gaps)), np.uint64)
    for k, gap in enumerate(gaps):
        total += hashes[gap : gap + n] * _STEP[k % 8] if k < 8 else mix(hashes[gap : gap + n] + np.uint64(k))
    return mix(total)
