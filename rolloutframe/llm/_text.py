"""Byte-level text primitives shared by the text operators (numpy over Arrow buffers).

Every function takes whole texts. Memory is bounded by working on slices of about ``SLICE_BYTES``; a single longer
text forms a slice of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
U64 = np.uint64
GOLDEN = U64(0x9E3779B97F4A7C15)
ODD = U64(0x5851F42D4C957F2D)
LONG_RANGE = 256  # bytes

# bytes 0x09-0x0D and 0x20 separate words
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix64(x):
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string or binary Arrow array; a null is an empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not pa.types.is_large_string(array.type) and not pa.types.is_large_binary(array.type):
        array = array.cast(pa.large_string() if pa.types.is_string(array.type) else pa.large_binary())
    if array.null_count:
        array = pc.fill_null(array, "" if pa.types.is_large_string(array.type) else b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if offsets and len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(array, limit: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) of consecutive runs of whole texts."""
    data, offsets = buffers(array)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = IS_SPACE):
    """(starts, ends, document of each word) of the maximal runs of bytes that aren't in ``space``; none crosses texts."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = ~space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range: 8 bytes at a time are mixed in, all ranges together.

    Ranges of at most 8 bytes and one length have different hashes. Ranges of more than LONG_RANGE bytes are hashed by
    BLAKE2, so that a text without breaks takes no step of its own for each 8 bytes.
    """
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix64(size.astype(U64) * GOLDEN + U64(1))
        if not len(starts):
            return out
        raw = np.concatenate([data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(data) + 1,), "<u8", raw.data, strides=(1,))  # the 8 bytes from each place on
        live, at = np.flatnonzero((size > 0) & (size <= LONG_RANGE)), 0
        while len(live):
            left = size[live] - at
            x = eight[starts[live] + at] & (~U64(0) >> (U64(8) * (U64(8) - np.minimum(left, 8).astype(U64))))
            out[live] = mix64(out[live] * ODD ^ x)
            live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG_RANGE).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest()
        out[i] = np.frombuffer(digest, U64)[0]
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, k: int):
    """Distinct k-word shingles of each text, ASCII letters lower-cased: (hashes sorted within each document, offsets).

    A text with 1 to k-1 words has the whole sequence as its one shingle, a text without words has none.
    """
    n = len(offsets) - 1
    starts, ends, doc = spans(data, offsets)
    words = range_hashes(LOWER[data], starts, ends)
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    with np.errstate(over="ignore"):
        h = np.zeros(max(0, len(words) - k + 1), U64)
        for j in range(k):
            h = mix64(h * U64(31) + words[j : j + len(h)] + GOLDEN)
        same = doc[k - 1 :] == doc[: len(h)] if len(h) else np.zeros(0, bool)
        h, d = h[same], doc[: len(same)][same]
        short = np.flatnonzero((count > 0) & (count < k))
        if len(short):
            own = []
            for i in short:
                x = U64(count[i])
                for w in words[first[i] : first[i + 1]]:
                    x = mix64(np.array([x * U64(31) + w + GOLDEN]))[0]
                own.append(x)
            h, d = np.concatenate([h, np.array(own, U64)]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[new], d[new]
    return h, np.concatenate([[0], np.cumsum(np.bincount(d, minlength=n))])
