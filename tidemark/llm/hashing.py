"""Words of UTF-8 buffers and their 64-bit hashes, in numpy.

A word's bytes go, eight at a time, through a keyed bijective mix; long words go to xxh3. Neither is a polynomial, so
no repeated pattern of letters makes different words alike. Hashes of word sequences of one length are put together
from those of halves. Each function takes a key; hashes under different keys tell nothing of each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
#: Keys of two independent hashes: one to bring things together, one to check that they are equal.
FIRST, SECOND = U(0x8BB84B93962EACC9), U(0x2D358DCCAA6C78A5)
#: Word ends are the bytes of white space: space and U+0009 to U+000D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: Bytes of text that are hashed at once, where single texts are no longer.
BLOCK = 1 << 18
#: Longer words, in bytes, are hashed one by one.
LONG = 256
#: By number: so many bytes of eight.
LEADING = np.array([(1 << 8 * k) - 1 for k in range(9)], U)


def mix(x: np.ndarray) -> np.ndarray:
    """The final steps of splitmix64."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin and end in the buffer, which begins a text and whose texts are parted by white space."""
    white = SPACE[buffer]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], white, [True]]).view(np.int8)))
    return edge[::2], edge[1::2]


def word_hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.uint64 = FIRST) -> np.ndarray:
    size = end - start
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(buffer) + 1, "<u8", padded.data, strides=(1,))  # from each byte on
    h = mix(size.astype(U) * STEP + key)
    live, at = np.flatnonzero(size <= LONG), 0
    while len(live):
        left = size[live] - at
        h[live] = mix(h[live] ^ (eight[start[live] + at] & LEADING[np.minimum(left, 8)]) * BASE)
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(size > LONG):
        h[i] = xxhash.xxh3_64_intdigest(buffer[start[i] : end[i]].tobytes(), int(key))
    return h


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two after each other."""
    return mix(a * STEP + (b ^ BASE))


def rolling(hashes: np.ndarray, width: int, key: np.uint64 = FIRST) -> np.ndarray:
    """The hash of each run of ``width`` hashes, by its first; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out, done, part, size = None, 0, mix(hashes + key), 1
    while True:
        if width & size:
            piece = part[done : done + n]
            out = piece if out is None else pair(out, piece)
            done += size
        if 2 * size > width:
            return out
        part, size = pair(part[:-size], part[size:]), 2 * size


def sums(hashes: np.ndarray, begin: np.ndarray, key: np.uint64 = FIRST) -> np.ndarray:
    """The hash of each sequence of hashes, all of them laid end to end, from where each begins."""
    if not len(begin):
        return np.zeros(0, U)
    n = np.diff(np.append(begin, len(hashes)))
    place = np.arange(len(hashes)) - np.repeat(begin, n)
    return mix(np.add.reduceat(mix(hashes + place.astype(U) * STEP + key), begin) + n.astype(U) * BASE)


def blocks(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, buffer, where each row begins in it) of a string column; each text is followed
    by a space. A block holds texts of BLOCK bytes together, or a single longer one."""
    column = column.cast(pa.large_string()).fill_null("")
    offset = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offset, offset[row] + BLOCK, "right")) - 1)
        size = np.diff(offset[row : last + 1])
        at = np.concatenate([[0], np.cumsum(size + 1)])
        out = np.full(at[-1], 0x20, np.uint8)
        keep = np.ones(at[-1], bool)
        keep[at[1:] - 1] = False
        out[keep] = data[offset[row] : offset[last]]
        yield row, last, LOWER[out] if lower else out, at
        row = last


def by_row(at: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each row of a block, its first word; one more entry for the end."""
    return np.searchsorted(start, at, "left")
