"""Array helpers for the tasks: texts of an Arrow batch as one byte array, words, rolling hashes.

Everything here works on one bounded slice of a batch (``slices``), never on a whole
table; the distribution of the work is Spark's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

# fixed values: bytes that are not part of a word, by the two word definitions in use
BLANKS = bytes([0x20, *range(0x09, 0x0E)])
NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

SLICE_BYTES = 2 << 20
BLOCK = 1 << 15    # values hashed at a time: few enough to stay in the cache of a core
NO_ID = np.iinfo(np.int64).max  # a null doc_id counts as larger than every id

# odd multipliers of the polynomial hashes, modulo 2^64
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xC2B2AE3D27D4EB4F


def table(outside: bytes) -> np.ndarray:
    """True for every byte that belongs to a word."""

    inside = np.ones(256, bool)
    inside[np.frombuffer(outside, np.uint8)] = False
    return inside


WORD = table(BLANKS)
ALNUM = table(NOT_ALNUM)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * BLOCK + 1)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)     # masks of the first k bytes
_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_BASE), _Powers(_WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64."""

    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _prefix(values: np.ndarray, powers: _Powers) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers.get(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * up[:-1], out=out[1:])
    return out, down


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: bool = False) -> np.ndarray:
    """64-bit hash of each values[start:end], starts ascending; ``words`` picks the base used for word hashes."""

    if len(values) > 2 * BLOCK:
        # a hash does not depend on where its range lies: block by block, in bounded memory
        out, k = np.empty(len(starts), np.uint64), 0
        while k < len(starts):
            base = int(starts[k])
            stop = max(int(np.searchsorted(starts, base + BLOCK)), k + 1)
            top = int(ends[k:stop].max())
            if top - base > 2 * BLOCK:      # a range longer than a block is hashed alone
                stop, top = k + 1, int(ends[k])
            out[k:stop] = _range_hashes(values[base:top], starts[k:stop] - base, ends[k:stop] - base, words)
            k = stop
        return out
    return _range_hashes(values, starts, ends, words)


def _range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: bool) -> np.ndarray:
    prefix, down = _prefix(values, _WORD_POWERS if words else _BYTE_POWERS)
    lengths = (ends - starts).astype(np.uint64)
    return mix((prefix[ends] - prefix[starts]) * down[starts] + lengths * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word data[start:end].

    Up to 16 bytes are mixed as two numbers, longer words go through XXH3: unlike a polynomial
    modulo 2^64, neither has word families that always collide."""

    size = ends - starts
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    eight = np.ndarray((len(data) + 9,), "<u8", buffer=padded, strides=(1,))     # the 8 bytes from each place on
    low = eight[starts] & _KEEP[np.minimum(size, 8)]
    high = eight[starts + 8] & _KEEP[np.clip(size - 8, 0, 8)]
    out = mix(mix(low ^ mix(size.astype(np.uint64) * np.uint64(_BYTE_BASE))) + high * np.uint64(_WORD_BASE))
    view = memoryview(padded)
    for k in np.flatnonzero(size > 16):
        out[k] = xxhash.xxh3_64_intdigest(view[starts[k]:ends[k]])
    return out


def window_hashes(values: np.ndarray, size: int, words: bool = False) -> np.ndarray:
    """Hash of every run of ``size`` values, by start."""

    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if n > 2 * BLOCK:
        return np.concatenate([window_hashes(values[a:a + BLOCK + size - 1], size, words) for a in range(0, n, BLOCK)])
    prefix, down = _prefix(values, _WORD_POWERS if words else _BYTE_POWERS)
    return mix((prefix[size:] - prefix[:n]) * down[:n])


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets; null is empty."""

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def ids(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(column.cast(pa.int64()), NO_ID))


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes each; a longer row is alone."""

    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes, and the n + 1 word offsets of the rows."""

    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    flag = inside[data]
    before = np.empty_like(flag)
    before[0], before[1:] = False, flag[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(flag & ~before)
    after = np.empty_like(flag)
    after[-1], after[:-1] = False, flag[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def inside_rows(row_offsets: np.ndarray, size: int, n: int) -> np.ndarray:
    """For each start 0..n-1 whether a run of ``size`` values stays within its row."""

    room = np.zeros(n, np.int64)
    lengths = np.diff(row_offsets)
    room = np.repeat(row_offsets[1:], lengths) - np.arange(n)
    return room >= size


def hashes_at(values: np.ndarray) -> Callable[[np.ndarray, int], np.ndarray]:
    """A function for the ``window_hashes`` at some starts only, of any size."""

    prefix, down = _prefix(values, _BYTE_POWERS)
    return lambda at, size: mix((prefix[at + size] - prefix[at]) * down[at])


def minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` consecutive hashes the index of its smallest (the leftmost of equals).

    The choice depends on the values inside the run alone, so equal runs choose the same offset.
    Works on ``BLOCK`` positions at a time: the low 20 bits of a key hold the position.
    """

    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    bits, out, step = 20, np.empty(n, np.int64), BLOCK + width
    for base in range(0, n, step):
        part = hashes[base:base + step + width - 1]
        key = (part >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            key = np.minimum(key[:-have], key[have:])
            have *= 2
        if have < width:
            key = np.minimum(key[:len(key) - (width - have)], key[width - have:])
        out[base:base + len(key)] = (key & np.uint64((1 << bits) - 1)).astype(np.int64) + base
    return out


def spread(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """True for each of n places covered by a range start..end."""

    change = np.zeros(n + 1, np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:-1]) > 0


def covered(flags: np.ndarray, size: int, n: int) -> np.ndarray:
    """True for each of n places within a run of ``size`` that starts at a flagged place."""

    count = np.zeros(n + 1, np.int32)
    np.cumsum(flags[:n] if len(flags) >= n else np.concatenate([flags, np.zeros(n - len(flags), bool)]), out=count[1:])
    low = np.maximum(np.arange(n) - size + 1, 0)
    return count[1:] - count[low] > 0
