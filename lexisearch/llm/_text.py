"""Vectorised word hashing over Arrow string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text; a Han or kana character is a word by itself. Everything else
separates, as does the punctuation of Latin-1, of the general block, and of the
Chinese, Japanese and full-width blocks. Work is done on the Arrow
buffers themselves, a few MB at a time, with no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 2 << 20
PIECE_ROWS = 1 << 15
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in (("0", "9"), ("a", "z"), ("A", "Z")):
    _WORD[ord(_a) : ord(_b) + 1] = True
_LONG = 4096
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_K1, _K2, _K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; works on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= _K2
    x ^= x >> np.uint64(27)
    x *= _K3
    x ^= x >> np.uint64(31)
    return x


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and each text's place; null is empty."""
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    n = len(arr)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, kind)[arr.offset : arr.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch that hold about ``most`` bytes of the column, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size)
    at, base = 0, 0
    while at < batch.num_rows:
        to = min(at + PIECE_ROWS, max(at + 1, int(np.searchsorted(ends, base + most, "right"))))
        yield batch.slice(at, to - at)
        at, base = to, int(ends[to - 1])


def _hash(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges, eight bytes a step."""
    if not len(start):
        return np.empty(0, np.uint64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h = mix(size.astype(np.uint64) * _K1 ^ (eight[start] & _MASK[np.minimum(size, 8)]))
    act, step = np.flatnonzero((size > 8) & (size <= _LONG)), 8
    while len(act):
        left = size[act] - step
        h[act] = mix(h[act] * _K1 ^ (eight[start[act] + step] & _MASK[np.minimum(left, 8)]))
        step += 8
        act = act[left > 8]
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh64_intdigest(data[start[i] : start[i] + size[i]].tobytes())
    return h


def _wide(data: np.ndarray, w: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Unmarks the bytes of punctuation that is not ASCII in ``w``; (places, bytes each) of characters that are words by themselves."""
    i = np.flatnonzero(data == 0xC2)
    last = len(data) - 1
    i = i[~np.isin(data[np.minimum(i + 1, last)], (0xAA, 0xB5, 0xBA))]
    w[i] = w[np.minimum(i + 1, last)] = False
    i = np.flatnonzero(data >= 0xE2)
    if not len(i):
        return []
    lead, a, b = data[i], data[np.minimum(i + 1, last)], data[np.minimum(i + 2, last)]
    marks = (lead == 0xE2) & (a <= 0x81) | (lead == 0xE3) & (a == 0x80) & (b != 0x85) & (b != 0x87)
    marks |= (lead == 0xEF) & ((a == 0xB8) & (b >= 0xB0) | (a == 0xB9) & (b <= 0xAF) | (a == 0xBC) & ((b <= 0x8F) | (b >= 0x9A) & (b <= 0xA0) | (b >= 0xBB)) | (a == 0xBD) & ((b == 0x80) | (b >= 0x9B) & (b <= 0xA5)))
    for k in range(3):
        w[np.minimum(i[marks] + k, last)] = False
    three = (lead >= 0xE4) & (lead <= 0xE9) | (lead == 0xE3) & ((a == 0x80) & ~marks | (a >= 0x81) & (a <= 0x83) | (a >= 0x90)) | (lead == 0xEF) & (a >= 0xA4) & (a <= 0xAB)
    four = (lead == 0xF0) & (a >= 0xA0) & (a <= 0xB3)
    return [(i[three & (i + 2 <= last)], 3), (i[four & (i + 3 <= last)], 4)]


def words(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, index of each text's first word plus the total)."""
    h, first, _, _ = word_spans(pc.utf8_lower(arr))
    return h, first


def word_spans(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Like :func:`words` without lower-casing, with the words' byte starts and lengths."""
    data, off = flat(arr)
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    w = _WORD[data]
    alone = _wide(data, w)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begin = w.copy()
    begin[1:] &= ~w[:-1] | edge[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | edge[1:n]
    for i, size in alone:
        begin[i] = end[i + size - 1] = True
        end[i[i > 0] - 1] |= w[i[i > 0] - 1]
        after = (i + size)[i + size < n]
        begin[after] |= w[after]
    start = np.flatnonzero(begin)
    size = np.flatnonzero(end) + 1 - start
    return _hash(data, start, size), np.searchsorted(start, off), start, size
