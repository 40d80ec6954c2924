"""Words of many texts at once, as 64-bit hashes in numpy; used inside tasks.

A word is a maximal run of bytes of a byte class. Both classes below treat every
byte of a multi-byte UTF-8 character as a word byte, so byte runs are character
runs. Hash equality stands for word equality: two different words share a hash
with a probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 18  # bytes hashed at a time, so that temporaries stay in cache
BLOCK = 4 << 20  # bytes of text worked on at a time

_U = np.uint64
_ODD = 0x9E3779B97F4A7C15
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20_240_517).integers(1, 1 << 63, 256, dtype=np.uint64)

#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, a-z, all non-ASCII.
ALNUM = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
#: ``[^\x20\x09-\x0D]+``: everything but ASCII white space.
BLACK = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= PIECE + 1:
        n = PIECE + 1
        if n not in _POWERS:
            _POWERS[n] = (_powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n))
        return _POWERS[n]
    return _powers(_ODD, n), _powers(pow(_ODD, -1, 1 << 64), n)


def _hash_piece(raw: np.ndarray, breaks: np.ndarray, word_byte: np.ndarray,
                lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words of a byte array; ``breaks`` end words, too."""
    data = _LOWER[raw] if lower else raw
    inside = word_byte[data]
    before = np.empty(len(inside), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    cut = np.zeros(len(inside) + 1, dtype=bool)
    cut[breaks] = True
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(inside), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    power, inverse = power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[:len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), \
        starts


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, data = column.buffers()
    if len(column) == 0 or where is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, dtype=np.int64 if wide else np.int32)[
        column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, texts: int | pa.Array,
           most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose texts (a column or an array) have about ``most`` bytes.

    A batch may hold 64 MB of text; hashing needs several times a text's size. A
    longer text is a block of its own.
    """
    column = batch.column(texts) if isinstance(texts, int) else texts
    sizes = np.diff(text_bytes(column)[1])
    ends, begin = np.cumsum(sizes), 0
    while begin < len(sizes):
        done = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def split_words(raw: np.ndarray, offsets: np.ndarray, word_byte: np.ndarray,
                lower: bool = True, places: bool = False):
    """Word hashes of texts that lie one after another in ``raw``.

    Returns (hashes, first): text ``i`` has the words ``first[i]:first[i + 1]``;
    with ``places`` also the byte at which each word starts. Memory beyond the
    result is bounded by PIECE, or by a single word where one is longer.
    """
    found, at = [], []
    begin, size = 0, len(raw)
    while begin < size:
        end = min(begin + PIECE, size)
        while end < size:  # end at a byte between words or at the end of a text
            tail = raw[max(begin, end - 4096):end]
            outside = np.flatnonzero(~word_byte[_LOWER[tail] if lower else tail])
            if len(outside):
                end = end - len(tail) + int(outside[-1]) + 1
                break
            k = np.searchsorted(offsets, end, side="right") - 1
            if offsets[k] > max(begin, end - 4096):
                end = int(offsets[k])
                break
            end = min(end + PIECE, size)
        low, high = np.searchsorted(offsets, begin), np.searchsorted(offsets, end, side="right")
        hashes, starts = _hash_piece(raw[begin:end], offsets[low:high] - begin, word_byte, lower)
        found.append(hashes)
        at.append(starts + begin)
        begin = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    starts = np.concatenate(at) if at else np.zeros(0, np.int64)
    first = np.searchsorted(starts, offsets)
    return (hashes, first, starts) if places else (hashes, first)


def words_of(column, word_byte: np.ndarray, lower: bool = True):
    """(hashes, first) of a string column, as in ``split_words``."""
    return split_words(*text_bytes(column), word_byte, lower)
