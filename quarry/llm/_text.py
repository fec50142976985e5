"""Vectorised views of Arrow string columns: bytes, classes, words and word hashes.

A batch's texts stay one UTF-8 byte buffer; every helper works on numpy slices of it, so no
Python object is made per word.  ``chunks`` cuts a batch into runs of whole texts of about
``limit`` bytes, which bounds the temporary arrays (one longer text makes a chunk by itself).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.default_rng(20240229)
#: one random odd-ish 64-bit value per byte value, and an odd multiplier with its inverse
BYTE_KEY = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_POW: dict[int, np.ndarray] = {}

_ASCII = np.arange(256)
LOWER = _ASCII.astype(np.uint8)
LOWER[65:91] += 32
#: letters and digits of ASCII and every byte of a longer code point
WORD = ((_ASCII >= 48) & (_ASCII <= 57)) | ((_ASCII >= 65) & (_ASCII <= 90)) | \
    ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
SPACE = (_ASCII == 32) | ((_ASCII >= 9) & (_ASCII <= 13))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    key = int(base)
    have = _POW.get(key)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = _POW[key] = np.multiply.accumulate(p)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> np.uint64(33))
        h = h * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def string_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(off, dtype=np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1]
    off = off.astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def chunks(col: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes."""
    data, off = string_buffer(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = int(np.searchsorted(off, off[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j, data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def segment_sum(x: np.ndarray, off: np.ndarray, dtype=np.int64) -> np.ndarray:
    """Sums of ``x`` between consecutive offsets (empty segments give 0)."""
    c = np.zeros(len(x) + 1, dtype=dtype)
    np.cumsum(x, dtype=dtype, out=c[1:])
    return c[off[1:]] - c[off[:-1]]


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """ASCII letters and the Latin-1 capitals (lead byte C3) in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        up = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
        out[1:][up] += 32
    return out


def word_spans(data: np.ndarray, off: np.ndarray, is_word: np.ndarray = WORD):
    """(start, end, first-word offsets per text): maximal runs of word bytes inside each text."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    m = is_word[data]
    begins = m.copy()
    begins[1:] &= ~m[:-1]
    cut = off[1:-1]
    cut = cut[(cut > 0) & (cut < len(m))]
    begins[cut] = m[cut]
    ends = m.copy()
    ends[:-1] &= ~m[1:]
    ends[cut - 1] = m[cut - 1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(start, off)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a random-byte polynomial, for ``span_hash``."""
    pre = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_KEY[data] * _powers(MULT, len(data)), dtype=np.uint64, out=pre[1:])
    return pre


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, pre: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of byte spans (``pre``: their bytes' prefix sums, if at hand)."""
    pre = prefix_hash(data) if pre is None else pre
    with np.errstate(over="ignore"):
        h = (pre[end] - pre[start]) * _powers(MULT_INV, len(data) + 1)[start]
    return mix(h + (end - start).astype(np.uint64))


GRAM_KEY = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive word hashes (len(words) - k + 1 of them)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for j in range(k):
            h += words[j:j + n] * GRAM_KEY[j]
    return mix(h)
