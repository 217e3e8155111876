"""Word shingles of whole texts as sorted 64-bit hashes, worked out over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd constants that weigh a shingle's words and mix hashes.
_WEIGHTS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text taken at once.
SLICE = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher: each bit of the input sways each bit of the result."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> _U(32))
        x = x * _U(0xD6E8FEB86659FD93)
        x = x ^ (x >> _U(32))
        x = x * _U(0xA0761D6478BD642F)
        return x ^ (x >> _U(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, of texts laid end to end; and each word's text."""
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    begins = np.concatenate([[True], ~inside[:-1]])
    ends = np.concatenate([~inside[1:], [True]])
    full = np.flatnonzero(np.diff(offsets))
    begins[offsets[full]] = True
    ends[offsets[full + 1] - 1] = True
    start = np.flatnonzero(inside & begins)
    length = np.flatnonzero(inside & ends) + 1 - start
    padded = np.concatenate([_LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data),), "<u8", padded.data, strides=(1,))
    with np.errstate(over="ignore"):
        h = length.astype(_U) * _WEIGHTS[0]
        live, at, left = np.arange(len(start)), start, length
        while len(live):
            v = eight[at]
            short = left < 8
            v[short] &= (_U(1) << (left[short].astype(_U) * _U(8))) - _U(1)
            h[live] = mix(h[live] ^ (v * _WEIGHTS[1]))
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    return h, np.searchsorted(offsets, start, "right") - 1


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles of `size` words.

    A text with fewer words has one shingle, all its words; null and empty texts have none.
    """
    texts = texts.fill_null("") if texts.null_count else texts
    wide = "<i8" if pa.types.is_large_string(texts.type) else "<i4"
    _, places, raw = texts.buffers()
    offsets = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
        some = offsets[k : stop + 1] - offsets[k]
        h, owner = word_hashes(data[offsets[k] : offsets[stop]], some)
        first = np.searchsorted(owner, np.arange(stop - k + 1))
        with np.errstate(over="ignore"):
            n = len(h) - size + 1
            whole = mix(sum(h[j : j + n] * _WEIGHTS[j % 5] for j in range(size))) if n > 0 else h[:0]
            for d in range(stop - k):
                a, b = int(first[d]), int(first[d + 1])
                if b - a >= size:
                    s = np.sort(whole[a : b - size + 1])
                    yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
                elif b > a:
                    yield mix(np.array([(h[a:b] * _WEIGHTS[: b - a]).sum(dtype=_U) + _U(b - a)]))
                else:
                    yield h[:0]
        k = stop


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
