"""Numpy kernels over batches of texts: bytes, words, shingles, rolling hashes.

A batch is one ``uint8`` array with all bytes and ``n + 1`` offsets. All hashes are 64 bits wide
and depend on content only. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: For kernels with several wide arrays per byte or word: a quarter of the memory, and no slower.
SHORT_SLICE_BYTES = 1 << 18
SHINGLE_WORDS = 5

# White space of the word rule [^\x20\x09-\x0D]+ and the lower case of A-Z.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_PLACE = [mix(np.array([k + 1000], np.uint64))[0] | np.uint64(1) for k in range(SHINGLE_WORDS)]
_SHORT = mix(np.arange(SHINGLE_WORDS + 1, dtype=np.uint64) + np.uint64(77))
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        step = SHORT_SLICE_BYTES + 1024
        size = (n // step + 1) * step
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[name] = have
    return have[:n]


def batch_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes and the offsets of a string column, without a copy where Arrow allows it."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if len(column) else pa.array([], pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, off, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes; a longer text is a range of its own."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums from which ``span_hash`` takes the hash of any stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODE[data] * _power("up", _BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches [start, end), the same wherever the stretch stands."""
    down = _power("down", _BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * down[start])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and ``n + 1`` offsets of the texts' words."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word and the texts' word offsets."""
    starts, ends, words = word_spans(data, offsets)
    return span_hash(prefix_hash(lower(data)), starts, ends), words


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all five-word shingles, in order, and the texts' shingle offsets.

    A text of one to four words has one shingle, its whole sequence; one without words has none.
    """
    counts = np.diff(offsets)
    per_text = np.where(counts >= SHINGLE_WORDS, counts - SHINGLE_WORDS + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(per_text)])
    total = np.zeros(len(words), np.uint64)
    for k, place in enumerate(_PLACE):
        total[: len(words) - k] += words[k:] * place
    within = np.arange(out_offsets[-1]) - np.repeat(out_offsets[:-1], per_text)
    first = np.repeat(offsets[:-1], per_text) + within
    out = total[first] if len(first) else np.empty(0, np.uint64)
    for i in np.flatnonzero((counts > 0) & (counts < SHINGLE_WORDS)):
        k = int(counts[i])
        part = words[offsets[i] : offsets[i + 1]] * np.array(_PLACE[:k], np.uint64)
        out[out_offsets[i]] = np.add.reduce([*part, _SHORT[k]])
    return mix(out), out_offsets


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row number, sorted distinct shingle hashes) of every text of a batch."""
    data, offsets = batch_bytes(column)
    for lo, hi in slices(offsets, SHORT_SLICE_BYTES):
        part = data[offsets[lo] : offsets[hi]]
        hashes, ends = shingles(*word_hashes(part, offsets[lo : hi + 1] - offsets[lo]))
        for i in range(hi - lo):
            own = np.sort(hashes[ends[i] : ends[i + 1]])
            yield lo + i, own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
