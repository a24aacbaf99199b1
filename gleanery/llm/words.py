"""Words and word shingles of Arrow string columns, as hashed numpy arrays.

A column's bytes are read in place. Every function takes whole texts; ``slices`` only cuts a
batch between rows, so that the working arrays stay a small multiple of ``SLICE_BYTES`` (or of the
longest single text).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
MAX_ROWS = 1 << 15
SHINGLE_WORDS = 5

_U = np.uint64
_PRIME = _U(0x9E3779B97F4A7C15)
#: one random word per byte value, from a fixed seed: the same on every machine
_BYTES = np.random.Generator(np.random.PCG64(20_211)).integers(1, 1 << 63, 256, dtype=np.uint64)
_PLACES = np.random.Generator(np.random.PCG64(20_212)).integers(1, 1 << 63, 64, dtype=np.uint64) | _U(1)

_CODES = np.arange(256)
#: Bytes that words are made of: ASCII letters and digits and everything beyond ASCII.
ALNUM = ((_CODES >= 48) & (_CODES <= 57)) | ((_CODES >= 65) & (_CODES <= 90)) | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
#: Bytes other than space and the controls 9 to 13.
SOLID = ~((_CODES == 32) | ((_CODES >= 9) & (_CODES <= 13)))
#: Every byte to itself, A-Z to a-z.
LOWER = np.where((_CODES >= 65) & (_CODES <= 90), _CODES + 32, _CODES).astype(np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit words; a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A text column with nulls as empty texts and 64-bit offsets."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text begins (one more entry than texts)."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text and at most ``MAX_ROWS`` rows, one row at least."""
    if not batch.num_rows:
        return
    ends = raw(column(batch, name))[1][1:]
    start = 0
    while start < len(ends):
        base = ends[start - 1] if start else 0
        stop = min(start + MAX_ROWS, max(start + 1, int(np.searchsorted(ends, base + limit, "right"))))
        yield batch.slice(start, stop - start)
        start = stop


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes of a kind inside one text, and each text's first run."""
    inside = kind[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _powers(base: int, size: int) -> np.ndarray:
    powers = np.full(size, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


_INVERSE = pow(int(_PRIME), -1, 1 << 64)
_UP, _DOWN = _powers(int(_PRIME), SLICE_BYTES), _powers(_INVERSE, SLICE_BYTES)


def _hash_some(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes by one running sum: the terms of a span, scaled back by the power at its start."""
    base = starts[0]
    size = int(ends[-1] - base)
    up, down = (_UP, _DOWN) if size <= SLICE_BYTES else (_powers(int(_PRIME), size), _powers(_INVERSE, size))
    sums = np.zeros(size + 1, np.uint64)
    terms = _BYTES[data[base : base + size]]
    terms *= up[:size]
    np.cumsum(terms, out=sums[1:])
    starts, ends = starts - base, ends - base
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes; the spans ascend."""
    found, at = [np.zeros(0, np.uint64)], 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
        found.append(_hash_some(data, starts[at:stop], ends[at:stop]))
        at = stop
    return np.concatenate(found)


def word_hashes(texts: pa.Array, kind: np.ndarray = ALNUM, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the place of each text's first word (one more entry than texts).

    ``lower`` folds A-Z only, so that the bytes keep their places.
    """
    data, offsets = raw(texts)
    starts, ends, first = spans(data, offsets, kind)
    return hashes(LOWER[data] if lower else data, starts, ends), first


def shingle_hashes(words: np.ndarray, first: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside one text; a shorter text has one shingle of all its words."""
    counts = np.diff(first)
    ends = np.repeat(first[1:], counts)
    at = np.arange(len(words))
    keep = at[(at + size <= ends) | ((at == np.repeat(first[:-1], counts)) & (np.repeat(counts, counts) < size))]
    total = np.zeros(len(keep), np.uint64)
    limit = ends[keep]
    for j in range(size):
        there = keep + j < limit
        total[there] += words[keep[there] + j] * _PLACES[j]
    made = np.where(counts > 0, np.maximum(counts - size + 1, 1), 0)
    return mix(total), np.concatenate([[0], np.cumsum(made)])


def multisets(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, their counts, and each text's first entry.

    A value is the upper 48 bits of its hash; a slice has fewer than ``MAX_ROWS`` texts, whose number fits
    into the rest of a word, so that one sort of plain words does it.
    """
    texts = len(first) - 1
    if texts > MAX_ROWS:
        raise ValueError("too many texts in one slice")
    keys = np.repeat(np.arange(texts, dtype=np.uint64) << _U(48), np.diff(first)) | (values >> _U(16))
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return keys & _U((1 << 48) - 1), counts, np.searchsorted(keys, np.arange(texts + 1, dtype=np.uint64) << _U(48))
