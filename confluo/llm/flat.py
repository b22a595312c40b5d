"""Whole-batch text primitives on the raw UTF-8 buffers of Arrow string arrays.

A batch of texts is one ``uint8`` buffer with offsets. Everything here works on slices of such a
buffer with NumPy, so no Python object is made per document or per word. Slices end between
documents, never inside one: a long document is a slice of its own and is read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
MOST_DOCS = 1 << 16

_FOLD = np.full(256, 32, np.uint8)
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)

_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RINV = np.uint64(pow(int(_R), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string array; a null text has length 0."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes."""
    n, i = len(off) - 1, 0
    while i < n:
        j = int(np.searchsorted(off, off[i] + most, "right")) - 1
        j = min(max(j, i + 1), n, i + MOST_DOCS)
        yield i, j
        i = j


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case at the same length; what is neither letter nor digit becomes a space.

    ASCII and the Latin-1 letters are folded; any other byte of a multi-byte character counts as
    part of a word and stays.
    """
    out = _FOLD[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) + 1 if data.size > 1 else np.zeros(0, np.int64)
    if lead.size:
        b = data[lead]
        upper = (b >= 0x80) & (b <= 0x9E) & (b != 0x97)
        out[lead[upper]] = b[upper] + 32
    return out


def words(folded: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of folded bytes, and the document that each is in."""
    is_word = folded != 32
    edge = np.zeros(len(folded) + 1, bool)
    edge[off] = True
    before = np.empty_like(is_word)
    before[:1] = False
    before[1:] = is_word[:-1]
    after = np.empty_like(is_word)
    after[-1:] = False
    after[:-1] = is_word[1:]
    starts = np.flatnonzero(is_word & (~before | edge[:-1]))
    ends = np.flatnonzero(is_word & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        p = np.full(size, base, np.uint64)
        p[0] = 1
        have = np.cumprod(p, dtype=np.uint64)
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = h + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span that doesn't depend on where the span lies."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("r", _R, n)[:n], out=sums[1:])
    raw = (sums[ends] - sums[starts]) * _power("i", _RINV, n)[starts]
    return mix(raw ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))


def hash_word(word: str) -> int:
    """The hash that :func:`span_hashes` gives for this word, folded."""
    data = fold(np.frombuffer(word.encode(), np.uint8))
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between offsets; an empty range has sum 0."""
    sums = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def distinct_per_doc(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (document, hash) pairs in order; of the hash, 44 bits count. A slice has under 2**20 documents."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]
    return (key >> np.uint64(44)).astype(np.int64), key << np.uint64(20)
