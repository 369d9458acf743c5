"""Vectorised words of UTF-8 text.

A word is a maximal run of digits, ASCII letters (taken in lower case) and
characters beyond ASCII, that is ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after
lower-casing A-Z.  Because all other separators are ASCII, words can be found
on the bytes of an Arrow string column without decoding it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True
IS_WORD_ANY_CASE = IS_WORD.copy()
IS_WORD_ANY_CASE[65:91] = True

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=np.uint64)  # of _BASE


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << int(n - 1).bit_length()
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


@dataclass
class Words:
    """Words of consecutive documents ``first`` .. ``first + n_docs - 1``."""

    first: int
    n_docs: int
    data: np.ndarray  # bytes of these documents
    base: np.ndarray  # where each document's bytes start in data; n_docs + 1
    start: np.ndarray  # of each word in data
    end: np.ndarray
    hash: np.ndarray  # uint64 of the lower-cased word
    bounds: np.ndarray  # n_docs + 1: document d has words bounds[d] .. bounds[d + 1]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), np.diff(self.bounds))

    def word(self, i: int) -> bytes:
        return LOWER[self.data[self.start[i] : self.end[i]]].tobytes()


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def doc_ranges(offsets: np.ndarray, max_docs: int, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``chunk_bytes``; a longer document is a range of its own."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + chunk_bytes, side="right")) - 1
        b = min(max(b, a + 1), n, a + max_docs)
        yield a, b
        a = b


def words_of(column: pa.Array | pa.ChunkedArray, max_docs: int = 4096) -> Iterator[Words]:
    """The words of a string column, by ranges of documents."""
    data, offsets = utf8(column)
    for a, b in doc_ranges(offsets, max_docs):
        part = data[offsets[a] : offsets[b]]
        base = offsets[a : b + 1] - offsets[a]
        yield find_words(part, base, a)


def run_hashes(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of consecutive runs of bytes, none of them empty."""
    first_of = np.cumsum(length) - length
    within = np.arange(len(data)) - np.repeat(first_of, length)
    value = (data.astype(np.uint64) + np.uint64(1)) * _power_table(int(length.max()))[within]
    return mix(np.add.reduceat(value, first_of) + length.astype(np.uint64))


def find_words(part: np.ndarray, base: np.ndarray, first: int = 0) -> Words:
    inside = IS_WORD_ANY_CASE[part]
    n = len(part)
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[base[:-1][base[:-1] < n]] = False  # a document's first byte starts a word
        start = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        after[-1] = False
        after[:-1] = inside[1:]
        cuts = base[1:] - 1
        after[cuts[cuts >= 0]] = False
        end = np.flatnonzero(inside & ~after) + 1
    else:
        start = end = np.zeros(0, np.int64)
    h = run_hashes(LOWER[part[inside]], end - start) if len(start) else np.zeros(0, np.uint64)
    return Words(first, len(base) - 1, part, base, start, end, h, np.searchsorted(start, base))


_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
SHINGLE_BITS = 52


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Document and 52-bit hash of every run of k words.

    A document of fewer words, but not none, is one shingle.
    """
    n, h = np.diff(words.bounds), words.hash
    doc = words.doc_of_word()
    m = len(h)
    value = np.zeros(max(0, m - k + 1), np.uint64)
    for j in range(k):
        value += h[j : m - k + 1 + j] * _STEP[j] if m >= k else np.zeros(0, np.uint64)
    whole = doc[: m - k + 1] == doc[k - 1 :] if m >= k else np.zeros(0, bool)
    docs, values = doc[: len(value)][whole], mix(value[whole])
    if len(short := np.flatnonzero((n > 0) & (n < k))):
        more = [sum(int(h[words.bounds[d] + j]) * int(_STEP[j]) for j in range(n[d])) + int(n[d]) for d in short]
        docs = np.concatenate((docs, short))
        values = np.concatenate((values, mix(np.array([x & (2**64 - 1) for x in more], dtype=np.uint64))))
    return docs, values >> np.uint64(64 - SHINGLE_BITS)


def shingle_counts(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and its count there, by document; up to 4096 documents."""
    docs, values = shingles(words, k)
    keys = np.sort((docs.astype(np.uint64) << np.uint64(SHINGLE_BITS)) | values)
    if not len(keys):
        return keys.astype(np.int64), keys, keys.astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    counts = np.diff(np.concatenate((first, [len(keys)])))
    keys = keys[first]
    return (keys >> np.uint64(SHINGLE_BITS)).astype(np.int64), keys & np.uint64((1 << SHINGLE_BITS) - 1), counts
