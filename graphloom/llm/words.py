"""Words of whole texts as numpy arrays.

Texts are split by Arrow on ASCII white space; each distinct word of a batch is hashed
once (64-bit xxHash, so tasks agree on it) and n-grams are combined from word hashes
by vector operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


@dataclass
class Words:
    """Words of consecutive texts: text k has words offsets[k] to offsets[k + 1]."""

    offsets: np.ndarray
    ids: np.ndarray  # into names, vocabulary and hashes
    names: pa.Array  # the distinct words

    @cached_property
    def vocabulary(self) -> list[bytes]:
        return self.names.cast(pa.large_binary()).to_pylist()

    @cached_property
    def hashes(self) -> np.ndarray:
        """Of the vocabulary."""
        return np.fromiter(map(xxhash.xxh3_64_intdigest, self.vocabulary), np.uint64, len(self.names))

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    def token_hashes(self) -> np.ndarray:
        return self.hashes[self.ids] if len(self.ids) else np.zeros(0, np.uint64)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.lengths)


def split(texts, lower: bool = False) -> Words:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = texts.take(pa.array(np.arange(len(texts))))  # ascii_lower reads offsets that don't start at 0 wrongly
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    blank = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if blank >= 0:  # from white space at the ends of a text
        full = ids != blank
        before = np.concatenate([[0], np.cumsum(full)])
        ids, offsets = ids[full], before[offsets]
    return Words(offsets, ids, coded.dictionary)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = np.uint64(0x9E3779B97F4A7C15)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position; positions may run over text limits."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:m].copy()
    for k in range(1, n):
        out *= _BASE
        out += hashes[k : k + m]
    return mix(out)


def inside(words: Words, n: int) -> np.ndarray:
    """Which positions of ngrams() stay within one text."""
    m = len(words.ids) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ends = np.repeat(words.offsets[1:], words.lengths)
    return ends[:m] - np.arange(m) >= n


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte over all of them, without bytes that are always 0."""
    if not len(values):
        return b"\0"
    raw = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)
    used = max(1, -(-int(values.max()).bit_length() // 8))
    return bytes([used]) + np.ascontiguousarray(raw[:, :used].T).tobytes()


def from_planes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, : data[0]] = np.frombuffer(data, np.uint8, data[0] * n, 1).reshape(data[0], n).T
    return out.view("<u8").ravel()


def sorted_planes(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers, as planes of their differences."""
    return planes(np.diff(values, prepend=np.uint64(0)))


def from_sorted_planes(data: bytes, n: int) -> np.ndarray:
    return np.cumsum(from_planes(data, n), dtype=np.uint64)


def bucket_limits(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal ranges of the hash space begins in ascending hashes."""
    edges = np.array([(k << 64) // n for k in range(n)], np.uint64)
    return np.concatenate([np.searchsorted(hashes, edges), [len(hashes)]])


def parts(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each."""
    sizes = pc.fill_null(pc.binary_length(texts), 0)
    if isinstance(sizes, pa.ChunkedArray):
        sizes = sizes.combine_chunks()
    group = np.cumsum(sizes.to_numpy(zero_copy_only=False), dtype=np.int64) // most
    starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in zip(starts, starts[1:], strict=False):
        if b > a:
            yield a, b
