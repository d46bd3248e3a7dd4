"""Token ids of whole texts by a public tokenizer, with a cache of words.

The tokenizer that is used here drops white space and never merges across it, so a text
is the sequence of its white-space separated words and each distinct word needs encoding
once. Words of visible Latin-1 characters, which its normaliser only lower-cases, are cut
by its own pattern here and the parts go to the BPE model directly; every other word goes
through the whole tokenizer; a text that holds a special token's string is not cut at
all. ``tests/llm`` holds the result against the library's own encoding of whole texts.
"""

from __future__ import annotations

import ctypes
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Entries of each of a worker's two word caches; at about 200 bytes each they stay under 120 MB.
CACHE_WORDS = 300_000
_VISIBLE = regex.compile(r"[\x21-\x7e\xa1-\xff]+")
_PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks and share a machine with others."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in kept:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Encoder(dict):
    """Maps a word (UTF-8, A-Z lowered) to its ids as little-endian bytes."""

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.size = self.whole.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.older: dict[bytes, bytes] = {}
        self.letters = _byte_letters()
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values()]
        self.end = np.array([END_ID], self.dtype).tobytes()

    @property
    def bits(self) -> int:
        return max(1, (self.size - 1).bit_length())

    def _pack(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def _fresh(self, word: bytes) -> bytes:
        text = word.decode()
        if not _VISIBLE.fullmatch(text):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        parts = _PARTS.findall(text.lower())
        if len(parts) > 1:
            return b"".join([self[p.encode()] for p in parts])
        if not word.isascii():
            text = "".join([self.letters[b] for b in parts[0].encode()])
        else:
            text = parts[0]
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._fresh(word)
        if len(self) >= CACHE_WORDS:  # what is used again moves over from the older half
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, raw: bytes | None) -> bytes:
        """Ids of a whole text and the end id, as bytes of ``dtype``."""
        if not raw:
            return self.end
        lowered = raw.lower()
        if any(s in lowered for s in self.special):
            return self._pack(self.whole.encode(raw.decode(), add_special_tokens=False).ids) + self.end
        return b"".join(map(self.__getitem__, lowered.split())) + self.end


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Drop encoders and their caches: for tasks that need none, in workers that packed before."""
    if _encoders:
        _encoders.clear()
        release()


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds many more than ``most`` bytes of a column; memory goes back at the end."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // most
        starts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def raw_texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()
