"""Substring dedup by the factors of a relative Lempel-Ziv parse.

The parse is not run symbol by symbol: factors are read off membership of whole windows, as
below, for the reference is far larger than a task and only hashes of its windows travel.

The reference of a document is every document with a smaller doc_id, held as blocks
(chunks of documents). Each block is indexed by the hashes of its ``min_words``-word
windows with the smallest doc_id that has each; the index is merged range by range of
the hash space. A document is parsed greedily from left to right: where the window at a
position is in the reference, the factor starts there and is extended word by word while
the next window is in it too, otherwise a literal word is taken. A factor may pass from
one source to another; each such change is a factor boundary and the windows over it
were looked up like all others, so none that occurs in a third document is missed.
Factors have at least ``min_words`` words by construction and are the duplicate spans.

Distribution: texts are shuffled once, by chunk (the second use reuses that exchange).
A chunk sends each distinct window once, with its smallest doc_id, to the window's
bucket, so a window that a third of the documents share arrives once a chunk; the
answer is one bit a window. Window hashes have 64 bits and are not compared word by
word again: the chance that any two of n windows collide is n^2 / 2^65.

Edge cases: null or empty texts have no words and keep none; texts shorter than
``min_words`` words lose nothing; repeated rows (equal doc_id) never remove each other's
words; a null doc_id counts as larger than all others; an empty table gives an empty
result; extra columns, whatever their names, are carried by :func:`cleaned` only.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm import words as W
from graphloom.llm.store import chunk_count, text_bytes

MIN_WORDS = 13
CHUNK_BYTES = 8 << 20
#: Text whose words are held at once.
PART_BYTES = 1 << 20
_LAST = np.iinfo(np.int64).max
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_REQUEST = "bucket int, chunk int, n long, base long, hashes binary, docs binary"


class _Chunk:
    """The windows of one chunk, its documents in ascending order of doc_id.

    Texts are hashed in parts of ``PART_BYTES``: of the words only their number stays.
    """

    def __init__(self, table: pa.Table, min_words: int):
        ids = table.column("doc_id").fill_null(_LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.table = table.take(pa.array(order))
        self.doc_ids, rank = np.unique(ids[order].astype(np.int64), return_inverse=True)
        texts = self.table.column("text").combine_chunks()
        lengths, grams = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for a, b in W.parts(texts, PART_BYTES):
            words = W.split(texts.slice(a, b - a))
            grams.append(W.ngrams(words.token_hashes(), min_words)[W.inside(words, min_words)])
            lengths.append(words.lengths)
        self.min_words, self.lengths = min_words, np.concatenate(lengths)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.windows = np.maximum(self.lengths - min_words + 1, 0)
        self.rank = np.repeat(rank.astype(np.int32), self.windows)  # of each window's doc_id
        hashes = np.concatenate(grams)
        del grams
        self.order = np.argsort(hashes, kind="stable").astype(np.int32)
        hashes = hashes[self.order]
        self.new = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
        self.unique = hashes[self.new]
        self.first = self.rank[self.order[self.new]]  # the smallest rank with each

    def least(self, lo: int, hi: int) -> np.ndarray:
        """The smallest doc_id that has each of the unique windows from ``lo`` to ``hi`` - 1."""
        return self.doc_ids[self.first[lo:hi]]

    def covered(self, known: np.ndarray) -> np.ndarray:
        """Which words lie in a window that a smaller doc_id has: here, or elsewhere (``known``, of the unique windows)."""
        group = np.cumsum(self.new, dtype=np.int32) - 1
        earlier = np.zeros(len(self.order), bool)
        earlier[self.order] = known[group] | (self.first[group] < self.rank[self.order])
        at, ends = np.flatnonzero(earlier), np.cumsum(self.windows)
        of = np.searchsorted(ends, at, side="right")
        at += (self.offsets[:-1] - ends + self.windows)[of]
        edge = np.zeros(int(self.offsets[-1]) + 1, np.int8)
        edge[at] += 1
        edge[at + self.min_words] -= 1
        return np.cumsum(edge[:-1], dtype=np.int32) > 0


def _requests(chunked: DataFrame, min_words: int, n: int) -> DataFrame:
    def emit(table: pa.Table) -> pa.Table:
        c = _Chunk(table, min_words)
        chunk = table.column("chunk")[0].as_py()
        limits, rows = W.bucket_limits(c.unique, n), []
        for b in range(n):
            lo, hi = int(limits[b]), int(limits[b + 1])
            if hi > lo:
                least = c.least(lo, hi)
                base = int(least.min())
                offset = least.astype(np.uint64) - np.uint64(base % (1 << 64))
                rows.append((b, chunk, hi - lo, base, W.sorted_planes(c.unique[lo:hi]), W.planes(offset)))
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        del c
        tokens.release()
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["bucket", "chunk", "n", "base", "hashes", "docs"])

    return chunked.groupBy("chunk").applyInArrow(emit, _REQUEST)


def _answers(requests: DataFrame, n: int) -> DataFrame:
    def reduce(table: pa.Table) -> pa.Table:
        sizes = table.column("n").to_numpy()
        ends = np.cumsum(sizes)
        hashes, docs = np.empty(ends[-1], np.uint64), np.empty(ends[-1], np.int64)
        for k, (m, end) in enumerate(zip(sizes.tolist(), ends.tolist(), strict=True)):
            base = np.uint64(table.column("base")[k].as_py() % (1 << 64))
            hashes[end - m : end] = W.from_sorted_planes(table.column("hashes")[k].as_buffer(), m)
            docs[end - m : end] = (W.from_planes(table.column("docs")[k].as_buffer(), m) + base).view(np.int64)
        order = np.argsort(hashes)
        hashes = hashes[order]
        starts = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
        del hashes
        ordered = docs[order]
        least = np.minimum.reduceat(ordered, starts)
        smaller = np.empty(len(docs), bool)
        smaller[order] = np.repeat(least, np.diff(starts, append=len(order))) < ordered
        bits = [np.packbits(x).tobytes() for x in np.split(smaller, ends[:-1])]
        del docs, order, starts, ordered, least, smaller
        tokens.release()
        return pa.table([table.column("chunk").combine_chunks(), table.column("bucket").combine_chunks(), pa.array(bits, pa.binary())], names=["chunk", "bucket", "bits"])

    return requests.repartition(n, "bucket").groupBy("bucket").applyInArrow(reduce, "chunk int, bucket int, bits binary")


def factors(flagged: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Factors (start, end) in words of one document from its windows in the reference."""
    edge = np.diff(np.concatenate([[0], flagged.astype(np.int8), [0]]))
    return [(int(a), int(b) + min_words - 1) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _covered(c: _Chunk, answers: pa.Table, n: int) -> np.ndarray:
    """Which words of the chunk lie in a factor."""
    known = np.zeros(len(c.unique), bool)
    limits = W.bucket_limits(c.unique, n)
    for b, bits in zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        lo, hi = int(limits[b]), int(limits[b + 1])
        known[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
    return c.covered(known)


def cut(raw: bytes, gone: np.ndarray) -> bytes:
    """A text without the words marked in ``gone``, nor the white space after them."""
    spans = [m.span() for m in _WORD.finditer(raw)]
    edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        out.append(raw[at : spans[a][0]])
        at = spans[b][0] if b < len(spans) else len(raw)
    return b"".join([*out, raw[at:]])


def _parsed(rows: DataFrame, finish, schema: str, min_words: int) -> DataFrame:
    """rows must have doc_id and text; ``finish(chunk, covered)`` makes the result of a chunk."""
    n = chunk_count(text_bytes(rows), 12, CHUNK_BYTES)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "chunk")
    answers = _answers(_requests(chunked.select("chunk", "doc_id", "text"), min_words, n), n)

    def final(table: pa.Table, answered: pa.Table) -> pa.Table:
        c = _Chunk(table, min_words)
        out = finish(c, _covered(c, answered, n))
        del c
        tokens.release()
        return out

    return chunked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(final, schema)


def digest(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, n_factors."""

    def finish(c: _Chunk, covered: np.ndarray) -> pa.Table:
        removed, shas, n_factors = [], [], []
        edge = np.diff(covered.astype(np.int8), prepend=np.int8(0)) == 1
        for raw, a, b in zip(tokens.raw_texts(c.table), c.offsets, c.offsets[1:], strict=False):
            gone, words = covered[a:b], (raw or b"").split()
            removed.append(int(gone.sum()))
            n_factors.append(int(edge[a:b].sum() + (b > a and a > 0 and covered[a] and covered[a - 1])))
            if removed[-1]:
                words = [w for w, out in zip(words, gone.tolist(), strict=True) if not out]
            shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table(
            [c.table.column("doc_id"), pa.array(c.lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(shas), pa.array(n_factors, pa.int64())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors"],
        )

    return _parsed(docs.select("doc_id", "text"), finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long", min_words)


def cleaned(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The same rows and columns, with duplicate spans cut out of ``text``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    kept = [(n, c) for n, c in zip(names, docs.columns, strict=True) if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *(docs[f"`{c}`"].alias(n) for n, c in kept))
    kinds = dict(rows.dtypes)

    def finish(c: _Chunk, covered: np.ndarray) -> pa.Table:
        texts = c.table.column("text")
        hit = np.unique(np.searchsorted(c.offsets, np.flatnonzero(covered), side="right") - 1)
        if len(hit):
            raw = texts.cast(pa.binary()).to_pylist()
            for k in hit.tolist():
                raw[k] = cut(raw[k], covered[c.offsets[k] : c.offsets[k + 1]])
            texts = pa.array(raw, pa.binary()).cast(pa.string())
        columns = [c.table.column("doc_id"), texts, *(c.table.column(n) for n, _ in kept)]
        return pa.table(columns, names=["doc_id", "text", *(n for n, _ in kept)])

    out = _parsed(rows, finish, ", ".join(f"{c} {kinds[c]}" for c in ["doc_id", "text", *(n for n, _ in kept)]), min_words)
    back = {c: n for n, c in kept}
    return out.select(*(F.col(back.get(c, c)).alias(c) for c in docs.columns))
