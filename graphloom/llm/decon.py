"""Benchmark decontamination by n-gram seeds and local alignment.

Words are lower-cased and lose everything but letters and digits. Every word trigram of
every test item is a seed, however frequent: each occurrence in a training text proposes
a place for the item, and Smith-Waterman alignment of the item with the text around it
(match 2, mismatch and gap -1) gives a score, divided by the score of a full match. Text
and item belong together from ``least`` on, so edited, cut and paraphrased copies count.

Places of one item whose stretches overlap are aligned at once. A stretch is passed over
only if a bound on its score, from which item words occur in it at all, is under
``least``. A copy is found if three words in a row of it are the item's. Substitutions
leave such words in every copy of n words that scores over 0.5 + 1/n; a copy with a word
put in after every second one of its words can score over 0.5 without, and is not found.

Test items are sent to every task, in blocks of at most ``BLOCK_BYTES`` of text, one pass
over the corpus for each block.

Edge cases: null or empty texts and items match nothing; items under three words are
matched whole; repeated items and repeated rows each give their rows; a null doc_id or
item_id is carried; empty tables give an empty result; extra columns are ignored, or
carried by :func:`without_leaks`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm import words as W

SEED, LEAST = 3, 0.5
BLOCK_BYTES = 32 << 20
_JUNK = re.compile(r"[\W_]+")
_FILTER_BITS = 22


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, their offsets, and each word's place among its text's raw words."""
    words = W.split(texts, lower=True)
    plain = [_JUNK.sub("", w.decode().lower()).encode() for w in words.vocabulary]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in plain), np.uint64, len(plain))
    full = np.array([bool(w) for w in plain], bool)
    if not len(words.ids):
        return np.zeros(0, np.uint64), words.offsets, np.zeros(0, np.int64)
    keep = full[words.ids]
    place = np.arange(len(words.ids)) - np.repeat(words.offsets[:-1], words.lengths)
    before = np.concatenate([[0], np.cumsum(keep)])
    return hashes[words.ids[keep]], before[words.offsets], place[keep]


@dataclass
class Items:
    """Test items, and the trigrams (or whole short items) by which they are found."""

    ids: list[int | None]
    words: list[np.ndarray]
    keys: np.ndarray  # ascending, distinct
    owners: list[list[tuple[int, int]]]  # of each key: (item, position)
    sizes: tuple[int, ...]

    def filter(self) -> np.ndarray:
        table = np.zeros(1 << _FILTER_BITS, bool)
        table[(self.keys >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return table


def index_items(rows: list[tuple[int | None, str | None]]) -> Items:
    hashes, offsets, _ = normalised(pa.array([t for _, t in rows], pa.string()))
    words = [hashes[a:b] for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False)]
    at: dict[int, list[tuple[int, int]]] = {}
    sizes = set()
    for item, w in enumerate(words):
        size = min(SEED, len(w))
        if size:
            sizes.add(size)
            for p, g in enumerate(_grams(w, size).tolist()):
                at.setdefault(g, []).append((item, p))
    keys = np.array(sorted(at), np.uint64)
    return Items([i for i, _ in rows], words, keys, [at[int(k)] for k in keys], tuple(sorted(sizes)))


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    return W.ngrams(hashes, size) ^ np.uint64(size)


def _hits(hashes: np.ndarray, offsets: np.ndarray, items: Items, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key number) of every item trigram in the texts."""
    found_at, found_key = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.repeat(offsets[1:], np.diff(offsets))
    for size in items.sizes:
        grams = _grams(hashes, size)
        at = np.flatnonzero(table[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
        at = at[ends[at] - at >= size]
        key = np.searchsorted(items.keys, grams[at])
        same = key < len(items.keys)
        same[same] = items.keys[key[same]] == grams[at][same]
        found_at.append(at[same])
        found_key.append(key[same])
    return np.concatenate(found_at), np.concatenate(found_key)


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: (best score, end of the best alignment in the text)."""
    ramp = np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    best, end = 0, 0
    for w in item:
        new = np.maximum(row - 1, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == w, 2, -1))
        row = np.maximum.accumulate(new + ramp) - ramp  # a gap costs 1 a word
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def _bound(item: np.ndarray, text: np.ndarray) -> int:
    """No alignment scores more: item words in the text count 2, the others between them cost 1."""
    there = set(text.tolist())
    top = run = 0
    for w in item.tolist():
        run = run + 2 if w in there else max(0, run - 1)
        top = max(top, run)
    return top


def _best(item: np.ndarray, text: np.ndarray, starts: list[int], least: float) -> tuple[float, int]:
    """Best share of a full match over the proposed places, and where it ends; (0, 0) if under ``least``."""
    n, best, end, starts = len(item), 0.0, 0, sorted(set(starts))
    for p in starts:
        if 0 <= p and p + n <= len(text) and (text[p : p + n] == item).all():
            return 1.0, p + n
    room = max(0, int(2 * n * (1 - least)))  # so many words at most are put into a copy
    spans: list[list[int]] = []
    for p in starts:
        a, b = max(0, p - room), min(len(text), p + n + room)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for a, b in spans:
        if _bound(item, text[a:b]) < least * 2 * n:
            continue
        score, at = align(item, text[a:b])
        if score / (2 * n) > best:
            best, end = score / (2 * n), a + at
    return (best, end) if best >= least else (0.0, 0)


def _matches(texts: pa.Array, items: Items, table: np.ndarray, least: float) -> Iterator[tuple[int, int, float, int]]:
    """(text, item, score, raw word where the match ends)."""
    hashes, offsets, place = normalised(texts)
    at, key = _hits(hashes, offsets, items, table)
    doc = np.searchsorted(offsets, at, "right") - 1
    proposed: dict[tuple[int, int], list[int]] = {}
    for d, p, k in zip(doc.tolist(), at.tolist(), key.tolist(), strict=True):
        for item, q in items.owners[k]:
            proposed.setdefault((d, item), []).append(p - q - int(offsets[d]))
    for (d, item), starts in proposed.items():
        score, end = _best(items.words[item], hashes[offsets[d] : offsets[d + 1]], starts, least)
        if end:
            yield d, item, score, int(place[offsets[d] + end - 1])


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """Test items in blocks of a bounded size, each gathered on the driver."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    n = max(1, -(-int(size) // BLOCK_BYTES))
    for k in range(n):
        part = benchmark.select("item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def matches(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """Rows (doc_id, item_id, score, end_word) of the texts that hold a copy of an item."""
    spark, outs = docs.sparkSession, []
    for rows in _blocks(benchmark):
        items = index_items(rows)
        sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            table = items.filter()
            for b in tokens.pieces(batches):
                ids, out = b.column("doc_id").to_pylist(), []
                for d, item, score, end in _matches(b.column("text"), items, table, least):
                    out.append((ids[d], items.ids[item], score, end))
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "score", "end_word"])

        outs.append(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, score double, end_word long"))
    return reduce(DataFrame.union, outs)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no copy of any item."""
    at, out = docs.columns.index("text"), docs
    for rows in _blocks(benchmark):
        items = index_items(rows)
        sent = docs.sparkSession.sparkContext.broadcast(items)
        plain = out.toDF(*(f"c{i}" for i in range(len(docs.columns))))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            table = items.filter()
            for b in tokens.pieces(batches, f"c{at}"):
                keep = np.ones(b.num_rows, bool)
                for d, *_ in _matches(b.column(at), items, table, least):
                    keep[d] = False
                yield b.filter(pa.array(keep))

        out = plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
    return out
