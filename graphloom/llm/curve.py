"""Packing along a space-filling curve.

A document's tokens are counted in hashed dimensions, the normalised vector is projected
to few dimensions, and the place in that space gives a Hilbert key. Documents are range
sorted by (key, doc_id) and laid one after the other into sequences, so what is similar
is packed together; a document goes on in the next sequence where one is full, which
leaves padding only in the last sequence of each range.

Edge cases: null or empty text is the end id alone; equal keys (copies) are ordered by
doc_id, so a large group of copies spreads over many ranges; repeated rows are packed
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm.store import chunk_count, materialize, text_bytes

LENGTH = 2048
HASHED, DIMS, BITS = 128, 3, 10


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of integer points (n, dims), by transposed Gray codes."""
    x = points.astype(np.int64).T.copy()
    dims, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where(x[dims - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _hash_of_ids(size: int) -> np.ndarray:
    i = np.arange(size, dtype=np.uint64)
    i = (i ^ (i >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return ((i >> np.uint64(40)) % np.uint64(HASHED)).astype(np.int64)


def document_keys(ids: list[np.ndarray], slot_of: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its ids."""
    n = np.array([len(x) for x in ids])
    doc = np.repeat(np.arange(len(ids)), n)
    v = np.bincount(doc * HASHED + slot_of[np.concatenate(ids)], minlength=len(ids) * HASHED).reshape(-1, HASHED)
    v = np.sqrt(v)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    axes = np.random.default_rng(2048).standard_normal((HASHED, DIMS))
    axes -= axes.mean(axis=0)  # else every document lies far out on the common direction
    place = 1 / (1 + np.exp(-2.0 * (v @ axes)))
    return hilbert_key(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


def keyed(docs: DataFrame, path: str) -> DataFrame:
    """Rows (curve_key, doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        slot_of = _hash_of_ids(enc.size)
        for b in tokens.pieces(batches):
            packed = [enc.encode(x) for x in tokens.raw_texts(b)]
            key = document_keys([np.frombuffer(x, enc.dtype) for x in packed], slot_of)
            yield pa.RecordBatch.from_arrays([pa.array(key), b.column("doc_id"), pa.array(packed, pa.binary())], ["curve_key", "doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "curve_key long, doc_id long, ids binary")


def _ranged(docs: DataFrame, path: str) -> DataFrame:
    """Rows (curve_key, doc_id, ids, range) in the order of packing."""
    n = chunk_count(text_bytes(docs))
    rows = materialize(keyed(docs, path), "curve")
    ranged = rows.repartitionByRange(n, "curve_key", "doc_id").sortWithinPartitions("curve_key", "doc_id", "ids")
    return ranged.withColumn("range", F.spark_partition_id())


def _laid(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents of one range."""
    enc = tokens.encoder(path)
    width = enc.dtype.itemsize
    used = 0  # ids laid down in this range so far
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "curve_key"]
    for b in tokens.pieces(batches, "ids"):
        out: list[list] = [[] for _ in names]
        for key, doc, ids, part in zip(*(b.column(c).to_pylist() for c in ("curve_key", "doc_id", "ids", "range")), strict=True):
            total, start = len(ids) // width, 0
            while start < total:
                sequence, offset = divmod(used, length)
                take = min(length - offset, total - start)
                row = (doc, start, take, ids[start * width : (start + take) * width], total, (part << 32) + sequence, offset, key)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
                start += take
                used += take
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)


def _crcs(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    dtype = tokens.encoder(path).dtype
    for b in batches:
        crc = [zlib.crc32(np.frombuffer(x, dtype).astype("<u4").tobytes()) for x in b.column("ids").to_pylist()]
        names = [c for c in b.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"])


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """Rows of pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset, curve_key).

    The tokenized table is written once, for the range partitioner samples its input;
    each range then streams through one task that holds a single document at a time.
    Sequence ids are the range's number times 2^32 plus a count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _laid(batches, path, length)

    return _ranged(docs, path).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, curve_key long")


def with_crc(pieces: DataFrame, path: str) -> DataFrame:
    """Replaces the ids by ids_crc32, over them as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _crcs(batches, path)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "ids")
    return pieces.mapInArrow(run, f"{kinds}, ids_crc32 long")


def pack_with_crc(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """As :func:`with_crc` of :func:`pack`, in one Python worker a task.

    Two steps in a row would hold two, and an executor keeps all its workers for the stages after it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _crcs(_laid(batches, path, length), path)

    return _ranged(docs, path).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, curve_key long, ids_crc32 long")
