"""Token ids in fixed-width bit-packed files.

Every id takes the fewest bits that the vocabulary needs. A file holds whole documents
in ascending order:

    magic ``GLBP`` | version u8 | bits u8 | pad u16 | block u32 | documents u32
    | ids u64 | first u64 | blocks u32 | pad u32
    | doc_id i64 * documents | present u8 * documents | ids of each u32 * documents
    | byte offset of each block u64 * blocks | packed blocks

A block holds ``block`` ids (the last one fewer), lowest bit first, and starts on a byte
boundary, so any range of ids is found by its block offset and unpacked by numpy without
reading the rest. ``first`` counts the ids of the shard's earlier files.

Files are rows of a Parquet table in shared storage (the ``file`` column), so Spark's
commit protocol makes a retried task harmless, and any store that Spark reads will do.

Edge cases: null text is the end id alone; a null ``doc_id`` is kept, ordered first;
rows with equal ids keep both, ordered by their ids' bytes; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import tokens
from graphloom.llm.store import chunk_count, materialize, text_bytes

_HEAD = struct.Struct("<4sBBHIIQQII")
BLOCK = 4096
FILE_IDS = 2_000_000


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Lowest bit first, zero padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little", count=bits).ravel(), bitorder="little").tobytes()


def unpack(data, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    out = np.zeros((n, 32), np.uint8)
    out[:, :bits] = flat
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def write_file(doc_ids: list[int | None], ids: list[np.ndarray], bits: int, first: int = 0, block: int = BLOCK) -> bytes:
    counts = np.array([len(x) for x in ids], "<u4")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    blocks = [pack(flat[i : i + block], bits) for i in range(0, len(flat), block)]
    head = _HEAD.pack(b"GLBP", 1, bits, 0, block, len(doc_ids), len(flat), first, len(blocks), 0)
    names = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is not None for d in doc_ids], np.uint8).tobytes()
    start = len(head) + len(names) + 4 * len(doc_ids) + 8 * len(blocks)
    offsets = start + np.cumsum([0, *map(len, blocks)])[: len(blocks)].astype("<u8") if blocks else np.zeros(0, "<u8")
    return b"".join([head, names, counts.tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, data: bytes):
        magic, version, self.bits, _, self.block, n, self.n_ids, self.first, blocks, _ = _HEAD.unpack_from(data)
        if magic != b"GLBP" or version != 1:
            raise ValueError("not a bit-packed token file of version 1")
        at = _HEAD.size
        present = np.frombuffer(data, np.uint8, n, at + 8 * n)
        self.doc_ids = [int(d) if p else None for d, p in zip(np.frombuffer(data, "<i8", n, at), present, strict=True)]
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n).astype(np.int64)
        self.starts = np.cumsum(self.counts) - self.counts
        self.offsets = np.frombuffer(data, "<u8", blocks, at + 13 * n)
        self.data = memoryview(data)

    def ids(self, start: int, length: int) -> np.ndarray:
        """Ids [start, start + length) of the file; only their blocks are touched."""
        if not length:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, (start + length - 1) // self.block
        out = []
        for k in range(a, b + 1):
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack(self.data[int(self.offsets[k]) : int(self.offsets[k]) + -(-n * self.bits // 8)], self.bits, n))
        return np.concatenate(out)[start - a * self.block : start - a * self.block + length]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.counts[k]))


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """Rows (shard, doc_id, ids): the ids as little-endian bytes, with the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).encode
        for b in tokens.pieces(batches):
            ids = pa.array([encode(x) for x in tokens.raw_texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("doc_id"), ids], ["shard", "doc_id", "ids"])

    return docs.mapInArrow(run, "shard int, doc_id long, ids binary")


def with_shard(docs: DataFrame, n: int) -> DataFrame:
    """Adds ``shard``: the number of quantiles of doc_id that a row's doc_id is over."""
    limits = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    step = F.array_size(F.filter(F.lit([int(x) for x in limits]), lambda x: x < F.col("doc_id"))) if limits else F.lit(0)
    return docs.withColumn("shard", F.coalesce(step, F.lit(0)).cast("int"))


def write(docs: DataFrame, path: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenize, order by doc_id and write files: rows (shard, file_no, n_docs, n_ids, file).

    The shards are cut at quantiles of ``doc_id``, which one scan of that column finds, so
    only packed ids are shuffled and nothing is tokenized twice.
    """
    rows = docs.select("doc_id", "text")
    n = chunk_count(text_bytes(rows))
    placed = tokenized(with_shard(rows, n), path).repartition(n, "shard").sortWithinPartitions("shard", "doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = tokens.encoder(path)
        names, held, size, shard, file_no, first = [], [], 0, None, 0, 0

        def flush():
            data = write_file(names, held, enc.bits, first)
            cols = [pa.array([v], t) for v, t in ((shard, pa.int32()), (file_no, pa.int32()), (len(names), pa.int64()), (size, pa.int64()), (data, pa.binary()))]
            return pa.RecordBatch.from_arrays(cols, ["shard", "file_no", "n_docs", "n_ids", "file"])

        for b in tokens.pieces(batches, "ids"):
            for s, d, x in zip(*(b.column(c).to_pylist() for c in ("shard", "doc_id", "ids")), strict=True):
                if names and (s != shard or size >= file_ids):
                    yield flush()
                    first, file_no = (first + size, file_no + 1) if s == shard else (0, 0)
                    names, held, size = [], [], 0
                shard = s
                names.append(d)
                held.append(np.frombuffer(x, enc.dtype))
                size += len(held[-1])
        if names:
            yield flush()

    return materialize(placed.mapInArrow(run, "shard int, file_no int, n_docs long, n_ids long, file binary"), "bitpack")


def read(files: DataFrame) -> DataFrame:
    """Per document of written files: doc_id, start, n_tokens, ids_crc32.

    The ids before a shard are summed over one row a shard; a file knows what its shard
    holds before it.
    """
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column("file"), b.column("before").to_pylist(), strict=True):
                r = Reader(file.as_py())
                crcs = [zlib.crc32(r.document(k).astype("<u4").tobytes()) for k in range(len(r.doc_ids))]
                start = r.starts + base + r.first
                cols = [pa.array(r.doc_ids, pa.int64()), pa.array(start, pa.int64()), pa.array(r.counts, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("shard", "file").join(before, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
