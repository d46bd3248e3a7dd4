"""Language-model scores by Katz backoff of order two.

Counts r of n-grams seen in training are discounted to r * d_r (Good-Turing for r up to
5, a fixed 0.1 of a count above, so that every context keeps mass for the unseen). A
token after a context takes the discounted bigram estimate if the bigram was seen and
backs off to the unigram estimate times the context's weight otherwise; a token without
unigram count takes the mass that the unigrams' discounts leave, which stands for one
unknown word. The weight of a context is

    (1 - sum of discounted bigram estimates) / (1 - sum of the same words' unigram estimates)

so the estimates after each context, over all known words and the unknown one, sum to 1.

Distribution: documents are dealt once to chunks. A chunk sends its distinct unigrams and
bigrams with their training counts to buckets of the hash space, and each bucket answers
with the total counts and lets one chunk own each n-gram. With these a chunk scores what
it has, and sends, per context, the two sums over the bigrams it owns; buckets of contexts
add them up and answer with the backoff weights. A frequent word or bigram arrives once a
chunk. What a chunk has scored and the sums by context are a written table; counts and
weights go to the chunks that asked and are not kept as a model of their own. With order
two the backoff has one step. N-grams are known by 56-bit hashes: of n types any two
collide with probability n^2 / 2^57.

Edge cases: null or empty text is the end token alone; repeated rows count and are scored
one by one; a null doc_id hashes like the empty text ('' has remainder 0: training); with
no training text every token is unknown, with probability 1; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import words as W
from graphloom.llm.store import chunk_count, materialize, text_bytes

GOOD_TURING_UP_TO = 5
CHUNK_BYTES = 9 << 20
TAIL = 0.1
_FIXED = float(1 << 40)
_BITS = np.uint64(8)  # hashes keep the upper 56 bits
_END, _START = np.uint64(0x1F3A5C7E9B2D4F61), np.uint64(0x6B1D3F5A7C9E2B4D)
_COUNTED = "kind int, bucket int, chunk int, n long, hashes binary, counts binary, owned binary, stats array<long>"
_SCORED = "kind int, bucket int, chunk int, n long, hashes binary, seen binary, lower binary, need binary, doc_id array<long>, numbers binary, backoff binary"


def discounts(of_counts: list[int], up_to: int = GOOD_TURING_UP_TO) -> list[float]:
    """d_1 .. d_k from how many types occur 1, 2, ... k + 1 times.

    Where Good-Turing gives no share in (0, 1), half a count is taken off instead.
    """
    n = [0, *of_counts]
    out = []
    tail = (up_to + 1) * n[up_to + 1] / n[1] if n[1] else 1.0
    for r in range(1, up_to + 1):
        d = 0.0
        if n[r] and tail < 1:
            d = ((r + 1) * n[r + 1] / (n[r] * r) - tail) / (1 - tail)
        out.append(d if 0 < d < 1 else (r - 0.5) / r)
    return out


@dataclass(frozen=True)
class Totals:
    """Corpus totals: tokens, types, and how many unigram and bigram types occur r times."""

    tokens: int
    types: int
    unigrams: tuple[int, ...]
    bigrams: tuple[int, ...]

    def kept(self, order: int) -> np.ndarray:
        """Discounted count for each r up to the Good-Turing limit, at index r."""
        d = discounts(list(self.unigrams if order == 1 else self.bigrams))
        return np.array([0.0, *((r + 1) * x for r, x in enumerate(d))])

    def discounted(self, counts: np.ndarray, order: int) -> np.ndarray:
        low = self.kept(order)
        return np.where(counts < len(low), low[np.minimum(counts, len(low) - 1)], counts - TAIL)

    @property
    def unknown(self) -> float:
        """The unigram estimate of the unknown word."""
        if not self.tokens:
            return 1.0
        low = self.kept(1)
        taken = sum(n * (r + 1 - low[r + 1]) for r, n in enumerate(self.unigrams[: len(low) - 1]))
        return (taken + TAIL * (self.types - sum(self.unigrams[: len(low) - 1]))) / self.tokens

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounted(counts, 1) / max(self.tokens, 1), self.unknown)


def is_held_out(doc_id: int | None, parts: int, part: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % parts == part


class _Chunk:
    """Tokens of a chunk, with the distinct unigrams and bigrams among them."""

    def __init__(self, table: pa.Table, parts: int, part: int):
        self.doc_ids = table.column("doc_id").to_pylist()
        self.held_out = np.array([is_held_out(d, parts, part) for d in self.doc_ids], bool)
        words = W.split(table.column("text"), lower=True)
        n = words.lengths
        self.offsets = np.concatenate([[0], np.cumsum(n + 1)])
        self.tokens = np.full(self.offsets[-1], _END)
        self.doc = np.repeat(np.arange(len(n), dtype=np.int32), n + 1)
        inner = np.ones(len(self.tokens), bool)
        inner[self.offsets[1:] - 1] = False
        self.tokens[inner] = words.token_hashes()
        del words, inner
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.offsets[:-1]] = _START
        train = ~self.held_out[self.doc]
        # unigrams, and the start as a context only
        self.unigrams, at = np.unique(np.concatenate([self.tokens, [_START]]) >> _BITS, return_inverse=True)
        self.word_at = at.astype(np.int32)
        del at
        self.unigram_counts = np.bincount(self.word_at[:-1], train, len(self.unigrams)).astype(np.int64)
        self.start_at = int(self.word_at[-1])
        self.word_at = self.word_at[:-1]
        self.unigram_counts[self.start_at] += int((~self.held_out).sum())
        self.context_at = np.empty_like(self.word_at)
        self.context_at[1:] = self.word_at[:-1]
        self.context_at[self.offsets[:-1]] = self.start_at
        pair = W.mix(context * np.uint64(0x9E3779B97F4A7C15) + self.tokens) >> _BITS
        del context, self.tokens
        self.bigrams, first, at = np.unique(pair, return_index=True, return_inverse=True)
        self.pair_at = at.astype(np.int32)
        del pair, at
        self.bigram_counts = np.bincount(self.pair_at, train, len(self.bigrams)).astype(np.int64)
        self.pair_context, self.pair_word = self.context_at[first], self.word_at[first]

    def of(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        return (self.unigrams, self.unigram_counts) if order == 1 else (self.bigrams, self.bigram_counts)


def _limits(hashes: np.ndarray, n: int) -> np.ndarray:
    return W.bucket_limits(hashes << _BITS, n)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def _requests(chunked: DataFrame, n: int, parts: int, part: int) -> DataFrame:
    def emit(table: pa.Table) -> pa.Table:
        c, rows = _Chunk(table, parts, part), []
        chunk = table.column("chunk")[0].as_py()
        for order in (1, 2):
            hashes, counts = c.of(order)
            limits = _limits(hashes, n)
            for b in range(n):
                lo, hi = int(limits[b]), int(limits[b + 1])
                if hi > lo:
                    rows.append((order, b, chunk, hi - lo, W.sorted_planes(hashes[lo:hi]), W.planes(counts[lo:hi].astype(np.uint64))))
        return _table(rows, ["kind", "bucket", "chunk", "n", "hashes", "counts"], [pa.int32()] * 3 + [pa.int64(), pa.binary(), pa.binary()])

    return chunked.groupBy("chunk").applyInArrow(emit, "kind int, bucket int, chunk int, n long, hashes binary, counts binary")


def _merged(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order that sorts the rows' hashes, where groups start in it, group of each, row limits."""
    hashes = np.concatenate([W.from_sorted_planes(r["hashes"], r["n"]) for r in rows])
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.empty(len(hashes), np.int64)
    group[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), group, np.cumsum([r["n"] for r in rows])[:-1]


def _count(requests: DataFrame, n: int) -> DataFrame:
    """Rows of kind 1 and 2 answer a chunk; rows of kind -1 and -2 hold a bucket's statistics."""

    def reduce(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        order, starts, group, limits = _merged(rows)
        counts = np.concatenate([W.from_planes(r["counts"], r["n"]) for r in rows]).astype(np.int64)
        total = np.add.reduceat(counts[order], starts)
        owner = np.zeros(len(counts), bool)
        owner[order[starts]] = True
        kind, bucket = rows[0]["kind"], rows[0]["bucket"]
        out = [
            (kind, bucket, r["chunk"], r["n"], None, W.planes(t.astype(np.uint64)), np.packbits(o).tobytes(), None)
            for r, t, o in zip(rows, np.split(total[group], limits), np.split(owner, limits), strict=True)
        ]
        hashes = np.concatenate([W.from_sorted_planes(r["hashes"], r["n"]) for r in rows])[order[starts]]
        real = (total > 0) & ((hashes != _START >> _BITS) if kind == 1 else True)
        of_counts = np.bincount(np.minimum(total[real], GOOD_TURING_UP_TO + 2), minlength=GOOD_TURING_UP_TO + 3)
        out.append((-kind, bucket, -1, int(real.sum()), None, None, None, [int(total[real].sum()), int(real.sum()), *map(int, of_counts[1 : GOOD_TURING_UP_TO + 2])]))
        names = ["kind", "bucket", "chunk", "n", "hashes", "counts", "owned", "stats"]
        return _table(out, names, [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 3 + [pa.list_(pa.int64())])

    return requests.repartition(n, "kind", "bucket").groupBy("kind", "bucket").applyInArrow(reduce, _COUNTED)


def _with_totals(counted: DataFrame) -> DataFrame:
    """The answers to chunks, each with the corpus totals (one row, joined by a constant key)."""
    sums = [F.sum(F.when(F.col("kind") == -k, F.element_at("stats", i))) for k in (1, 2) for i in range(1, GOOD_TURING_UP_TO + 4)]
    one = counted.filter("kind < 0").groupBy(F.lit(1).alias("all")).agg(F.array(*(F.coalesce(x, F.lit(0)) for x in sums)).alias("totals"))
    answers = counted.filter("kind > 0").select("kind", "bucket", "chunk", "n", "counts", "owned", F.lit(1).alias("all"))
    return answers.join(F.broadcast(one), "all").drop("all")


def totals(numbers: list[int]) -> Totals:
    one, two = numbers[: len(numbers) // 2], numbers[len(numbers) // 2 :]
    return Totals(one[0], one[1], tuple(one[2:]), tuple(two[2:]))


def _answered(c: _Chunk, answers: list[dict], order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    hashes = c.of(order)[0]
    counts, owned = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    limits = _limits(hashes, n)
    for r in answers:
        if r["kind"] == order:
            at = slice(int(limits[r["bucket"]]), int(limits[r["bucket"] + 1]))
            counts[at] = W.from_planes(r["counts"], r["n"])
            owned[at] = np.unpackbits(np.frombuffer(r["owned"], np.uint8), count=r["n"])
    return counts, owned


def _score(chunked: DataFrame, counted: DataFrame, n: int, parts: int, part: int) -> DataFrame:
    """Rows of kind 3 have a chunk's sums by context; rows of kind 4 its documents' scores so far."""

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        c, chunk = _Chunk(table, parts, part), table.column("chunk")[0].as_py()
        t = totals(answers.column("totals")[0].as_py())
        found = answers.drop_columns(["totals"]).to_pylist()
        unigram, _ = _answered(c, found, 1, n)
        bigram, owned = _answered(c, found, 2, n)
        del found, answers
        lower = t.unigram(unigram)
        context = np.maximum(unigram[c.pair_context], 1)
        higher = t.discounted(bigram, 2) / context
        # documents
        count, docs = unigram[c.word_at], len(c.doc_ids)
        base = np.bincount(c.doc, np.log10((count + 1) / (t.tokens + t.types + 1)), docs)
        known = np.bincount(c.doc, count > 0, docs)
        seen = bigram[c.pair_at] > 0
        value = np.where(seen, higher[c.pair_at], lower[c.word_at])
        so_far = np.bincount(c.doc, np.log10(value), docs)
        wait = np.flatnonzero(~seen & (unigram[c.context_at] > 0))
        numbers = np.stack([np.diff(c.offsets), known, base, so_far, c.held_out, np.full(docs, t.tokens)]).astype("<f8").tobytes()
        backoff = np.stack([c.doc[wait], c.context_at[wait]]).astype("<i4").tobytes()
        rows = [(4, 0, chunk, len(wait), None, None, None, None, c.doc_ids, numbers, backoff)]
        # contexts
        mine = owned & (bigram > 0)
        at = c.pair_context[mine]
        sums = [np.rint(np.bincount(at, x, len(c.unigrams)) * _FIXED).astype(np.uint64) for x in (higher[mine], lower[c.pair_word[mine]])]
        need = np.zeros(len(c.unigrams), bool)
        need[c.context_at[wait]] = True
        used = np.flatnonzero(need | (sums[0] > 0))
        limits = _limits(c.unigrams[used], n)
        for b in range(n):
            i = used[int(limits[b]) : int(limits[b + 1])]
            if len(i):
                rows.append((3, b, chunk, len(i), W.sorted_planes(c.unigrams[i]), W.planes(sums[0][i]), W.planes(sums[1][i]), np.packbits(need[i]).tobytes(), None, None, None))
        names = ["kind", "bucket", "chunk", "n", "hashes", "seen", "lower", "need", "doc_id", "numbers", "backoff"]
        return _table(rows, names, [pa.int32()] * 3 + [pa.int64()] + [pa.binary()] * 4 + [pa.list_(pa.int64()), pa.binary(), pa.binary()])

    return chunked.groupBy("chunk").cogroup(_with_totals(counted).groupBy("chunk")).applyInArrow(score, _SCORED)


def _weights(scored: DataFrame, n: int) -> DataFrame:
    """Log10 backoff weights that each chunk needs, with the place of each in its vocabulary order."""

    def reduce(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        order, starts, group, limits = _merged(rows)
        seen, lower = (np.add.reduceat(np.concatenate([W.from_planes(r[k], r["n"]) for r in rows])[order].astype(np.int64), starts) / _FIXED for k in ("seen", "lower"))
        weight = np.log10(np.maximum(1 - seen, 1e-12) / np.maximum(1 - lower, 1e-12))
        hashes = [W.from_sorted_planes(r["hashes"], r["n"]) for r in rows]
        out = []
        for r, h, g in zip(rows, hashes, np.split(group, limits), strict=True):
            need = np.unpackbits(np.frombuffer(r["need"], np.uint8), count=r["n"]).astype(bool)
            if need.any():
                out.append((r["chunk"], int(need.sum()), W.sorted_planes(h[need]), weight[g[need]].astype("<f8").tobytes()))
        return _table(out, ["chunk", "n", "hashes", "weights"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()])

    rows = scored.filter("kind = 3").select("bucket", "chunk", "n", "hashes", "seen", "lower", "need")
    return rows.repartition(n, "bucket").groupBy("bucket").applyInArrow(reduce, "chunk int, n long, hashes binary, weights binary")


def _finish(scored: DataFrame, weights: DataFrame) -> DataFrame:
    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        found = answers.to_pylist()
        # A chunk needs its contexts in ascending order of hash, so ranks stand for their places.
        hashes = np.concatenate([np.zeros(0, np.uint64), *(W.from_sorted_planes(r["hashes"], r["n"]) for r in found)])
        weight = np.concatenate([np.zeros(0), *(np.frombuffer(r["weights"], "<f8") for r in found)])[np.argsort(hashes)]
        for r in table.to_pylist():
            ids = r["doc_id"]
            length, known, base, score, held, trained = np.frombuffer(r["numbers"], "<f8").reshape(6, len(ids))
            doc, at = np.frombuffer(r["backoff"], "<i4").reshape(2, r["n"])
            score = score + np.bincount(doc, weight[np.unique(at, return_inverse=True)[1]] if len(at) else None, len(ids))
            out += zip(ids, held.astype(bool).tolist(), length.astype(int).tolist(), known.astype(int).tolist(), trained.astype(int).tolist(), base.tolist(), score.tolist(), strict=True)
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        return _table(out, names, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()])

    docs = scored.filter("kind = 4").select("chunk", "n", "doc_id", "numbers", "backoff")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.groupBy("chunk").cogroup(weights.groupBy("chunk")).applyInArrow(finish, schema)


def score(docs: DataFrame, parts: int = 7, part: int = 2) -> DataFrame:
    """Train on rows whose crc32(doc_id as text) mod ``parts`` is not ``part``; score all rows."""
    rows = docs.select("doc_id", "text")
    n = chunk_count(text_bytes(rows), 12, CHUNK_BYTES)
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")).repartition(n, "chunk")
    counted = _count(_requests(chunked, n, parts, part), n)
    scored = materialize(_score(chunked, counted, n, parts, part), "katz")
    return _finish(scored, _weights(scored, n))
