"""Toxicity by the nearest labelled examples.

Terms are lower-case words without outer punctuation, and their first 4 and 5 letters
(so that inflected forms meet), each known by its 64-bit hash. A bounded sample of
labelled rows (``sample`` rows, those with the smallest hash of doc_id) gives the
examples. All their terms are indexed; the document frequency of each is counted over all
documents. Examples and documents are vectors of unit length over these terms, weighted
by TF-IDF and by the root of how much the label depends on the term's presence (G, per
example), so that words of the subject weigh little beside words of the label. All
examples vote: the ``neighbours`` nearest by cosine, with their similarity as weight,
against a prior, the share of toxic examples. Votes become scores by a logistic curve
that is fitted to the votes of the examples themselves, each judged by the others.

The search is exact. Postings are kept in blocks of ``BLOCK`` examples (toxic ones first,
so that blocks differ) with the largest weight of each term in each block; the blocks
with the largest upper bounds are searched, and then all others that can still reach the
k-th best similarity. Terms of many examples are whole rows instead, multiplied for many
documents at once.

The index is bounded by ``sample`` and the terms of its texts whatever the corpus holds,
so it is sent to every task: a hash a term, and an example's number and a count a posting;
weights are computed where it arrives. Document frequencies are one number a term,
summed in runs of ``RUN`` terms. Any two of n terms share a hash with probability
n^2 / 2^65.

Edge cases: null or empty texts and texts without a term that depends on the label get the
score of the prior; labels that are null are not learned from; repeated labels count once
(the largest); a labelled doc_id without text is no example, and with several rows it is
one (its smallest terms); without labelled rows every score is 0, and with one label only
votes are not calibrated; ties between neighbours go to the smaller example number; an
empty table gives an empty result; extra columns are ignored, or carried by
:func:`without_toxic`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import tokens
from graphloom.llm import words as W

SAMPLE, NEIGHBOURS = 6000, 15
_PRIOR_WEIGHT = 0.5
_OUTER = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + "«»„“”‘’…¿¡–—"
BLOCK, RUN, TOGETHER = 2048, 1024, 256
#: Words whose terms are sorted at once: about 1.5 MB of text.
WORDS = 1 << 18
#: Size of the whole rows, in single precision, that the most frequent terms have.
ROW_BYTES = 32 << 20
#: Similarities that differ by less are ties; single precision leaves smaller errors.
_TIE = 1e-5


def _vocabulary_terms(vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, hash) of every term of the words: each word, and its first 4 and 5 letters if it has more."""
    words = pc.utf8_trim(pc.utf8_lower(vocabulary), _OUTER)
    letters = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    of_word, hashes = [], []
    for n in (None, 4, 5):
        which = np.flatnonzero(letters > (n or 0))
        found = words.take(pa.array(which)) if n is None else pc.utf8_slice_codeunits(words.take(pa.array(which)), 0, n).dictionary_encode()
        if n is None:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, found.to_pylist()), np.uint64, len(found))
        else:
            kinds = found.dictionary.to_pylist()
            h = np.fromiter((xxhash.xxh3_64_intdigest(x + "*") for x in kinds), np.uint64, len(kinds))[found.indices.to_numpy(zero_copy_only=False)]
        of_word.append(which)
        hashes.append(h)
    word, hash_ = np.concatenate(of_word), np.concatenate(hashes)
    order = np.argsort(word, kind="stable")
    return word[order], hash_[order]


def terms_of(word: bytes) -> tuple[int, ...]:
    """Hashes of a word's terms."""
    return tuple(_vocabulary_terms(pa.array([word.decode()]))[1].tolist())


def _counted_parts(texts: pa.Array, terms: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges of texts of about ``WORDS`` words: first and last + 1, and (text, term, occurrences) as :func:`_counted` gives them.

    The words of all texts are hashed in one go, but no more than a range's terms are sorted at once.
    """
    words = W.split(texts, lower=True)
    word, code = _vocabulary_terms(words.names)
    if terms is None:
        names, code = np.unique(code, return_inverse=True)
    else:
        at = np.minimum(np.searchsorted(terms, code), max(0, len(terms) - 1))
        same = terms[at] == code if len(terms) else np.zeros(len(code), bool)
        word, code, names = word[same], at[same], np.arange(len(terms))
    lengths = np.bincount(word, minlength=len(words.names))
    starts = np.cumsum(lengths) - lengths
    limits = [0, *(np.flatnonzero(np.diff(words.offsets[1:] // WORDS)) + 1).tolist(), len(texts)]
    for first, last in zip(limits, limits[1:], strict=False):
        ids = words.ids[words.offsets[first] : words.offsets[last]]
        if not len(ids) or not len(code):
            yield first, last, np.zeros(0, np.int64), np.zeros(0, names.dtype), np.zeros(0, np.int64)
            continue
        per = lengths[ids]
        owner = np.repeat(np.arange(first, last), words.lengths[first:last])
        key, n = np.unique(np.repeat(owner, per) * len(names) + code[W.ranges(starts[ids], per)], return_counts=True)
        yield first, last, key // len(names), names[key % len(names)], n


def _counted(texts: pa.Array, terms: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, occurrences), ordered by text: terms as hashes, or as their places in ``terms`` (ascending)."""
    return tuple(np.concatenate(x) for x in list(zip(*_counted_parts(texts, terms), strict=True))[2:])


def _pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """As :func:`tokens.pieces`, in a worker that gives up what earlier tasks kept for encoding."""
    tokens.forget()
    yield from tokens.pieces(batches, column)


@dataclass
class Index:
    """Unit vectors of the examples as a block-max inverted index."""

    terms: np.ndarray  # hashes, ascending
    idf: np.ndarray  # of each term, with the weight of the label's dependence on it
    example: np.ndarray  # of each posting; postings are ordered by term and example
    count: np.ndarray
    lengths: np.ndarray  # postings of each term
    toxic: np.ndarray
    ids: np.ndarray
    curve: tuple[float, float] | None = None  # slope and intercept of the logistic curve

    @property
    def prior(self) -> float:
        return float(self.toxic.mean()) if len(self.toxic) else 0.0

    def __getstate__(self):
        """In the smallest types, and without what :meth:`build` makes."""
        small = lambda x: x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
        return self.terms, self.idf, small(self.example), small(self.count), small(self.lengths), self.toxic.astype(bool), self.ids, self.curve

    def __setstate__(self, state):
        self.terms, self.idf, self.example, self.count, self.lengths, toxic, self.ids, self.curve = state
        self.toxic = toxic.astype(float)

    def build(self) -> Index:
        """Ready for searches; a worker that is used again keeps what it built."""
        if hasattr(self, "rows"):
            return self
        example, term = self.example.astype(np.int32), np.repeat(np.arange(len(self.terms), dtype=np.int32), self.lengths)
        weight = self.count.astype(float)  # changed in place: there are millions
        np.log(weight, out=weight)
        weight += 1
        weight *= self.idf[term]
        weight /= np.sqrt(np.bincount(example, weight * weight, len(self.ids)))[example]
        often = np.zeros(len(self.terms), bool)
        often[np.argsort(-self.lengths.astype(np.int64), kind="stable")[: ROW_BYTES // (4 * max(1, len(self.ids)))]] = True
        self.common = np.where(often, np.cumsum(often) - 1, -1)
        self.rows = np.zeros((int(often.sum()), len(self.ids)), np.float32)
        of_row = often[term]
        self.rows[self.common[term[of_row]], example[of_row]] = weight[of_row]
        example, term, weight = example[~of_row], term[~of_row], weight[~of_row].astype(np.float32)
        # example and weight of a posting side by side, as one number that is fetched at once
        both = np.empty((len(example), 2), np.float32)
        both[:, 0], both[:, 1] = example, weight
        self.postings = both.view(np.int64).ravel()
        self.posts = np.where(often, 0, self.lengths).astype(np.int64)
        self.post_start = np.cumsum(self.posts) - self.posts
        self.n_blocks = -(-len(self.ids) // BLOCK)
        # runs of postings of one term in one block
        run = term.astype(np.int64) * self.n_blocks + example // BLOCK
        first = np.flatnonzero(np.diff(run, prepend=-1))
        self.run_start, self.run_length = first.astype(np.int32), np.diff(first, append=len(run)).astype(np.int32)
        self.run_block = (example[first] // BLOCK).astype(np.int16)
        self.run_max = np.nextafter(np.maximum.reduceat(weight, first), np.float32(2)) if len(first) else np.zeros(0, np.float32)
        self.runs_of = np.searchsorted(term[first], np.arange(len(self.terms) + 1)).astype(np.int32)
        del example, term, weight, both, run, first, of_row
        tokens.release()
        return self

    def vectors_of_examples(self, first: int = 0, last: int | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """(terms, weights) of each example from ``first`` to ``last`` - 1, its terms ascending."""
        last = len(self.ids) if last is None else last
        here = np.flatnonzero((self.example >= first) & (self.example < last))
        term = np.repeat(np.arange(len(self.terms), dtype=np.int32), self.lengths)[here]
        example, count = self.example[here], self.count[here]
        order = np.argsort(example, kind="stable")
        limits = np.searchsorted(example[order], np.arange(first + 1, last))
        return [self.vector(t, n) for t, n in zip(np.split(term[order], limits), np.split(count[order], limits), strict=True)]

    def vector(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of unit length; none if nothing has a weight."""
        weight = (1 + np.log(n.astype(float))) * self.idf[at]
        return at, weight / np.sqrt((weight * weight).sum()) if len(at) else weight

    def by_common(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the similarity of each vector with each example."""
        own = np.zeros((len(vectors), len(self.rows)), np.float32)
        for row, (at, weight) in zip(own, vectors, strict=True):
            c = self.common[at]
            row[c[c >= 0]] = weight[c >= 0]
        return own @ self.rows

    def search(self, at: np.ndarray, weight: np.ndarray, base: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(examples, similarities) of the k nearest with a similarity over 0, best first."""
        weight_of, per = weight, self.runs_of[at + 1] - self.runs_of[at]
        run, weight = W.ranges(self.runs_of[at], per), np.repeat(weight, per)
        block = self.run_block[run]
        bound = np.bincount(block, weight * self.run_max[run], self.n_blocks)
        if len(base):
            bound = bound + np.maximum.reduceat(base, np.arange(0, len(base), BLOCK))
        best_e, best_s = np.zeros(0, np.int64), np.zeros(0)
        ahead = 2 * bound >= bound.max(initial=0)
        for wanted in (ahead, ~ahead):
            wanted = wanted & (bound > 0)
            if len(best_s) == k:
                wanted &= bound + _TIE >= best_s[-1]
            if not wanted.any():
                continue
            if wanted.all():
                length, q = self.posts[at], weight_of
                post = W.ranges(self.post_start[at], length)
            else:
                here = wanted[block]
                length, q = self.run_length[run[here]], weight[here]
                post = W.ranges(self.run_start[run[here]], length)
            got = self.postings[post].view(np.float32)
            s = np.bincount(got[::2].astype(np.int64), np.repeat(q, length) * got[1::2], len(self.ids)) + base
            if not wanted.all():
                s = np.where(np.repeat(wanted, BLOCK)[: len(s)], s, 0)
            least = np.partition(s, -k)[-k] - _TIE if len(s) > k else 0
            e = np.flatnonzero((s > 0) & (s >= least))
            best_e, best_s = np.concatenate([best_e, e]), np.concatenate([best_s, s[e]])
            order = np.lexsort((best_e, -np.round(best_s / _TIE)))[:k]
            best_e, best_s = best_e[order], best_s[order]
        return best_e, best_s

    def vote(self, e: np.ndarray, s: np.ndarray) -> float:
        return (float(s @ self.toxic[e]) + _PRIOR_WEIGHT * self.prior) / (float(s.sum()) + _PRIOR_WEIGHT)

    def score(self, vote: float) -> float:
        if self.curve is None:
            return min(1.0, max(0.0, vote))
        return float(1 / (1 + np.exp(-(self.curve[0] * vote + self.curve[1]))))

    def searched(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for i in range(0, len(vectors), TOGETHER):
            part = vectors[i : i + TOGETHER]
            for (at, weight), base in zip(part, self.by_common(part), strict=True):
                yield self.search(at, weight, base, k)

    def judged(self, texts: pa.Array, k: int) -> list[tuple[float, list[int]]]:
        """(score, doc_ids of the nearest examples) of each text."""
        out = []
        for first, last, doc, term, n in _counted_parts(texts, self.terms):
            ends = np.searchsorted(doc, np.arange(first, last + 1)).tolist()
            vectors = [self.vector(term[a:b], n[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            out += [(self.score(self.vote(e, s)), [int(x) for x in self.ids[e[:3]]]) for e, s in self.searched(vectors, k)]
        return out


def fitted_curve(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the logistic curve of greatest likelihood.

    Targets are drawn in from 0 and 1 by what one more example of each label would do, so
    the curve stays finite where votes tell the labels apart.
    """
    n1, n0 = float(toxic.sum()), float(len(toxic) - toxic.sum())
    target = np.where(toxic > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([votes, np.ones(len(votes))])
    at = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(at: np.ndarray) -> float:
        z = at @ x
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-(at @ x)))
        slope = x @ (p - target)
        step = np.linalg.solve((x * (p * (1 - p))) @ x.T + 1e-9 * np.eye(2), slope)
        size, now = 1.0, loss(at)
        while size > 1e-6 and loss(at - size * step) > now - 1e-4 * size * float(step @ slope):
            size /= 2
        at = at - size * step
        if abs(size * step).max() < 1e-9:
            break
    return float(at[0]), float(at[1])


def _g(a: np.ndarray, b: np.ndarray, na: int, nb: int) -> np.ndarray:
    """G statistic of presence in a of na against b of nb."""
    total, n = a + b, na + nb
    out = np.zeros(len(a))
    for seen, size, both in ((a, na, total), (b, nb, total), (na - a, na, n - total), (nb - b, nb, n - total)):
        expect = both * size / n
        with np.errstate(divide="ignore", invalid="ignore"):
            out += np.where(seen > 0, 2 * seen * np.log(np.where(seen > 0, seen, 1) / np.where(expect > 0, expect, 1)), 0)
    return out


def _sample(docs: DataFrame, labels: DataFrame, sample: int, parts: int, part: int) -> list[tuple[int, int, bytes, bytes]]:
    """(doc_id, toxic, hashes, counts) of the examples: at most ``sample`` rows, and so fit for the driver."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(parts))
    learned = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold != part))
    learned = learned.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = learned.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _pieces(batches):
            doc, term, n = _counted(b.column("text"))
            limits = np.searchsorted(doc, np.arange(1, b.num_rows))
            cols = [pa.array([x.tobytes() for x in np.split(v, limits)], pa.binary()) for v in (term, n.astype("<i4"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), *cols], ["doc_id", "toxic", "terms", "counts"])

    rows = texts.mapInArrow(run, "doc_id long, toxic int, terms binary, counts binary")
    one = rows.groupBy("doc_id", "toxic").agg(F.min(F.struct("terms", "counts")).alias("x")).select("doc_id", "toxic", "x.terms", "x.counts")
    # toxic examples first, so that blocks of the index differ
    return sorted(((r[0], r[1], bytes(r[2]), bytes(r[3])) for r in one.toLocalIterator()), key=lambda r: (-r[1], r[0]))


def _frequencies(docs: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """How many documents there are and how many have each term, over all of them."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, n = sent.value, len(sent.value)
        df = np.zeros((n // RUN + 1) * RUN, np.int64)
        for b in _pieces(batches):
            df[-1] += b.num_rows  # after the last term
            for _, _, _, term, _ in _counted_parts(b.column("text"), terms):
                df[:n] += np.bincount(term, minlength=n)
        runs = df.reshape(-1, RUN)
        seen = np.flatnonzero(runs.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array([W.planes(runs[i].astype(np.uint64)) for i in seen], pa.binary())], ["run", "df"])

    def add(run: pa.Table) -> pa.Table:
        total = sum(W.from_planes(x, RUN) for x in run.column("df").to_pylist())
        return pa.table({"run": run.column("run").slice(0, 1), "df": pa.array([W.planes(total)], pa.binary())})

    kind = "run long, df binary"
    df = np.zeros((len(terms) // RUN + 1, RUN), np.int64)
    for r in docs.select("text").mapInArrow(run, kind).groupBy("run").applyInArrow(add, kind).collect():  # 8 bytes a term at most
        df[r["run"]] = W.from_planes(bytes(r["df"]), RUN)
    df = df.ravel()
    return int(df[-1]), df[: len(terms)].astype(float)


def _votes(docs: DataFrame, index: Index, k: int) -> np.ndarray:
    """The vote on each example by the others."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        index = sent.value.build()
        for b in batches:
            at, out = b.column("id").to_pylist(), []
            lowest = min(at, default=0)
            vectors = index.vectors_of_examples(lowest, max(at, default=-1) + 1)
            for x, (e, s) in zip(at, index.searched([vectors[x - lowest] for x in at], k + 1), strict=True):
                others = e != x
                out.append(index.vote(e[others][:k], s[others][:k]))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(out, pa.float64())], ["id", "vote"])

    parts = max(1, min(spark.sparkContext.defaultParallelism, len(index.ids) // 256))
    rows = spark.range(0, len(index.ids), 1, parts).mapInArrow(run, "id long, vote double").collect()  # a number an example
    out = np.zeros(len(index.ids))
    for r in rows:
        out[r["id"]] = r["vote"]
    return out


def fit(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0, sample: int = SAMPLE, k: int = NEIGHBOURS) -> Index:
    """Learn from labelled rows whose crc32(doc_id as text) mod ``parts`` is not ``part``."""
    examples = _sample(docs, labels, sample, parts, part)
    toxic, ids = np.array([r[1] for r in examples], float), np.array([r[0] for r in examples], np.int64)
    hashes = np.frombuffer(b"".join(r[2] for r in examples), np.uint64)
    count = np.frombuffer(b"".join(r[3] for r in examples), "<i4")
    example = np.repeat(np.arange(len(examples), dtype=np.int32), [len(r[2]) // 8 for r in examples])
    del examples
    terms, term = np.unique(hashes, return_inverse=True)
    n1, both = int(toxic.sum()), np.bincount(term, minlength=len(terms))
    a = np.bincount(term, toxic[example], len(terms))
    g = np.maximum(_g(a, both - a, n1, len(ids) - n1), 0) / len(ids) if len(ids) else np.zeros(0)
    telling = g > 1e-12  # other terms have no weight
    kept = telling[term]
    term, example, count = (np.cumsum(telling) - 1)[term[kept]], example[kept], count[kept]
    terms, g = terms[telling], g[telling]
    n, df = _frequencies(docs, terms)
    order = np.lexsort((example, term))
    index = Index(terms, (np.log((1 + n) / (1 + df)) + 1) * np.sqrt(g), example[order], count[order], np.bincount(term, minlength=len(terms)), toxic, ids)
    if 0 < n1 < len(ids):
        index.curve = fitted_curve(_votes(docs, index, k), toxic)
    return index


def score(docs: DataFrame, index: Index, k: int = NEIGHBOURS) -> DataFrame:
    """Rows (doc_id, score, evidence): evidence is the doc_ids of the nearest examples."""
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.build()
        for b in _pieces(batches):
            found = index.judged(b.column("text"), k)
            cols = [b.column("doc_id"), pa.array([s for s, _ in found], pa.float64()), pa.array([e for _, e in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "score", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, evidence array<long>")


def digest(docs: DataFrame, labels: DataFrame, parts: int = 5, part: int = 0) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, evidence."""
    out = score(docs, fit(docs, labels, parts, part))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(parts)) == part
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def without_toxic(docs: DataFrame, labels: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs``, unchanged, whose score is under 0.5; learned from all labelled rows."""
    index = fit(docs, labels, 1, -1, k=k)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value.build()
        for b in _pieces(batches, f"c{at}"):
            found = index.judged(b.column(at), k)
            yield b.filter(pa.array([s < 0.5 for s, _ in found], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def fold_of(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts
