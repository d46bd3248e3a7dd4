"""Katz scores, substring dedup, token files and packing against brute force."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import bitpack, curve, katz, rlz, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    vocabulary = ["the", "of", "Und", "naïve,", "x.", "don't", "1984", " odd", "İ", "z̸", "...", "été"] + [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choice(vocabulary, n))
    passage = draw(40)
    rows = [draw(int(n)) for n in rng.integers(1, 90, 60)]
    rows += [draw(5) + "\n" + passage + "\t " + draw(7), passage, "  " + passage + "  ", passage[: len(passage) // 2] + " " + draw(9)]
    rows += [rows[3], rows[3], "", "   ", None, "<|endoftext|> the of", "THE <|ENDOFTEXT|>", draw(9000)]
    return [(i * 3, t) for i, t in enumerate(rows)] + [(None, passage), (9, rows[3]), (9, rows[3])]


def frame(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return df.withColumn("chunk", F.lit("clash")).withColumn("shard", F.lit("x")).withColumn("kind", F.lit(1.5)).withColumn("ids", F.lit("b"))


def brute_katz(rows):
    docs = [(d, [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in WORD.findall(t or "")] + [0]) for d, t in rows]
    train = [w for d, w in docs if not katz.is_held_out(d, 7, 2)]
    uni, bi, ctx = Counter(), Counter(), Counter()
    for w in train:
        uni.update(w)
        for a, b in zip([1, *w], w, strict=False):
            bi[a, b] += 1
            ctx[a] += 1
    N, V = sum(uni.values()), len(uni)

    def kept(counts):
        n = Counter(counts.values())
        d = katz.discounts([n[r] for r in range(1, 7)])
        return lambda r: r * d[r - 1] if r <= 5 else r - katz.TAIL

    k1, k2 = kept(uni), kept(bi)
    p1 = {w: k1(c) / N for w, c in uni.items()}
    unk = 1 - sum(p1.values())
    after = defaultdict(dict)
    for (a, b), c in bi.items():
        after[a][b] = k2(c) / ctx[a]
    alpha = {a: (1 - sum(p.values())) / (1 - sum(p1[b] for b in p)) for a, p in after.items()}

    def prob(a, b):
        if b in after.get(a, {}):
            return after[a][b]
        return alpha.get(a, 1.0) * p1.get(b, unk)

    for a in list(after)[:20]:  # exact normalisation
        assert abs(sum(prob(a, b) for b in uni) + prob(a, object()) - 1) < 1e-9
    out = []
    for d, w in docs:
        score = sum(math.log10(prob(a, b)) for a, b in zip([1, *w], w, strict=False))
        base = sum(math.log10((uni[b] + 1) / (N + V + 1)) for b in w)
        out.append((d, katz.is_held_out(d, 7, 2), len(w), sum(b in uni for b in w), N, base, score))
    return out


def test_katz_matches_brute_force(spark, texts):
    got = [tuple(r) for r in katz.score(frame(spark, texts)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[6])
    for g, e in zip(sorted(got, key=key), sorted(brute_katz(texts), key=key), strict=True):
        assert g[:5] == e[:5]
        assert g[5:] == pytest.approx(e[5:], rel=1e-7, abs=1e-7)


def test_katz_empty_and_untrained(spark):
    assert katz.score(frame(spark, [])).count() == 0
    held = next(i for i in range(99) if katz.is_held_out(i, 7, 2))
    rows = katz.score(frame(spark, [(held, "a b")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)]


def test_discounts_stay_in_range():
    for counts in ([0] * 6, [5, 9, 1, 0, 4, 2], [100, 30, 12, 7, 4, 3]):
        assert all(0 < d < 1 for d in katz.discounts(counts))


def brute_rlz(rows, n):
    least = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    big = 1 << 70
    for d, w in words:
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(least.get(k, big), big - 1 if d is None else d)
    out = []
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < (big - 1 if d is None else d):
                gone[i : i + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("n", [13, 3])
def test_rlz_matches_brute_force(spark, texts, n):
    got = sorted(map(str, (tuple(r)[:4] for r in rlz.digest(frame(spark, texts), n).collect())))
    assert got == sorted(map(str, brute_rlz(texts, n)))


def test_rlz_cleaned_keeps_rows_and_columns(spark, texts):
    df = frame(spark, texts)
    out = rlz.cleaned(df, 13)
    assert out.schema.simpleString() == df.schema.simpleString()
    expect = Counter((d, h) for d, _, _, h in brute_rlz(texts, 13))
    got = Counter((r.doc_id, hashlib.sha256(" ".join(WORD.findall(r.text or "")).encode()).hexdigest()) for r in out.collect())
    assert got == expect
    untouched = {(d, t) for (d, t), (_, _, r, _) in zip(texts, brute_rlz(texts, 13), strict=True) if not r}
    assert untouched <= {(r.doc_id, r.text) for r in out.collect()}
    assert rlz.cleaned(frame(spark, [])).count() == 0


def test_rlz_chunk_holds_little():
    """A chunk of 8 MB of text at 50 words: numpy's and Python's memory beside Arrow's, which is the text's."""
    rng = np.random.default_rng(5)
    vocabulary = np.array([f"w{i:06d}" for i in range(30_000)])
    texts = [" ".join(rng.choice(vocabulary, 1000)) for _ in range(1000)]
    chunk = pa.table({"doc_id": pa.array(range(1000)), "text": pa.array(texts)})
    rlz._Chunk(chunk.slice(0, 2), 50)
    tracemalloc.start()
    rlz._Chunk(chunk, 50)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 6 * chunk.nbytes


def test_rlz_factors():
    assert rlz.factors(np.array([0, 1, 1, 0, 1], bool), 13) == [(1, 15), (4, 17)]


def whole_ids(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids + [1]


def test_encoder_equals_library(texts):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    whole, enc = Tokenizer.from_file(path), tokens.encoder(path)
    more = ["l'été d'Été.,", "ﬁne Ｆull ÀÉ ª º µ ß ÿ", "a\x1cb\x85c d", "it's 's 'S WE'LL", "日本 語", "é ́x", "a..b ,., .", "Σας ΣΑΣ İI", "👩‍👩‍👧 x", "\x00\x01", "don't.", "Ǆ ŉ"]
    for t in [*(t for _, t in texts), *more]:
        assert np.frombuffer(enc.encode((t or "").encode()), enc.dtype).tolist() == whole.encode(t or "", add_special_tokens=False).ids + [1]


def test_bitpack_round_trip(spark, texts):
    path = tokens.vocabulary_path()
    files = bitpack.write(frame(spark, texts), path, file_ids=500)
    assert files.count() > 3
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in bitpack.read(files).collect()))
    rows = sorted(((d is not None, d or 0, np.array(whole_ids(path, t), "<u2").tobytes()) for d, t in texts))
    start, expect = 0, []
    for known, d, ids in rows:
        x = np.frombuffer(ids, "<u2")
        expect.append((known, d, start, len(x), zlib.crc32(x.astype("<u4").tobytes())))
        start += len(x)
    assert got == expect
    assert bitpack.read(bitpack.write(frame(spark, []), path)).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 15, 16, 17, 32])
def test_bitpack_widths(bits):
    x = np.random.default_rng(bits).integers(0, 1 << bits, 999).astype(np.uint32)
    assert (bitpack.unpack(bitpack.pack(x, bits), bits, 999) == x).all()
    assert len(bitpack.pack(x, bits)) == -(-999 * bits // 8)
    docs = [x[:100], x[100:100], x[100:]]
    r = bitpack.Reader(bitpack.write_file([3, None, 5], docs, bits, 7, block=64))
    assert r.doc_ids == [3, None, 5] and all((r.document(k) == d).all() for k, d in enumerate(docs))
    assert (r.ids(37, 200) == x[37:237]).all()


def test_curve_packs_everything(spark, texts):
    path = tokens.vocabulary_path()
    rows = curve.pack(frame(spark, texts), path, 256).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(len(whole_ids(path, t)) for _, t in texts)
    assert sum(r.length for r in rows) == total
    assert len(by_seq) <= total // 256 + 1 + len({s >> 32 for s in by_seq})
    for d, t in texts:
        if d not in (None, 9):
            mine = sorted(by_doc[d], key=lambda r: r.start)
            assert [r.start for r in mine] == [sum(x.length for x in mine[:k]) for k in range(len(mine))]
            assert np.frombuffer(b"".join(r.ids for r in mine), "<u2").tolist() == whole_ids(path, t)
            assert {r.doc_tokens for r in mine} == {len(whole_ids(path, t))}
    assert curve.with_crc(curve.pack(frame(spark, []), path), path).count() == 0


def test_hilbert_curve_is_continuous():
    side = 8
    grid = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = curve.hilbert_key(grid, 3)
    assert sorted(key) == list(range(side**3))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("lower", [False, True])
def test_words_of_sliced_arrays(lower):
    import pyarrow as pa

    from graphloom.llm import words as W

    texts = ["a B", "c", "d e F", "Gé  h", "x\ty", "Z é"] * 5
    for whole in (pa.array(texts), pa.array([*texts, None])):
        for start, n in ((0, 30), (2, 3), (7, 20), (29, 1)):
            found = W.split(whole.slice(start, n), lower)
            words = [found.vocabulary[i].decode() for i in found.ids.tolist()]
            fold = lambda w: "".join(c.lower() if c.isascii() else c for c in w) if lower else w
            assert words == [fold(w) for t in texts[start : start + n] for w in WORD.findall(t)]
            assert found.lengths.tolist() == [len(WORD.findall(t)) for t in texts[start : start + n]]
