"""Near-duplicate groups, toxicity and decontamination against brute force."""

import re
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decon, knn, superminhash
from graphloom.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def naive_superminhash(hashes, slots):
    """The sequential form: a permutation per element, stopping at the largest slot value."""
    sig = [float("inf")] * slots
    step = int(superminhash._STEP)
    mix = lambda x: int(W.mix(np.array([x % (1 << 64)], np.uint64))[0])
    for h in hashes:
        p = list(range(slots))
        for j in range(slots):
            salt = (2 * j + 1) * step
            r = j + (mix(int(h) + salt) >> 11) / (1 << 53)
            k = j + mix(int(h) + salt + step) % (slots - j)
            p[j], p[k] = p[k], p[j]
            sig[p[j]] = min(sig[p[j]], r)
    return sig


def test_signatures_equal_the_sequential_form():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 5, 40, 300)]
    doc = np.repeat(np.arange(5), [len(d) for d in docs])
    got = superminhash.signatures(np.concatenate(docs), doc, 5, 32)
    for row, d in zip(got, docs, strict=True):
        assert row.tolist() == naive_superminhash(d, 32)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(2)
    agree, true = [], []
    for _ in range(60):
        common, a, b = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (85, 8, 7))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        sig = superminhash.signatures(np.concatenate([x, y]), np.repeat([0, 1], [len(x), len(y)]), 2, 128)
        agree.append((sig[0] == sig[1]).mean())
        true.append(0.85)
    assert abs(np.mean(agree) - 0.85) < 0.02 and np.std(agree) < 0.035


def sets_of(text, size):
    w = [x.lower() for x in WORD.findall(text or "")]
    if len(w) < size:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def brute_groups(rows, size, percent):
    sets = [sets_of(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)]


@pytest.fixture(scope="module")
def families():
    """A large family of near copies, a chain of drifting copies, borderline families, and odd rows."""
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    draw = lambda n: list(rng.choice(vocabulary, n))

    def edited(words, k):
        out = list(words)
        for i in rng.choice(len(out), k, replace=False):
            out[i] = str(rng.choice(vocabulary))
        return out

    texts = [draw(int(n)) for n in rng.integers(1, 120, 40)]
    first = draw(150)
    texts += [edited(first, int(k)) for k in rng.integers(0, 5, 60)]
    chain = draw(200)
    for _ in range(25):
        texts.append(chain)
        chain = edited(chain, 4)
    near, far = draw(100), None
    far = edited(near, 6)
    texts += [edited(near, int(k)) for k in rng.integers(0, 3, 15)] + [edited(far, int(k)) for k in rng.integers(0, 3, 15)]
    rows = [(1000 - 3 * i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(2000, rows[60][1]), (1, rows[60][1].upper().replace(" ", "\n ")), (1, "solo text here now"), (1, "solo text here now")]
    return rows + [(5, ""), (6, None), (7, " \t"), (None, rows[70][1]), (None, "only null owns this"), (8, "a b"), (9, "A b"), (10, "b")]


def frame(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("node", F.lit("x")).withColumn("c0", F.lit(1)).withColumn("label", F.lit(2.0))


@pytest.mark.parametrize(("size", "percent"), [(3, 85), (5, 80)])
def test_groups_match_brute_force(spark, families, size, percent):
    rows = superminhash.digest(frame(spark, families), size, percent).collect()
    assert sorted(map(str, ((r.doc_id, r.n_shingles, r.component_id) for r in rows))) == sorted(map(str, brute_groups(families, size, percent)))
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.component_id is not None)


@pytest.mark.parametrize("work", [superminhash.WORK, 1 << 18])
def test_loose_copies_of_one_text_match_brute_force(spark, work):
    """Copies that share edits, most of them linked with few others; small units force splitting."""
    rng = np.random.default_rng(21)
    base = [f"w{i}" for i in range(140)]
    shared = [(int(rng.integers(0, 138)), str(i)) for i in range(60)]
    rows = []
    for d in range(300):
        words = list(base)
        for e in rng.choice(60, int(rng.integers(0, 12)), replace=False):
            at, name = shared[e]
            words[at] = "" if e % 3 == 0 else f"edit{name}"
        if d % 4 == 0:
            words[int(rng.integers(0, 140))] = f"own{d}"
        rows.append((d, " ".join(words)))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in superminhash.digest(frame(spark, rows), 3, 85, work).collect()}
    want = brute_groups(rows, 3, 85)
    assert got == set(want)
    assert 10 < len({c for _, _, c in want}) < 290


def test_first_of_each_keeps_one_row_a_class(spark, families):
    df = frame(spark, families)
    out = superminhash.first_of_each(df, 5, 80)
    assert out.columns == df.columns
    ids = Counter(r.doc_id for r in out.collect())
    expect = Counter({c for _, n, c in brute_groups(families, 5, 80) if n and c is not None})
    expect.update([5, 6, 7])  # without words: all stay
    expect.update([None])  # the class that only a row without id is in
    expect.update([1])  # doc_id 1 stands for two classes
    assert ids == expect


def test_groups_of_nothing(spark):
    assert superminhash.digest(frame(spark, [])).count() == 0
    assert superminhash.first_of_each(frame(spark, [(1, None)])).count() == 1


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(3)
    vocabulary, bad = [f"w{i}" for i in range(800)], ["scum,", "Idiot", "vequmo", "vequta", "vequée", "trash."]
    rows, labels = [], []
    for i in range(900):
        words, toxic = list(rng.choice(vocabulary, int(rng.integers(5, 60)))), int(rng.random() < 0.2)
        for w in rng.choice(bad, int(rng.integers(2, 5)) if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), str(w))
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return rows, labels


def test_toxicity_finds_held_out_rows(spark, labelled):
    rows, labels = labelled
    extra = [(900, None), (901, ""), (901, ""), (None, "you scum idiot trash"), (902, "w1 " * 30000)]
    marks = spark.createDataFrame([*labels, (None, 1), (905, 1), (3, None)], "doc_id long, toxic int")
    out = knn.digest(frame(spark, rows + extra), marks).collect()
    truth, seen = dict(labels), Counter()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in truth and knn.fold_of(r.doc_id, 5) == 0:
            assert r.held_out
            seen[truth[r.doc_id], r.predicted] += 1
    assert len(out) == len(rows) + len(extra)
    assert seen[1, 1] >= 0.9 * (seen[1, 0] + seen[1, 1]) and not seen[0, 1]
    assert next(r for r in out if r.doc_id is None).predicted == 1
    kept = knn.without_toxic(frame(spark, rows + extra), marks)
    assert kept.columns == frame(spark, []).columns
    ids = {r.doc_id for r in kept.collect()}
    assert {i for i, t in labels if not t} <= ids and len(ids & {i for i, t in labels if t}) < 20


def test_words_of_few_toxic_examples_are_not_left_out(spark):
    rng = np.random.default_rng(9)
    vocabulary, bad = [f"w{i}" for i in range(300)], ["scum", "idiot", "vequmo", "trash", "moron", "filth"]
    rows, labels = [], []
    for i in range(150):
        toxic = int(i % 5 == 0)
        words = list(rng.choice(vocabulary, 30)) + (list(rng.choice(bad, 2, replace=False)) if toxic else [])
        rows.append((i, " ".join(rng.permutation(words))))
        labels.append((i, toxic))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    index = knn.fit(frame(spark, rows), marks)
    examples = {i for i, _ in labels if knn.fold_of(i, 5)}
    assert set(index.ids.tolist()) == examples == set(index.ids[np.unique(index.example)].tolist())
    found = Counter(t for i, x in rows if i in examples for t in {t for w in x.split() for t in knn.terms_of(w.encode())})
    assert set(index.terms.tolist()) <= set(found)
    assert {t for w in bad for t in knn.terms_of(w.encode())} <= set(index.terms.tolist())
    assert index.lengths.tolist() == [found[t] for t in index.terms.tolist()]
    truth = dict(labels)
    held = [(truth[r.doc_id], r.score) for r in knn.digest(frame(spark, rows), marks).collect() if r.held_out]
    assert min(s for t, s in held if t) >= 0.5 > max(s for t, s in held if not t)


@pytest.mark.parametrize("row_bytes", [knn.ROW_BYTES, 4 * 500 * 20])
def test_search_equals_brute_force(labelled, monkeypatch, row_bytes):
    rows, labels = labelled
    monkeypatch.setattr(knn, "BLOCK", 64)
    monkeypatch.setattr(knn, "ROW_BYTES", row_bytes)
    counts = [Counter(t for w in x.split() for t in knn.terms_of(w.encode())) for _, x in rows]
    names = np.unique(np.array([t for c in counts[:500] for t in c], np.uint64))
    number = {t: i for i, t in enumerate(names.tolist())}
    idf = np.linspace(1, 4, len(names))
    posts = sorted((number[t], e, n) for e, c in enumerate(counts[:500]) for t, n in c.items())
    term, example, count = (np.array(x) for x in zip(*posts, strict=True))
    index = knn.Index(names, idf, example, count, np.bincount(term, minlength=len(names)), np.zeros(500), np.arange(500)).build()
    vectors = np.zeros((len(rows), len(names)))
    for row, c in zip(vectors, counts, strict=True):
        for t, n in c.items():
            if t in number:
                row[number[t]] = (1 + np.log(n)) * idf[number[t]]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    asked = [(np.flatnonzero(v), v[v > 0]) for v in vectors[500:560]]
    for v, (e, s) in zip(vectors[500:560], index.searched(asked, 15), strict=True):
        all_ = vectors[:500] @ v
        best = np.sort(all_)[::-1][:15]
        assert s == pytest.approx(all_[e], abs=1e-5) and s == pytest.approx(best[best > 1e-9], abs=2e-5)
    own = index.vectors_of_examples()
    assert all(np.allclose(v[at], w) for v, (at, w) in zip(vectors[:500], own, strict=True))


def test_scores_follow_from_votes_by_hand(spark, labelled):
    """Every document's score, from whole vectors, votes and the fitted curve."""
    rows, labels = labelled
    index = knn.fit(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    texts, number = dict(rows), {t: i for i, t in enumerate(index.terms.tolist())}
    df = Counter(t for x in texts.values() for t in {t for w in x.split() for t in knn.terms_of(w.encode())})
    ids, truth = index.ids.tolist(), dict(labels)
    has = lambda i: {t for w in texts[i].split() for t in knn.terms_of(w.encode())}
    bad, good = [has(i) for i in ids if truth[i]], [has(i) for i in ids if not truth[i]]
    for t in index.terms.tolist()[::37]:
        a, b = sum(t in x for x in bad), sum(t in x for x in good)
        table = [(a, len(bad), a + b), (b, len(good), a + b), (len(bad) - a, len(bad), len(ids) - a - b), (len(good) - b, len(good), len(ids) - a - b)]
        g = sum(2 * o * np.log(o * len(ids) / (row * col)) for o, row, col in table if o) / len(ids)
        assert index.idf[number[t]] == pytest.approx((np.log((1 + len(rows)) / (1 + df[t])) + 1) * np.sqrt(g), abs=1e-6)

    def vector(i):
        c = Counter(number[t] for w in texts[i].split() for t in knn.terms_of(w.encode()) if t in number)
        v = np.zeros(len(number))
        for t, n in c.items():
            v[t] = (1 + np.log(n)) * index.idf[t]
        return v / max(np.linalg.norm(v), 1e-12)

    whole = np.array([vector(i) for i in ids])
    for r in knn.score(frame(spark, rows[:120]), index).collect():
        s = whole @ vector(r.doc_id)
        e = np.lexsort((np.arange(len(s)), -np.round(s / 1e-5)))[: knn.NEIGHBOURS]
        vote = (s[e] @ index.toxic[e] + 0.5 * index.prior) / (s[e].sum() + 0.5)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(index.curve[0] * vote + index.curve[1]))), abs=0.02)
        assert set(r.evidence) <= set(ids)


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in knn.digest(frame(spark, [(1, "a")]), none).collect()] == [0.0]
    assert knn.digest(frame(spark, []), none).count() == 0


def naive_align(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return int(h.max())


def test_alignment_equals_the_plain_recurrence():
    rng = np.random.default_rng(4)
    for _ in range(40):
        a, b = rng.integers(0, 6, int(rng.integers(1, 25))), rng.integers(0, 6, int(rng.integers(1, 60)))
        assert decon.align(a, b)[0] == naive_align(a, b)


def test_leaks_are_found_and_clean_rows_stay(spark):
    rng = np.random.default_rng(6)
    vocabulary = ["the", "of", "and"] + [f"w{i}" for i in range(2000)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, draw(int(n))) for i, n in enumerate(rng.integers(14, 60, 20))]
    rows, leaked = [], set()
    for i in range(200):
        words = draw(int(rng.integers(1, 300)))
        if i % 4 == 0:
            item, copy = items[i % 20][0], list(items[i % 20][1])
            for k in range(i % 3, len(copy), 7):  # an edit in each seven words
                copy[k] = "edited"
            if i % 8 == 0:
                copy = [w.upper() + "," for w in copy]
            at = int(rng.integers(0, len(words)))
            words[at:at] = copy
            leaked.add((i, item))
        rows.append((i, " ".join(words)))
    rows += [(None, "x " + " ".join(items[3][1])), (300, None), (301, "")]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "w1 w2"), (97, "")], "item_id long, text string")
    df = frame(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decon.matches(df, bench).collect() if r.item_id != 99}
    assert got == leaked | {(None, 3)}
    short = {r.doc_id for r in decon.matches(df, bench).collect() if r.item_id == 99}
    assert short == {d for d, t in rows if t and " w1 w2 " in f" {t} "}
    kept = decon.without_leaks(df, bench.filter("item_id <> 99"))
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in rows} - {d for d, _ in leaked} - {None}
    assert decon.matches(frame(spark, []), bench).count() == 0
    assert decon.matches(df, bench.limit(0)).count() == 0 and decon.without_leaks(df, bench.limit(0)).count() == len(rows)


def test_copies_with_an_edit_in_four_words_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(1500)]
    draw = lambda n: list(rng.choice(vocabulary, n))
    items = [(i, draw(n)) for i, n in enumerate([16, 30, 55] * 4)]
    rows = []
    for i in range(240):
        copy = [str(rng.choice(vocabulary)) if rng.random() < 0.25 else w for w in items[i % 12][1]]
        if i % 5 == 0:  # words put in as well
            copy = [x for k, w in enumerate(copy) for x in ([w, "put", "in"] if k % 6 == 5 else [w])]
        rows.append((i, " ".join(draw(int(rng.integers(0, 60))) + copy + draw(int(rng.integers(0, 60))))))
    number = {w: i for i, w in enumerate([*vocabulary, "put", "in"])}
    code = lambda words: np.array([number[w] for w in words])
    want = {}
    for d, text in rows:
        for i, item in items:
            score = decon.align(code(item), code(text.split()))[0] / (2 * len(item))
            if score >= 0.5:
                want[d, i] = score
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decon.matches(frame(spark, rows), bench).collect()}
    assert len(want) > 150 and got == pytest.approx(want)


def test_counting_takes_little_memory_and_encoders_go():
    import tracemalloc

    import pyarrow as pa

    from graphloom.llm import tokens

    rng = np.random.default_rng(11)
    names = np.array(["".join(map(chr, rng.integers(97, 123, 7))) for _ in range(5000)])
    texts = [" ".join(names[rng.integers(0, 5000, 300)]) for _ in range(3400)] + ["", None, "x"]  # 8 MB, a piece
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    terms = np.unique(knn._counted(batch.column(0).slice(0, 200))[1])
    expect = knn._counted(batch.column(0), terms)
    index = knn.Index(terms, np.ones(len(terms)), np.zeros(len(terms), int), np.ones(len(terms), int), np.ones(len(terms), int), np.zeros(1), np.zeros(1, int)).build()
    tokens._encoders["kept by a packing task"] = None
    [piece] = knn._pieces(iter([batch.slice(0, 3000)]))
    assert not tokens._encoders
    tracemalloc.start()
    got = index.judged(piece.column(0), 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 3000 and peak < 100 << 20
    parts = list(knn._counted_parts(batch.column(0), terms))
    assert len(parts) > 2 and [p[:2] for p in parts] == list(zip([0] + [p[1] for p in parts[:-1]], [p[1] for p in parts], strict=True)) and parts[-1][1] == len(texts)
    for k in (0, 1500, 3399):
        want = Counter(t for w in texts[k].split() for t in knn.terms_of(w.encode()) if t in set(terms.tolist()))
        assert dict(zip(terms[expect[1][expect[0] == k]].tolist(), expect[2][expect[0] == k].tolist(), strict=True)) == want
