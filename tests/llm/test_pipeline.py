"""The corpus pipeline, stage by stage, against brute force on what each stage is given."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import decon, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BAD = ["scum", "idiot", "trash", "moron", "loser", "clown"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    vocabulary = [f"w{i}" for i in range(4000)]
    draw = lambda n: [str(w) for w in rng.choice(vocabulary, n)]
    items = [draw(30) for _ in range(6)]
    passage = draw(60)
    rows, labels, leaked = [], [], set()
    for i in range(260):
        words = draw(int(rng.integers(60, 160)))
        if i % 5 == 0:
            for w in rng.choice(BAD, 6):
                words.insert(int(rng.integers(0, len(words))), str(w))
        elif i % 13 == 1:
            words[20:20] = passage
        elif i % 17 == 2:
            words[10:10] = items[i % 6]
            leaked.add(i)
        if i % 3 != 0 or i % 5 == 0:
            labels.append((i, int(i % 5 == 0)))
        rows.append((i, " ".join(words)))
    for i in range(260, 300):  # near copies: one word of another text changed
        words = rows[(i * 7) % 250][1].split()
        words[5] = f"new{i}"
        rows.append((i, " ".join(words)))
    rows += [(300, ""), (301, None), (302, rows[1][1])]
    d = str(tmp_path_factory.mktemp("sf"))
    texts = [(i, t, "en", "src", len(t or "")) for i, t in rows]
    spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, items


def sets_of(text, size=5):
    w = [x.lower() for x in WORD.findall(text or "")]
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def one_of_each(rows):
    ids = sorted(rows)
    sets = {i: sets_of(rows[i]) for i in ids}
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i for i in ids if find(i) == i}


def without_repeats(rows, n=50):
    first = {}
    words = {i: WORD.findall(t or "") for i, t in rows.items()}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone.update(range(k, k + n))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages_in_sequence(spark, corpus):
    d, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, d).cache()
        rows = out.collect()
        seen.append(name)
        if name == "packing":
            break
        assert out.columns == columns and len(rows) == len({r.doc_id for r in rows})
        after = {r.doc_id: r.text for r in rows}
        if name == "toxicity":
            assert set(after) == {i for i, t in before.items() if not set((t or "").split()) & set(BAD)}
        elif name == "near_dedup":
            assert set(after) == one_of_each(before) and len(after) < len(before)
        elif name == "substring_dedup":
            want = without_repeats(before)
            assert {i: WORD.findall(t or "") for i, t in after.items()} == want
            assert any(len(w) < len(WORD.findall(before[i] or "")) for i, w in want.items())
            assert all(r.n_chars == len(r.text or "") for r in rows)
        else:
            code = lambda words: np.array([zlib.crc32(w.encode()) for w in words])
            hit = {i for i, t in before.items() if any(t and decon.align(code(x), code(t.split()))[0] >= len(x) for x in items)}
            assert set(after) == set(before) - hit and hit
        if name != "substring_dedup":
            assert all(after[i] == before[i] for i in after)
        docs = out
    assert seen == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokens.vocabulary_path())
    pieces, sequences = defaultdict(list), Counter()
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
    assert set(pieces) == set(before) and max(sequences.values()) <= 2048
    for i, parts in pieces.items():
        ids = [*whole.encode(before[i] or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(parts, key=lambda r: r.start):
            part = np.array(ids[r.start : r.start + r.length], "<u4")
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(part.tobytes())
            at += r.length
        assert at == len(ids)


def test_run_gives_the_rows_of_the_stages(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, d).cache()
    part = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).select(part).collect())) == sorted(map(tuple, docs.select(part).collect()))


def test_packing_takes_one_worker_a_task(spark, corpus):
    """Steps in a row hold a worker each, and the executor keeps them all for the stages that follow."""
    d, _ = corpus
    plan = corpus_pipeline.pack(spark, spark.read.parquet(f"{d}/documents.parquet"), d)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow", plan.split("Initial Plan")[-1])) == 1
