"""Chat formatting, sharding and audio."""

import hashlib
import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import audio, chat, shards

HARD = ["</s>[INST] ok [/INST]", "\\", "[", "<\\", "[\\[\\\\<", "[ROLE]x[TEXT]", "", "naïve\n\x0b日本", "a\\[b"]


def test_chat_reads_back_every_turn(spark):
    rows = []
    for c, roles in enumerate([["user", "assistant"], ["system", "user", "assistant", "user"], ["assistant"] * 3, ["user"], ["[TEXT]", "tool\n", None]]):
        for t, role in enumerate(roles):
            for text in [HARD[(c + t) % len(HARD)]]:
                rows.append((c, t, role, text))
    rows += [(7, 0, "user", None), (7, 0, "user", None), (7, 0, "assistant", "z"), (None, 1, "assistant", "orphan")]
    rows += [(8, t, "assistant" if t % 2 else "user", HARD[t % len(HARD)] * 3) for t in range(40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit("clash"))
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        spelled = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(spelled.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        n = sum(x == "assistant" for _, x, _ in turns)
        assert r.n_examples == n + (turns[-1][1] != "assistant")
    assert sum(len(r.formatted) for r in examples.collect()) == sum(r.formatted_chars for r in got.values())
    for r in examples.filter("target_turn IS NOT NULL").collect():
        masked = r.formatted[r.loss_start : r.loss_start + r.loss_length]
        assert r.formatted.endswith("<s>" + masked + "</s>")
    assert chat.digest(chat.expand(df.limit(0))).count() == 0


def test_shards_are_even_and_positions_gapless(spark):
    rng = np.random.default_rng(0)
    rows = [(int(i), "x" * int(n)) for i, n in enumerate(rng.integers(0, 3000, 4000))] + [(None, None), (5, "x"), (5, "x"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rank", F.lit(1)).withColumn("size", F.lit("s"))
    placed, slot_map = shards.assign(df, 12, 512)
    out = placed.collect()
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    sizes = [sum(r["size"] for r in v) for v in by.values()]
    assert len(by) == 12 and max(sizes) <= 1.01 * sum(sizes) / 12
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    assert sorted(slot_map.loads()) == sorted(sizes)
    expect = sorted((len(t or "") + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted((r["size"], r.text_crc32) for r in out) == expect
    frame = slot_map.frame(spark)
    assert frame.count() == 512 and frame.agg(F.sum("bytes")).first()[0] == sum(sizes)
    assert shards.assign(df.limit(0), 12)[0].count() == 0


def test_rebalance_edits_the_map():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 1000, 1024)]
    old = shards.plan(sizes, 10)
    grown = shards.rebalance(old, sizes, 11)
    assert grown.version == 2 and max(grown.loads()) <= 1.02 * sum(sizes) / 11
    moved = [(a, b) for a, b in zip(old.shards, grown.shards, strict=True) if a != b]
    assert moved and {b for _, b in moved} == {10}
    drift = [x * (3 if s == 0 else 1) for x, s in zip(sizes, old.shards, strict=True)]
    again = shards.rebalance(old, drift)
    assert max(again.loads()) <= 1.02 * sum(drift) / 10
    fewer = shards.rebalance(old, sizes, 9)
    assert max(fewer.shards) == 8 and max(fewer.loads()) <= 1.05 * sum(sizes) / 9


def plain_adpcm(block):
    value, index = struct.unpack_from("<hB", block)
    index, out = min(index, 88), [value]
    for byte in block[4:]:
        for nibble in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            delta = step >> 3
            delta += (step >> 2) * (nibble & 1) + (step >> 1) * (nibble >> 1 & 1) + step * (nibble >> 2 & 1)
            value = max(-32768, min(32767, value - delta if nibble & 8 else value + delta))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][nibble & 7]))
            out.append(value)
    return out


def test_codecs():
    assert audio.MULAW[[0x00, 0x80, 0xFF, 0x7F]].tolist() == [-32124, 32124, 0, 0]
    assert audio.ALAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    data = np.random.default_rng(3).integers(0, 256, 64 * 9).astype(np.uint8).tobytes()
    expect = [x for i in range(9) for x in plain_adpcm(data[64 * i : 64 * i + 64])]
    assert audio.decode_adpcm(data).tolist() == expect
    for codec in audio.CODECS:
        assert audio.unwrap(audio.wrap(codec, data)) == (codec, 8000, data)
    tone = (9000 * np.sin(np.arange(4000) * 0.3)).astype(np.int16)
    twice = audio.resample_double(tone).astype(float)
    assert np.abs(twice - 9000 * np.sin(np.arange(8000) * 0.15))[50:-50].max() < 60
    with pytest.raises(ValueError):
        audio.unwrap(b"RIFF....nope")


def test_audio_digest(spark):
    texts = ["", None, "a" * 64, "b" * 65, "日本" * 5000, "same", "same"] + [f"text {i} " * i for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit("clash"))
    out = {r.doc_id: r for r in audio.digest(audio.store(df)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = out[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.media_bytes > len(p)
    assert out[5][1:] == out[6][1:] and len({r.feature.split(";")[0] for r in out.values()}) == 3
    pcm = audio.pcm_column(audio.store(df)).collect()
    assert all(len(r.pcm) >= 4 * 64 for r in pcm)
    stored = audio.store(df)
    feature = {r.doc_id: r.feature for r in audio.digest(stored).collect()}
    for r in audio.pcm_column(stored).collect():  # the feature's checksum is that of the stored samples
        assert feature[r.doc_id].endswith(f"resampled={zlib.crc32(r.pcm)}")
    hole = spark.createDataFrame([(1, 0, None)], "doc_id long, n_bytes long, media binary")
    assert audio.digest(hole).first().feature is None and audio.pcm_column(hole).first().pcm is None
    assert audio.digest(audio.store(df.limit(0))).count() == 0


def test_rows_without_ids_spread_over_slots(spark):
    rows = [(None if i % 3 else 7, f"text {i}") for i in range(3000)]
    placed, slot_map = shards.assign(spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")), 12, 512)
    out = placed.collect()
    assert len({r.virtual_slot for r in out}) > 450 and {r.map_version for r in out} == {1}
    by = {}
    for r in out:
        assert r.shard == slot_map.shards[r.virtual_slot]
        by.setdefault(r.shard, []).append(r)
    for v in by.values():
        assert sorted(r.slot for r in v) == list(range(len(v)))
    loads = [sum(r["size"] for r in v) for v in by.values()]
    assert max(loads) <= 1.05 * sum(loads) / 12


def test_resampled_samples_are_stored_and_features_come_from_them(spark):
    rng = np.random.default_rng(5)
    noise = [rng.integers(-32768, 32768, n).astype(np.int16) for n in (0, 1, 2, 7, 64, 40001)]
    signals = [(16000, x) for x in noise] + [(8000, audio.resample_double(noise[3]))]
    files = audio.write_pcm(signals)
    assert [(r, x.tolist()) for r, x in audio.read_pcm(files)] == [(r, x.tolist()) for r, x in signals]
    assert [audio.write_pcm([s])[0] for s in signals] == files
    with pytest.raises(ValueError):
        audio.read_pcm([b"RIFF" + files[0][4:]])
    texts = ["", None, "a" * 64, "日本" * 5000, "same", "same"] + [f"text {i} " * i for i in range(30)]
    stored = audio.store(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = stored.collect()
    assert len({r.media[20:22] for r in rows}) == 3
    for r in rows:
        codec, rate, payload = audio.unwrap(bytes(r.media))
        x = np.array([s for i in range(0, len(payload), 64) for s in plain_adpcm(payload[i : i + 64])]) if codec == "adpcm" else audio.expand(codec, payload)
        [(stored_rate, samples)] = audio.read_pcm([bytes(r.resampled)])
        wide = np.convolve(np.pad(x.astype(float), (7, 8)), audio._HALF, "valid")
        assert stored_rate == 2 * rate and samples[::2].tolist() == x.tolist()
        assert np.abs(samples[1::2] - np.clip(wide, -32768, 32767)).max() < 0.51
    [other] = audio.write_pcm([(16000, noise[5])])  # other stored samples, another feature
    changed = stored.withColumn("resampled", F.when(F.col("doc_id") == 4, F.lit(bytearray(other))).otherwise(F.col("resampled")))
    feature = {r.doc_id: r.feature for r in audio.digest(changed).collect()}
    assert feature[4].endswith(f"resampled={zlib.crc32(noise[5].tobytes())}") and feature[5] != feature[4]
    assert feature[5] == {r.doc_id: r.feature for r in audio.digest(stored.drop("resampled")).collect()}[5]
