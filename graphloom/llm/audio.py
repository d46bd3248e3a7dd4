"""Telephony audio columns: mu-law, A-law and IMA ADPCM.

Companded samples are expanded by 256-entry lookup tables; ADPCM is decoded by numpy
across the blocks of many documents (one step handles the same nibble of every block).
A medium is a RIFF/WAVE file in a binary column, with its codec, rate and channel count
in the header. :func:`store` writes it and, beside it, what it decodes to at twice the
rate; :func:`digest` reads both back and takes its features from the stored samples.

Stored samples are 16-bit and coded without loss by :func:`write_pcm`: those of even
number as they are, those between as differences from what a half-band filter makes of
the former. Any samples can be stored so; where all differences are 0, as in what that
filter made, they take no room. :func:`pcm_column` gives the plain samples.

Edge cases: empty payloads give empty PCM; null media give null results; ADPCM step
indices outside the table are clamped, as decoders do; a trailing part of a block is
dropped, which cannot happen in what :func:`wrap` writes; tables of media without stored
samples get them first.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm import tokens
from graphloom.llm.store import materialize

RATE = 8000
BLOCK = 64
#: How media and samples are compressed: they would take more room than the input otherwise.
_TIGHT = {"parquet.compression.codec.zstd.level": "7", "parquet.page.size": str(4 << 20)}
CODECS = ("mulaw", "alaw", "adpcm")
_TAGS = {"mulaw": 7, "alaw": 6, "adpcm": 0x11}
_NAMES = {v: k for k, v in _TAGS.items()}


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    part, mantissa = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(part == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(part - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw_table(), _alaw_table()
STEPS = np.array(
    "7 8 9 10 11 12 13 14 16 17 19 21 23 25 28 31 34 37 41 45 50 55 60 66 73 80 88 97 107 118 130 143 157 173 190 209 230 253 279 307 337 371 408 449 494 544 598 658 724 796 876 963 1060 1166 1282 1411 1552 1707 1878 2066 2272 2499 2749 3024 3327 3660 4026 4428 4871 5358 5894 6484 7132 7845 8630 9493 10442 11487 12635 13899 15289 16818 18500 20350 22385 24623 27086 29794 32767".split(),
    np.int64,
)
_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int64)
# Change of the predictor for each step index and nibble, and the next index.
_NIBBLE = np.arange(16)
_DELTA = STEPS[:, None] // 8 + np.where(_NIBBLE & 1, STEPS[:, None] // 4, 0) + np.where(_NIBBLE & 2, STEPS[:, None] // 2, 0) + np.where(_NIBBLE & 4, STEPS[:, None], 0)
_DELTA = np.where(_NIBBLE & 8, -_DELTA, _DELTA).astype(np.int32).ravel()
_NEXT = np.clip(np.arange(len(STEPS))[:, None] + _INDEX, 0, len(STEPS) - 1).astype(np.int32).ravel()


def decode_adpcm(data: bytes, block: int = BLOCK) -> np.ndarray:
    """PCM of mono IMA ADPCM blocks: 4 bytes of header, then two samples a byte."""
    n = len(data) // block
    raw = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * block).reshape(n, block).T)
    value = (raw[0] | raw[1].astype(np.uint16) << 8).view(np.int16).astype(np.int32)
    index = np.minimum(raw[2], len(STEPS) - 1).astype(np.int32)
    out = np.empty((1 + 2 * (block - 4), n), np.int16)
    out[0] = value
    for k in range(2 * (block - 4)):
        byte = raw[4 + k // 2]
        at = index * 16 + (byte >> 4 if k % 2 else byte & 15)
        value = np.clip(value + _DELTA[at], -32768, 32767)
        index = _NEXT[at]
        out[k + 1] = value
    return out.T.ravel()


def expand(codec: str, payload: bytes) -> np.ndarray:
    return expand_all([(codec, payload)])[0]


def expand_all(coded: list[tuple[str, bytes]]) -> list[np.ndarray]:
    """PCM of each (codec, payload); the ADPCM blocks of all are decoded together."""
    blocks = [p[: len(p) // BLOCK * BLOCK] if c == "adpcm" else b"" for c, p in coded]
    decoded = decode_adpcm(b"".join(blocks))
    ends = np.cumsum([0, *(len(x) // BLOCK * (1 + 2 * (BLOCK - 4)) for x in blocks)]).tolist()
    tables = {"mulaw": MULAW, "alaw": ALAW}
    return [decoded[i:j] if c == "adpcm" else tables[c][np.frombuffer(p, np.uint8)] for i, j, (c, p) in zip(ends, ends[1:], coded, strict=False)]


def wrap(codec: str, payload: bytes, rate: int = RATE) -> bytes:
    """A WAVE file around companded samples or ADPCM blocks; the payload is stored as it is."""
    if codec == "adpcm":
        per = 1 + 2 * (BLOCK - 4)
        fmt = struct.pack("<HHIIHHHH", _TAGS[codec], 1, rate, rate * BLOCK // per, BLOCK, 4, 2, per)
        samples = len(payload) // BLOCK * per
    else:
        fmt = struct.pack("<HHIIHHH", _TAGS[codec], 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    pad = b"\0" * (len(payload) % 2)
    body = b"".join([b"WAVEfmt ", struct.pack("<I", len(fmt)), fmt, b"fact", struct.pack("<II", 4, samples), b"data", struct.pack("<I", len(payload)), payload, pad])
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwrap(media: bytes) -> tuple[str, int, bytes]:
    """codec, rate and payload of a WAVE file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = _NAMES[tag]
        elif kind == b"data":
            return codec, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def _halfband(taps: int = 8) -> np.ndarray:
    k = np.arange(-taps, taps) + 0.5
    h = np.sinc(k) * np.hamming(2 * taps)
    return h / h.sum()


_HALF = _halfband()
#: Samples that are filtered at once, so that they stay in a core's cache.
_AT_ONCE = 1 << 15
_MAGIC, _PCM = b"PCM2", struct.Struct("<4sII?")


def between(signals: list[np.ndarray]) -> list[np.ndarray]:
    """A sample after each given one, by a windowed sinc of 16 neighbours; zeros lie outside.

    Every sample is summed in the same order, so a signal's result does not depend on the others.
    """
    gap = np.zeros(8, np.int16)
    line = np.concatenate([gap, *(x for s in signals for x in (s, gap))])
    half = _HALF[:8].astype(np.float32)
    out = np.empty(len(line), np.int16)
    for i in range(0, len(line) - 15, _AT_ONCE):
        part = line[i : i + _AT_ONCE + 15].astype(np.float32)
        n = len(part) - 15
        total = half[0] * (part[:n] + part[15:])
        for k in range(1, 8):
            total += half[k] * (part[k : k + n] + part[15 - k : 15 - k + n])
        out[i : i + n] = np.clip(np.rint(total), -32768, 32767)
    starts = np.cumsum([1, *(len(s) + 8 for s in signals)]).tolist()  # seven neighbours before, eight after
    return [out[a : a + len(s)] for a, s in zip(starts, signals, strict=False)]


def resample_all(signals: list[np.ndarray]) -> list[np.ndarray]:
    """Twice the rate: given samples stay."""
    out = []
    for given, added in zip(signals, between(signals), strict=True):
        twice = np.empty(2 * len(given), np.int16)
        twice[::2], twice[1::2] = given, added
        out.append(twice)
    return out


def resample_double(pcm: np.ndarray) -> np.ndarray:
    return resample_all([pcm])[0]


def write_pcm(signals: list[tuple[int, np.ndarray]]) -> list[bytes]:
    """A file of each (rate, 16-bit samples), without loss.

    After the header lie the samples of even number and, unless all are 0, the differences of
    the others from what :func:`between` makes of the former.
    """
    files = []
    for (rate, x), guess in zip(signals, between([x[::2] for _, x in signals]), strict=True):
        rest = x[1::2] - guess[: len(x) // 2]  # modulo 2^16
        differ = bool(rest.any())
        files.append(_PCM.pack(_MAGIC, rate, len(x), differ) + x[::2].astype("<i2").tobytes() + (rest.astype("<i2").tobytes() if differ else b""))
    return files


def read_pcm(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """(rate, samples) of what :func:`write_pcm` made."""
    heads = [_PCM.unpack_from(f) for f in files]
    if any(h[0] != _MAGIC for h in heads):
        raise ValueError("not a file of samples")
    even = [np.frombuffer(f, "<i2", n - n // 2, _PCM.size) for f, (_, _, n, _) in zip(files, heads, strict=True)]
    out = []
    for f, (_, rate, n, differ), given, guess in zip(files, heads, even, between(even), strict=True):
        x = np.empty(n, np.int16)
        x[::2], x[1::2] = given, guess[: n // 2]
        if differ:
            x[1::2] += np.frombuffer(f, "<i2", n // 2, _PCM.size + 2 * len(given))
        out.append((rate, x))
    return out


def _resampled(media: list[bytes | None]) -> list[bytes | None]:
    """The file of samples of each medium."""
    known = [unwrap(m) for m in media if m is not None]
    twice = resample_all(expand_all([(codec, p) for codec, _, p in known]))
    files = iter(write_pcm([(2 * rate, x) for (_, rate, _), x in zip(known, twice, strict=True)]))
    return [None if m is None else next(files) for m in media]


def feature(codec: str, rate: int, pcm: np.ndarray, twice: np.ndarray) -> str:
    x = pcm.astype(np.int64)
    rms = int(np.sqrt((x * x).mean())) if len(x) else 0
    peak = int(np.abs(x).max()) if len(x) else 0
    crossings = int(np.count_nonzero(np.diff(pcm < 0)))
    return f"{codec};{rate}>{2 * rate}Hz;samples={len(pcm)}>{len(twice)};rms={rms};peak={peak};crossings={crossings};resampled={zlib.crc32(twice.tobytes())}"


def payload_of(raw: bytes | None) -> bytes:
    raw = raw or b""
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def store(docs: DataFrame) -> DataFrame:
    """Write every text's bytes as a telephony file with its samples at twice the rate.

    Rows (doc_id, n_bytes, media, resampled), read back lazily. The codec follows from the
    payload, so equal texts give equal files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches):
            payloads = [payload_of(x) for x in tokens.raw_texts(b)]
            codec = np.array([zlib.crc32(p) % len(CODECS) for p in payloads])
            order = np.argsort(codec, kind="stable")  # like lies beside like, which compresses better
            media = [wrap(CODECS[codec[i]], payloads[i]) for i in order]
            n = pc.fill_null(pc.binary_length(b.column("text")), 0).cast(pa.int64())
            cols = [b.column("doc_id").take(pa.array(order)), n.take(pa.array(order)), pa.array(media, pa.binary()), pa.array(_resampled(media), pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "media", "resampled"])

    return materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary, resampled binary"), "audio", **_TIGHT)


def _kinds(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def with_resampled(media: DataFrame) -> DataFrame:
    """``media`` with stored samples: as it is if it has them, else written with them."""
    if "resampled" in media.columns:
        return media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "media"):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_resampled(b.column("media").to_pylist()), pa.binary())], [*b.schema.names, "resampled"])

    return materialize(media.mapInArrow(run, f"{_kinds(media)}, resampled binary"), "audio", **_TIGHT)


def pcm_column(media: DataFrame) -> DataFrame:
    """Adds ``pcm``: 16-bit little-endian samples at twice the stored rate, as stored; null media give null."""
    media = with_resampled(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "resampled", 4 << 20):
            files = b.column("resampled").to_pylist()
            read = iter(read_pcm([f for f in files if f is not None]))
            out = [None if f is None else next(read)[1].astype("<i2").tobytes() for f in files]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], [*b.schema.names, "pcm"])

    return media.mapInArrow(run, f"{_kinds(media)}, pcm binary")


def digest(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, per document; the feature is that of the stored samples."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches, "resampled", 4 << 20):
            files = b.column("resampled").to_pylist()
            read = iter(read_pcm([f for f in files if f is not None]))
            rows = []
            for m, f in zip(b.column("media").to_pylist(), files, strict=True):
                if m is None:
                    rows.append((None,) * 6)
                    continue
                codec, _, p = unwrap(m)
                rate, twice = next(read)
                rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(m), hashlib.sha256(m).hexdigest(), feature(codec, rate // 2, twice[::2], twice)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], names)

    plain = with_resampled(media).select("doc_id", "n_bytes", "media", "resampled")
    return plain.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
