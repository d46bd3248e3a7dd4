"""Readers of binary and model files: rows (path, content) to typed rows.

Each reader is a generator over one file's bytes; :func:`parse` runs it in Arrow batches.
A file that is not of the format, or is cut off, gives no rows instead of an error.
"""

from __future__ import annotations

import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def parse(files: DataFrame, reader: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """(path, ...) rows of every file; ``schema`` names the reader's columns."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(path, *r) for r in reader(bytes(content or b""))]
                except (struct.error, ValueError, IndexError, KeyError, UnicodeDecodeError, zipfile.BadZipFile):
                    continue
            yield pd.DataFrame(rows, columns=["path", *names])

    return files.select("path", "content").mapInPandas(run, f"path string, {schema}")


def safetensors(b: bytes) -> Iterator[tuple]:
    """(name, dtype, shape, bytes)"""
    n = struct.unpack_from("<Q", b)[0]
    for name, t in sorted(json.loads(b[8 : 8 + n]).items()):
        if name != "__metadata__":
            yield name, t["dtype"], "x".join(map(str, t["shape"])), t["data_offsets"][1] - t["data_offsets"][0]


_GGUF = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


class _Cursor:
    def __init__(self, b: bytes, at: int = 0):
        self.b, self.at = b, at

    def take(self, fmt: str):
        out = struct.unpack_from("<" + fmt, self.b, self.at)
        self.at += struct.calcsize("<" + fmt)
        return out[0] if len(out) == 1 else out

    def text(self) -> str:
        n = self.take("Q")
        self.at += n
        return self.b[self.at - n : self.at].decode("utf-8", "replace")

    def value(self, kind: int):
        if kind == 8:
            return self.text()
        if kind == 9:
            inner, n = self.take("I"), self.take("Q")
            return [self.value(inner) for _ in range(n)]
        return self.take(_GGUF[kind])


def gguf(b: bytes) -> Iterator[tuple]:
    """(section, name, value): metadata keys, then tensors with type and shape."""
    if b[:4] != b"GGUF":
        return
    c = _Cursor(b, 4)
    c.take("I")
    tensors, keys = c.take("QQ")
    for _ in range(keys):
        name = c.text()
        yield "meta", name, str(c.value(c.take("I")))[:200]
    for _ in range(tensors):
        name, dims = c.text(), c.take("I")
        shape = [c.take("Q") for _ in range(dims)]
        kind, _ = c.take("I"), c.take("Q")
        yield "tensor", name, f"{kind}:{'x'.join(map(str, shape))}"


_PYC = {3390: "3.7", 3413: "3.8", 3425: "3.9", 3439: "3.10", 3495: "3.11", 3531: "3.12", 3571: "3.13"}


def pyc(b: bytes) -> Iterator[tuple]:
    """(magic, version)"""
    magic, mark = struct.unpack_from("<H2s", b)
    if mark == b"\r\n":
        near = max((m for m in _PYC if m <= magic), default=None)
        yield magic, _PYC.get(near, "unknown")


def elf(b: bytes) -> Iterator[tuple]:
    """(kind, name, size): sections and needed libraries of 64-bit little-endian files."""
    if b[:4] != b"\x7fELF" or b[4] != 2 or b[5] != 1:
        return
    shoff = struct.unpack_from("<Q", b, 40)[0]
    size, n, names = struct.unpack_from("<HHH", b, 58)
    heads = [struct.unpack_from("<IIQQQQIIQQ", b, shoff + i * size) for i in range(n)]
    word = lambda table, at: b[table + at : b.index(b"\0", table + at)].decode()
    for h in heads:
        yield "section", word(heads[names][4], h[0]), h[5]
    for h in heads:
        if h[1] == 6:  # dynamic
            strings = heads[h[6]][4]
            for at in range(h[4], h[4] + h[5], 16):
                tag, value = struct.unpack_from("<qQ", b, at)
                if tag == 1:
                    yield "needed", word(strings, value), 0


def pe(b: bytes) -> Iterator[tuple]:
    """(kind, name, size): machine and sections with raw size; what lies behind the last one is overlay."""
    if b[:2] != b"MZ":
        return
    at = struct.unpack_from("<I", b, 60)[0]
    if b[at : at + 4] != b"PE\0\0":
        return
    machine, n, stamp, _, _, optional = struct.unpack_from("<HHIIIH", b, at + 4)
    yield "machine", f"{machine:#06x}", stamp
    end = 0
    for i in range(n):
        name, _, _, raw, where = struct.unpack_from("<8sIIII", b, at + 24 + optional + 40 * i)
        yield "section", name.rstrip(b"\0").decode("latin-1"), raw
        end = max(end, where + raw)
    if n and len(b) > end:
        yield "overlay", "overlay", len(b) - end


def pe_carve(b: bytes) -> Iterator[tuple]:
    """(offset, key): embedded PE files, plain or under a single-byte XOR."""
    for key in range(256):
        mark, at = bytes([0x4D ^ key, 0x5A ^ key]), 0
        while (at := b.find(mark, at)) >= 0:
            if at + 64 <= len(b):
                head = struct.unpack("<I", bytes(x ^ key for x in b[at + 60 : at + 64]))[0]
                if 64 <= head < 4096 and bytes(x ^ key for x in b[at + head : at + head + 4]) == b"PE\0\0":
                    yield at, key
            at += 1


def _leb(b: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        x = b[at]
        out |= (x & 127) << shift
        at, shift = at + 1, shift + 7
        if x < 128:
            return out, at


_WASM = "custom type import function table memory global export start element code data".split()


def wasm(b: bytes) -> Iterator[tuple]:
    """(kind, name, size): sections, and the names of imports and exports."""
    if b[:4] != b"\0asm":
        return
    at = 8
    while at < len(b):
        kind = b[at]
        size, body = _leb(b, at + 1)
        yield "section", _WASM[kind] if kind < len(_WASM) else str(kind), size
        if kind == 7:
            n, p = _leb(b, body)
            for _ in range(n):
                length, p = _leb(b, p)
                yield "export", b[p : p + length].decode(), b[p + length]
                _, p = _leb(b, p + length + 1)
        at = body + size


def java_class(b: bytes) -> Iterator[tuple]:
    """(kind, name, size): version and every class the constant pool names."""
    if b[:4] != b"\xca\xfe\xba\xbe":
        return
    _, major, n = struct.unpack_from(">HHH", b, 4)
    yield "version", str(major - 44), major
    texts, classes, at, i = {}, [], 10, 1
    size = {3: 5, 4: 5, 5: 9, 6: 9, 7: 3, 8: 3, 9: 5, 10: 5, 11: 5, 12: 5, 15: 4, 16: 3, 17: 5, 18: 5, 19: 3, 20: 3}
    while i < n:
        tag = b[at]
        if tag == 1:
            length = struct.unpack_from(">H", b, at + 1)[0]
            texts[i] = b[at + 3 : at + 3 + length].decode("utf-8", "replace")
            at += 3 + length
        else:
            if tag == 7:
                classes.append(struct.unpack_from(">H", b, at + 1)[0])
            at += size[tag]
        i += 2 if tag in (5, 6) else 1
    for c in classes:
        yield "class", texts[c], 0


def macho(b: bytes) -> Iterator[tuple]:
    """(kind, name, size): libraries a 64-bit file loads and its segments."""
    if struct.unpack_from("<I", b)[0] != 0xFEEDFACF:
        return
    at = 32
    for _ in range(struct.unpack_from("<I", b, 16)[0]):
        cmd, size = struct.unpack_from("<II", b, at)
        if cmd in (0xC, 0x80000018):
            start = at + struct.unpack_from("<I", b, at + 8)[0]
            yield "dylib", b[start : at + size].split(b"\0")[0].decode(), 0
        elif cmd == 0x19:
            yield "segment", b[at + 8 : at + 24].rstrip(b"\0").decode(), struct.unpack_from("<Q", b, at + 48)[0]
        at += size


def archive(b: bytes) -> Iterator[tuple]:
    """(entry, size) of a ZIP, APK or JAR."""
    for x in zipfile.ZipFile(io.BytesIO(b)).infolist():
        yield x.filename, x.file_size


def dbf(b: bytes) -> Iterator[tuple]:
    """(name, type, length) of dBASE fields."""
    head = struct.unpack_from("<H", b, 8)[0]
    for at in range(32, head - 1, 32):
        if b[at] == 0x0D:
            return
        yield b[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(b[at + 11]), b[at + 16]


def strings(b: bytes, least: int = 6) -> Iterator[tuple]:
    """(offset, encoding, s): printable runs of ASCII and UTF-16."""
    import re

    for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, b):
        yield m.start(), "ascii", m[0].decode()
    for m in re.finditer(rb"(?:[\x20-\x7e]\0){%d,}" % least, b):
        yield m.start(), "utf16", m[0].decode("utf-16-le")


SCHEMAS = {
    safetensors: "name string, dtype string, shape string, bytes long",
    gguf: "section string, name string, value string",
    pyc: "magic long, version string",
    elf: "kind string, name string, size long",
    pe: "kind string, name string, size long",
    pe_carve: "offset long, xor_key long",
    wasm: "kind string, name string, size long",
    java_class: "kind string, name string, size long",
    macho: "kind string, name string, size long",
    archive: "entry string, size long",
    dbf: "name string, type string, length long",
    strings: "offset long, encoding string, s string",
}


def read(files: DataFrame, reader: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    return parse(files, reader, SCHEMAS[reader])
