"""Media columns by signature sniffing.

Aho-Corasick finds magic bytes anywhere in a value; a validator for each format follows its chunks,
boxes or trailers and says how long the medium is. A valid medium at place 0 that fills the value is its
type, whatever was declared; other valid media are carved as embedded. Magic bytes that no validator
confirms are text.

Nulls are empty and of type application/x-empty; values of any length; equal values give equal
results; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchwell.llm.common import reachable, slices, stored, text_bytes

#: Magic bytes, as published with the formats. Fixed values.
MAGIC = [
    (b"RIFF", "riff"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"GIF87a", "image/gif"),
    (b"GIF89a", "image/gif"),
    (b"%PDF-", "application/pdf"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b\x08", "application/gzip"),
    (b"OggS", "audio/ogg"),
    (b"fLaC", "audio/flac"),
    (b"ftyp", "video/mp4"),
]


def _riff(d: bytes, at: int):
    """RIFF: a form of the stated length, made of whole chunks."""
    if at + 12 > len(d):
        return None
    size, form = struct.unpack_from("<I4s", d, at + 4)
    end = at + 8 + size
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}.get(form)
    if not kind or end > len(d):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", d, p)
        seen.add(name)
        p += 8 + n + (n & 1)
    if p != end or (kind == "audio/wav" and not {b"fmt ", b"data"} <= seen):
        return None
    return kind, at, end


def _png(d: bytes, at: int):
    """PNG: chunks with right check sums from IHDR to IEND."""
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, name = struct.unpack_from(">I4s", d, p)
        if first and name != b"IHDR" or p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return "image/png", at, p
    return None


def _jpeg(d: bytes, at: int):
    """JPEG: segments up to a scan, then an end marker."""
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        mark, n = d[p + 1], struct.unpack_from(">H", d, p + 2)[0]
        if mark == 0xD9 or n < 2:
            return None
        p += 2 + n
        if mark == 0xDA:
            end = d.find(b"\xff\xd9", p)
            return ("image/jpeg", at, end + 2) if end >= 0 else None
    return None


def _gif(d: bytes, at: int):
    """GIF: screen, blocks of sub-blocks, trailer."""
    if at + 13 > len(d):
        return None
    p = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)
    while p < len(d):
        if d[p] == 0x3B:
            return "image/gif", at, p + 1
        if d[p] == 0x21:
            p += 2
        elif d[p] == 0x2C and p + 10 < len(d):
            p += 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0)
        else:
            return None
        while p < len(d) and d[p]:
            p += d[p] + 1
        p += 1
    return None


def _next(d: bytes, pattern: bytes, at: int, memo: dict) -> int:
    """d.find(pattern, at) for places that ascend: each pattern goes through the value once."""
    since, found = memo.get(pattern, (len(d) + 1, -1))
    if not (since <= at and (found < 0 or found >= at)):
        found = d.find(pattern, at)
        memo[pattern] = at, found
    return found


def _pdf(d: bytes, at: int, memo: dict):
    """PDF: a version, a cross-reference pointer and an end mark."""
    if not d[at + 5 : at + 6].isdigit():
        return None
    ref = _next(d, b"startxref", at, memo)
    end = _next(d, b"%%EOF", ref, memo) if ref >= 0 else -1
    return ("application/pdf", at, end + 5) if end >= 0 else None


def _zip(d: bytes, at: int, memo: dict):
    """ZIP: an end record whose directory lies where it says."""
    end = _next(d, b"PK\x05\x06", at, memo)
    if end < 0 or end + 22 > len(d):
        return None
    size, start, note = struct.unpack_from("<IIH", d, end + 12)
    ok = start + size == end - at and end + 22 + note <= len(d) and (not size or d[at + start : at + start + 4] == b"PK\x01\x02")
    return ("application/zip", at, end + 22 + note) if ok else None


def _gzip(d: bytes, at: int):
    """GZIP: a stream that inflates to its stated check sum."""
    z = zlib.decompressobj(31)
    try:
        rest = memoryview(d)[at:]
        for i in range(0, len(rest), 1 << 16):
            z.decompress(rest[i : i + (1 << 16)], 1 << 20)
            while z.unconsumed_tail and not z.eof:
                z.decompress(z.unconsumed_tail, 1 << 20)
            if z.eof:
                return "application/gzip", at, at + min(len(rest), i + (1 << 16)) - len(z.unused_data)
    except zlib.error:
        return None
    return None


def _ogg(d: bytes, at: int):
    """Ogg: pages, the last marked as such."""
    p = at
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d):
        n = d[p + 26]
        flags = d[p + 5]
        p2 = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if p2 > len(d) or d[p + 4]:
            return None
        p = p2
        if flags & 4:
            return "audio/ogg", at, p
    return None


def _flac(d: bytes, at: int):
    """FLAC: metadata blocks that start with the stream's; frames have no length, so they go to the end."""
    p, first = at + 4, True
    while p + 4 <= len(d):
        kind, n = d[p], int.from_bytes(d[p + 1 : p + 4], "big")
        if first and (kind & 127 or n != 34):
            return None
        p, first = p + 4 + n, False
        if kind & 128:
            return ("audio/flac", at, len(d)) if d[p : p + 1] == b"\xff" else None
    return None


def _mp4(d: bytes, at: int):
    """MP4: boxes that follow one another from the file type box on, a movie box among them."""
    start = p = at - 4
    seen = set()
    while 0 <= p and p + 8 <= len(d):
        n, name = struct.unpack_from(">I4s", d, p)
        if n < 8 or p + n > len(d) or not name.isalnum():
            break
        seen.add(name)
        p += n
    return ("video/mp4", start, p) if b"moov" in seen else None


CHECKS = {"riff": _riff, "image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "audio/flac": _flac, "video/mp4": _mp4}

SEEKING = ("application/pdf", "application/zip")


def automaton():
    a = ahocorasick.Automaton()
    for magic, kind in MAGIC:
        a.add_word(magic.decode("latin-1"), (len(magic), kind))
    a.make_automaton()
    return a


def sniff(data: bytes, a=None) -> list[tuple[str, int, int]]:
    """Valid media (type, from, to) by place, the outer before what it holds."""
    found, memo = [], {}
    for last, (n, kind) in (a or automaton()).iter(data.decode("latin-1")):
        got = CHECKS[kind](data, last - n + 1, memo) if kind in SEEKING else CHECKS[kind](data, last - n + 1)
        if got:
            found.append(got)
    return sorted(set(found), key=lambda x: (x[1], -x[2], x[0]))


def corrected(data: bytes, declared: str | None, a=None) -> tuple[str, list[tuple[str, int, int]]]:
    """The type of the value, and the media embedded in it."""
    found = sniff(data, a)
    whole = [x for x in found if x[1] == 0 and x[2] == len(data)]
    if whole:
        return whole[0][0], [x for x in found if x is not whole[0]]
    if not data:
        return "application/x-empty", []
    text = declared and declared.startswith("text/")
    return (declared if text else "application/octet-stream"), found


def sniffed(media: DataFrame, value: str = "bytes", declared: str = "declared") -> DataFrame:
    """(id, type, bytes, embedded): the corrected type and the places of embedded media, for media(id, declared, bytes)."""
    reachable(media.sparkSession)
    part = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("id", pa.int64()), ("type", pa.string()), ("n_bytes", pa.int64()), ("embedded", pa.list_(part))])

    def run(batches):
        a = automaton()
        for b in batches:
            ids, declared_, values = b.column(0), b.column(1).to_pylist(), b.column(2)
            for lo, hi in slices(values, 4 << 20):
                types, sizes, inner = [], [], []
                for d, v in zip(declared_[lo:hi], values.slice(lo, hi - lo).to_pylist()):
                    kind, found = corrected(v or b"", d, a)
                    types.append(kind)
                    sizes.append(len(v or b""))
                    inner.append([{"type": k, "start": s, "length": e - s} for k, s, e in found])
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(types, pa.string()), pa.array(sizes, pa.int64()), pa.array(inner, pa.list_(part))], schema=schema)

    return media.select(F.col("id").cast("long"), F.col(declared).cast("string"), F.col(value).cast("binary")).mapInArrow(run, "id long, type string, n_bytes long, embedded array<struct<type:string,start:long,length:long>>")


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A WAVE file of the payload as unsigned 8-bit mono samples."""
    pad = len(payload) & 1
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + pad, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * pad


def wav_samples(data: bytes, start: int, end: int) -> tuple[bytes, int]:
    """Samples and rate of a valid WAVE medium at [start, end)."""
    p, rate = start + 12, 0
    while p + 8 <= end:
        name, n = struct.unpack_from("<4sI", data, p)
        if name == b"fmt ":
            rate = struct.unpack_from("<I", data, p + 12)[0]
        if name == b"data":
            return data[p + 8 : p + 8 + n], rate
        p += 8 + n + (n & 1)
    return b"", rate


def carved(media: DataFrame, value: str = "bytes", declared: str = "declared") -> DataFrame:
    """(id, type, start, carved): a row for each medium embedded in a value of media(id, declared, bytes), with its bytes."""
    places = sniffed(media, value, declared).select("id", F.explode("embedded").alias("e")).distinct()
    return media.select("id", F.col(value).cast("binary").alias("v")).join(places, "id").select("id", "e.type", "e.start", F.expr("substring(v, int(e.start) + 1, int(e.length))").alias("carved"))


def as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, declared, bytes): each text as a WAVE file of 8-bit samples, padded to a multiple of 64."""
    reachable(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("declared", pa.string()), ("bytes", pa.binary())])

    def run(batches):
        for b in batches:
            for lo, hi in slices(b.column(1), 4 << 20):
                raw, off = text_bytes(b.column(1).slice(lo, hi - lo))
                size = np.diff(off)
                files = [to_wav(raw[off[i] : off[i + 1]].tobytes() + b"\0" * (max(64, -(-n // 64) * 64) - n)) for i, n in enumerate(size.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(["application/octet-stream"] * (hi - lo)), pa.array(files, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, declared string, bytes binary")


def read_back(media: DataFrame) -> DataFrame:
    """The contract's columns and the found type, from media(doc_id, n_bytes, declared, bytes)."""
    reachable(media.sparkSession)
    kinds = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    schema = pa.schema(kinds)

    def row(data: bytes, declared: str, a) -> tuple:
        kind, inner = corrected(data, declared, a)
        payload, rate = wav_samples(data, 0, len(data)) if kind == "audio/wav" else (b"", 0)
        s = np.frombuffer(payload, np.uint8)
        level = int(s.sum(dtype=np.uint64))
        turns = int(np.count_nonzero(np.diff((s >= 128).view(np.int8))))
        feature = f"{kind};{rate}Hz;u8;{len(s)} samples;mean {level / max(1, len(s)):.3f};crossings {turns};embedded {','.join(f'{k}@{x}+{y - x}' for k, x, y in inner) or '-'}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches):
        a = automaton()
        for b in batches:
            for lo, hi in slices(b.column(3), 4 << 20):
                part = b.slice(lo, hi - lo)
                rows = [row(v.as_buffer().to_pybytes(), d, a) for v, d in zip(part.column(3), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds[2:]))], schema=schema)

    return media.select("doc_id", "n_bytes", "declared", "bytes").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def stored_as_media(docs: DataFrame) -> DataFrame:
    """Each text stored as a WAVE file in a media column, written; then read back, sniffed and measured."""
    return read_back(stored(as_media(docs), "media", compression="zstd"))
