"""Media columns: storing bytes as 8-bit samples, and sniffing types by signature.

An Aho-Corasick automaton finds all known magic bytes of a value in one pass. Each find is only a candidate: a validator of its format walks the
structure (chunks, check sums, blocks, declared lengths) and says how long the medium is, or that there is none. A medium at the start
corrects the declared type; media further in are carved with offset and length. Finds inside a carved medium are its own parts.

Nulls: null bytes are empty: no media, the declared type stays. Tables may be empty; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bound_arrow, map_arrow, materialize, only

#: Bytes of a block of samples.
UNIT = 64
RATE = 8000

#: The signatures of the formats, and where in the file each stands.
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": ("image/png", 0),
    b"\xff\xd8\xff": ("image/jpeg", 0),
    b"GIF87a": ("image/gif", 0),
    b"GIF89a": ("image/gif", 0),
    b"BM": ("image/bmp", 0),
    b"RIFF": ("riff", 0),
    b"fLaC": ("audio/flac", 0),
    b"OggS": ("audio/ogg", 0),
    b"ftyp": ("video/mp4", 4),
    b"%PDF-": ("application/pdf", 0),
    b"\x1f\x8b\x08": ("application/gzip", 0),
}


def _u32(data: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(order + "I", data, at)[0] if at + 4 <= len(data) else -1


def _png(d: bytes, at: int) -> int:
    p, first = at + 8, True
    while p + 12 <= len(d):
        n, kind = _u32(d, p, ">"), d[p + 4 : p + 8]
        if p + 12 + n > len(d) or zlib.crc32(d[p + 4 : p + 8 + n]) != _u32(d, p + 8 + n, ">") or (first and kind != b"IHDR"):
            return 0
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return 0


def _jpeg(d: bytes, at: int) -> int:
    p = at + 2
    while p + 4 <= len(d) and d[p] == 0xFF:
        kind = d[p + 1]
        if kind == 0xD9:
            return p + 2 - at
        n = int.from_bytes(d[p + 2 : p + 4], "big")
        if n < 2 or p + 2 + n > len(d):
            return 0
        p += 2 + n
        if kind == 0xDA:  # the scan's data: up to a marker that is neither stuffed nor a restart
            while True:
                p = d.find(b"\xff", p)
                if p < 0 or p + 1 >= len(d):
                    return 0
                if d[p + 1] == 0 or 0xD0 <= d[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return 0


def _gif(d: bytes, at: int) -> int:
    if at + 13 > len(d):
        return 0
    p = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(d) and d[p]:
            p += 1 + d[p]
        return p + 1

    while p < len(d):
        if d[p] == 0x3B:
            return p + 1 - at
        if d[p] == 0x21:
            p = blocks(p + 2)
        elif d[p] == 0x2C and p + 10 < len(d):
            p = blocks(p + 10 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 0x80 else 0) + 1)
        else:
            return 0
    return 0


def _bmp(d: bytes, at: int) -> int:
    n, start, head = _u32(d, at + 2), _u32(d, at + 10), _u32(d, at + 14)
    return n if at + n <= len(d) and head in (12, 40, 52, 56, 64, 108, 124) and 14 + head <= start <= n and d[at + 6 : at + 10] == bytes(4) else 0


def _riff(d: bytes, at: int) -> int:
    n = _u32(d, at + 4)
    if n < 4 or at + 8 + n > len(d) or d[at + 8 : at + 12] not in (b"WAVE", b"WEBP", b"AVI "):
        return 0
    p = at + 12
    while p + 8 <= at + 8 + n:
        p += 8 + _u32(d, p + 4) + (_u32(d, p + 4) & 1)
    return 8 + n if p == at + 8 + n else 0


def crc_table(polynomial: int, width: int) -> list[int]:
    """What each byte adds to a check sum of `width` bits, most significant bit first."""
    out, top, full = [], 1 << width - 1, (1 << width) - 1
    for byte in range(256):
        c = byte << width - 8
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & full
        out.append(c)
    return out


CRC8, CRC16, CRC32 = crc_table(0x07, 8), crc_table(0x8005, 16), crc_table(0x04C11DB7, 32)


def crc(data: bytes, table: list[int], width: int) -> int:
    c, full = 0, (1 << width) - 1
    for byte in data:
        c = c << 8 & full ^ table[c >> width - 8 ^ byte]
    return c


def _flac_frame(d: bytes, at: int) -> tuple[int, int]:
    """(bytes of the frame's header, its samples), (0, 0) if none begins here."""
    if d[at : at + 1] != b"\xff" or d[at + 1 : at + 2] not in (b"\xf8", b"\xf9") or at + 6 > len(d):
        return 0, 0
    size, rate = d[at + 2] >> 4, d[at + 2] & 15
    lead = d[at + 4]
    number = 1 if lead < 0x80 else next((k for k in range(2, 8) if lead >> 7 - k == (1 << k + 1) - 2), 0)
    if not size or not number:
        return 0, 0
    p = at + 4 + number
    if size in (6, 7):
        samples = int.from_bytes(d[p : p + size - 5], "big") + 1
        p += size - 5
    else:
        samples = 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    return (p + 1 - at, samples) if p < len(d) and crc(d[at:p], CRC8, 8) == d[p] else (0, 0)


def _flac(d: bytes, at: int) -> int:
    """Metadata blocks, then frames whose check sums hold, up to the stream's number of samples (or, if that is unknown, as far as frames follow)."""
    p, last, total = at + 4, False, 0
    while not last:
        if p + 4 > len(d):
            return 0
        last, kind, n = bool(d[p] & 0x80), d[p] & 0x7F, int.from_bytes(d[p + 1 : p + 4], "big")
        if (kind == 0) != (p == at + 4) or (kind == 0 and n != 34) or p + 4 + n > len(d):
            return 0
        if kind == 0:
            total = int.from_bytes(d[p + 17 : p + 22], "big") & (1 << 36) - 1
        p += 4 + n
    seen = 0
    while not total or seen < total:
        head, samples = _flac_frame(d, p)
        if not head:
            break
        seen += samples
        c, end = crc(d[p : p + head], CRC16, 16), 0
        for q in range(p + head, len(d) - 1):  # the frame ends where its check sum stands, at the stream's end or before another frame
            if c == d[q] << 8 | d[q + 1] and ((total and seen >= total) or _flac_frame(d, q + 2)[0] or (not total and q + 2 == len(d))):
                end = q + 2
                break
            c = c << 8 & 0xFFFF ^ CRC16[c >> 8 ^ d[q]]
        if not end:
            return 0
        p = end
    return p - at if seen and seen >= total else 0


def _ogg(d: bytes, at: int) -> int:
    """Pages whose check sums hold, up to one that ends the stream."""
    p = at
    while d[p : p + 4] == b"OggS" and p + 27 <= len(d) and d[p + 4] == 0:
        n = d[p + 26]
        q = p + 27 + n + sum(d[p + 27 : p + 27 + n])
        if q > len(d) or crc(d[p : p + 22] + bytes(4) + d[p + 26 : q], CRC32, 32) != _u32(d, p + 22):
            return 0
        p, last = q, d[p + 5] & 4
        if last:
            return p - at
    return 0


def _mp4(d: bytes, at: int) -> int:
    """Top-level boxes; a size of 1 stands for 64 bits behind the kind, one of 0 for all the rest."""
    p, kinds = at, []
    while p + 8 <= len(d):
        n, kind = _u32(d, p, ">"), d[p + 4 : p + 8]
        n, least = (int.from_bytes(d[p + 8 : p + 16], "big"), 16) if n == 1 else (n or len(d) - p, 8)
        if n < least or p + n > len(d) or kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"wide", b"udta", b"moof", b"sidx", b"uuid"):
            break
        kinds.append(kind)
        p += n
    return p - at if b"ftyp" in kinds[:1] and len(kinds) > 1 else 0


def _pdf(d: bytes, at: int) -> int:
    """Up to the last end mark before another PDF begins; each part that an update added has its startxref."""
    nxt = d.find(b"%PDF-", at + 1)
    nxt = len(d) if nxt < 0 else nxt
    p = end = at
    while (e := d.find(b"%%EOF", p, nxt)) >= 0 and d.find(b"startxref", p, e) >= 0:
        p = end = e + 5
    return end - at


def _gzip(d: bytes, at: int) -> int:
    z = zlib.decompressobj(31)
    try:
        for p in range(at, len(d), 1 << 16):
            z.decompress(d[p : p + (1 << 16)])
            if z.eof:
                return min(p + (1 << 16), len(d)) - len(z.unused_data) - at
    except zlib.error:
        pass
    return 0


VALIDATORS = {"image/png": _png, "image/jpeg": _jpeg, "image/gif": _gif, "image/bmp": _bmp, "riff": _riff, "audio/flac": _flac, "audio/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/gzip": _gzip}


@functools.cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, (kind, lead) in SIGNATURES.items():
        a.add_word(magic.decode("latin-1"), (len(magic), kind, lead))
    a.make_automaton()
    return a


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, offset, length) of the media in the bytes, in order, none inside another."""
    found: list[tuple[int, str]] = []
    for end, (n, kind, lead) in automaton().iter(data.decode("latin-1")):
        if (at := end + 1 - n - lead) >= 0:
            found.append((at, kind))
    out, free = [], 0
    for at, kind in sorted(found):
        if at < free:
            continue
        n = VALIDATORS[kind](data, at)
        if n:
            out.append((_subtype(data, at) if kind == "riff" else kind, at, n))
            free = at + n
    return out


def _subtype(data: bytes, at: int) -> str:
    return {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}[data[at + 8 : at + 12]]


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """The bytes as 8-bit mono samples."""
    pad = b"\0" * (len(payload) & 1)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    body = b"WAVE" + fmt + struct.pack("<4sI", b"data", len(payload)) + payload + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> bytes:
    """The samples of the data chunk."""
    p, end = 12, 8 + _u32(media, 4)
    while p + 8 <= end:
        n = _u32(media, p + 4)
        if media[p : p + 4] == b"data":
            return media[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)
    raise ValueError("no data chunk")


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + b"\0" * (max(unit, -(-len(data) // unit) * unit) - len(data))


def store_texts(docs: DataFrame, unit: int = UNIT) -> DataFrame:
    """doc_id, n_bytes, declared type and media: each text's padded UTF-8 as a WAV of 8-bit samples, declared as unknown bytes."""
    bound_arrow(docs.sparkSession)

    def run(b: pa.RecordBatch) -> dict:
        texts = as_bytes(b.column("text").fill_null(""))
        return {"doc_id": b.column("doc_id"), "n_bytes": pa.array([len(t) for t in texts], pa.int64()), "declared": pa.array(["application/octet-stream"] * len(texts)), "media": pa.array([to_wav(pad(t, unit)) for t in texts], pa.binary())}

    rows = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return map_arrow(rows, run, "doc_id bigint, n_bytes bigint, declared string, media binary", "text")


def sniff_column(rows: DataFrame, column: str = "media", declared: str = "declared", digest: bool = False) -> DataFrame:
    """Adds `media_type` (corrected), `carved` (type, offset, length) of further media and, if asked for, digests of a WAV column's samples."""
    bound_arrow(rows.sparkSession)
    keep = [f for f in rows.schema.fields if f.name != column]
    more = ", payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" * digest

    def run(b: pa.RecordBatch) -> dict:
        kinds, carved, rest = [], [], []
        for data, said in zip((x if x is not None else b"" for x in b.column(column).to_pylist()), b.column(declared).to_pylist(), strict=True):
            found = sniff(data)
            own = found[0][0] if found and found[0][1] == 0 else said
            kinds.append(own)
            inner = found[1:] if found and found[0][1] == 0 else found
            if digest:
                payload = from_wav(data)
                inner = [(k, at + 44, n) for k, at, n in sniff(payload)]  # what the samples carry
                rest.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(own, payload, inner)))
            carved.append([{"type": k, "offset": at, "length": n} for k, at, n in inner])
        out = {f.name: b.column(f.name) for f in keep}
        out |= {"media_type": pa.array(kinds, pa.string()), "carved": pa.array(carved, pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])))}
        if digest:
            for k, (name, kind) in enumerate((("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))):
                out[name] = pa.array([r[k] for r in rest], kind)
        return out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", media_type string, carved array<struct<type: string, offset: bigint, length: bigint>>" + more
    return map_arrow(rows, run, schema, column)


def feature(kind: str, payload: bytes, inner: list) -> str:
    """Type, mean and spread of the samples, steps that change sign about the mean, and how many media the samples carry."""
    x = np.frombuffer(payload, dtype=np.uint8)
    mean = float(x.mean())
    above = x > mean
    return f"{kind};mean={mean:.4f};std={float(x.std()):.4f};crossings={int(np.count_nonzero(above[1:] != above[:-1]))};carved={len(inner)}"


def media_column(docs: DataFrame) -> DataFrame:
    """Stores the texts of documents as media, reads the stored bytes back and describes them."""
    return sniff_column(materialize(store_texts(docs), "media"), digest=True)
