"""Media columns: what bytes really are, by signature, structure and length.

One Aho-Corasick automaton finds the magic bytes of all formats in a single pass over a value; the format's validator
then walks the structure from there (chunks, segments, blocks, checksums) and tells where the medium ends, or that it is
none. A value whose medium starts at byte 0 gets that type, whatever was declared; media elsewhere are carved out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

UNIT, PAD = 192, b" "
RATE = 8000


# -- containers ----------------------------------------------------------------------------------------------------
def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples as a RIFF/WAVE file; a byte of padding follows an odd number of samples."""
    odd = len(payload) & 1
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + odd) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8)
    return head + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * odd


def wav_samples(stored: bytes) -> bytes:
    """The data chunk of a RIFF/WAVE file."""
    at = 12
    while at + 8 <= len(stored):
        (size,) = struct.unpack_from("<I", stored, at + 4)
        if stored[at : at + 4] == b"data":
            return stored[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


# -- validators: (bytes, start) -> the byte after the medium, or None ------------------------------------------------
def _png(b: bytes, at: int) -> int | None:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        (size,) = struct.unpack_from(">I", b, p)
        end = p + 12 + size
        if end > len(b) or (first and b[p + 4 : p + 8] != b"IHDR") or zlib.crc32(b[p + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return None
        if b[p + 4 : p + 8] == b"IEND":
            return end
        p, first = end, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)
    while p < len(b):
        kind = b[p]
        if kind == 0x3B:
            return p + 1
        if kind == 0x21:
            p += 2
        elif kind == 0x2C:
            if p + 10 > len(b):
                return None
            flags = b[p + 9]
            p += 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1
        else:
            return None
        while p < len(b) and b[p]:
            p += b[p] + 1
        p += 1
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p, framed, scanned = at + 2, False, False
    while p + 4 <= len(b):
        if b[p] != 0xFF:
            return None
        kind = b[p + 1]
        if kind == 0xFF:
            p += 1
            continue
        if kind == 0xD9:
            return p + 2 if scanned else None
        if kind in (0x01, *range(0xD0, 0xD9)):
            return None
        (size,) = struct.unpack_from(">H", b, p + 2)
        if size < 2:
            return None
        p += 2 + size
        framed |= 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC)
        if kind == 0xDA:
            if not framed:
                return None
            scanned = True
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
    return p + 2 if scanned and b[p : p + 2] == b"\xff\xd9" else None


def _riff(kind: bytes, needs: tuple[bytes, ...]) -> Callable[[bytes, int], int | None]:
    def run(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != kind:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        p, seen = at + 12, set()
        while p + 8 <= end:
            (size,) = struct.unpack_from("<I", b, p + 4)
            seen.add(b[p : p + 4])
            p += 8 + size + (size & 1)
        return end if p == end and (not needs or seen & set(needs)) else None

    return run


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, zero, offset, head = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    ok = not zero and head in (40, 108, 124) and 14 + head <= offset <= size and at + size <= len(b) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if ok else None


def _pdf(b: bytes, at: int) -> int | None:
    if not b[at + 5 : at + 6].isdigit():
        return None
    after = b.find(b"%PDF-", at + 5)
    end = b.rfind(b"%%EOF", at, after if after >= 0 else len(b))
    return end + 5 if end >= 0 and b.find(b"startxref", at, end) >= 0 else None


@lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """Where the archives of a value end, by where they begin: an end record tells its archive's length, so one search of
    the value finds them all. Of several that begin at one place the first counts."""
    out: dict[int, int] = {}
    p = 0
    while (p := b.find(b"PK\x05\x06", p)) >= 0:
        if p + 22 <= len(b):
            size, offset, note = struct.unpack_from("<IIH", b, p + 12)
            at = p - size - offset
            if at >= 0 and b[at + offset : at + offset + 4] == b"PK\x01\x02" and p + 22 + note <= len(b):
                out.setdefault(at, p + 22 + note)
        p += 4
    return out


def _zip(b: bytes, at: int) -> int | None:
    return _zip_ends(b).get(at)


def _gzip(b: bytes, at: int) -> int | None:
    d = zlib.decompressobj(31)
    p = at
    try:
        while not d.eof:
            piece = d.unconsumed_tail or b[p : p + 65536]
            if not d.unconsumed_tail:
                p += 65536
            if not piece:
                return None
            d.decompress(piece, 1 << 20)
    except zlib.error:
        return None
    return min(p, len(b)) - len(d.unused_data)


_MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _ogg_sum(page: bytes) -> int:
    """A page's checksum: the usual polynomial, but bits from the other end, and nothing inverted."""
    plain = zlib.crc32(page.translate(_MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{plain:032b}"[::-1], 2)


def _ogg(b: bytes, at: int) -> int | None:
    """Pages whose checksums are right, as far as they go."""
    p, end = at, None
    while p + 27 <= len(b) and b[p : p + 4] == b"OggS" and b[p + 4] == 0:
        table_ = b[p + 27 : p + 27 + b[p + 26]]
        after = p + 27 + len(table_) + sum(table_)
        if after > len(b) or _ogg_sum(b[p : p + 22] + bytes(4) + b[p + 26 : after]) != int.from_bytes(b[p + 22 : p + 26], "little"):
            break
        p = end = after
    return end


def _remainders(bits: int, polynomial: int) -> list[int]:
    """What each byte leaves when divided by a polynomial of so many bits."""
    out, top, mask = [], 1 << (bits - 1), (1 << bits) - 1
    for value in range(256):
        value <<= bits - 8
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & top else value << 1) & mask
        out.append(value)
    return out


_CRC8, _CRC16 = _remainders(8, 0x07), _remainders(16, 0x8005)


def _flac_head(b: bytes, p: int) -> tuple[int, int] | None:
    """(byte after the head, samples) of the frame at ``p``; None if its head, with its checksum, is none."""
    if len(b) < p + 6 or b[p] != 0xFF or b[p + 1] & 0xFE != 0xF8 or b[p + 3] & 1:
        return None
    size, rate, channels, depth = b[p + 2] >> 4, b[p + 2] & 15, b[p + 3] >> 4, b[p + 3] >> 1 & 7
    more = 8 - (b[p + 4] ^ 0xFF).bit_length()  # bytes of the frame's number
    if not size or rate == 15 or channels > 10 or depth == 3 or more in (1, 8):
        return None
    at = p + 4 + max(more, 1)
    if any(x & 0xC0 != 0x80 for x in b[p + 5 : at]):
        return None
    wide, fast = {6: 1, 7: 2}.get(size, 0), {12: 1, 13: 2, 14: 2}.get(rate, 0)
    samples = int.from_bytes(b[at : at + wide], "big") + 1 if wide else 192 if size == 1 else 576 << size - 2 if size < 6 else 256 << size - 8
    end, crc = at + wide + fast + 1, 0
    for x in b[p:end]:
        crc = _CRC8[crc ^ x]
    return (end, samples) if end <= len(b) and not crc else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks, then frames up to the number of samples that the first block names.

    A frame tells no length: it ends where its checksum comes out, and for all but the last also where another one's head
    begins. In the last, chance gives a false end once in 65,536 bytes.
    """
    p, info = at + 4, None
    while True:
        if p + 4 > len(b):
            return None
        kind, size = b[p], int.from_bytes(b[p + 1 : p + 4], "big")
        if info is None:
            if kind & 0x7F or size != 34 or p + 38 > len(b):
                return None
            info = b[p + 4 : p + 38]
        p += 4 + size
        if kind & 0x80:
            break
    left = int.from_bytes(info[13:18], "big") & (1 << 36) - 1
    least, known = int.from_bytes(info[4:7], "big"), left > 0
    while (head := _flac_head(b, p)) is not None:
        first, samples = head
        left, crc, end, q = left - samples, 0, None, p
        for q in range(p, len(b)):
            crc = (crc << 8 & 0xFFFF) ^ _CRC16[crc >> 8 ^ b[q]]
            if not crc and q + 1 >= max(first + 3, p + least):
                follows = _flac_head(b, q + 1) is not None
                if follows or left <= 0 and known or not known and end is None:
                    end = q + 1
                    if follows or known:
                        break
        if end is None:
            return None
        p = end
        if known and left <= 0:
            return p
        if not known and _flac_head(b, p) is None:
            return p
    return None


def _mp4(b: bytes, at: int) -> int | None:
    at -= 4
    if at < 0:
        return None
    p, seen = at, set()
    while p + 8 <= len(b):
        size, kind = struct.unpack_from(">I", b, p)[0], b[p + 4 : p + 8]
        if size < 8 or p + size > len(b) or not kind.isalnum():
            break
        seen.add(kind)
        p += size
    return p if b"ftyp" in seen and seen & {b"moov", b"mdat", b"meta", b"moof"} else None


#: Signature, type, bytes before the signature, validator.
FORMATS: list[tuple[bytes, str, int, Callable[[bytes, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", 0, _png),
    (b"GIF87a", "image/gif", 0, _gif),
    (b"GIF89a", "image/gif", 0, _gif),
    (b"\xff\xd8\xff", "image/jpeg", 0, _jpeg),
    (b"RIFF", "audio/wav", 0, _riff(b"WAVE", (b"data",))),
    (b"RIFF", "image/webp", 0, _riff(b"WEBP", (b"VP8 ", b"VP8L", b"VP8X"))),
    (b"RIFF", "video/avi", 0, _riff(b"AVI ", (b"LIST",))),
    (b"BM", "image/bmp", 0, _bmp),
    (b"%PDF-", "application/pdf", 0, _pdf),
    (b"PK\x03\x04", "application/zip", 0, _zip),
    (b"\x1f\x8b\x08", "application/gzip", 0, _gzip),
    (b"OggS", "audio/ogg", 0, _ogg),
    (b"fLaC", "audio/flac", 0, _flac),
    (b"ftyp", "video/mp4", 4, _mp4),
]


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.by_magic: dict[bytes, list] = {}
        for magic, kind, before, check in FORMATS:
            self.by_magic.setdefault(magic, []).append((kind, before, check))
        self.automaton = ahocorasick.Automaton()
        for magic in self.by_magic:
            self.automaton.add_word(magic.decode("latin-1"), magic)
        self.automaton.make_automaton()

    def media(self, b: bytes) -> list[tuple[str, int, int]]:
        """(type, start, end) of the outermost media in order; what lies inside of one is part of it."""
        out: list[tuple[str, int, int]] = []
        free = 0
        for last, magic in self.automaton.iter(b.decode("latin-1")):
            at = last + 1 - len(magic)
            for kind, before, check in self.by_magic[magic]:
                if at - before >= free and (end := check(b, at)) is not None:
                    out.append((kind, at - before, end))
                    free = end
                    break
        return out


SPANS = "array<struct<type:string,start:long,length:long>>"


def sniff(df: DataFrame, content_col: str, declared_col: str) -> DataFrame:
    """``df`` with detected_type, media_length, corrected and embedded.

    detected_type is the type of the valid medium at byte 0 (null: none), media_length its bytes, corrected whether that
    differs from what was declared (a null declaration differs), embedded the other media found. A null or empty value
    has none of them. Columns of those names, in any case, are replaced; all others are kept.
    """
    added = ["detected_type", "media_length", "corrected", "embedded"]
    df = df.drop(*added)  # in any case
    place, told = df.columns.index(content_col), df.columns.index(declared_col)
    from pyspark.sql.types import StructType

    schema = StructType(list(df.schema.fields)).add("detected_type", "string").add("media_length", "long").add("corrected", "boolean")
    schema = schema.add("embedded", StructType.fromDDL(f"x {SPANS}")["x"].dataType)
    kind = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                found = sniffer.media(batch.column(place)[i].as_py() or b"")
                whole = found[0] if found and found[0][1] == 0 else None
                out[0].append(whole and whole[0])
                out[1].append(whole and whole[2])
                out[2].append(bool(whole) and batch.column(told)[i].as_py() != whole[0])
                out[3].append([{"type": k, "start": a, "length": b - a} for k, a, b in found[bool(whole) :]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], kind)], names=[*batch.schema.names, *added]
            )

    return df.mapInArrow(run, schema)


def carve(df: DataFrame, content_col: str, embedded_col: str = "embedded") -> DataFrame:
    """One row per embedded medium: the columns of ``df`` without these two, and media_type, media_start, media_bytes, which
    replace columns of those names in any case. Rows without embedded media, nulls and empty tables give none; rows that
    repeat give theirs each; contents of any length are cut in place."""
    keep = df.drop(content_col, embedded_col, "media_type", "media_start", "media_bytes").columns
    each = df.select(*keep, F.col(content_col).alias("_content"), F.explode(embedded_col).alias("_m"))
    cut = F.expr("substring(_content, cast(_m.start + 1 as int), cast(_m.length as int))")
    return each.select(*keep, F.col("_m.type").alias("media_type"), F.col("_m.start").alias("media_start"), cut.alias("media_bytes"))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and content: each text as samples of a WAVE file. Null counts as empty; rows that repeat an id are
    stored each for itself. A text of 4 GB and more does not fit a WAVE file; Spark's strings end at 2 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(x.as_py() or "").encode() for x in batch.column(1)]
            wavs = [to_wav(t + PAD * (max(1, -(-len(t) // UNIT)) * UNIT - len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(wavs, pa.binary())], names=["doc_id", "n_bytes", "content"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, content binary")


def samples_of(df: DataFrame) -> DataFrame:
    """Read the samples of sniffed WAVE values back; from doc_id, n_bytes, content and what ``sniff`` added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                if r.detected_type != "audio/wav" or r.media_length != len(r.content):
                    raise ValueError(f"document {r.doc_id} was not stored as one whole WAVE file")
                data = wav_samples(r.content)
                s = np.frombuffer(data, np.uint8).astype(np.int64) - 128
                feature = f"{r.detected_type};corrected={str(bool(r.corrected)).lower()};rate={RATE};samples={len(s)};peak={int(abs(s).max())};sum={int(s.sum())};crossings={int(((s[1:] < 0) != (s[:-1] < 0)).sum())};embedded={len(r.embedded)}"
                rows.append((r.doc_id, r.n_bytes, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(r.content), hashlib.sha256(r.content).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return df.mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media_columns(spark, sf_dir: str) -> DataFrame:
    """Every text stored as a WAVE file, sniffed, its declaration corrected where it is wrong (for odd and missing ids), and read
    back."""
    right = F.when(F.col("doc_id") % 2 == 0, "audio/wav").otherwise("application/octet-stream")
    return samples_of(sniff(store(table(spark, sf_dir, "documents")).withColumn("declared_type", right), "content", "declared_type"))


_LE = "printf('%02x%02x%02x%02x', {x} & 255, {x} >> 8 & 255, {x} >> 16 & 255, {x} >> 24 & 255)"
#: The stored form put together by hand: header, samples; and what the samples are.
OP8_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
m AS (SELECT *, CAST(greatest(1, (n + {UNIT - 1}) // {UNIT}) * {UNIT} AS BIGINT) AS size FROM d),
p AS (SELECT doc_id, n, size, encode(t || repeat(' ', size - n)) AS payload FROM m),
x AS (SELECT *, hex(payload) AS code FROM p),
s AS (SELECT *, list_transform(range(size), lambda i: CAST('0x' || substr(code, 2 * i + 1, 2) AS INT) - 128) AS v FROM x),
w AS (SELECT *, unhex('52494646' || {_LE.format(x='(36 + size)')} || '57415645666d7420' || '10000000' || '0100' || '0100' || {_LE.format(x=RATE)} || {_LE.format(x=RATE)} || '0100' || '0800' || '64617461' || {_LE.format(x='size')}) || payload AS media,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(v[size - 15:size], lambda y: (y + 128)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda y, _: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)), 4294967295::BIGINT) AS crc FROM s)
SELECT doc_id, n AS n_bytes, size AS payload_bytes, sha256(payload) AS payload_sha256, CAST(crc AS BIGINT) AS tail_crc32, CAST(octet_length(media) AS BIGINT) AS media_bytes, sha256(media) AS media_sha256,
  'audio/wav;corrected=' || CASE WHEN doc_id % 2 = 0 THEN 'false' ELSE 'true' END || ';rate={RATE};samples=' || size || ';peak=' || list_max(list_transform(v, lambda y: abs(y))) || ';sum=' || list_sum(v) ||
  ';crossings=' || len(list_filter(range(1, size), lambda i: (v[i] < 0) <> (v[i + 1] < 0))) || ';embedded=0' AS feature FROM w
"""
