import gzip
import hashlib
import io
import struct
import wave
import zipfile
import zlib

from tidemill.llm import media


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0ab\0cd")) + chunk(b"IEND", b"")


def zipped():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\0" + b"\x3b"
JPEG = b"\xff\xd8\xff\xe0\x00\x10JFIF\0" + bytes(9) + b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00" + b"\xff\xda\x00\x04ab" + b"data\xff\x00more\xff\xd9"
BMP = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"abc\0"
PDF = b"%PDF-1.4\nstuff\nstartxref\n0\n%%EOF"
OGG = b"OggS\0" + bytes(17) + bytes.fromhex("d46c02be") + b"\x01\x05hello"


def crc(data, bits, polynomial):
    out = 0
    for byte in data:
        out ^= byte << bits - 8
        for _ in range(8):
            out = (out << 1 ^ polynomial if out >> bits - 1 else out << 1) & (1 << bits) - 1
    return out.to_bytes(bits // 8, "big")


def flac(frames=3, samples=192, known=True):
    """Eight-bit mono frames with a constant, then verbatim samples, by the format's description."""
    total = frames * samples if known else 0
    info = struct.pack(">HH", samples, samples) + bytes(6) + (8000 << 44 | 0 << 41 | 7 << 36 | total).to_bytes(8, "big") + bytes(16)
    out = b"fLaC\x00\x00\x00\x22" + info + b"\x81\x00\x00\x03abc"
    for i in range(frames):
        head = b"\xff\xf8" + bytes([0x10 | 4, 0 << 4 | 1 << 1]) + (bytes([i]) if i < 128 else chr(i).encode())
        body = head + crc(head, 8, 7) + (b"\x00\x05" if i % 2 else b"\x02" + bytes((i * 7 + k) % 251 for k in range(samples)))
        out += body + crc(body, 16, 0x8005)
    return out


FLAC = flac()
MP4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 12) + b"mdatabcd"
WEBP = b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8L" + struct.pack("<I", 4) + b"abcd"
ALL = {"image/png": png(), "image/gif": GIF, "image/jpeg": JPEG, "image/bmp": BMP, "application/pdf": PDF, "application/zip": zipped(), "application/gzip": gzip.compress(b"x" * 100_000), "audio/ogg": OGG, "audio/flac": FLAC, "video/mp4": MP4, "image/webp": WEBP, "audio/wav": media.to_wav(b"abc")}


def test_each_format_alone_and_carved():
    s = media.Sniffer()
    for kind, b in ALL.items():
        assert s.media(b) == [(kind, 0, len(b))], kind
        if kind != "audio/flac":
            assert s.media(b"text BM GIF89a " + b + b" tail") == [(kind, 15, 15 + len(b))], kind
        for cut in (1, len(b) // 2):
            assert not any(k == kind and (a, e) == (0, len(b)) for k, a, e in s.media(b[:-cut])), kind
    broken = bytearray(png())
    broken[40] ^= 1
    assert s.media(bytes(broken)) == []


def test_wave_library_reads_it():
    with wave.open(io.BytesIO(media.to_wav(b"abcde"))) as w:
        assert w.readframes(9) == b"abcde" and w.getsampwidth() == 1


def test_sniff_and_carve(spark):
    rows = [(1, ALL["image/png"], "image/gif", "x"), (2, b"..." + GIF + b"--" + png(), "text/plain", "x"), (3, None, None, None), (4, b"", "a", "x"), (5, b"plain", None, "x"), (6, GIF, "image/gif", "x")]
    df = spark.createDataFrame(rows, "doc_id long, content binary, declared string, embedded string")
    got = {r.doc_id: r for r in media.sniff(df, "content", "declared").collect()}
    assert [(got[i].detected_type, got[i].corrected, len(got[i].embedded)) for i in range(1, 7)] == [("image/png", True, 0), (None, False, 2), (None, False, 0), (None, False, 0), (None, False, 0), ("image/gif", False, 0)]
    cut = media.carve(media.sniff(df, "content", "declared"), "content").collect()
    assert {(r.doc_id, r.media_type, bytes(r.media_bytes)) for r in cut} == {(2, "image/gif", GIF), (2, "image/png", png())}


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = media.op8_media_columns(spark, sf_dir).collect()
    assert len(got) == len(text)
    for r in got:
        raw = text[r.doc_id].encode()
        padded = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert r.media_bytes == len(padded) + 44 and f"corrected={'true' if r.doc_id % 2 else 'false'}" in r.feature


def test_edge_cases(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "é" * 96, 1), (None, "x", None), (4, "RIFF" * 50_000, 1), (4, "RIFF" * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, content int")
    got = media.samples_of(media.sniff(media.store(docs).selectExpr("*", "'x' as declared"), "content", "declared")).collect()
    assert sorted((r.n_bytes, r.payload_bytes) for r in got) == [(0, 192), (0, 192), (1, 192), (192, 192), (200_000, 200_064), (200_000, 200_064)]


def test_many_headers_without_an_archive_take_linear_time():
    import time

    from tidemill.llm import media

    took = []
    for n in (4_000, 32_000):
        b = b"PK\x03\x04" + bytes(6)
        start = time.perf_counter()
        assert all(media._zip(b * n, at) is None for at in range(0, 200, 10))
        value = b * n
        assert media._zip(value, 0) is None and all(media._zip(value, at) is None for at in range(0, len(value), 10))
        took.append(time.perf_counter() - start)
    assert took[1] < 60 * max(took[0], 0.005)


def test_archives_within_a_value():
    import io
    import zipfile

    from tidemill.llm import media

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "x" * 50)
    one = out.getvalue()
    value = b"some text " + one + b" between " + one + b"!"
    first, second = 10, 10 + len(one) + 9
    assert media._zip(value, first) == first + len(one) and media._zip(value, second) == second + len(one)
    assert media._zip(value, first + 1) is None


def test_columns_of_any_case_are_replaced(spark):
    rows = spark.createDataFrame([(bytearray(b"xx"), "a/b", 1, 2)], "content binary, declared string, Embedded int, Media_Type int")
    found = media.sniff(rows, "content", "declared")
    assert found.select("embedded").first()[0] == [] and media.carve(found, "content").collect() == []


def test_checksums_and_frames_are_confirmed():
    def by_bits(page):
        crc = 0
        for byte in page:
            crc ^= byte << 24
            for _ in range(8):
                crc = ((crc << 1) ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
        return crc

    bare = OGG[:22] + bytes(4) + OGG[26:]
    assert by_bits(bare) == media._ogg_sum(bare) == int.from_bytes(OGG[22:26], "little")
    find = media.Sniffer().media
    assert find(OGG) and not find(OGG[:-1] + b"O") and not find(JPEG.replace(b"\xff\xc0", b"\xff\xe1"))
    assert find(OGG + OGG + OGG[:-1]) == [("audio/ogg", 0, 2 * len(OGG))]


def test_flac_frames():
    find = media.Sniffer().media
    for value in (flac(1), flac(2), flac(200), flac(4, known=False)):
        assert find(value) == [("audio/flac", 0, len(value))]
        assert find(b"text " + value + b" more text" * 3) == [("audio/flac", 5, 5 + len(value))]
    broken = bytearray(FLAC)
    broken[-10] ^= 1
    assert not find(bytes(broken)) and not find(FLAC[:-1]) and not find(FLAC[:60])
