"""MPEG audio: round trips, a reader of its own for what the writer makes, foreign tags and tables, and damage of all kinds."""

import hashlib
import random
import struct
import zlib

from pyspark.sql import functions as F

from tallyspark.llm import mpeg_audio

ODD = [None, "", " ", "a", "é", "a\x00b", "x" * 5000, "z" * 937 * 3, "z" * 937 * 64, "日本語 テキスト", "µ" * 100_000]


def plain_crc(data):
    """CRC-16 bit by bit over a long division."""
    bits = "".join(f"{x:08b}" for x in data)
    register = [1] * 16
    for bit in bits:
        out = register.pop(0) ^ int(bit)
        register.append(0)
        if out:
            for place in (0, 13, 15):
                register[place] ^= 1
    return int("".join(map(str, register)), 2)


def plain_reader(media):
    """(payload, offsets, table, end) of a file of 48 kHz mono Layer III frames with checksums, by the format's arithmetic alone."""
    assert media[:3] == b"ID3" and media[-128:-125] == b"TAG"
    at = 10 + sum(b << s for b, s in zip(media[6:10], (21, 14, 7, 0), strict=True))
    kbps = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
    offsets, payload, table = [], b"", None
    while at < len(media) - 128:
        size = 144 * kbps[media[at + 2] >> 4] * 1000 // 48_000
        if media[at + 21 : at + 25] == b"Xing":
            table = struct.unpack(">III", media[at + 25 : at + 37]) + (media[at + 37 : at + 137], at)
        else:
            assert struct.unpack(">H", media[at + 4 : at + 6])[0] == plain_crc(media[at + 2 : at + 4] + media[at + 6 : at + 23])
            offsets.append(at)
            payload += media[at + 23 : at + size]
        at += size
    return payload, offsets, table, at


def test_round_trip():
    for text in ODD:
        payload, n = mpeg_audio.padded(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64
        media = mpeg_audio.encode(payload, n)
        got = mpeg_audio.decode(media)
        assert got["payload"] == payload and got["n_bytes"] == n and got["table_ok"] and not got["crc_bad"] and not got["resyncs"]
        assert got["samples"] == 1152 * len(got["offsets"]) and all(mpeg_audio.header(media[o : o + 4]) for o in got["offsets"])


def test_against_another_reader():
    for text in ["", "q" * 100, "q" * 9000]:
        payload, n = mpeg_audio.padded(text)
        media = mpeg_audio.encode(payload, n)
        carried, offsets, table, end = plain_reader(media)
        got = mpeg_audio.decode(media)
        assert carried[: len(payload)] == payload and not carried[len(payload) :].strip(b"\0")
        assert offsets == got["offsets"] and got["crc_ok"] == len(offsets)
        flags, frames, size, toc, origin = table
        assert (flags, frames, size) == (7, len(offsets), end - origin) and list(toc) == got["table"]["toc"] and list(toc) == sorted(toc)
        assert all(abs(origin + toc[i] * size // 256 - offsets[i * frames // 100]) <= size // 256 + 1 or toc[i] == 255 for i in range(100))


def test_crc_of_the_format():
    assert mpeg_audio.crc16(b"123456789") == plain_crc(b"123456789") == 0xAEE7


def test_damage():
    whole = mpeg_audio.encode(*mpeg_audio.padded("q" * 9000))
    at = mpeg_audio.decode(whole)["offsets"]
    spoilt = whole[: at[2] + 8] + bytes([whole[at[2] + 8] ^ 1]) + whole[at[2] + 9 :]
    assert mpeg_audio.decode(spoilt)["crc_bad"] == 1
    torn = whole[: at[3]] + b"\xff\xfajunk" + whole[at[3] :]
    assert mpeg_audio.decode(torn)["resyncs"] >= 1 and len(mpeg_audio.decode(torn)["offsets"]) == len(at)
    for junk in (None, b"", b"ID3", b"\xff" * 50, bytes(range(256)) * 3):
        assert mpeg_audio.decode(junk)["samples"] == 0 or junk


def tag(fields, version=3):
    body = b""
    for name, data in fields:
        size = len(data) if version != 4 else sum((len(data) >> 7 * i & 127) << 8 * i for i in range(4))
        body += name + (size.to_bytes(3, "big") if version == 2 else size.to_bytes(4, "big") + b"\0\0") + data
    return b"ID3" + bytes([version, 0, 0]) + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body


def test_what_once_crashed():
    frame = bytes([0xFF, 0xF3, 0x18, 0xC0])
    size = mpeg_audio.header(frame)[0]
    assert mpeg_audio.decode(frame + bytes(9) + b"Xing")["samples"] == 0 and mpeg_audio.decode((frame + bytes(9) + b"Xing").ljust(size, b"\0"))["table"]
    for number in ("²", "9" * 5000, "-1", "१"):
        got = mpeg_audio.decode(tag([(b"TXXX", b"\3PAYLOAD_BYTES\0" + number.encode())]))
        assert got["payload"] == b"" and got["n_bytes"] == 0


def test_tags_of_any_kind():
    picture = b"\0image/png\0\3\0" + b"TXXX" * 300
    for version, names in ((2, (b"TT2", b"PIC", b"TXX")), (3, (b"TIT2", b"APIC", b"TXXX")), (4, (b"TIT2", b"APIC", b"TXXX"))):
        made = tag([(names[0], b"\3Song"), (names[1], picture), (names[2], b"\3mood\0calm"), (names[0][:-1] + b"3", b"\1" + "später".encode("utf-16"))], version)
        size, fields = mpeg_audio.tag_v2(made + b"rest")
        name = names[0].decode()
        assert size == len(made) and fields == {name: "Song", "mood": "calm", name[:-1] + "3": "später"}
    assert mpeg_audio.tag_v2(b"ID3\4\0\x10" + bytes(4) + b"3DI" + bytes(7))[0] == 20


def test_other_tables_and_layers():
    frame = bytes([0xFF, 0xFB, 0x94, 0xC0])
    size = mpeg_audio.header(frame)[0]
    vbri = frame + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 3 * size, 2, 3, 2, 2, 1) + struct.pack(">HHH", 5, 6, 7)
    media = vbri.ljust(size, b"\0") + 2 * frame.ljust(size, b"\0")
    got = mpeg_audio.decode(media)
    assert got["table"] == {"kind": "VBRI", "frames": 2, "bytes": 3 * size, "toc": [10, 12, 14]} and got["table_ok"] and got["offsets"] == [size, 2 * size] and got["samples"] == 2304
    for word, expected in ((b"\xff\xff\x14\xc0", (32, 48000, 384)), (b"\xff\xfd\x14\xc0", (96, 48000, 1152)), (b"\xff\xf5\x14\xc0", (48, 24000, 1152)), (b"\xff\xe3\x14\xc0", (48, 12000, 576))):
        assert mpeg_audio.header(word)[:3] == expected
        got = mpeg_audio.decode(3 * word.ljust(expected[0], b"\0"))
        assert got["samples"] == 3 * expected[2] and got["rate"] == expected[1]


def test_ten_thousand_damaged_files():
    rng = random.Random(4)
    whole = [mpeg_audio.encode(*mpeg_audio.padded("q" * n)) for n in (0, 40, 2500)] + [tag([(b"TIT2", b"\1ab"), (b"TXXX", b"\3PAYLOAD_BYTES\0001")]), tag([(b"TXX", b"\0a")], 2)]
    marks = [b"Xing", b"VBRI", b"ID3\3", b"ID3\4\0\xff", b"TAG", b"\xff\xfb", b"\xff\xe3", b"TXXX", b"\xff\xff\xff\xff"]
    for _ in range(10_000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(data) + 1)
            kind = rng.randrange(4)
            if kind == 0:
                data[at : at + 1] = bytes([rng.randrange(256)])
            elif kind == 1:
                del data[at : at + rng.choice([1, 7, 500, 10_000])]
            elif kind == 2:
                data[at:at] = rng.randbytes(rng.randint(1, 40))
            else:
                data[at : at + 4] = rng.choice(marks)
        found = mpeg_audio._features(bytes(data))
        assert found["media_bytes"] == len(data) and found["n_frames"] == len(found["seek_offsets"]) and found["duration_s"] >= 0


def test_query(spark, docs):
    rows = {r["doc_id"]: r for r in mpeg_audio.op3_media(docs([(1, "héllo"), (2, None), (3, "y" * 3000), (4, "héllo")])).collect()}
    payload = "héllo".encode().ljust(64, b"\0")
    assert rows[1]["payload_sha256"] == hashlib.sha256(payload).hexdigest() and rows[1]["tail_crc32"] == zlib.crc32(payload) and rows[1]["n_bytes"] == 6
    assert rows[2]["payload_bytes"] == 64 and rows[2]["n_bytes"] == 0 and rows[3]["payload_bytes"] == 3008
    assert rows[1].asDict() | {"doc_id": 4} == rows[4].asDict()


def test_odd_tables(spark, docs):
    assert mpeg_audio.op3_media(docs([(1, "a")]).limit(0)).collect() == []
    clash = spark.createDataFrame([(1, None, "x"), (2, bytearray(b"junk"), "y")], "doc_id long, media binary, features string")
    got = {r["doc_id"]: r for r in mpeg_audio.media_features(clash).collect()}
    assert got[1]["features"]["media_bytes"] == 0 and got[2]["features"]["n_frames"] == 0 and set(got[1].asDict()) == {"doc_id", "media", "features"}
    made = mpeg_audio.with_media(docs([(1, "a")]).withColumn("media", F.lit("old")))
    assert made.columns.count("media") == 1 and mpeg_audio.decode(bytes(made.first()["media"]))["payload"][:1] == b"a"
