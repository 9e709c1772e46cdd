"""Media column: MPEG audio whose ancillary data carries a payload.

The writer lays out: an ID3v2 tag (payload lengths), a frame with a variable-bitrate table (frames, bytes, 100 seek points), mono 48 kHz Layer III
frames whose granules are empty (silence) and whose rest is ancillary data holding the payload, protected by the format's CRC-16,
and an ID3v1 tag. All but the last frame run at 320 kbit/s, the last at the lowest rate that holds what is left.

The reader takes any bytes: MPEG-1, -2 and -2.5, Layers I to III. It reads the text frames of ID3v2 tags (2.2 to 2.4) and steps over all others, reads ID3v1 tags and both kinds of variable-bitrate
tables (Xing/Info and VBRI), finds frame headers again after damage (a header counts only if another frame or the end follows), and gives exact durations in samples and the
offset of every frame. Checksums are verified in Layer III, where what they cover has a fixed size. Empty or damaged input yields a record of what was found, with no frames if there are none, never
an error.

Defined cases: null and empty texts are 64 bytes of padding; null media is empty; very long texts are one file of their own; repeated rows give equal values; other columns are kept, one that has the name of the
output is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the format (ISO/IEC 11172-3, 13818-3).
KBPS_V1_L1 = [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448]
KBPS_V1_L2 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]
KBPS_V2_L1 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256]
KBPS_V1_L3 = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
KBPS_V2_L3 = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
RATES_V1 = [44100, 48000, 32000]
CRC_POLY = 0x8005

SIDE_MONO, OVERHEAD, TOC_FLAGS = 17, 4 + 2 + 17, 7


@lru_cache(maxsize=65_536)
def crc16(data: bytes) -> int:
    """The format's CRC-16, started at all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1) ^ CRC_POLY if crc & 0x8000 else crc << 1
            crc &= 0xFFFF
    return crc


@lru_cache(maxsize=65_536)
def header(word: bytes) -> tuple[int, int, int, int, bool] | None:
    """(frame bytes, sample rate, samples, side bytes, protected) of a frame header; None if it is not one. Only Layer III has side bytes (0 else)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate_at, sr_at = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or rate_at in (0, 15) or sr_at == 3 or word[3] & 3 == 2:
        return None
    first = version == 3
    rate = RATES_V1[sr_at] >> (0 if first else 1 if version == 2 else 2)
    padding, protected, mono = word[2] >> 1 & 1, not word[1] & 1, word[3] >> 6 == 3
    if layer == 1:
        kbps = (KBPS_V1_L1 if first else KBPS_V2_L1)[rate_at]
        return (12 * kbps * 1000 // rate + padding) * 4, rate, 384, 0, protected
    if layer == 2:
        kbps = (KBPS_V1_L2 if first else KBPS_V2_L3)[rate_at]
        return 144 * kbps * 1000 // rate + padding, rate, 1152, 0, protected
    kbps, samples = (KBPS_V1_L3 if first else KBPS_V2_L3)[rate_at], 1152 if first else 576
    side = (17 if mono else 32) if first else (9 if mono else 17)
    return samples // 8 * kbps * 1000 // rate + padding, rate, samples, side, protected


def _head(kbps: int, protected: bool) -> bytes:
    return bytes([0xFF, 0xFA if protected else 0xFB, KBPS_V1_L3.index(kbps) << 4 | 1 << 2, 0xC0])


def _id3v2(fields: dict[str, str]) -> bytes:
    body = b"".join(b"TXXX" + struct.pack(">I", len(x)) + b"\0\0" + x for x in (b"\0" + k.encode() + b"\0" + v.encode() for k, v in fields.items()))
    return b"ID3\x03\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body


def encode(payload: bytes, n_bytes: int) -> bytes:
    """The audio file that carries payload; n_bytes of it count, the rest pads."""
    full = 960 - OVERHEAD
    silent = bytes(SIDE_MONO)
    start = _head(320, True)
    start += struct.pack(">H", crc16(start[2:] + silent)) + silent
    whole = len(payload) // full
    frames = [start + payload[i * full : (i + 1) * full] for i in range(whole)]
    if rest := payload[whole * full :]:
        kbps = next(k for k in KBPS_V1_L3[1:] if 3 * k - OVERHEAD >= len(rest))
        last = _head(kbps, True)
        frames.append(last + struct.pack(">H", crc16(last[2:] + silent)) + silent + rest.ljust(3 * kbps - OVERHEAD, b"\0"))
    total = 144 + sum(map(len, frames))
    at, offsets = 144, []
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, 256 * offsets[min(len(offsets) - 1, i * len(offsets) // 100)] // total) for i in range(100))
    table = b"Xing" + struct.pack(">III", TOC_FLAGS, len(frames), total) + toc
    first = (_head(48, False) + silent + table).ljust(144, b"\0")
    tag = _id3v2({"PAYLOAD_BYTES": str(len(payload)), "TEXT_BYTES": str(n_bytes)})
    return b"".join([tag, first, *frames, b"TAG" + b"payload".ljust(124, b"\0") + b"\xff"])


def _number(data: bytes, at: int, size: int) -> int:
    """A big-endian number; what lies beyond the end counts as 0."""
    return int.from_bytes(data[at : at + size].ljust(size, b"\0"), "big")


def _synchsafe(data: bytes) -> int:
    """A size in bytes of seven bits."""
    out = 0
    for byte in data:
        out = out << 7 | byte & 127
    return out


def _text(data: bytes) -> list[str]:
    """The strings of a text frame: an encoding byte, then strings ended by zeros."""
    names = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    text = data[1:].decode(names.get(data[0], "latin-1"), "replace") if data else ""
    return text.rstrip("\0").lstrip("\ufeff").split("\0")


def tag_v2(media: bytes) -> tuple[int, dict[str, str]]:
    """(bytes of the ID3v2 tag at the beginning, its text frames by name; user-defined ones by their description)."""
    if media[:3] != b"ID3" or len(media) < 10 or not 2 <= media[3] <= 4:
        return 0, {}
    version, flags = media[3], media[5]
    end = min(len(media), 10 + _synchsafe(media[6:10]))
    body = media[10:end]
    if flags & 128 and version < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at, fields = 0, {}
    if flags & 64 and version > 2:
        at = _number(body, 0, 4) + 4 if version == 3 else _synchsafe(body[:4])
    wide = 3 if version == 2 else 4
    head = 6 if version == 2 else 10
    while at + head <= len(body) and body[at : at + wide].isalnum():
        name, sized = body[at : at + wide].decode("ascii"), body[at + wide : at + 2 * wide]
        size = _synchsafe(sized) if version == 4 else _number(sized, 0, wide)
        data = body[at + head : at + head + size]
        at += head + size
        if name[0] != "T" or len(data) < size:
            continue
        if version == 4 and body[at - size - 1] & 2:
            data = data.replace(b"\xff\0", b"\xff")
        found = _text(data)
        if name in ("TXXX", "TXX"):
            fields[found[0]] = "\0".join(found[1:]).lstrip("\ufeff")
        else:
            fields[name] = "\0".join(found)
    return end + (10 if version == 4 and flags & 16 else 0), fields


def rate_table(frame: bytes, body: int, side: int) -> dict | None:
    """What a frame's variable-bitrate table says: Xing or Info behind the side bytes, or VBRI 32 bytes behind the header."""
    at = body + side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, at = _number(frame, at + 4, 4), at + 8
        out: dict = {"kind": "Xing", "frames": None, "bytes": None, "toc": []}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = _number(frame, at, 4)
                at += 4
        if flags & 4:
            out["toc"] = list(frame[at : at + 100])
        return out
    if frame[36:40] == b"VBRI":
        entries, scale, width = _number(frame, 54, 2), _number(frame, 56, 2), _number(frame, 58, 2)
        whole = max(0, min(entries, (len(frame) - 62) // width)) if 1 <= width <= 4 else 0
        toc = [scale * _number(frame, 62 + i * width, width) for i in range(whole)]
        return {"kind": "VBRI", "frames": _number(frame, 50, 4), "bytes": _number(frame, 46, 4), "toc": toc}
    return None


def _field(fields: dict[str, str], key: str, default: int) -> int:
    text = fields.get(key, "")
    return int(text) if text.isascii() and text.isdecimal() and len(text) <= 18 else default


def decode(media: bytes | None) -> dict:
    """All that the file holds: tags, table, frame offsets, durations, checksums, and the ancillary payload."""
    media = media or b""
    at, fields = tag_v2(media)
    end = len(media)
    at = min(at, end)
    if end - at >= 128 and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        fields["id3v1"] = media[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    offsets, sizes, parts, samples, rate, good, bad, resyncs, table, origin = [], set(), [], 0, 0, 0, 0, 0, None, at
    lost = False
    while at + 4 <= end:
        found = header(media[at : at + 4])
        sound = found and at + found[0] <= end and (not lost or at + found[0] == end or header(media[at + found[0] : at + found[0] + 4]))
        if not sound:
            resyncs += not lost
            lost = True
            at = media.find(b"\xff", at + 1, end)
            if at < 0:
                break
            continue
        lost = False
        size, rate, count, side, protected = found
        body = 4 + 2 * protected
        frame = media[at : at + size]
        if side and table is None and not offsets and (table := rate_table(frame, body, side)):
            origin = at
            at += size
            continue
        if side and protected:
            ok = crc16(frame[2:4] + frame[body : body + side]) == _number(frame, 4, 2)
            good, bad = good + ok, bad + (not ok)
        offsets.append(at)
        sizes.add(size)
        parts.append(frame[body + side :] if side else b"")
        samples += count
        at += size
    payload = b"".join(parts)
    payload = payload[: _field(fields, "PAYLOAD_BYTES", len(payload))]
    return {
        "fields": fields, "table": table, "offsets": offsets, "samples": samples, "rate": rate, "crc_ok": good, "crc_bad": bad, "resyncs": resyncs,
        "variable": len(sizes) > 1, "payload": payload, "n_bytes": _field(fields, "TEXT_BYTES", len(payload)),
        "table_ok": bool(table) and table["frames"] == len(offsets) and table["bytes"] == at - origin,
    }


def padded(text: str | None) -> tuple[bytes, int]:
    """The UTF-8 of a text with bytes 0 up to a positive multiple of 64, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0"), len(raw)


def with_media(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """docs (its other columns as they are) with the audio bytes of each text; memory holds one Arrow batch."""
    from pyspark.sql import functions as F

    @F.arrow_udf("binary")
    def to_media(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([encode(*padded(x)) for x in batch.to_pylist()], pa.binary())

    return docs.withColumn(out, to_media(F.col(text)))


FEATURES = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "n_frames long, sample_rate int, duration_samples long, duration_s double, crc_bad long, seek_offsets array<long>"
)


def _features(media: bytes | None) -> dict:
    media = media or b""
    got = decode(media)
    payload, rate = got["payload"], got["rate"]
    seek = hashlib.sha256(b",".join(b"%d" % x for x in got["offsets"])).hexdigest()[:16]
    feature = (
        f"layer=3;rate={rate};frames={len(got['offsets'])};samples={got['samples']};vbr={int(got['variable'])};table={int(got['table_ok'])};"
        f"crc_ok={got['crc_ok']};crc_bad={got['crc_bad']};resyncs={got['resyncs']};seek={seek}"
    )
    return {
        "n_bytes": got["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]),
        "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "n_frames": len(got["offsets"]), "sample_rate": rate,
        "duration_samples": got["samples"], "duration_s": got["samples"] / rate if rate else 0.0, "crc_bad": got["crc_bad"], "seek_offsets": got["offsets"],
    }


def media_features(df: DataFrame, media: str = "media", out: str = "features") -> DataFrame:
    """df with one struct column of what the stored bytes hold (fields as in FEATURES)."""
    from pyspark.sql import functions as F
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(FEATURES)
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([_features(x) for x in batch.to_pylist()], arrow)

    return df.withColumn(out, look(F.col(media)))


def op3_media(docs: DataFrame) -> DataFrame:
    return media_features(with_media(docs.select("doc_id", "text")).select("doc_id", "media")).select("doc_id", "features.*")
