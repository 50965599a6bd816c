"""Operator 6: media columns of MPEG audio.

A media column holds whole MPEG-1 Layer III streams. Writing keeps any payload losslessly in the data
area of checksummed frames, behind an ID3v2 tag and a variable-bitrate table; reading walks the stream
by its frame headers, resynchronises after damage, parses tag and table, verifies each checksum, and
gives exact duration and the offset of every frame for seeking. Nothing is shuffled: each row is
independent, so the work follows the input's partitions.

Defined results: null or empty texts become a payload of 64 zero bytes; extra columns are ignored;
repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import materialise, slices, table, utf8_texts, whole_text

# Fixed values of the MPEG-1 Layer III format: bitrate index -> kbit/s, sample-rate index -> Hz.
KBPS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
HZ = (44100, 48000, 32000)
SAMPLES = 1152
MONO_SIDE = 17
STEREO_SIDE = 32

RATE_INDEX = 2  # 32 kHz: every frame length is a whole number of bytes
LENGTHS = tuple(144_000 * k // HZ[RATE_INDEX] for k in KBPS)
OVERHEAD = 4 + 2 + MONO_SIDE
CAPACITY = tuple(max(0, n - OVERHEAD) for n in LENGTHS)
TEXT_KEY = b"payload"


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out[i] = c
    return out


CRC_TABLE = _crc_table()


def crc16(rows: np.ndarray) -> np.ndarray:
    """Checksum of each row of bytes (polynomial 0x8005, all ones at the start)."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for column in rows.T:
        c = (c << np.uint16(8)) ^ CRC_TABLE[(c >> np.uint16(8)) ^ column]
    return c


def _frame_heads() -> tuple[bytes, ...]:
    heads = []
    for i in range(len(KBPS)):
        head = bytes((0xFF, 0xFA, i << 4 | RATE_INDEX << 2, 0xC0))
        side = bytes(MONO_SIDE)
        crc = int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None, :])[0])
        heads.append(head + crc.to_bytes(2, "big") + side)
    return tuple(heads)


HEADS = _frame_heads()


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def write_stream(payload: bytes) -> bytes:
    """The payload as a complete MPEG stream."""
    full, last = CAPACITY[-1], len(payload) % CAPACITY[-1]
    n_full = len(payload) // full
    parts = []
    for i in range(n_full):
        parts += (HEADS[-1], payload[i * full : (i + 1) * full])
    n = n_full
    if last:
        k = bisect_left(CAPACITY, last)
        parts += (HEADS[k], payload[n_full * full :], bytes(CAPACITY[k] - last))
        n += 1
    body = b"".join(parts)
    info = bytes((0xFF, 0xFB, 1 << 4 | RATE_INDEX << 2, 0xC0)) + bytes(MONO_SIDE)
    total = LENGTHS[1] + len(body)
    seek = bytes(min(255, (LENGTHS[1] + min(n, p * n // 100) * LENGTHS[-1]) * 256 // total) for p in range(100))
    info += b"Xing" + struct.pack(">III", 7, n, total) + seek
    info += bytes(LENGTHS[1] - len(info))
    text = b"\x00" + TEXT_KEY + b"\x00" + str(len(payload)).encode()
    tag_frame = b"TXXX" + _syncsafe(len(text)) + b"\x00\x00" + text
    return b"ID3\x04\x00\x00" + _syncsafe(len(tag_frame)) + tag_frame + info + body


def _length_at(data: bytes, at: int) -> int:
    """Length of the Layer III frame whose header is at ``at``; 0 if no valid header is there."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xFA:
        return 0
    b, r = data[at + 2] >> 4, (data[at + 2] >> 2) & 3
    if b == 0 or b == 15 or r == 3:
        return 0
    return 144_000 * KBPS[b] // HZ[r] + ((data[at + 2] >> 1) & 1)


def read_stream(data: bytes) -> dict:
    """Tag texts, variable-bitrate table, frame offsets and lengths, and how often sync had to be found again."""
    at, tags = 0, {}
    if data[:3] == b"ID3" and len(data) >= 10:
        size = sum((x & 0x7F) << s for x, s in zip(data[6:10], (21, 14, 7, 0)))
        p, stop = 10, min(len(data), 10 + size)
        while p + 10 <= stop and data[p : p + 4].strip(b"\0"):
            k = sum((x & 0x7F) << s for x, s in zip(data[p + 4 : p + 8], (21, 14, 7, 0)))
            if data[p : p + 4] == b"TXXX":
                key, _, value = data[p + 11 : p + 10 + k].partition(b"\0")
                tags[key.decode("latin-1")] = value.decode("latin-1")
            p += 10 + k
        at = 10 + size
    offsets, lengths, resyncs, table_at, vbr = [], [], 0, -1, {}
    known: dict[bytes, int] = {}
    end = len(data)
    while at < end:
        head = data[at : at + 4]
        n = known.get(head)
        if n is None:
            n = known[head] = _length_at(data, at)
        if n and at + n <= end:
            offsets.append(at)
            lengths.append(n)
            at += n
            continue
        lost = at
        while True:  # a frame counts after damage if another one or the end follows it
            at = data.find(b"\xff", at + 1)
            if at < 0:
                at = end
                break
            n = _length_at(data, at)
            if n and (at + n == end or _length_at(data, at + n)):
                break
        resyncs += lost < end
    if offsets:
        p = offsets[0]
        side = MONO_SIDE if data[p + 3] >> 6 == 3 else STEREO_SIDE
        q = p + 4 + side
        if data[q : q + 4] in (b"Xing", b"Info"):
            flags, table_at = int.from_bytes(data[q + 4 : q + 8], "big"), 0
            q += 8
            if flags & 1:
                vbr["frames"], q = int.from_bytes(data[q : q + 4], "big"), q + 4
            if flags & 2:
                vbr["bytes"], q = int.from_bytes(data[q : q + 4], "big"), q + 4
            if flags & 4:
                vbr["seek"] = data[q : q + 100]
        else:
            q = p + 4 + 32
            if data[q : q + 4] == b"VBRI":
                vbr, table_at = {"bytes": int.from_bytes(data[q + 10 : q + 14], "big"), "frames": int.from_bytes(data[q + 14 : q + 18], "big")}, 0
    audio = slice(1, None) if table_at == 0 else slice(0, None)
    return {"tags": tags, "vbr": vbr, "offsets": offsets[audio], "lengths": lengths[audio], "resyncs": resyncs}


def checksums_ok(data: bytes, offsets: list[int]) -> tuple[int, int]:
    """Frames that carry a checksum, and those whose checksum is right."""
    if not offsets:
        return 0, 0
    raw = np.frombuffer(data + bytes(64), np.uint8)
    at = np.asarray(offsets)
    at = at[raw[at + 1] & 1 == 0]
    ok = 0
    mono = raw[at + 3] >> 6 == 3
    for own, side in ((at[mono], MONO_SIDE), (at[~mono], STEREO_SIDE)):
        if len(own):
            cover = np.r_[2, 3, 6 : 6 + side]
            stored = raw[own + 4].astype(np.uint16) << np.uint16(8) | raw[own + 5]
            ok += int((crc16(raw[own[:, None] + cover]) == stored).sum())
    return len(at), ok


def payload_of(data: bytes, found: dict) -> bytes:
    """The payload that ``write_stream`` put into a stream."""
    body = b"".join([data[p + OVERHEAD : p + n] for p, n in zip(found["offsets"], found["lengths"])])
    return body[: int(found["tags"].get(TEXT_KEY.decode(), len(body)))]


def write_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as UTF-8, zero-filled to a positive multiple of 64, as an MPEG stream."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8_000_000):
            texts = utf8_texts(part)
            media = [write_stream(t + bytes(max(64, -(-len(t) // 64) * 64) - len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(encode, f"doc_id {id_type}, n_bytes bigint, media binary")


READ_SCHEMA = (
    "media_bytes bigint, media_sha256 string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, n_frames bigint, duration_us bigint, "
    "crc_frames bigint, crc_ok bigint, resyncs bigint, table_frames bigint, frame_offsets array<bigint>"
)


def read_media(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Parse the column ``media``: exact duration, checksums, seek offsets of frames, and the payload's digests.

    A null or empty stream gives zero frames and the digests of no bytes.
    """
    kept = ", ".join(f"{c} {media.schema[c].dataType.simpleString()}" for c in keep)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 8_000_000):
            rows = []
            for data in part.column("media").to_pylist():
                data = data or b""
                found = read_stream(data)
                payload = payload_of(data, found)
                rates = {data[p + 2] >> 2 & 3 for p in found["offsets"]}
                if len(rates) <= 1:
                    micros = len(found["offsets"]) * SAMPLES * 1_000_000 // HZ[next(iter(rates), 0)]
                else:
                    micros = sum(SAMPLES * 1_000_000 // HZ[data[p + 2] >> 2 & 3] for p in found["offsets"])
                n_crc, ok = checksums_ok(data, found["offsets"])
                rows.append((len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(found["offsets"]), micros, n_crc, ok, found["resyncs"], found["vbr"].get("frames", -1), found["offsets"]))
            arrays = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 7, pa.list_(pa.int64())))]
            names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *arrays], [*keep, *names])

    return media.select(*keep, "media").mapInArrow(decode, f"{kept}, {READ_SCHEMA}")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(materialise(write_media(table(spark, sf_dir, "documents")), "media"))
    seek = F.array_join(F.transform("frame_offsets", lambda x: x.cast("string")), "/")
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.format_string("frames=%d;duration_us=%d;crc=%d/%d;resyncs=%d;table=%d;seek=%s", "n_frames", "duration_us", "crc_ok", "crc_frames", "resyncs", "table_frames", seek).alias("feature"),
    )
