"""Media columns: payloads stored as MPEG transport streams with timestamps and random-access points.

A payload of 8-bit samples is cut into access units of whole frames. Each unit is a PES packet with a presentation
time, opened by fresh program tables and a packet that carries the random-access flag and a clock reference. Reading
back parses the program tables, checks continuity counters and reassembles the elementary stream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import known_id, pieces, prepare, scratch_path, with_known_id

FRAME = 576  # samples in a frame, and the bytes a payload is padded to
UNIT = 64 * FRAME  # bytes in an access unit, at most
TICKS = 1080  # of the 90 kHz clock in a frame at 48 kHz
PACKET, PMT_PID, ES_PID, STREAM_TYPE = 188, 0x1000, 0x0100, 0x80


def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | len(body) + 9, number, 0xC1, 0, 0)
    return head + body + struct.pack(">I", crc32_mpeg(head + body))


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    data = struct.pack(">BHBB", 0x47, 0x4000 | pid, 0x10, 0) + section
    return np.frombuffer(data + b"\xff" * (PACKET - len(data)), np.uint8)


_PAT = _table_packet(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID)))
_PMT = _table_packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | ES_PID, 0xF000, STREAM_TYPE, 0xE000 | ES_PID, 0xF000)))


def _stamp(pts: int) -> bytes:
    return bytes((0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE))


def padded(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8 with bytes 255 up to a positive multiple of FRAME, and its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(1, -(-len(raw) // FRAME)) * FRAME
    return raw + b"\xff" * (size - len(raw)), len(raw)


def mux(payload: bytes) -> tuple[bytes, list[tuple[int, int]]]:
    """A transport stream of payload, and its random-access points: (presentation time, byte offset)."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"a payload is a positive multiple of {FRAME} bytes")
    parts, points, count, at = [], [], 0, 0
    for k, start in enumerate(range(0, len(payload), UNIT)):
        data = payload[start : start + UNIT]
        pts = start // FRAME * TICKS & (1 << 33) - 1
        body = np.frombuffer(struct.pack(">IHBBB", 0x1BD, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data, np.uint8)
        n = 1 + -(-(len(body) - 176) // 184)
        packets = np.full((n, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = 0x47, ES_PID >> 8, ES_PID & 0xFF
        packets[:, 3] = 0x10 | (np.arange(count, count + n) & 15)
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        packets[0, 4:12] = np.frombuffer(struct.pack(">BBIH", 7, 0x50, pts >> 1, (pts & 1) << 15 | 0x7E00), np.uint8)
        packets[0, 12:] = body[:176]
        whole = n - 2
        packets[1 : n - 1, 4:] = body[176 : 176 + 184 * whole].reshape(whole, 184)
        rest = body[176 + 184 * whole :]
        fill = 184 - len(rest)
        if fill:
            packets[-1, 3] |= 0x20
            packets[-1, 4] = fill - 1
            if fill > 1:
                packets[-1, 5] = 0
        packets[-1, PACKET - len(rest) :] = rest
        tables = np.stack([_PAT, _PMT])
        tables[:, 3] |= k & 15
        parts += [tables.tobytes(), packets.tobytes()]
        points.append((pts, at))
        at += PACKET * (n + 2)
        count += n
    return b"".join(parts), points


class StreamError(ValueError):
    """A transport stream that does not hold what its tables and counters promise."""


def _read_section(packet: np.ndarray, table: int) -> bytes:
    data = packet.tobytes()
    start = 5 + data[4]
    length = struct.unpack_from(">H", data, start + 1)[0] & 0xFFF
    section = data[start : start + 3 + length]
    if section[0] != table or crc32_cached(section) != 0:
        raise StreamError("a program table is damaged")
    return section


_checked: dict[bytes, int] = {}


def crc32_cached(section: bytes) -> int:
    if section not in _checked:
        if len(_checked) > 1000:
            _checked.clear()
        _checked[section] = crc32_mpeg(section)
    return _checked[section]


def demux(stream: bytes) -> tuple[bytes, dict]:
    """The payload of a transport stream and what was found: packets, units, times, random-access points."""
    if not stream or len(stream) % PACKET:
        raise StreamError("not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise StreamError("lost sync")
    pid = (packets[:, 1].astype(np.int64) & 0x1F) << 8 | packets[:, 2]
    tables = np.flatnonzero(pid == 0)
    if not len(tables):
        raise StreamError("no program association")
    section = _read_section(packets[tables[0]], 0)
    pmt_pid = struct.unpack_from(">H", section, 10)[0] & 0x1FFF
    maps = np.flatnonzero(pid == pmt_pid)
    if not len(maps):
        raise StreamError("no program map")
    section = _read_section(packets[maps[0]], 2)
    skip = struct.unpack_from(">H", section, 10)[0] & 0xFFF
    kind, es_pid = struct.unpack_from(">BH", section, 12 + skip)
    es_pid &= 0x1FFF
    for one in (0, pmt_pid, es_pid):
        counter = packets[pid == one, 3].astype(np.int64) & 15
        if (np.diff(counter) % 16 != 1).any():
            raise StreamError(f"continuity broken in {one}")
    own = np.flatnonzero(pid == es_pid)
    es = packets[own]
    opens = (es[:, 1] & 0x40) != 0
    if not len(es) or not opens[0]:
        raise StreamError("no packet opens the stream")
    adapted = (es[:, 3] & 0x20) != 0
    start = 4 + np.where(adapted, 1 + es[:, 4].astype(np.int64), 0)
    flagged = adapted & (es[:, 4] > 0) & ((es[:, 5] & 0x40) != 0)
    data = es[np.arange(PACKET)[None, :] >= start[:, None]].tobytes()
    begins = np.concatenate([[0], np.cumsum(PACKET - start)])[:-1][opens].tolist() + [len(data)]
    parts, times = [], []
    for a, b in zip(begins, begins[1:]):
        code, size, _, flags, more = struct.unpack_from(">IHBBB", data, a)
        if code != 0x1BD or size != b - a - 6 or not flags & 0x80:
            raise StreamError("a packetized unit is damaged")
        p = data[a + 9 : a + 14]
        times.append((p[0] >> 1 & 7) << 30 | p[1] << 22 | p[2] >> 1 << 15 | p[3] << 7 | p[4] >> 1)
        parts.append(data[a + 9 + more : b])
    return b"".join(parts), {"packets": len(packets), "units": len(parts), "times": times, "points": int(flagged.sum()), "type": kind}


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (a transport stream) and access (random-access points) for every row of (doc_id, text).

    Null and empty texts are one frame of padding. Null and repeated doc_ids stay as rows; other columns are ignored.
    """
    prepare(docs.sparkSession)

    def store(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches):
            rows = []
            for text in batch["text"]:
                payload, size = padded(text)
                stream, points = mux(payload)
                rows.append((size, stream, [{"pts": a, "offset": b} for a, b in points]))
            out = pd.DataFrame(rows, columns=["n_bytes", "media", "access"])
            for at, name in enumerate(("doc_id", "known")):
                out.insert(at, name, batch[name].to_numpy())
            yield out

    done = with_known_id(docs, F.col("text").cast("string").alias("text")).mapInPandas(store, "doc_id long, known boolean, n_bytes long, media binary, access array<struct<pts:bigint,offset:bigint>>")
    return done.withColumn("doc_id", known_id()).drop("known")


def describe(payload: bytes, found: dict) -> str:
    """What the samples and times say: frames, units, points, duration, and level, peak and crossings of the signal."""
    x = np.frombuffer(payload, np.uint8)
    total, square = int(x.sum(dtype=np.int64)), int((x.astype(np.int64) ** 2).sum())
    high = x >= 128
    crossings = int((high[1:] != high[:-1]).sum())
    last = found["times"][-1] + (len(payload) - 1) % UNIT // FRAME * TICKS + TICKS
    return f"frames={len(x) // FRAME};units={found['units']};points={found['points']};ticks={last};mean={total * 1000 // len(x)};power={square // len(x)};peak={int(x.max())};crossings={crossings}"


def read_media(stored: DataFrame) -> DataFrame:
    """doc_id, n_bytes and, from the stored bytes, payload and media sizes and digests and a feature string.

    The stored access points are held against the stream: their times, and the payload that the last one opens.
    """
    prepare(stored.sparkSession)

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in pieces(batches, "media"):
            rows = []
            for stream, access in zip(batch["media"], batch["access"]):
                payload, found = demux(stream)
                if [a["pts"] for a in access] != found["times"] or len(access) > 1 and not payload.endswith(demux(stream[access[-1]["offset"] :])[0]):
                    raise StreamError("access points that lead elsewhere")
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stream), hashlib.sha256(stream).hexdigest(), describe(payload, found)))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            for at, name in enumerate(("doc_id", "known", "n_bytes")):
                out.insert(at, name, batch[name].to_numpy())
            yield out

    schema = "doc_id long, known boolean, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    done = with_known_id(stored, F.col("n_bytes"), F.col("media"), F.col("access")).mapInPandas(read, schema)
    return done.withColumn("doc_id", known_id()).drop("known")


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Store all documents as a table with a media column in the shared folder, and describe what is read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "media")
    store_media(docs).write.option("compression", "zstd").parquet(path)
    return read_media(spark.read.parquet(path))
