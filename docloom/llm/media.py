"""Media columns as MPEG transport streams (operator 6).

``mux`` stores a byte string as one program: a program association table, a
program map table, and packetised elementary packets (private data) cut into
188-byte transport packets, each elementary packet opening with a random-access
point, a clock reference and a timestamp.  ``demux`` reads such a stream back
by its tables: it finds the program map, the elementary stream, checks
continuity counters, reassembles the elementary packets and returns payload,
timestamps and random-access points.

``store`` makes a media column, ``read`` takes one apart into payloads,
timestamps and random-access points; ``digest`` writes the column as a table
and describes what it reads back.  Nothing is shuffled or collected; one
document at a time is in memory.  Defined cases: a null text is an empty one;
an empty text is one block of padding; equal texts give equal streams; repeated
rows are stored each; a null doc_id stays null; an empty table gives an empty
one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

PACKET, BODY, SYNC = 188, 184, 0x47
PMT_PID, ES_PID = 0x1000, 0x0100
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
UNIT = 576
TAIL = 32
#: Payload bytes of one elementary packet: 64 units, so its length field (16 bits) holds.
ACCESS_BYTES = 64 * UNIT
CLOCK, FRAME, FIRST_PTS = 90_000, 3_600, 126_000
PES_HEADER = 14


def crc32_mpeg(data: bytes) -> int:
    """The checksum of program tables: polynomial 0x04C11DB7, not reflected."""
    crc = 0xFFFFFFFF
    for b in data:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, rest: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(rest) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00"
    body = head + rest
    return body + crc32_mpeg(body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


def _tables() -> bytes:
    pat = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    es = bytes([PRIVATE_DATA]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00"
    pmt = _section(0x02, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + es)
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


TABLES = _tables()


def _pts_bytes(pts: int) -> bytes:
    p = pts & (1 << 33) - 1
    return bytes([0x21 | p >> 29 & 0x0E, p >> 22 & 0xFF, 0x01 | p >> 14 & 0xFE, p >> 7 & 0xFF, 0x01 | p << 1 & 0xFE])


def _pts_value(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def pad(data: bytes) -> bytes:
    """The payload: bytes 255 up to a positive multiple of 576."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b"\xff")


def mux(payload: bytes) -> bytes:
    """Store a payload as a transport stream."""
    out, counter = [TABLES], 0
    for k, at in enumerate(range(0, max(1, len(payload)), ACCESS_BYTES)):
        unit = payload[at : at + ACCESS_BYTES]
        pts = FIRST_PTS + k * FRAME
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + PES_HEADER - 6).to_bytes(2, "big") + b"\x84\x80\x05" + _pts_bytes(pts) + unit
        clock = pts - FRAME & (1 << 33) - 1
        opening = bytes([7, 0x50]) + (clock << 15 | 0x7E00).to_bytes(6, "big")  # random access and clock reference
        room = BODY - len(opening)
        rest = len(pes) - room
        n = 1 + max(0, -(-rest // BODY))
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1] = ES_PID >> 8
        packets[:, 2] = ES_PID & 0xFF
        packets[:, 3] = 0x10 | counter + np.arange(n) & 15
        packets[0, 1] |= 0x40
        packets[0, 3] |= 0x20
        counter = counter + n & 15
        if rest < 0:  # it all fits in the first packet: longer adaptation field
            opening = bytes([7 - rest]) + opening[1:] + b"\xff" * -rest
            room += rest
        data = np.frombuffer(pes, np.uint8)
        packets[0, 4 : 4 + len(opening)] = np.frombuffer(opening, np.uint8)
        packets[0, 4 + len(opening) :] = data[:room]
        if n > 1:
            whole = n - 1 if rest % BODY == 0 else n - 2
            packets[1 : 1 + whole, 4:] = data[room : room + whole * BODY].reshape(whole, BODY)
            if whole < n - 1:
                tail = data[room + whole * BODY :]
                fill = BODY - len(tail)
                stuffing = bytes([fill - 1]) + (b"\x00" + b"\xff" * (fill - 2) if fill > 1 else b"")
                packets[-1, 3] |= 0x20
                packets[-1, 4 : 4 + fill] = np.frombuffer(stuffing, np.uint8)
                packets[-1, 4 + fill :] = tail
        out.append(packets.tobytes())
    return b"".join(out)


@dataclass
class Stream:
    payload: bytes = b""
    programs: int = 0
    streams: int = 0
    packets: int = 0
    elementary: int = 0
    counter_errors: int = 0
    pts: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)

    def feature(self) -> str:
        first, last = (self.pts[0], self.pts[-1]) if self.pts else (0, 0)
        return (
            f"programs={self.programs};streams={self.streams};packets={self.packets};units={self.elementary};"
            f"pts={first}-{last};access={len(self.random_access)};counter_errors={self.counter_errors}"
        )


def demux(data: bytes) -> Stream:
    """Read a transport stream back by its tables."""
    grid = np.frombuffer(data, np.uint8).reshape(-1, PACKET)
    if (grid[:, 0] != SYNC).any():
        raise ValueError("lost packet synchronisation")
    got = Stream(packets=len(grid))
    pid = (grid[:, 1].astype(np.int32) & 0x1F) << 8 | grid[:, 2]
    es_pids: list[int] = []
    for p in np.flatnonzero(pid == 0)[:1]:
        programs = _checked(grid[p])
        for i in range(0, len(programs), 4):
            got.programs += 1
            map_pid = int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF
            for q in np.flatnonzero(pid == map_pid)[:1]:
                body = _checked(grid[q])
                at = 4 + (int.from_bytes(body[2:4], "big") & 0x0FFF)
                while at < len(body):
                    es_pids.append(int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF)
                    at += 5 + (int.from_bytes(body[at + 3 : at + 5], "big") & 0x0FFF)
    got.streams = len(es_pids)
    parts = []
    for es in es_pids:
        own = grid[pid == es]
        flags = own[:, 3]
        carries = flags & 0x10 > 0
        counters = (flags & 15)[carries].astype(np.int16)
        got.counter_errors += int((np.diff(counters) % 16 != 1).sum())
        adapted = flags & 0x20 > 0
        skip = np.where(adapted, 1 + own[:, 4].astype(np.int64), 0)
        opens = own[:, 1] & 0x40 > 0
        entry = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)
        sizes = np.where(carries, BODY - skip, 0)
        odd = np.flatnonzero(skip > 0)
        pieces, last = [], 0
        for i in odd:  # whole packets between the few with an adaptation field
            if i > last:
                pieces.append(own[last:i, 4:].reshape(-1))
            pieces.append(own[i, 4 + skip[i] :])
            last = i + 1
        pieces.append(own[last:, 4:].reshape(-1))
        raw = np.concatenate(pieces).tobytes()
        starts = np.append((np.cumsum(sizes) - sizes)[opens], len(raw))
        for j in range(len(starts) - 1):
            pes = raw[starts[j] : starts[j + 1]]
            if pes[:3] != b"\x00\x00\x01":
                raise ValueError("an elementary packet has no start code")
            size = int.from_bytes(pes[4:6], "big")
            if pes[7] & 0x80:
                got.pts.append(_pts_value(pes[9:14]))
            parts.append(pes[9 + pes[8] : 6 + size if size else len(pes)])
            got.elementary += 1
        got.random_access += np.flatnonzero(entry).tolist()
    got.payload = b"".join(parts)
    return got


def _checked(packet: np.ndarray) -> bytes:
    """The fields of the section in a table packet, behind its pointer byte, if its checksum holds."""
    raw = packet[4 + 1 + int(packet[4]) :].tobytes()
    size = 3 + (int.from_bytes(raw[1:3], "big") & 0x0FFF)
    if crc32_mpeg(raw[:size]):
        raise ValueError("a program table is damaged")
    return raw[8 : size - 4]


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pts array<long>, random_access array<long>"
#: Media in a record batch, about.
BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[tuple], schema: pa.Schema, weight) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row)
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (binary): each text as a transport stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches):
        for b in batches:
            for doc_id, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                yield doc_id, len(raw), mux(pad(raw))

    def run(batches):
        return _batches(rows(batches), schema, lambda r: len(r[2]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame) -> DataFrame:
    """doc_id, payload, pts, random_access, counter_errors from a media column."""
    schema = pa.schema([("doc_id", pa.int64()), ("payload", pa.binary()), ("pts", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int64())), ("counter_errors", pa.int32())])

    def rows(batches):
        for b in batches:
            for doc_id, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                g = demux(m.as_buffer())
                yield doc_id, g.payload, g.pts, g.random_access, g.counter_errors

    def run(batches):
        return _batches(rows(batches), schema, lambda r: len(r[1]))

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, payload binary, pts array<long>, random_access array<long>, counter_errors int")


def describe(media: DataFrame) -> DataFrame:
    """What is read back from stored media (doc_id, n_bytes, media): sizes, digests, features, timestamps and random-access points."""
    texts, lists = ("payload_sha256", "media_sha256", "feature"), ("pts", "random_access")
    schema = pa.schema([(n, pa.string() if n in texts else pa.list_(pa.int64()) if n in lists else pa.int64()) for n in (x.split()[0] for x in DIGEST.split(", "))])

    def rows(batches):
        for b in batches:
            for doc_id, n, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                stored = m.as_buffer()
                back = demux(stored)
                yield doc_id, n, len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), back.feature(), back.pts, back.random_access

    def run(batches):
        return _batches(rows(batches), schema, lambda r: 1000)

    return media.select(F.col("doc_id").cast("long"), "n_bytes", "media").mapInArrow(run, DIGEST)


def digest(docs: DataFrame) -> DataFrame:
    """Store every text as a media column of a written table, and describe what is read back."""
    return describe(Scratch(docs.sparkSession).keep(store(docs), "media"))
