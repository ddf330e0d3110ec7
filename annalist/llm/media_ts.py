"""Media columns: MPEG transport streams in binary columns.

``mux`` stores byte payloads as transport streams: one elementary stream of
packetised access units with time stamps, a clock reference with each, and
random-access points, in front of which the program tables are repeated, so
that a reader may start at any of them. Units are shown in the order of their
coding, so they carry no decoding time of their own. ``demux`` reads any such
column back: it parses the program tables with their check sums, follows
continuity counters, reassembles the elementary packets and returns payload,
clock references, time stamps and random-access points. Both are narrow Arrow
passes; rows are handled some ``BATCH_BYTES`` at a time, or one where it is longer.

Defined results: a null payload counts as empty; a null stream, or one without
a readable program table, gives an empty payload, no units and its errors in
``errors``; repeated rows are handled each; empty tables give empty tables;
extra columns are kept by neither, whatever their names, only the id goes along.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.memory import trimmed
from annalist.llm.tokens import batches_by_bytes

PACKET, BODY, SYNC = 188, 184, 0x47
PMT_PID, STREAM_PID = 0x1000, 0x0100
PROGRAM, PRIVATE_DATA, PRIVATE_STREAM = 1, 0x06, 0xBD
UNIT = 8192
#: 90 kHz ticks between units, and from a unit's clock reference to its time stamp; units between random-access points.
TICKS, DELAY, ACCESS_EVERY = 3600, 9000, 8
PADDING = 64
BATCH_BYTES = 1 << 22


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        table.append(c & 0xFFFFFFFF)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ _CRC[(c >> 24) ^ b]
    return c


# --- writing ----------------------------------------------------------------


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | (len(body) + 9)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + bytes([0x10 | counter]) + b"\x00"
    return (head + section).ljust(PACKET, b"\xff")


_ASSOCIATION = _section(0, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_MAP = _section(2, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00")
#: The program tables, for each value of their continuity counters.
TABLES = [_table_packet(0, _ASSOCIATION, i) + _table_packet(PMT_PID, _MAP, i) for i in range(16)]


def pts_bytes(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E), pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def pcr_bytes(base: int) -> bytes:
    """A clock reference of 90 kHz ticks: 33 bits, six reserved ones, and no 27 MHz ticks beyond."""
    return (base << 15 | 0x7E00).to_bytes(6, "big")


def _packets(data: bytes, counter: int, access: bool, clock: int) -> bytes:
    """Transport packets of one elementary packet: the first with the clock reference, the last one stuffed."""
    first = bytes([0x50 if access else 0x10]) + pcr_bytes(clock)
    begin = min(len(data), BODY - 1 - len(first))
    whole = (len(data) - begin) // BODY
    rest = len(data) - begin - whole * BODY
    n = 1 + whole + (rest > 0)
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = STREAM_PID >> 8
    out[0, 1] |= 0x40
    out[:, 2] = STREAM_PID & 0xFF
    out[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
    x = np.frombuffer(data, np.uint8)
    if whole:
        out[1 : 1 + whole, 4:] = x[begin : begin + whole * BODY].reshape(whole, BODY)
    for row, part, head in ((0, x[:begin], first),) + (((n - 1, x[len(x) - rest :], b"\x00"),) if rest else ()):
        field = BODY - len(part)
        if field:
            out[row, 3] |= 0x20
            out[row, 4] = field - 1
            if field > 1:
                out[row, 5 : 5 + len(head)] = np.frombuffer(head, np.uint8)
        out[row, PACKET - len(part) :] = part
    return out.tobytes()


def write_stream(payload: bytes, unit: int = UNIT) -> bytes:
    """A payload as a transport stream; the unit is at most 65,000 bytes."""
    parts, counter = [], 0
    for i, at in enumerate(range(0, len(payload), unit)):
        if i % ACCESS_EVERY == 0:
            parts.append(TABLES[i // ACCESS_EVERY & 15])
        own, clock = payload[at : at + unit], i * TICKS & (1 << 33) - 1
        head = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(own) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + pts_bytes(clock + DELAY & (1 << 33) - 1)
        parts.append(_packets(head + own, counter, i % ACCESS_EVERY == 0, clock))
        counter = (counter + len(parts[-1]) // PACKET) & 15
    return b"".join(parts) or TABLES[0]


# --- reading ----------------------------------------------------------------


class Stream(NamedTuple):
    payload: bytes
    sizes: list[int]
    pts: list[int | None]
    pcr: list[int | None]
    access: list[bool]
    packets: int
    lost: int
    duplicates: int
    errors: list[str]


def _read_section(rows: np.ndarray, start: np.ndarray, unit: np.ndarray) -> bytes | None:
    """The first whole section with a right check sum among a PID's packets."""
    data = bytearray()
    open_ = False
    for row, a, begins in zip(rows, start, unit):
        body = row[a:].tobytes()
        if begins:
            data, open_ = bytearray(body[1 + body[0] :] if body else b""), bool(body)
        elif open_:
            data += body
        if open_ and len(data) >= 3:
            n = 3 + (int.from_bytes(data[1:3], "big") & 0x0FFF)
            if len(data) >= n:
                if n >= 12 and crc32_mpeg(bytes(data[:n])) == 0:
                    return bytes(data[:n])
                open_ = False
    return None


def _pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1


def read_stream(data: bytes | None) -> Stream:
    """Program tables, continuity, elementary packets, time stamps and random-access points of a stream.

    The first elementary stream of the first program is read.
    """
    errors: list[str] = []
    data = data or b""
    if len(data) % PACKET:
        errors.append("length")
    rows = np.frombuffer(data, np.uint8, len(data) // PACKET * PACKET).reshape(-1, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] < 0x80)
    if not good.all():
        errors.append("sync")
        rows = rows[good]
    packets = len(rows)
    pid = (rows[:, 1].astype(np.uint16) & 0x1F) << 8 | rows[:, 2]
    unit, field, body = rows[:, 1] & 0x40 != 0, rows[:, 3] & 0x20 != 0, rows[:, 3] & 0x10 != 0
    start = np.where(field, 5 + rows[:, 4].astype(np.int64), 4)
    if (start > PACKET).any():
        errors.append("adaptation")
        start = np.minimum(start, PACKET)

    def section(of: int) -> bytes | None:
        at = np.flatnonzero((pid == of) & body)
        return _read_section(rows[at], start[at], unit[at])

    nothing = Stream(b"", [], [], [], [], packets, 0, 0, errors)
    pat = section(0)
    programs = [int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4) if pat[i : i + 2] != b"\x00\x00"] if pat and pat[0] == 0 else []
    if not programs:
        errors.append("no program association")
        return nothing
    pmt = section(programs[0])
    if not pmt or pmt[0] != 2:
        errors.append("no program map")
        return nothing
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
    streams = []
    while at + 5 <= len(pmt) - 4:
        streams.append(int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF)
        at += 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF)
    if not streams:
        errors.append("no elementary stream")
        return nothing
    at = np.flatnonzero((pid == streams[0]) & body)
    rows, start, unit, field = rows[at], start[at], unit[at], field[at]
    step = np.diff((rows[:, 3] & 15).astype(np.int64)) & 15
    same = np.concatenate(([False], step == 0)) if len(rows) else np.zeros(0, bool)
    jump = field & (start > 5) & (rows[:, 5] & 0x80 != 0)
    lost = int(((step != 1) & (step != 0) & ~jump[1:]).sum())
    if lost:
        errors.append("continuity")
    duplicates = int(same.sum())
    if duplicates:
        rows, start, unit, field = rows[~same], start[~same], unit[~same], field[~same]
    access = field & (start > 5) & (rows[:, 5] & 0x40 != 0)
    flat = rows[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    firsts = np.flatnonzero(unit)
    begins = (ends[firsts] - (PACKET - start[firsts])).tolist()
    clocked = field & (start > 11) & (rows[:, 5] & 0x10 != 0)
    parts, sizes, times, clocks, points = [], [], [], [], []
    for i, b in enumerate(begins):
        stop = begins[i + 1] if i + 1 < len(begins) else len(flat)
        head = flat[b : b + 19]
        if head[:3] != b"\x00\x00\x01" or len(head) < 9:
            errors.append("elementary packet")
            continue
        n = int.from_bytes(head[4:6], "big")
        if n and b + 6 + n <= stop:
            stop = b + 6 + n
        elif n:
            errors.append("short elementary packet")
        parts.append(flat[b + 9 + head[8] : stop])
        sizes.append(len(parts[-1]))
        times.append(_pts(head[9:14]) if head[7] & 0x80 and len(head) >= 14 else None)
        clocks.append(int.from_bytes(rows[firsts[i], 6:12].tobytes(), "big") >> 15 if clocked[firsts[i]] else None)
        points.append(bool(access[firsts[i]]))
    return Stream(b"".join(parts), sizes, times, clocks, points, packets, lost, duplicates, errors)


# --- columns ----------------------------------------------------------------


def padded(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of 64."""
    return text + b"\x00" * ((-len(text)) % PADDING or (0 if text else PADDING))


def mux(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes and media: each text's UTF-8 bytes, padded, as a transport stream."""
    slim = documents.select(F.col(f"`{id_column}`").alias("id"), F.coalesce(F.col(f"`{text_column}`"), F.lit("")).cast("binary").alias("data"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for a, b in batches_by_bytes(pc.binary_length(batch.column("data")).to_pylist(), BATCH_BYTES):
                part = batch.slice(a, b - a)
                data = part.column("data").to_pylist()
                media = [write_stream(padded(x)) for x in data]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([len(x) for x in data], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"]
                )

    return slim.mapInArrow(trimmed(run), f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_column)


def demux(media: DataFrame, id_column: str = "doc_id", media_column: str = "media", keep_payload: bool = True) -> DataFrame:
    """id with the payload read back, time stamps, sizes and random-access points of its units, counts and errors."""
    slim = media.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{media_column}`").alias("media"))
    kind = slim.schema["id"].dataType.simpleString()
    schema = (
        f"id {kind}, payload binary, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, "
        "sizes array<bigint>, pts array<bigint>, pcr array<bigint>, access array<bigint>, packets bigint, lost bigint, duplicates bigint, errors array<string>"
    )

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        longs = pa.list_(pa.int64())
        for batch in batches:
            for a, b in batches_by_bytes(pc.fill_null(pc.binary_length(batch.column("media")), 0).to_pylist(), BATCH_BYTES):
                part = batch.slice(a, b - a)
                stored = part.column("media").to_pylist()
                found = [read_stream(x) for x in stored]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        pa.array([s.payload if keep_payload else None for s in found], pa.binary()),
                        pa.array([len(s.payload) for s in found], pa.int64()),
                        pa.array([hashlib.sha256(s.payload).hexdigest() for s in found], pa.string()),
                        pa.array([zlib.crc32(s.payload[-PADDING:]) for s in found], pa.int64()),
                        pa.array([len(x or b"") for x in stored], pa.int64()),
                        pa.array([hashlib.sha256(x or b"").hexdigest() for x in stored], pa.string()),
                        pa.array([s.sizes for s in found], longs),
                        pa.array([s.pts for s in found], longs),
                        pa.array([s.pcr for s in found], longs),
                        pa.array([[i for i, x in enumerate(s.access) if x] for s in found], longs),
                        pa.array([s.packets for s in found], pa.int64()),
                        pa.array([s.lost for s in found], pa.int64()),
                        pa.array([s.duplicates for s in found], pa.int64()),
                        pa.array([s.errors for s in found], pa.list_(pa.string())),
                    ],
                    schema=pa.schema(
                        [("id", batch.schema.field("id").type), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
                         ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("sizes", longs), ("pts", longs), ("pcr", longs), ("access", longs), ("packets", pa.int64()), ("lost", pa.int64()),
                         ("duplicates", pa.int64()), ("errors", pa.list_(pa.string()))]
                    ),
                )

    return slim.mapInArrow(trimmed(run), schema).withColumnRenamed("id", id_column)


def op3(spark, sf_dir: str) -> DataFrame:
    """Every text muxed, and its stored bytes demuxed again."""
    from annalist.sources.tables import table

    stored = mux(table(spark, sf_dir, "documents")).withColumn("key", F.struct("doc_id", "n_bytes"))
    read = demux(stored, id_column="key", keep_payload=False)
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("units="), F.size("pts")),
        F.concat(F.lit("access="), F.size("access")),
        F.concat(F.lit("pts="), F.element_at("pts", 1), F.lit("-"), F.element_at("pts", -1)),
        F.concat(F.lit("pcr="), F.element_at("pcr", 1), F.lit("-"), F.element_at("pcr", -1)),
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("lost="), F.col("lost")),
        F.concat(F.lit("errors="), F.size("errors")),
    )
    return read.select(
        F.col("key.doc_id").alias("doc_id"), F.col("key.n_bytes").alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
