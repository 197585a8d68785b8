"""Media columns: MPEG transport streams that hold bytes losslessly.

Each payload becomes one program: one packetised elementary stream of access units of up to ``UNIT`` bytes, and the
program association and program map tables, which stand at the start and again before every random-access point, so
that a reader can enter there. Each unit starts with a header that carries a presentation time stamp; every
``GOP``-th unit starts with a random-access point and a clock reference. Reading parses the tables, checks every
continuity counter and table checksum, and reassembles the units. The query writes the streams as a media column,
beside the time stamps and random-access points, and reads them back from there.

Defined results: null and empty payloads give a stream of the tables alone, without units; equal payloads give
equal streams; a stream that is damaged raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from driftmerge.llm.common import materialize, release, table

PACKET, SYNC = 188, 0x47
PID_PAT, PID_PMT, PID_DATA = 0, 0x100, 0x101
#: stream_type for private data in PES packets, stream_id private_stream_1.
STREAM_TYPE, STREAM_ID = 0x06, 0xBD
UNIT, GOP, TICKS = 16 * 1024, 4, 3600


def section_crc(data: bytes) -> int:
    """CRC-32/MPEG-2, most significant bit first; tables are a few dozen bytes."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table_id, 0xB000 | len(body) + 9, ident, 0xC1, 0, 0) + body
    return head + struct.pack(">I", section_crc(head))


def _table_packet(pid: int, counter: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10 | counter, 0) + section).ljust(PACKET, b"\xff")


_PAT, _PMT = _section(0, 1, struct.pack(">HH", 1, 0xE000 | PID_PMT)), _section(2, 1, struct.pack(">HHBHH", 0xE000 | PID_DATA, 0xF000, STREAM_TYPE, 0xE000 | PID_DATA, 0xF000))
#: Both tables, for each value of their continuity counters.
TABLES = [_table_packet(PID_PAT, k, _PAT) + _table_packet(PID_PMT, k, _PMT) for k in range(16)]


def _stamp(pts: int) -> bytes:
    return struct.pack(">BHH", 0x21 | pts >> 29 & 0x0E, (pts >> 14 & 0xFFFE) | 1, (pts << 1 & 0xFFFE) | 1)


def mux(payload: bytes) -> bytes:
    """The transport stream of one payload."""
    parts, counter = [] if payload else [TABLES[0]], 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        pts = number * TICKS
        unit = payload[at : at + UNIT]
        pes = b"\x00\x00\x01" + struct.pack(">BHBBB", STREAM_ID, len(unit) + 8, 0x84, 0x80, 5) + _stamp(pts) + unit
        here, size, random = 0, len(pes), number % GOP == 0
        if random:
            parts.append(TABLES[number // GOP & 15])
        while here < size:
            first = here == 0
            field_ = b""
            if first and random:
                base = pts & 0x1FFFFFFFF
                field_ = b"\x50" + struct.pack(">IH", base >> 1, (base & 1) << 15 | 0x7E00)
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            left = size - here
            if left < room:  # an adaptation field fills the rest
                fill = PACKET - 4 - left
                field_ = (field_ or (b"\x00" if fill > 1 else b"")).ljust(fill - 1, b"\xff")
                head = struct.pack(">BHBB", SYNC, first << 14 | PID_DATA, 0x30 | counter, fill - 1)
                parts += (head, field_, pes[here:])
                here = size
            elif field_:
                parts += (struct.pack(">BHBB", SYNC, first << 14 | PID_DATA, 0x30 | counter, len(field_)), field_, pes[here : here + room])
                here += room
            else:
                parts += (struct.pack(">BHB", SYNC, first << 14 | PID_DATA, 0x10 | counter), pes[here : here + room])
                here += room
            counter = counter + 1 & 15
    return b"".join(parts)


@dataclass
class Parsed:
    """What a stream holds: the payload, the units' time stamps and the byte offsets of the random-access points' tables."""

    payload: bytes = b""
    stamps: list[int] = field(default_factory=list)
    access: list[int] = field(default_factory=list)
    packets: int = 0


def _checked(packet: bytes, what: str) -> bytes:
    start = 5 + packet[4]
    size = 3 + (struct.unpack_from(">H", packet, start + 1)[0] & 0xFFF)
    section = packet[start : start + size]
    if section_crc(section[:-4]) != struct.unpack(">I", section[-4:])[0]:
        raise ValueError(f"checksum of the {what}")
    return section


_TABLE_CACHE: dict[bytes, bytes] = {}


def _section_of(packet: bytes, what: str) -> bytes:
    """A packet's table; equal packets are checked once."""
    if packet not in _TABLE_CACHE:
        if len(_TABLE_CACHE) > 64:
            _TABLE_CACHE.clear()
        _TABLE_CACHE[packet] = _checked(packet, what)
    return _TABLE_CACHE[packet]


def demux(stream: bytes) -> Parsed:
    """Reads a stream back; raises ValueError where a table, counter, start code or length is wrong."""
    if len(stream) % PACKET:
        raise ValueError("the stream isn't whole packets")
    out, units = Parsed(packets=len(stream) // PACKET), []
    map_pid = data_pid = -1
    expected: dict[int, int] = {}
    unit, want, tables = [], 0, 0

    def close() -> None:
        nonlocal unit
        if unit:
            body = b"".join(unit)
            if len(body) != want:
                raise ValueError("length of an elementary packet")
            units.append(body)
        unit = []

    for at in range(0, len(stream), PACKET):
        sync, word, flags = struct.unpack_from(">BHB", stream, at)
        if sync != SYNC:
            raise ValueError("lost synchronisation")
        pid, counter = word & 0x1FFF, flags & 15
        if expected.get(pid, counter) != counter:
            raise ValueError("continuity counter")
        expected[pid] = counter + 1 & 15
        if pid == data_pid:
            body = at + 4
            if flags & 0x20:
                length = stream[body]
                if length and stream[body + 1] & 0x40:
                    out.access.append(tables)
                body += length + 1
            if word & 0x4000:
                close()
                if stream[body : body + 4] != b"\x00\x00\x01\xbd":
                    raise ValueError("start code of an elementary packet")
                want = struct.unpack_from(">H", stream, body + 4)[0] - 3 - stream[body + 8]
                a, b, c = struct.unpack_from(">BHH", stream, body + 9)
                out.stamps.append((a & 0x0E) << 29 | (b & 0xFFFE) << 14 | c >> 1)
                body += 9 + stream[body + 8]
            unit.append(stream[body : at + PACKET])
        elif pid == PID_PAT:
            tables = at
            map_pid = struct.unpack_from(">H", _section_of(stream[at : at + PACKET], "program association table"), 10)[0] & 0x1FFF
        elif pid == map_pid:
            data_pid = struct.unpack_from(">H", _section_of(stream[at : at + PACKET], "program map table"), 13)[0] & 0x1FFF
        else:
            raise ValueError("a packet of no known program")
    close()
    out.payload = b"".join(units)
    return out


def entered(stream: bytes, access: int) -> Parsed:
    """What follows a random-access point, read without anything before it."""
    return demux(stream[access:])


def encode_column(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", multiple: int = 192) -> DataFrame:
    """Rows (id, n_bytes, media, stamps, access): the UTF-8 text, filled up with blanks to a positive multiple, as a stream.

    stamps are the units' time stamps, access the byte offsets at which a reader may enter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                plain = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in part.column(1)]
                media = [mux(x.ljust(max(1, -(-len(x) // multiple)) * multiple)) for x in plain]
                read = [demux(x) for x in media]  # what is stored is what can be read
                lists = [pa.array(x, pa.list_(pa.int64())) for x in ([r.stamps for r in read], [r.access for r in read])]
                yield pa.record_batch([part.column(0), pa.array(map(len, plain), pa.int64()), pa.array(media, pa.binary()), *lists], ["id", "n_bytes", "media", "stamps", "access"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(docs[id_column], docs[text_column]).mapInArrow(run, f"id {kind}, n_bytes long, media binary, stamps array<long>, access array<long>")


def features(media: DataFrame) -> DataFrame:
    """Reads stored streams (id, n_bytes, media) back and describes them, a row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for n_bytes, cell in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                stream = cell.as_py()
                got = demux(stream)
                rows.append(
                    (n_bytes, len(got.payload), hashlib.sha256(got.payload).hexdigest(), zlib.crc32(got.payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest(),
                     f"packets={got.packets};units={len(got.stamps)};last_pts={got.stamps[-1] if got.stamps else -1};access_points={','.join(map(str, got.access))}")
                )
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = media.schema["id"].dataType.simpleString()
    return media.select("id", "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = materialize(encode_column(table(spark, sf_dir, "documents")), "media")
    out = materialize(features(stored).withColumnRenamed("id", "doc_id"), "features")
    release(stored)
    return out
