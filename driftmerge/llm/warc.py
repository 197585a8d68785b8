"""WARC bundles: records in independent Zstandard frames, with a seek table as the last, skippable frame.

Writing: records are gathered as they come into bundles of a bounded size, and within a bundle into frames of about
``FRAME_BYTES`` of plain text; a larger record has a frame of its own. A frame is compressed by itself, so a reader
who wants one record decompresses its frame and nothing else, and records of a frame share what they have in common.
The footer is the seekable format's table (frame sizes, both compressed and plain). The index maps each record's id to
its frame, its offset within the frame's plain bytes and its length. Bundles are rows of a Parquet table: a store that
only Spark can reach is enough, and a lost task writes again. ``record_index`` reads the columns of the index alone,
and ``fetch_records`` opens only the bundles, and in them only the frames, that hold the wanted ids.

Duplicates: of the records with equal payloads the one with the smallest id is a ``response``; all others are
``revisit`` records that refer to it and carry no payload.

Defined results: a null payload is an empty one; rows with equal ids are records of their own; a row without an id is a response that nothing refers to, named ``None``, and
read back without an id; empty tables give no
bundle; a damaged bundle raises ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from uuid import NAMESPACE_URL, uuid5

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import materialize, release, table

BUNDLE_BYTES, FRAME_BYTES = 4 << 20, 128 << 10
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
BUNDLES = "bundle_id string, ids array<string>, frames array<int>, offsets array<long>, lengths array<long>, data binary"


def record_id(ident: object) -> str:
    return f"<urn:uuid:{uuid5(NAMESPACE_URL, f'page:{ident}')}>"


def record(ident: object, url: str, payload: bytes, digest: str, refers_to: object) -> bytes:
    """One WARC/1.1 record; a revisit (refers_to not None) has headers only."""
    kind = "response" if refers_to is None else "revisit"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(ident)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {re.sub(r'[^!-~]', lambda m: ''.join(f'%{b:02X}' for b in m[0].encode()), url)}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page: {ident}",
        f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        block = http + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To: {refers_to}"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; raises ValueError if its form or digest is wrong."""
    head, found, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("length of a record")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and digest_of(payload) != fields["WARC-Payload-Digest"].removeprefix("sha1:"):
        raise ValueError("digest of a payload")
    return fields, payload


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def bundle(records: list[bytes], frame_bytes: int = FRAME_BYTES, level: int = 3) -> tuple[bytes, list[tuple[int, int, int]]]:
    """A bundle's bytes and, for each record, its frame, its offset there and its length.

    Frames come first, then the seek table: a skippable frame whose last nine bytes say how to read it.
    """
    press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    plain: list[list[bytes]] = []
    held, places = 0, []
    for x in records:
        if not plain or held and held + len(x) > frame_bytes:
            plain.append([])
            held = 0
        places.append((len(plain) - 1, held, len(x)))
        plain[-1].append(x)
        held += len(x)
    whole = [b"".join(x) for x in plain]
    frames = [press.compress(x) for x in whole]
    entries = b"".join(struct.pack("<II", len(f), len(x)) for f, x in zip(frames, whole, strict=True))
    body = entries + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return b"".join(frames) + struct.pack("<II", SKIPPABLE, len(body)) + body, places


def seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, packed size, plain size) of each frame, read from the footer alone."""
    count, flags, magic = struct.unpack_from("<IBI", data, len(data) - 9)
    start = len(data) - 9 - 8 * count
    if magic != SEEKABLE or flags or struct.unpack_from("<II", data, start - 8) != (SKIPPABLE, 8 * count + 9):
        raise ValueError("seek table")
    out, at = [], 0
    for packed, plain in struct.iter_unpack("<II", data[start : start + 8 * count]):
        out.append((at, packed, plain))
        at += packed
    if at != start - 8:
        raise ValueError("frames and seek table differ")
    return out


def fetch(data: bytes, frame: int, offset: int = 0, length: int | None = None) -> bytes:
    """Plain bytes of a frame from `offset` on, without touching the other frames."""
    at, packed, plain = seek_table(data)[frame]
    out = zstandard.ZstdDecompressor().decompress(memoryview(data)[at : at + packed])
    if len(out) != plain or length is not None and offset + length > plain:
        raise ValueError("plain size of a frame")
    return out[offset : None if length is None else offset + length]


def first_of_equal(pages: DataFrame, id_column: str, least: int = 0) -> DataFrame:
    """Adds refers_to: the smallest id with the same payload, null where that is the row itself or the payload is short.

    Payloads are told apart by SHA-256. Ids and digests alone are grouped, and what refers to another row is written as a table of ids, whose size
    is known when it is joined: payloads are shuffled only where it is too large to be broadcast. A payload that a third of all pages share meets one row of
    the aggregate, and adaptive skew handling splits the other side.
    """
    key = F.sha2(F.col("payload"), 256).alias("_key")
    keyed = pages.filter(F.length("payload") >= least).select(F.col(id_column).alias("_id"), key).filter("_id is not null")
    first = keyed.groupBy("_key").agg(F.min("_id").alias("_first"), F.count("*").alias("_copies")).filter("_copies > 1").select("_key", "_first")
    later = materialize(keyed.join(first, "_key").filter("_first <> _id").distinct(), "revisits")
    whole = pages.withColumn("_id", F.col(id_column)).withColumn("_key", key).join(later, ["_id", "_key"], "left")
    return whole.select(*pages.columns, F.col("_first").alias("refers_to"))


def write_bundles(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", text_column: str | Column = "html", least: int = 0, bundle_bytes: int = BUNDLE_BYTES, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Bundles of all rows; a row closes the bundle that it fills."""
    body = F.coalesce(F.col(text_column) if isinstance(text_column, str) else text_column, F.lit("")).cast("binary")
    plain = first_of_equal(pages.select(F.col(id_column).alias("ident"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), body.alias("payload")), "ident", least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[str] = []
        records: list[bytes] = []
        held = 0

        def close() -> pa.RecordBatch:
            data, places = bundle(records, frame_bytes)
            name = hashlib.sha256(data).hexdigest()[:32]
            kinds = (pa.int32(), pa.int64(), pa.int64())
            return pa.record_batch([pa.array([name]), pa.array([ids]), *(pa.array([list(c)], pa.list_(t)) for c, t in zip(zip(*places, strict=True), kinds, strict=True)), pa.array([data], pa.binary())], ["bundle_id", "ids", "frames", "offsets", "lengths", "data"])

        for batch in batches:
            for ident, url, payload, refers in zip(*(batch.column(k) for k in ("ident", "url", "payload", "refers_to")), strict=True):
                payload, ident = payload.as_py(), ident.as_py()
                ids.append(str(ident))
                records.append(record(ident, url.as_py(), payload, digest_of(payload), refers.as_py()))
                held += len(records[-1])
                if held >= bundle_bytes:
                    yield close()
                    ids, records, held = [], [], 0
        if ids:
            yield close()

    return plain.select("ident", "url", "payload", "refers_to").mapInArrow(run, BUNDLES)


RECORDS = "ident string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def _read(data: bytes, wanted: Iterable[tuple[str, int, int, int]]) -> pa.RecordBatch:
    """The wanted (id, frame, offset, length) of one bundle; each of their frames is decompressed once, the others never."""
    places, view, unpack = seek_table(data), memoryview(data), zstandard.ZstdDecompressor()
    out, open_, text = [], -1, b""
    for ident, frame, offset, length in sorted(wanted, key=lambda x: x[1:3]):
        if frame != open_:
            at, packed, plain = places[frame]
            open_, text = frame, unpack.decompress(view[at : at + packed])
            if len(text) != plain:
                raise ValueError("plain size of a frame")
        if offset + length > len(text):
            raise ValueError("a record that ends beyond its frame")
        fields, payload = parse(text[offset : offset + length])
        if fields["X-Page"] != ident:
            raise ValueError("the index names another record")
        out.append((ident, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], fields.get("X-Refers-To"), fields["WARC-Target-URI"], payload))
    kinds = (pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary())
    return pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 7, kinds, strict=True)], ["ident", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"])


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row of every record, found through the index and the seek table and read from its frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                ids, frames, offsets, lengths, data = (batch.column(k)[row].as_py() for k in ("ids", "frames", "offsets", "lengths", "data"))
                yield _read(data, zip(ids, frames, offsets, lengths, strict=True))

    return bundles.select("ids", "frames", "offsets", "lengths", "data").mapInArrow(run, RECORDS)


def record_index(bundles: DataFrame) -> DataFrame:
    """Rows (ident, bundle_id, frame, offset, length) of all records; of stored bundles only these columns are read."""
    zipped = F.explode(F.arrays_zip("ids", "frames", "offsets", "lengths"))
    return bundles.select("bundle_id", zipped.alias("x")).select(F.col("x.ids").alias("ident"), "bundle_id", F.col("x.frames").alias("frame"), F.col("x.offsets").alias("offset"), F.col("x.lengths").alias("length"))


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose ids stand in `wanted` (ident); a bundle's other frames stay compressed."""
    found = record_index(bundles).join(wanted.select(F.col("ident").cast("string").alias("ident")).distinct(), "ident", "left_semi")
    places = found.groupBy("bundle_id").agg(F.collect_list(F.struct("ident", "frame", "offset", "length")).alias("places"))  # a bundle's own records at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places_, data in zip(batch.column(0), batch.column(1), strict=True):
                yield _read(data.as_py(), [tuple(x.values()) for x in places_.as_py()])

    return bundles.select("bundle_id", "data").join(places, "bundle_id").select("places", "data").mapInArrow(run, RECORDS)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(write_bundles(table(spark, sf_dir, "pages")), "warc")
    out = read_bundles(archives).select(F.col("ident").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
    out = materialize(out, "records")
    release(archives)
    return out


#: Base 32 from the hexadecimal digest: 40 digits are 160 bits, five bits a letter.
OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id FROM pages
), d AS (
  SELECT *, list_transform(range(0, 160), lambda i: (strpos('0123456789abcdef', sha1(body)[(i // 4 + 1):(i // 4 + 1)]) - 1) // (1 << (3 - i % 4)) % 2) AS bits FROM p
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(16 * bits[5 * j + 1] + 8 * bits[5 * j + 2] + 4 * bits[5 * j + 3] + 2 * bits[5 * j + 4] + bits[5 * j + 5] + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN first_id = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM d
"""
