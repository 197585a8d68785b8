"""Element codec: a document's elements as bytes, predicted from the element before.

Layout: the writers in the order they are first named, the number of elements, then each element's flags with what
they don't already say, and its character in UTF-8. Numbers are in groups of seven bits, differences zigzag. The
layout and the flags are fixed: sizes depend on them. The length is pure SQL (``encoded_size``); bytes are an
Arrow-batched function that handles a piece's characters at once, as all but the first are fully predicted.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmerge.functions.scalars import varint_length, zigzag
from driftmerge.operators.sequence import pieces
from driftmerge.sources.shared import dealt

#: Flag bits of an element. Fixed values.
DELETED, ORIGIN_PREV, ORIGIN_NONE, SAME_PEER, CLOCK_PLUS_1 = 1, 2, 4, 8, 16
Elem = tuple[int, int, int | None, int | None, str, bool]


def put(out: bytearray, value: int) -> None:
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)


def _signed(value: int) -> int:
    return value * 2 if value >= 0 else -value * 2 - 1


def pack_longs(*columns: np.ndarray) -> bytes:
    """Columns of longs, of one length, as compressed differences."""
    rows = np.array(columns, "<i8")
    steps = rows.copy()
    steps[:, 1:] -= rows[:, :-1]
    return zlib.compress(steps, 1)


def unpack_longs(data: bytes | None, columns: int) -> np.ndarray:
    """What ``pack_longs`` packed, a row a column; nothing packed is no longs."""
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i8").reshape(columns, -1), axis=1) if data else np.zeros((columns, 0), np.int64)


def pack_text(text: str) -> bytes:
    return zlib.compress(text.encode(), 1)


def unpack_text(data: bytes | None) -> str:
    return zlib.decompress(data).decode() if data else ""


def encode(elems: list[Elem]) -> bytes:
    """Bytes of (clock, peer, o_clock, o_peer, ch, deleted) in document order."""
    return encode_pieces([(*e[:5], "1" if e[5] else "0") for e in elems])


Piece = tuple[int, int, int | None, int | None, str, str]
_INNER = ORIGIN_PREV | SAME_PEER | CLOCK_PLUS_1


def encode_pieces(pieces: list[Piece]) -> bytes:
    """Bytes of (clock, peer, o_clock, o_peer, text, gone) in document order: encode() of their characters."""
    index: dict[int, int] = {}
    for _, peer, o_clock, o_peer, _, _ in pieces:
        index.setdefault(peer, len(index))
        if o_clock is not None:
            index.setdefault(o_peer, len(index))
    out = bytearray()
    for number in (len(index), *index, sum(len(p[4]) for p in pieces)):
        put(out, number)
    last: tuple[int, int | None] = (0, None)
    for clock, peer, o_clock, o_peer, text, gone in pieces:
        none, prev = o_clock is None, last[1] is not None and (o_clock, o_peer) == last
        same, step = peer == last[1], clock == last[0] + 1
        out.append(DELETED * (gone[0] == "1") | ORIGIN_NONE * none | ORIGIN_PREV * prev | SAME_PEER * same | CLOCK_PLUS_1 * step)
        if not same:
            put(out, index[peer])
        if not step:
            put(out, _signed(clock - last[0]))
        if not (none or prev):
            put(out, index[o_peer])
            put(out, _signed(o_clock - clock))
        out += text[0].encode()
        if len(text) > 1:
            body = np.frombuffer(text[1:].encode(), np.uint8)
            flags = (np.frombuffer(gone[1:].encode(), np.uint8) & 1) * DELETED | _INNER
            out += np.insert(body, np.flatnonzero(body & 0xC0 != 0x80), flags).tobytes()
        last = (clock + len(text) - 1, peer)
    return bytes(out)


#: Fully predicted elements, one after the other.
_STRETCH = re.compile(rb"(?:[\x1a\x1b](?:[\x00-\x7f]|[\xc0-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf7][\x80-\xbf]{3}))*+")


def decode(data: bytes) -> list[Elem] | None:
    """The elements, or None if the bytes are cut off, too long or no such list."""
    held = decode_pieces(data)
    if held is None:
        return None
    return [(c + k, p, *((o, q) if k == 0 else (c + k - 1, p)), ch, g == "1") for c, p, o, q, text, gone in held for k, (ch, g) in enumerate(zip(text, gone, strict=True))]


def decode_pieces(data: bytes) -> list[Piece] | None:
    """The elements as pieces: an element and the fully predicted ones that follow it; None as for ``decode``."""
    at = 0

    def take() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7
            if shift > 63:
                raise IndexError

    def signed() -> int:
        v = take()
        return v >> 1 if not v & 1 else -(v + 1 >> 1)

    try:
        count = take()
        if count > len(data):
            return None
        peers = [take() for _ in range(count)]
        many = take()
        if many > len(data):
            return None
        out: list[Piece] = []
        last: tuple[int, int | None] = (0, None)
        there = 0
        while there < many:
            flags = data[at]
            at += 1
            peer = last[1] if flags & SAME_PEER else peers[take()]
            clock = last[0] + 1 if flags & CLOCK_PLUS_1 else last[0] + signed()
            origin: tuple[int | None, int | None] = (None, None)
            if flags & ORIGIN_PREV:
                origin = last
            elif not flags & ORIGIN_NONE:
                o_peer = peers[take()]
                origin = (clock + signed(), o_peer)
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            ch = data[at : at + size].decode()
            if len(ch) != 1 or peer is None:
                return None
            at += size
            text, gone = ch, "1" if flags & DELETED else "0"
            body = np.frombuffer(data, np.uint8, _STRETCH.match(data, at).end() - at, at)
            if len(body):
                # Of the bytes that start something every other one is an element's flags.
                starts = np.flatnonzero(body & 0xC0 != 0x80)[: 2 * (many - there - 1)]
                if len(starts):
                    end = int(starts[-1]) + 1
                    while end < len(body) and body[end] & 0xC0 == 0x80:
                        end += 1
                    text += np.delete(body[:end], starts[::2]).tobytes().decode()
                    gone += ((body[starts[::2]] & DELETED) + ord("0")).tobytes().decode()
                    at += end
            out.append((clock, peer, *origin, text, gone))
            there += len(text)
            last = (clock + len(text) - 1, peer)
        return out if at == len(data) else None
    except (IndexError, UnicodeDecodeError):
        return None


def encoded_size(elems: DataFrame) -> DataFrame:
    """(path, bytes): the length that encode() would give, without making the bytes.

    A piece's inner characters are fully predicted: each takes its flags and itself. So only heads have to be looked at.
    """
    elems = pieces(elems, "pos")
    by = W.partitionBy("path").orderBy("pos")
    named = elems.select("path", F.explode(F.array(F.struct("pos", F.lit(0).alias("k"), F.col("peer").alias("p")), F.struct("pos", F.lit(1).alias("k"), F.col("o_peer").alias("p")))).alias("x")).select("path", "x.*").filter("p is not null")
    first = named.groupBy("path", "p").agg(F.min(F.struct("pos", "k")).alias("first"))
    index = first.withColumn("idx", (F.row_number().over(W.partitionBy("path").orderBy("first")) - 1).cast("long"))
    heads = index.groupBy("path").agg((varint_length(F.count("*")) + F.sum(varint_length(F.col("p")))).alias("head"))
    own, far = index.select("path", F.col("p").alias("peer"), F.col("idx").alias("i1")), index.select("path", F.col("p").alias("o_peer"), F.col("idx").alias("i2"))
    x = elems.withColumn("pc", F.coalesce(F.lag(F.col("clock") + F.col("n") - 1).over(by), F.lit(0))).withColumn("pp", F.lag("peer").over(by))
    x = x.join(own, ["path", "peer"]).join(far, ["path", "o_peer"], "left")
    prev = F.coalesce((F.col("o_clock") == F.col("pc")) & (F.col("o_peer") == F.col("pp")), F.lit(False))
    size = (
        F.col("n") + F.octet_length("text") + F.when(F.col("peer").eqNullSafe(F.col("pp")), 0).otherwise(varint_length(F.col("i1"))) + F.when(F.col("clock") == F.col("pc") + 1, 0).otherwise(varint_length(zigzag(F.col("clock") - F.col("pc"))))
        + F.when(F.col("o_clock").isNull() | prev, 0).otherwise(varint_length(F.col("i2")) + varint_length(zigzag(F.col("o_clock") - F.col("clock"))))
    )
    return x.groupBy("path").agg(F.sum(size).alias("body"), F.sum("n").alias("n")).join(heads, "path").select("path", (F.col("body") + F.col("head") + varint_length(F.col("n"))).cast("long").alias("bytes"))


def _by_path(elems: DataFrame, make: Callable[[str, list[Piece]], pa.Table], schema: str) -> DataFrame:
    """make(path, pieces in document order) for each path: a task holds one document."""

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        return make(part.column("path")[0].as_py(), list(zip(*(part.column(c).to_pylist() for c in ("clock", "peer", "o_clock", "o_peer", "text", "gone")), strict=True)))

    return dealt(pieces(elems, "pos")).groupBy("path").applyInArrow(run, schema)


def encoded(elems: DataFrame) -> DataFrame:
    """(path, n, data): each path's elements as bytes."""

    def make(path: str, held: list[Piece]) -> pa.Table:
        return pa.table([pa.array([path]), pa.array([sum(len(p[4]) for p in held)]), pa.array([encode_pieces(held)], pa.binary())], ["path", "n", "data"])

    return _by_path(elems, make, "path string, n long, data binary")


def decoded(data: DataFrame) -> DataFrame:
    """(path, pos, clock, peer, o_clock, o_peer, ch, deleted) of (path, data); bytes that are no such list give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if elems := decode(cell.as_py()) if cell.is_valid else None:
                    columns = [pa.array([path] * len(elems), pa.string()), pa.array(range(1, len(elems) + 1), pa.int64())]
                    kinds = (*[pa.int64()] * 4, pa.string(), pa.bool_())
                    yield pa.record_batch([*columns, *(pa.array(c, t) for c, t in zip(zip(*elems, strict=True), kinds, strict=True))], ["path", "pos", "clock", "peer", "o_clock", "o_peer", "ch", "deleted"])

    return data.select("path", "data").mapInArrow(run, "path string, pos long, clock long, peer long, o_clock long, o_peer long, ch string, deleted boolean")


def decoded_runs(data: DataFrame) -> DataFrame:
    """What ``decoded`` gives, as pieces: (path, pos, clock, peer, o_clock, o_peer, text, n, gone), a row for each run of predicted elements."""
    kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.string()]
    names = ["path", "pos", "clock", "peer", "o_clock", "o_peer", "text", "n", "gone"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                pos = 1
                for *ids, text, gone in (decode_pieces(cell.as_py()) or ()) if cell.is_valid else ():
                    rows.append((path, pos, *ids, text, len(text), gone))
                    pos += len(text)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)

    return data.select("path", "data").mapInArrow(run, "path string, pos long, clock long, peer long, o_clock long, o_peer long, text string, n long, gone string")
