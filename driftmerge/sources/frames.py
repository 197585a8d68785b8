"""Files of length-prefixed frames, as the format ``frames``: four bytes, big-endian, that say how long the payload is, and the payload.

The sink writes a file a task, beside it an index of the offsets at which frames start, one about every ``SPLIT`` bytes; files get
their names when all tasks are done. The source reads a file in as many tasks as its index allows, and one without an index in one task. A
frame that announces more than ``MOST`` bytes is refused before anything is allocated for it, one that is cut off is an error, and the sink
refuses payloads that are too large. A null payload is an empty one.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from driftmerge.sources.folders import store_of

#: The largest payload. A fixed value of the model.
MOST = 64 << 20
SPLIT = 16 << 20
FRAMES = "file string, offset long, payload binary"


def framed(payload: bytes, most: int = MOST) -> bytes:
    if len(payload) > most:
        raise ValueError(f"a frame of {len(payload)} bytes is too large")
    return struct.pack(">I", len(payload)) + payload


def unframed(f: object, start: int, end: int, most: int = MOST) -> Iterator[tuple[int, bytes]]:
    """Offset and payload of each frame of an open file that starts between two offsets."""
    f.seek(start)
    while start < end:
        head = f.read(4)
        if len(head) < 4:
            raise EOFError(f"a frame's length is cut off at {start}")
        (n,) = struct.unpack(">I", head)
        if n > most:
            raise ValueError(f"the frame at {start} announces {n} bytes")
        body = f.read(n)
        if len(body) < n:
            raise EOFError(f"the frame at {start} is cut off")
        yield start, body
        start += 4 + n


class Frames(DataSource):
    """Options: ``path``, and ``most`` and ``split`` instead of the module's values."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: object) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema: object, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options, schema.fieldNames(), overwrite)


class Part(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class FrameReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.most = options["path"], int(options.get("most", MOST))

    def partitions(self) -> list[Part]:
        store, base = store_of(self.path)
        there = store.get_file_info(base)
        if there.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [there] if there.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(base))
        out = []
        for f in sorted((f for f in files if f.path == base or f.base_name.endswith(".frames")), key=lambda f: f.path):
            try:
                with store.open_input_stream(f"{f.path}.index") as held:
                    starts = [x for (x,) in struct.iter_unpack(">Q", held.read())]
            except FileNotFoundError:
                starts = [0]
            if not f.size:
                continue
            out += [Part(f.path, a, z) for a, z in zip(starts, [*starts[1:], f.size], strict=True)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.file:
            return
        store, _ = store_of(self.path)
        with store.open_input_file(partition.file) as f:
            for at, body in unframed(f, partition.start, partition.end, self.most):
                yield partition.file.rpartition("/")[2], at, body


@dataclass
class Wrote(WriterCommitMessage):
    part: str


class FrameWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str], overwrite: bool) -> None:
        if "payload" not in names:
            raise ValueError("frames are written from a column payload")
        self.path, self.most, self.split, self.overwrite = options["path"], int(options.get("most", MOST)), int(options.get("split", SPLIT)), overwrite

    def write(self, rows: Iterator[Row]) -> Wrote:
        store, base = store_of(self.path)
        store.create_dir(base, recursive=True)
        part, at, starts = f"{base}/{uuid.uuid4().hex}.part", 0, []
        with store.open_output_stream(part) as out:
            for row in rows:
                if not starts or at - starts[-1] >= self.split:
                    starts.append(at)
                at += out.write(framed(bytes(row.payload or b""), self.most))
        with store.open_output_stream(f"{part}.index") as out:
            out.write(struct.pack(f">{len(starts)}Q", *starts))
        return Wrote(part)

    def commit(self, messages: list[Wrote | None]) -> None:
        store, base = store_of(self.path)
        mine = {m.part for m in messages if m}
        for f in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if self.overwrite and f.base_name.endswith((".frames", ".frames.index")):
                store.delete_file(f.path)
        for part in sorted(mine):  # the index first, so that no file is seen without it
            store.move(f"{part}.index", f"{part.removesuffix('.part')}.frames.index")
            store.move(part, f"{part.removesuffix('.part')}.frames")

    def abort(self, messages: list[Wrote | None]) -> None:
        store, _ = store_of(self.path)
        for part in (m.part for m in messages if m):
            for name in (part, f"{part}.index"):
                if store.get_file_info(name).type == pafs.FileType.File:
                    store.delete_file(name)


def write_frames(payloads: DataFrame, path: str, mode: str = "append", **options: int) -> None:
    """Writes the column payload of each row as a frame below path."""
    payloads.sparkSession.dataSource.register(Frames)
    payloads.select(F.col("payload").cast("binary")).write.format("frames").mode(mode).options(**options).save(path)


def read_frames(spark: SparkSession, path: str, **options: int) -> DataFrame:
    """Rows (file, offset, payload) of the frames of a file, or of all in a folder."""
    spark.dataSource.register(Frames)
    return spark.read.format("frames").options(**options).load(path)
