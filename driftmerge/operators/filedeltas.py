"""Deltas of files that don't fit in a cell or in one task, and files rebuilt from them.

A greedy delta is sequential: where a copy starts depends on where the one before ended. So a file is cut into ranges, and a first
pass finds for each range, by itself, where a scan that enters it at any offset leaves it: a step function of the offset, as
scans that enter between two matches go on alike. Following these functions from range to range gives the offset at which the sequential scan enters each; a
second pass writes each range's ops from there. Both passes take a task a range.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.functions.scalars import inflate
from driftmerge.operators import blocks, codec
from driftmerge.sources.folders import store_of
from driftmerge.sources.shared import materialize

#: Bytes of a range, and of a range that are looked at, or of a file that are copied, at a time.
SPAN, READ = 64 << 20, 4 << 20
#: Steps after which a batch of them is given out.
STEPS = 1 << 18
FILE_OP = "path string, n long, op struct<kind:string,block_no:long,bytes:binary>"
_OP = pa.struct([("kind", pa.string()), ("block_no", pa.int64()), ("bytes", pa.binary())])


def ranges(files: DataFrame, size: int, span: int = SPAN) -> DataFrame:
    """(path, uri, k, start, end, last) of files (path, uri): ranges of `span` bytes; the last one takes what is left, so none is shorter than a block."""
    span = max(span, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, uri in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, place = store_of(uri)
                found = store.get_file_info(place)
                if found.type != pafs.FileType.File:
                    raise FileNotFoundError(uri)
                many = max(1, found.size // span)
                rows += [(path, uri, k, k * span, found.size if k == many - 1 else (k + 1) * span, k == many - 1) for k in range(many)]
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["path", "uri", "k", "start", "end", "last"])

    return files.select("path", "uri").mapInArrow(run, "path string, uri string, k long, start long, end long, last boolean")


def range_matches(data: bytes, weaks: np.ndarray, known: Known | set[tuple[int, bytes]], size: int) -> np.ndarray:
    """The offsets at which a window equals a block. A window that equals the one before, in a run of one byte, isn't hashed again."""
    keys = blocks.rolling(data, size)
    maybe = blocks.candidates(keys, weaks)
    if not len(maybe):
        return maybe
    x = np.frombuffer(data, np.uint8)
    same = np.r_[0, np.cumsum(x[1:] == x[:-1])]  # same[i]: how many of the bytes 1 to i equal the one before
    hit = np.zeros(len(keys) + 1, bool)
    for i in maybe.tolist():
        if i and same[i + size - 1] - same[i - 1] == size:
            hit[i] = hit[i - 1]
        else:
            hit[i] = (int(keys[i]), hashlib.sha256(data[i : i + size]).digest()[:8]) in known
    return np.flatnonzero(hit[:-1])


class Known:
    """The signatures of blocks, as a set that is made when it is asked."""

    def __init__(self, weaks: np.ndarray, strongs: np.ndarray) -> None:
        self.weaks, self.strongs, self.made = weaks, strongs, None

    def __contains__(self, signature: tuple[int, bytes]) -> bool:
        if self.made is None:
            self.made = set(zip(self.weaks.tolist(), self.strongs.tolist(), strict=True))
        return signature in self.made


def exits(found: np.ndarray, start: int, end: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Steps (upto, leaves): a scan that enters [start, end) at `upto` or before, but after the step before, leaves it at `leaves`.

    found: all offsets in the range at which a block stands.
    """
    after = np.searchsorted(found, found + size)
    leaves = np.full(len(found) + 1, end)
    for j in range(len(found) - 1, -1, -1):
        leaves[j] = max(leaves[after[j]], found[j] + size)
    enters = np.minimum(np.searchsorted(found, [start, start + size - 1]), len(found))
    kept = np.arange(enters[0], enters[1] + 1)
    upto = np.r_[found, np.iinfo(np.int64).max][kept]
    return upto, leaves[kept]


def _signed(rows: DataFrame, old_signatures: DataFrame) -> DataFrame:
    """Rows beside their file's signatures, which are 12 bytes for each block of it."""
    return rows.join(blocks.signed_rows(old_signatures), "path", "left")


def ranged_deltas(files: DataFrame, old_signatures: DataFrame, size: int, span: int = SPAN) -> DataFrame:
    """Rows (path, n, op) of files (path, uri): what the sequential delta gives, by ranges; n orders a file's ops.

    Neighbouring literals are what one literal of the sequential delta is: they are cut where ranges and parts end.
    """
    spans = materialize(_signed(ranges(files, size, span), old_signatures).repartition(F.col("path"), F.col("k")), "ranges")

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            steps, first, many = [], 0, 0
            for i, (uri, start, end) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("uri", "start", "end")), strict=True)):
                weaks, strongs = blocks.held_signatures(batch.column("sigs")[i])
                known = Known(weaks, strongs)
                store, place = store_of(uri)
                found = []
                with store.open_input_file(place) as f:
                    for at in range(start, end, READ):
                        stop = min(at + READ, end)
                        f.seek(at)
                        found.append(at + range_matches(f.read(stop - at + size - 1), weaks, known, size))
                steps.append(exits(np.concatenate(found) if found else np.zeros(0, np.int64), start, end, size))
                many += len(steps[-1][0])
                if many >= STEPS or i + 1 == batch.num_rows:
                    own = batch.slice(first, len(steps))
                    yield pa.record_batch([*(own.column(c) for c in ("path", "k", "start")), *(pa.array(x, pa.list_(pa.int64())) for x in zip(*steps, strict=True))], ["path", "k", "start", "upto", "leaves"])
                    steps, first, many = [], i + 1, 0

    steps = spans.mapInArrow(leave, "path string, k long, start long, upto array<long>, leaves array<long>")

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at = None, 0
        for batch in batches:
            entered = []
            for name, start, upto, leaves in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), batch.column(4), strict=True):
                path, at = name, max(at, start) if name == path else start
                entered.append(at)
                at = int(leaves.values.to_numpy()[np.searchsorted(upto.values.to_numpy(), at)])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(entered, pa.int64())], ["path", "k", "entered"])

    entered = steps.repartition("path").sortWithinPartitions("path", "k").mapInArrow(follow, "path string, k long, entered long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, ops, held = [], [], [], 0

            def rows() -> pa.RecordBatch:
                return pa.record_batch([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), blocks.ops_array([ops]).values], ["path", "n", "op"])  # noqa: B023  called at once

            for i, r in enumerate(batch.drop_columns("sigs").to_pylist()):
                for n, op in enumerate(range_ops(r, *blocks.held_signatures(batch.column("sigs")[i]), size), r["k"] << 32):
                    names.append(r["path"])
                    numbers.append(n)
                    ops.append(op)
                    held += len(op[2] or b"")
                    if held >= blocks.GIVEN or len(ops) >= 1 << 14:
                        yield rows()
                        names, numbers, ops, held = [], [], [], 0
            if ops:
                yield rows()

    out = spans.join(entered, ["path", "k"]).select("path", "uri", "k", "entered", "end", "last", "sigs").mapInArrow(write, FILE_OP)
    out._driftmerge_path = spans._driftmerge_path  # for release(), once the ops were used
    return out


def range_ops(r: dict, weaks: np.ndarray, strongs: list[bytes], size: int) -> Iterator[blocks.Op]:
    """The ops of a range from the offset at which the scan enters it; those of the last range see the file's short tail."""
    at, end = r["entered"], r["end"]
    if at >= end:
        return
    store, place = store_of(r["uri"])
    with store.open_input_file(place) as f:
        f.seek(at)
        left = end - at + (0 if r["last"] else size - 1)  # windows that start in the range may end beyond it

        def parts() -> Iterator[bytes]:
            nonlocal left
            while left > 0 and (part := f.read(min(READ, left))):
                left -= len(part)
                yield part

        # Beyond the range there is no window more, so what is left over at the end is literal, and the next range's.
        for op in blocks.delta_stream(parts(), weaks, strongs, size):
            if at >= end:
                return
            if op[0] == "lit" and not r["last"]:
                op = ("lit", None, op[2][: end - at])
            at += size if op[0] == "copy" else len(op[2])
            yield op


APPLIED = "path string, len long, hash string, outcome string"


class Rebuilt:
    """One file that is being written: copies from the old one and literals, hashed as they come, under a name of its own."""

    def __init__(self, root: str, path: str, uri: str | None, announced: str | None, size: int, made: set[str] | None = None) -> None:
        self.store, base = store_of(root)
        self.path, self.target, self.announced, self.size = path, f"{base}/{path}", announced, size
        self.part, self.digest, self.length, self.old = f"{self.target}.dmtmp{uuid.uuid4().hex}", hashlib.sha256(), 0, None
        self.run: tuple[int, int] | None = None  # blocks that stand side by side are read at once
        made = set() if made is None else made  # folders that are there
        if (folder := self.target.rpartition("/")[0]) not in made:
            self.store.create_dir(folder, recursive=True)
            made.add(folder)
        if uri:
            other, place = store_of(uri)
            if other.get_file_info(place).type == pafs.FileType.File:
                self.old = other.open_input_file(place)
        self.out = self.store.open_output_stream(self.part)

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.digest.update(data)
        self.length += len(data)

    def flush(self) -> None:
        if self.run and self.old:
            self.old.seek(self.run[0] * self.size)
            left = (self.run[1] - self.run[0]) * self.size
            while left and (data := self.old.read(min(READ, left))):  # the old file's last block may be short
                self.put(data)
                left -= len(data)
        self.run = None

    def add(self, kind: str, block: int | None, data: bytes | None) -> None:
        if kind == "copy":
            if self.run and self.run[1] == block:
                self.run = (self.run[0], block + 1)
            else:
                self.flush()
                self.run = (block, block + 1)
            return
        self.flush()
        self.put(inflate(data) if kind == "litz" else data)

    def close(self) -> tuple[str, int, str, str]:
        """The file gets its name if its hash is the one announced; else it goes."""
        self.flush()
        self.out.close()
        if self.old:
            self.old.close()
        made = self.digest.hexdigest()
        fine = self.announced is None or made == self.announced
        if fine:
            self.store.move(self.part, self.target)
        else:
            self.store.delete_file(self.part)
            if (size := self.rebuilt()) is not None:
                return self.path, size, self.announced, "written"
        return self.path, self.length, made, "written" if fine else "other content"

    def rebuilt(self) -> int | None:
        """The bytes of the file that is there already, if its hash is the one announced: where files take the old ones' places, a task that runs twice finds them so."""
        if self.store.get_file_info(self.target).type != pafs.FileType.File:
            return None
        digest, size = hashlib.sha256(), 0
        with self.store.open_input_file(self.target) as f:
            while data := f.read(READ):
                digest.update(data)
                size += len(data)
        return size if digest.hexdigest() == self.announced else None


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ops as a row for those of a file that lie one after the other: numbers that say the block of a copy or, below zero, the bytes of a literal, and all literals compressed. A row an op would be shuffled as some hundred bytes more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        n, op = batch.column("n").to_numpy(), batch.column("op")
        kind, block, data = (pc.struct_field(op, c) for c in ("kind", "block_no", "bytes"))
        data = data.fill_null(b"")
        edges = np.frombuffer(data.buffers()[1], np.int64 if pa.types.is_large_binary(data.type) else np.int32)[data.offset : data.offset + len(data) + 1]
        body = memoryview(data.buffers()[2] or b"")
        literal = -1 - 2 * np.diff(edges).astype(np.int64) - pc.equal(kind, "litz").to_numpy(zero_copy_only=False)
        codes = np.where(pc.equal(kind, "copy").to_numpy(zero_copy_only=False), block.fill_null(0).to_numpy(), literal)
        path = batch.column("path").dictionary_encode().indices.to_numpy()
        at = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (np.diff(n) != 1)])
        cells = [(codec.pack_longs(codes[i:j]), zlib.compress(body[edges[i] : edges[j]], 1)) for i, j in zip(at.tolist(), [*at[1:].tolist(), len(n)], strict=True)]
        yield pa.record_batch([batch.column("path").take(pa.array(at)), pa.array(n[at]), *(pa.array(c, pa.binary()) for c in zip(*cells, strict=True))], ["path", "n", "codes", "data"])


def _unpacked(codes: bytes, data: bytes) -> Iterator[blocks.Op]:
    data, at = zlib.decompress(data), 0
    for code in codec.unpack_longs(codes, 1)[0].tolist():
        if code >= 0:
            yield "copy", code, None
        else:
            size, packed = divmod(-1 - code, 2)
            yield "litz" if packed else "lit", None, data[at : at + size]
            at += size


def apply_deltas(ops: DataFrame, announced: DataFrame, root: str, size: int) -> DataFrame:
    """Writes the files that ops (path, n, op) rebuild below root; gives (path, len, hash, outcome), "written" or "other content".

    announced: (path, uri, hash), a row a file: where its old content is, null if there is none, and the hash that the new one must have, null if it isn't checked. A file without
    ops is empty. A task writes its files one after the other and holds one batch of ops and one part of an old file, whatever
    their sizes; nothing is seen under a file's name before its hash is right. Files may take the places of the old ones.
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = announced.select("path", F.lit(-1).cast("long").alias("n"), none("binary").alias("codes"), none("binary").alias("data"), "uri", "hash")
    packed = ops.select("path", "n", "op").mapInArrow(_packed, "path string, n long, codes binary, data binary").join(announced.select("path"), "path", "left_semi")
    rows = heads.unionByName(packed.select("path", "n", "codes", "data", none("string").alias("uri"), none("string").alias("hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Rebuilt | None = None
        made: set[str] = set()  # folders

        def done(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], [x.split()[0] for x in APPLIED.split(", ")])

        for batch in batches:
            out = []
            for i, (path, n, uri, hash_) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "n", "uri", "hash")), strict=True)):
                if n < 0:
                    if held:
                        out.append(held.close())
                    held = Rebuilt(root, path, uri, hash_, size, made)
                else:
                    for op in _unpacked(batch.column("codes")[i].as_py(), batch.column("data")[i].as_py()):
                        held.add(*op)
            if out:
                yield done(out)
        if held:
            yield done([held.close()])

    return materialize(rows.repartition("path").sortWithinPartitions("path", "n").select("path", "n", "codes", "data", "uri", "hash").mapInArrow(run, APPLIED), "applied")
