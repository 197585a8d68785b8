"""Folder trees: distributed listing that leaves ignored folders alone, file scans, and a stream of what changes.

A task walks folders breadth first until it has listed ``BUDGET`` entries; folders that it didn't get to are dealt over all tasks of the
next round, so a small tree takes one round and a large one few, whatever its depth. An ignored folder is never listed and
an ignored file never opened. Stores are those that Arrow reads.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from driftmerge.functions import paths, scalars
from driftmerge.sources.shared import materialize

#: Entries that a task lists before it hands folders on, and bytes of a file that are read at a time.
BUDGET, READ = 20_000, 4 << 20
ENTRY = "path string, folder boolean, len long, mtime_us long"
_ENTRY = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("len", pa.int64()), ("mtime_us", pa.int64())])


def store_of(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path within it; one without a scheme is local."""
    store, base = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return store, base.rstrip("/")


def entries(store: pafs.FileSystem, base: str, folder: str, ignored: Callable[[str], bool]) -> Iterator[tuple[str, bool, int, int]]:
    """(path, is a folder, length, modified at) of what lies in a folder and isn't ignored; nothing if the folder is gone by now."""
    try:
        found = store.get_file_info(pafs.FileSelector(f"{base}/{folder}".rstrip("/") or "/", allow_not_found=bool(folder)))
    except FileNotFoundError:
        if folder:
            return
        raise
    for x in found:
        path = f"{folder}/{x.base_name}" if folder else x.base_name
        if x.type in (pafs.FileType.File, pafs.FileType.Directory) and not ignored(path):
            yield path, x.type == pafs.FileType.Directory, x.size or 0, (x.mtime_ns or 0) // 1000


def walk(store: pafs.FileSystem, base: str, folders: list[str], ignored: Callable[[str], bool], budget: int = BUDGET) -> Iterator[tuple[str, bool, int, int]]:
    """The files below some folders, and those folders that were not got to."""
    queue, seen = deque(folders), 0
    while queue and seen < budget:
        for one in entries(store, base, queue.popleft(), ignored):
            seen += 1
            if one[1]:
                queue.append(one[0])
            else:
                yield one
    yield from ((folder, True, 0, 0) for folder in queue)


def listing(spark: SparkSession, root: str, rules: list[str] = (), budget: int = BUDGET) -> DataFrame:
    """Rows (path, len, mtime_us) of all files below root that no rule ignores, from their folders alone."""
    patterns = [*paths.BUILT_IN, *rules]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        ignored = paths.matcher(patterns)
        for batch in batches:
            rows: list[tuple] = []
            for one in walk(store, base, batch.column(0).to_pylist(), ignored, budget):
                rows.append(one)
                if len(rows) == 10_000:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=_ENTRY)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], schema=_ENTRY)

    todo, rounds = spark.createDataFrame([("",)], "path string").coalesce(1), []
    while True:
        found = materialize(todo.mapInArrow(run, ENTRY), "listing")
        rounds.append(found.filter("not folder").select("path", "len", "mtime_us"))
        todo = found.filter("folder").select("path")
        if todo.isEmpty():
            return reduce(DataFrame.unionAll, rounds)
        todo = todo.repartition(n)


def looked(store: pafs.FileSystem, base: str, path: str, sniff: int = scalars.SNIFF) -> tuple[str, int, str, bytes] | None:
    """(path, length, SHA-256, first bytes) of a file of any length, read part by part; none if it is gone by now."""
    digest, head, size = hashlib.sha256(), b"", 0
    try:
        with store.open_input_stream(f"{base}/{path}") as f:
            while part := f.read(READ):
                if len(head) <= sniff:
                    head += part[: sniff + 1 - len(head)]
                digest.update(part)
                size += len(part)
    except FileNotFoundError:
        return None
    return path, size, digest.hexdigest(), head


def scan_files(spark: SparkSession, root: str, rules: list[str] = ()) -> DataFrame:
    """Rows (path, len, mtime_ms, hash, is_binary) of all files below root that no rule ignores, empty ones too.

    Folders are listed first. Files are dealt over all tasks, which open those alone that are kept; one that went away in between has no row.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["path", "mtime_us", "len", "hash", "head"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(root)
        rows, held = [], 0
        for batch in batches:
            for path, mtime in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if one := looked(store, base, path):
                    rows.append((path, mtime, *one[1:]))
                    held += len(one[3])
                if held > 2 * READ:
                    yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], names)

    kept = listing(spark, root, rules).select("path", "mtime_us").repartition(n)
    found = kept.mapInArrow(run, "path string, mtime_us long, len long, hash string, head binary")
    return found.select("path", "len", F.floor(F.col("mtime_us") / 1000).cast("long").alias("mtime_ms"), "hash", scalars.is_binary(scalars.sniffed(F.col("head"))).alias("is_binary"))


CHANGE = "path string, kind string, len long, mtime_us long, batch long"


class FolderChanges(DataSource):
    """The format ``folder_changes``: what was created, modified or removed below a folder since the batch before.

    Options: ``path``, the folder; ``snapshots``, a folder that the cluster shares, for the listings that batches are compared with; ``rules``, a
    JSON list of ignore rules beside the built-in ones; ``shards`` and ``depth``. Each batch lists the tree in `shards` tasks: a task walks the files and
    folders whose first `depth` names hash to it, compares them with its listing of the batch before, and keeps the new one. A batch that runs again finds the listing
    that it kept and gives the same rows. Each batch is a listing, so trigger it at the rate that the store can bear.
    A file counts as modified if its length or the time of its last change did; what came and went between two batches has no row.
    """

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return CHANGE

    def streamReader(self, schema: object) -> FolderReader:  # noqa: N802  a name of the interface
        return FolderReader(self.options)


class Shard(InputPartition):
    def __init__(self, number: int, start: int, end: int) -> None:
        self.number, self.start, self.end = number, start, end


class FolderReader(DataSourceStreamReader):
    """Offsets are numbers of listings: 0 is before the first one."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.kept = options["path"], options["snapshots"].rstrip("/")
        self.rules = [*paths.BUILT_IN, *json.loads(options.get("rules", "[]"))]
        self.shards, self.depth = int(options.get("shards", "8")), int(options.get("depth", "1"))
        self.last = 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """A number that no listing has yet: after a restart, one more than the latest that was kept."""
        store, base = store_of(self.kept)
        names = [x.base_name for x in store.get_file_info(pafs.FileSelector(base, allow_not_found=True))]
        self.last = max([self.last, *(int(x) for x in names if x.isdigit())]) + 1
        store.create_dir(f"{base}/{self.last}", recursive=True)
        return {"batch": self.last}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return [Shard(k, start["batch"], end["batch"]) for k in range(self.shards)]

    def shard(self, path: str) -> int:
        return zlib.crc32("/".join(path.split("/")[: self.depth]).encode()) % self.shards

    def listed(self, number: int) -> pa.Table:
        """The shard's files as they are now: folders above `depth` are listed by every shard, those below by one."""
        store, base = store_of(self.root)
        plain = paths.matcher(self.rules)
        other = lambda path: plain(path) or (path.count("/") + 1 >= self.depth and self.shard(path) != number)
        rows = [(path, size, at) for path, _, size, at in walk(store, base, [""], other, budget=1 << 62) if self.shard(path) == number]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 3, (pa.string(), pa.int64(), pa.int64()), strict=True)], ["path", "len", "mtime_us"])

    def snapshot(self, batch: int, number: int) -> pa.Table | None:
        store, base = store_of(self.kept)
        try:
            return pq.read_table(f"{base}/{batch}/{number}.parquet", filesystem=store)
        except FileNotFoundError:
            return None

    def read(self, partition: Shard) -> Iterator[tuple]:
        number, batch = partition.number, partition.end
        now = self.snapshot(batch, number)
        if now is None:
            store, base = store_of(self.kept)
            now, place = self.listed(number), f"{base}/{batch}/{number}.parquet"
            store.create_dir(f"{base}/{batch}", recursive=True)
            part = f"{place}.{hashlib.sha256(repr(id(now)).encode()).hexdigest()[:8]}.part"
            pq.write_table(now, part, filesystem=store)
            store.move(part, place)
        before = self.snapshot(partition.start, number) if partition.start else None
        if partition.start and before is None:
            raise FileNotFoundError(f"listing {partition.start} of shard {number} is gone from {self.kept}")
        old = dict(zip(before.column("path").to_pylist(), zip(before.column("len").to_pylist(), before.column("mtime_us").to_pylist(), strict=True), strict=True)) if before else {}
        for path, size, at in zip(*(now.column(c).to_pylist() for c in ("path", "len", "mtime_us")), strict=True):
            was = old.pop(path, None)
            if was != (size, at):
                yield path, "modified" if was else "created", size, at, batch
        yield from ((path, "removed", size, at, batch) for path, (size, at) in old.items())

    def commit(self, end: dict) -> None:
        """Listings before the last one that was used are no longer compared with."""
        store, base = store_of(self.kept)
        for x in store.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
            if x.base_name.isdigit() and int(x.base_name) < end["batch"]:
                store.delete_dir(x.path)


def changes(spark: SparkSession, root: str, snapshots: str, rules: list[str] = (), shards: int = 8, depth: int = 1) -> DataFrame:
    """A stream (path, kind, len, mtime_us, batch) of what is created, modified and removed below root."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("snapshots", snapshots).option("rules", json.dumps(list(rules))).option("shards", shards).option("depth", depth).load(root)
