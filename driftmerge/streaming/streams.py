"""Structured Streaming twins of the event operators. Each runs over what is there (availableNow) and returns it.

Sinks and state lie below the folder in spark.checkpoint.dir, which the cluster shares.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from driftmerge.config import Settings
from driftmerge.operators import blocks, codec, sequence
from driftmerge.sources import tables
from driftmerge.sources.shared import materialize, remove, shared_dir

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def work_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


#: A state store that isn't held in the executors' heaps, and that single entries are read from.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: With it a batch stores what it changed, not the files that it changed.
STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}


def drained(stream: DataFrame, most_tasks: int | None = None) -> DataFrame:
    """Runs a stream over all input that is there and gives what it wrote.

    What the state still holds at the end follows, if the stream says how to read it (``_rest``); the state itself goes. The session's own state store is what it was
    afterwards. Each task of the state costs a store opened and committed a batch, so `most_tasks` bounds them where a session shuffles over many more.
    """
    spark, place = stream.sparkSession, work_dir(stream.sparkSession)
    own = dict(STORE)
    if most_tasks and int(spark.conf.get("spark.sql.shuffle.partitions")) > most_tasks:
        own["spark.sql.shuffle.partitions"] = str(most_tasks)
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        running = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").outputMode("append").trigger(availableNow=True).start()
        running.awaitTermination()
        out = spark.read.schema(stream.schema).parquet(f"{place}/out")
        rest = getattr(stream, "_rest", None)
        # Read while the store is the stream's.
        if rest:
            out = materialize(out.unionByName(rest(lambda **options: spark.read.format("statestore").options(**options).load(f"{place}/state"))), "drained")
            remove(spark, f"{place}/out")
        remove(spark, f"{place}/state")
        return out
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def source(spark: SparkSession, path: str, schema: str = EVENTS, files_per_batch: int | None = None) -> DataFrame:
    """A file stream. Spark's session time zone is the tables' zone. A bound on a batch's files is the backpressure."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def _timed(events: DataFrame, late: str, *columns: str) -> DataFrame:
    """Columns of a stream whose watermark is `late` behind the latest us, without losing the rows behind it.

    Rows whose time is behind the watermark would be dropped; a time of null never is. The state needs such a column.
    """
    timed = events.withColumn("_at", F.timestamp_micros("us")).withWatermark("_at", late)
    return timed.select(*columns, F.lit(None).cast("timestamp").alias("_at", metadata={"spark.watermarkDelayMs": 0}))


BURST = "last_us long, last_id long, kind string, n long"


def _bursts(gap_us: int):  # noqa: ANN202  a factory of the state function
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        out = []
        for us, ident, kind in sorted((int(us), int(i), k) for frame in frames for us, i, k in zip(frame.us, frame.event_id, frame.kind, strict=True)):
            if held is None or abs(us - held[0]) >= gap_us:
                if held:
                    out.append((key[0], held[0], held[2], held[3]))
                held = (us, ident, kind, 1)
            else:
                held = (*max(((us, ident, kind), tuple(held[:3])), key=lambda x: x[:2]), held[3] + 1)
        if state.hasTimedOut and held:
            out.append((key[0], held[0], held[2], held[3]))
            held = None
        if held:
            state.update(held)
            state.setTimeoutTimestamp(max(-(-(held[0] + gap_us) // 1000), state.getCurrentWatermarkMs(), 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["path", "last_us", "kind", "n"])

    return run


def bursts(events: DataFrame, gap_us: int, late: str = "1 day") -> DataFrame:
    """The last event of each burst, (path, last_us, kind, n), of a stream (path, us, event_id, kind).

    A burst ends where the path's next event is `gap_us` or more away, or the watermark is; a path holds one burst at
    a time. At the end of what is there, ``drained`` gives those still open. Of equal times the larger event_id is last.
    """
    out = _timed(events, late, "path", "us", "event_id", "kind").groupBy("path").applyInPandasWithState(_bursts(gap_us), "path string, last_us long, kind string, n long", BURST, "append", GroupStateTimeout.EventTimeTimeout)
    out._rest = lambda state: state().select(F.col("key.path").alias("path"), *(F.col(f"value.groupState.{c}").alias(c) for c in ("last_us", "kind", "n")))
    return out


def debounced(spark: SparkSession, path: str, gap_seconds: int) -> DataFrame:
    """Bursts of each user's events."""
    events = source(spark, path).select(F.col("user_id").cast("string").alias("path"), F.unix_micros("ts").alias("us"), "event_id", F.col("event_type").alias("kind"))
    return drained(bursts(events, gap_seconds * 1_000_000))


def deduplicated(spark: SparkSession, path: str) -> DataFrame:
    """Counts per kind of a stream in which every event comes twice, however late: ids have no end of life, so the state holds each one, on disk."""
    both = source(spark, path).union(source(spark, path))
    once = both.dropDuplicates(["event_id"]).select("event_id", F.col("event_type").alias("kind"))
    return drained(once).groupBy("kind").agg(F.count("*").alias("n"))


PLACED = "path string, kind string, clock long, peer long, text string, clocks array<long>"
#: Clocks of a writer that are one entry of the state store, as a power of two.
BITS = 12


class Cell:
    """Rows of some keys of a shard as one entry of a map state, as compressed JSON: a call to the store costs more than many rows. It is read once and written if a row changed."""

    def __init__(self, state: object, number: int) -> None:
        self.state, self.key, self.dirty = state, (number,), False
        self.rows: dict[tuple, list] = dict(((*key,), row) for key, row in json.loads(zlib.decompress(state.getValue(self.key)[0]))) if state.containsKey(self.key) else {}

    def put(self, key: tuple, row: list | None) -> None:
        if row != self.rows.get(key):
            self.dirty = True
            self.rows.pop(key, None) if row is None else self.rows.update({key: row})

    def save(self) -> None:
        if self.dirty and self.rows:
            self.state.updateValue(self.key, (zlib.compress(json.dumps(list(self.rows.items())).encode(), 1),))
        elif self.dirty:
            self.state.removeKey(self.key)


class Ids:
    """What is known of a path's ids: bit maps of 2**BITS clocks of a writer each, in hexadecimal digits a row of a cell."""

    #: Fields of a row: the ids that are placed, deleted, deleted before they came, and waited for; then the entries of ``Waiting`` for them.
    PLACED, GONE, EARLY, AWAITED, MANY = range(5)

    def __init__(self, cell: Cell, path: str | None) -> None:
        self.cell, self.path, self.held = cell, path, {}

    def entry(self, peer: int, bucket: int) -> list[int]:
        key = (peer, bucket)
        if key not in self.held:
            self.held[key] = [int(x, 16) for x in self.cell.rows.get((self.path, *key), "00000")]
        return self.held[key]

    def put(self, peer: int, bucket: int, field: int, value: int) -> None:
        self.entry(peer, bucket)[field] = value

    def __contains__(self, ident: tuple[int, int]) -> bool:
        return bool(self.entry(ident[1], ident[0] >> BITS)[self.PLACED] >> (ident[0] & (1 << BITS) - 1) & 1)

    def awaits(self, clock: int, peer: int) -> None:
        self.entry(peer, clock >> BITS)[self.AWAITED] |= 1 << (clock & (1 << BITS) - 1)

    def containsKey(self, key: tuple[int, int]) -> bool:  # noqa: N802  with the three below: a map state of counts
        return self.entry(*key)[self.MANY] > 0

    def getValue(self, key: tuple[int, int]) -> tuple[int]:  # noqa: N802
        return (self.entry(*key)[self.MANY],)

    def updateValue(self, key: tuple[int, int], value: tuple[int]) -> None:  # noqa: N802
        self.put(*key, self.MANY, value[0])

    def removeKey(self, key: tuple[int, int]) -> None:  # noqa: N802
        self.put(*key, self.MANY, 0)

    def save(self) -> None:
        for key, fields in self.held.items():
            self.cell.put((self.path, *key), [f"{x:x}" for x in fields] if any(fields) else None)


class Under:
    """The entries of a map state whose keys begin with a path."""

    def __init__(self, state: object, path: str | None) -> None:
        self.state, self.path = state, path

    def getValue(self, key: tuple) -> tuple:  # noqa: N802
        return self.state.getValue((self.path, *key))

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        self.state.updateValue((self.path, *key), value)

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        self.state.removeKey((self.path, *key))


def spans(clock: int, n: int) -> Iterator[tuple[int, int]]:
    """The buckets that clocks from one on stand in, with the bits of each."""
    while n > 0:
        low = clock & (1 << BITS) - 1
        m = min(n, (1 << BITS) - low)
        yield clock >> BITS, ((1 << m) - 1) << low
        clock, n = clock + m, n - m


def bits_in(clocks: np.ndarray) -> int:
    """The bits of some clocks of one bucket."""
    there = np.zeros(1 << BITS, np.uint8)
    there[clocks & (1 << BITS) - 1] = 1
    return int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")


def _beside(runs: np.ndarray) -> np.ndarray:
    """Which runs (clock, peer, o_clock, o_peer, n) hang on nothing, or on one of these runs."""
    clock, peer, o_clock, o_peer, n = runs
    near = o_clock < 0
    writers = set(o_peer.tolist())
    if len(writers) > 8:
        return near | sequence.held(peer[:, None], clock, n, o_peer[:, None], o_clock)
    for writer in writers:
        of, asked = np.flatnonzero(peer == writer), np.flatnonzero((o_peer == writer) & ~near)
        if len(of) and len(asked):
            start = clock[of]
            if (start[1:] < start[:-1]).any():
                of = of[np.argsort(start, kind="stable")]
                start = clock[of]
            end = np.maximum.accumulate(start + n[of])
            up = o_clock[asked]
            i = np.searchsorted(start, up, "right") - 1
            near[asked[(i >= 0) & (end[i] > up)]] = True
    return near


def _pieces(text: str, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> str:
    """The parts of a text that some runs have: number `at` from `start` to `end`, joined; mostly they lie side by side."""
    turns = (np.flatnonzero(at[1:] != at[:-1] + 1) + 1).tolist()
    return "".join([text[start[i] : end[j - 1]] for i, j in zip([0, *turns], [*turns, len(at)], strict=True)])


def bits_of(clocks: np.ndarray) -> Iterator[tuple[int, int]]:
    """The buckets that some clocks stand in, with the bits of each."""
    if (clocks[1:] < clocks[:-1]).any():
        clocks = np.sort(clocks)
    bucket = clocks >> BITS
    turns = (np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist()
    for i, j in zip([0, *turns], [*turns, len(clocks)], strict=True) if len(clocks) else ():
        yield int(bucket[i]), bits_in(clocks[i:j])


def flags(bits: int) -> np.ndarray:
    """Whether each of a bucket's clocks has its bit."""
    return np.unpackbits(np.frombuffer(bits.to_bytes(1 << BITS - 3, "little"), np.uint8), bitorder="little").astype(bool)


def clocks_of(bucket: int, bits: int) -> Iterator[int]:
    while bits:
        yield (bucket << BITS) + (bits & -bits).bit_length() - 1
        bits &= bits - 1


class Waiting:
    """Runs that wait, by the bucket of the origin of their first character.

    What a batch adds for a bucket is one entry more, 0, 1, ..., and nothing is read for it; the entries of a bucket are read when one of its origins comes, and
    what still waits then is one entry again.
    """

    def __init__(self, entries: object, many: object) -> None:
        self.entries, self.many = entries, many
        self.held: dict[tuple[int, int], dict[int, list]] = {}
        self.read: dict[tuple[int, int], int] = {}

    def add(self, origin: tuple[int, int], run: list) -> None:
        runs = self.held.setdefault((origin[1], origin[0] >> BITS), {}).setdefault(origin[0], [])
        if run not in runs[-4:]:  # one that comes again soon; any other is placed once all the same
            runs.append(run)

    def count(self, key: tuple[int, int]) -> int:
        return int(self.many.getValue(key)[0]) if self.many.containsKey(key) else 0

    def take(self, clock: int, peer: int) -> list:
        """The runs that wait for an id, which wait no longer."""
        key = (peer, clock >> BITS)
        if key not in self.read:
            self.read[key] = self.count(key)
            for k in range(self.read[key]):
                self.hold(key, self.unpacked(self.entries.getValue((*key, k))))
        return self.held.get(key, {}).pop(clock, [])

    def hold(self, key: tuple[int, int], rows: Iterable[list]) -> None:
        there = self.held.setdefault(key, {})
        for at, *run in rows:
            there.setdefault(at, []).append(run)

    def left(self, key: tuple[int, int]) -> tuple | None:
        """An entry of all that is held for a bucket."""
        rows = [[at, *run] for at, runs in self.held.get(key, {}).items() for run in runs]
        return (json.dumps(rows),) if rows else None

    @staticmethod
    def unpacked(entry: tuple) -> list[list]:
        return json.loads(entry[0])

    def save(self) -> None:
        for key in self.held.keys() | self.read.keys():
            left = self.left(key)
            for k in range(1, self.read.get(key, 0)):
                self.entries.removeKey((*key, k))
            at = 0 if key in self.read else self.count(key)
            if left:
                self.entries.updateValue((*key, at), left)
                self.many.updateValue(key, (at + 1,))
            elif self.read.get(key):
                self.entries.removeKey((*key, 0))
                self.many.removeKey(key)


class WaitingRuns(Waiting):
    """The same; many runs are added at once, as columns, which become rows only if one of their bucket's origins comes. Entries are packed longs and their texts."""

    def __init__(self, entries: object, many: object) -> None:
        super().__init__(entries, many)
        self.columns: dict[tuple[int, int], list[tuple[np.ndarray, str]]] = {}

    def add_all(self, key: tuple[int, int], ids: np.ndarray, text: str) -> None:
        """Runs (o_clock, clock, peer, n), a row a column, whose origins are of one bucket."""
        self.held.setdefault(key, {})
        self.columns.setdefault(key, []).append((ids, text))

    def take(self, clock: int, peer: int) -> list:
        key = (peer, clock >> BITS)
        for ids, text in self.columns.pop(key, ()):
            self.hold(key, _rows(ids, text))
        return super().take(clock, peer)

    def left(self, key: tuple[int, int]) -> tuple | None:
        parts = list(self.columns.get(key, ()))
        if rows := [(at, *run) for at, runs in self.held.get(key, {}).items() for run in runs]:
            parts.append((np.array([(at, clock, peer, len(text)) for at, clock, peer, text in rows], np.int64).T, "".join(x[3] for x in rows)))
        if not parts:
            return None
        ids, text = parts[0] if len(parts) == 1 else (np.concatenate([x for x, _ in parts], axis=1), "".join(x for _, x in parts))
        return codec.pack_longs(*ids), codec.pack_text(text)

    @staticmethod
    def unpacked(entry: tuple) -> list[list]:
        return _rows(codec.unpack_longs(entry[0], 4), codec.unpack_text(entry[1]))


def _rows(ids: np.ndarray, text: str) -> list[list]:
    ends = np.cumsum(ids[3]).tolist()
    return [[at, clock, peer, text[i:j]] for at, clock, peer, i, j in zip(*ids[:3].tolist(), [0, *ends], ends, strict=False)]


#: Groups that a stream's keys are dealt to, and the cells of all of them: a call of Python for each key would cost far more than its rows.
SHARDS, CELLS = 512, 1 << 14
PACKED = "path string, clock array<long>, peer array<long>, o_clock array<long>, o_peer array<long>, n array<long>, text string, d_peer array<long>, d_clock array<long>"


def sharded(rows: DataFrame, *keys: str, cells: int = CELLS) -> DataFrame:
    """Rows with the ``cell`` of their key, and the ``shard`` of that."""
    return rows.withColumn("cell", F.pmod(F.hash(*keys), F.lit(cells)).cast("long")).withColumn("shard", F.col("cell") % SHARDS)


def packed_ops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inserts, and deletes of one character (`dead`), that lie by path as a row for each path of a batch: the inserts' ids and joined texts, and the deletes' targets. No origin is -1."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        new = sequence._turns(batch.column("path"))
        doc = np.cumsum(new) - 1
        dead = batch.column("dead").to_numpy(zero_copy_only=False)
        ins, gone = part.filter(pa.array(~dead)), part.filter(pa.array(dead))
        at, to = (np.searchsorted(doc[x], np.arange(doc[-1] + 2)).astype(np.int32) for x in (~dead, dead))
        lists = lambda edges, values: pa.ListArray.from_arrays(pa.array(edges), pa.array(values, pa.int64()))
        texts = ins.column("text").combine_chunks().fill_null("")
        joined = sequence._joined(texts, at[:-1]) if len(texts) else pa.array([""] * (len(at) - 1), pa.string())
        numbers = [lists(at, sequence._numbers(ins, c)) for c in ("clock", "peer", "o_clock", "o_peer")]
        cells = [batch.column("path").filter(pa.array(new)), *numbers, lists(at, pc.utf8_length(texts).to_numpy(zero_copy_only=False)), joined, *(lists(to, sequence._numbers(gone, c)) for c in ("peer", "clock"))]
        yield pa.record_batch(cells, [x.split()[0] for x in PACKED.split(", ")])


class Causal(StatefulProcessor):
    """Of the paths of a shard: the ids that are placed, deleted, deleted before they came, and waited for, as bit maps; and the runs that wait.

    All are entries of their own, so a batch reads and writes what it is about. What is held is what one frame of rows is about.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getMapState("ids", "cell long", "rows binary")
        self.waits = handle.getMapState("waiting", "path string, peer long, bucket long, nth long", "ids binary, text binary")

    def ops(self, frame: pd.DataFrame) -> Iterator[tuple]:
        """The cell and path of each row, its inserts' (clock, peer, o_clock, o_peer, n), their texts, and its deletes' (peer, clock)."""
        for cell, path, *ids, text, peers, clocks in zip(frame.cell, *(frame[c.split()[0]] for c in PACKED.split(", ")), strict=True):
            yield cell, path, (np.array([np.asarray(x, np.int64) for x in ids]), text, np.array([np.asarray(x, np.int64) for x in (peers, clocks)]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        for frame in rows:
            self.out: list[tuple] = []
            held: dict[int, dict[str | None, list[tuple]]] = {}
            for number, path, ops in self.ops(frame):
                held.setdefault(number, {}).setdefault(path, []).append(ops)
            for number, paths in held.items():
                cell = Cell(self.state, number)
                for path, parts in paths.items():
                    self.document(cell, path, parts)
                cell.save()
            yield pd.DataFrame(self.out, columns=["path", "kind", "clock", "peer", "text", "clocks"]).astype({"clock": "Int64"})

    def document(self, cell: Cell, path: str | None, parts: list[tuple]) -> None:
        self.ids = ids = Ids(cell, path)
        self.waiting = WaitingRuns(Under(self.waits, path), ids)
        runs, text, dead = parts[0] if len(parts) == 1 else (np.concatenate([x for x, _, _ in parts], axis=1), "".join(x for _, x, _ in parts), np.concatenate([x for _, _, x in parts], axis=1))
        if runs.shape[1]:
            ends = np.cumsum(runs[4])
            at = self.possible(runs, text, ends)
            for clock, peer, o_clock, o_peer, n, end in zip(*runs[:, at].tolist(), ends[at].tolist(), strict=True):
                self.insert(path, clock, peer, None if o_clock < 0 else (o_clock, o_peer), text[end - n : end])
        for peer in np.unique(dead[0]).tolist():
            done: list[int] = []
            for bucket, bits in bits_of(dead[1, dead[0] == peer]):
                placed, gone, early, _, _ = ids.entry(peer, bucket)
                ids.put(peer, bucket, ids.EARLY, early | bits & ~placed)
                if new := bits & placed & ~gone:
                    ids.put(peer, bucket, ids.GONE, gone | new)
                    done += clocks_of(bucket, new)
            if done:
                self.out.append((path, "del", None, peer, None, done))
        self.waiting.save()
        ids.save()  # last: it has the counts of those

    def possible(self, runs: np.ndarray, text: str, ends: np.ndarray) -> np.ndarray:
        """The runs whose origin is placed or comes beside them; all others wait, added at once."""
        near = _beside(runs)
        far = np.flatnonzero(~near)
        if not len(far):
            return np.flatnonzero(near)
        waits = runs[:, far]
        rising = waits[:, 1:] > waits[:, :-1]
        if not (rising[2].all() and (waits[3] == waits[3, 0]).all()):  # mostly they lie by origin
            by = np.lexsort((waits[0], waits[1], waits[2], waits[3]))
            far, waits = far[by], waits[:, by]
            same = (waits[:, 1:] == waits[:, :-1]).all(axis=0)  # one that comes again beside itself
            if same.any():
                first = np.flatnonzero(np.concatenate([[True], ~same]))
                far, waits = far[first], waits[:, first]
        _, _, o_clock, o_peer, _ = waits
        bucket = o_clock >> BITS
        turns = (np.flatnonzero((bucket[1:] != bucket[:-1]) | (o_peer[1:] != o_peer[:-1])) + 1).tolist()
        for a, z in zip([0, *turns], [*turns, len(far)], strict=True):
            at, ids, key = far[a:z], waits[:, a:z], (int(o_peer[a]), int(bucket[a]))
            placed, _, _, awaited, _ = self.ids.entry(*key)
            if placed:
                there = flags(placed)[ids[2] & (1 << BITS) - 1]
                near[at[there]] = True
                at, ids = at[~there], ids[:, ~there]
            if len(at):
                self.ids.put(*key, Ids.AWAITED, awaited | bits_in(ids[2]))
                self.waiting.add_all(key, ids[[2, 0, 1, 4]], _pieces(text, at, ends[at] - ids[4], ends[at]))
        return np.flatnonzero(near)

    def insert(self, path: str | None, clock: int, peer: int, origin: tuple[int, int] | None, text: str) -> None:
        ids, queue = self.ids, [(clock, peer, origin, text)]
        while queue:
            clock, peer, origin, text = queue.pop()
            if origin and origin not in ids:
                self.waiting.add(origin, [clock, peer, text])
                ids.awaits(*origin)
                continue
            for bucket, bits in spans(clock, len(text)):
                placed, gone, early, awaited, _ = ids.entry(peer, bucket)
                new = bits & ~placed
                if not new:
                    continue
                ids.put(peer, bucket, ids.PLACED, placed | new)
                left = new
                while left:  # characters side by side are one row
                    low = (left & -left).bit_length() - 1
                    m = (~(left >> low) & (left >> low) + 1).bit_length() - 1
                    at = (bucket << BITS) + low
                    self.out.append((path, "ins", at, peer, text[at - clock : at - clock + m], None))
                    left &= ~(((1 << m) - 1) << low)
                if came := new & early:  # their deletes came first
                    ids.put(peer, bucket, ids.EARLY, early & ~came)
                    ids.put(peer, bucket, ids.GONE, gone | came)
                    self.out.append((path, "del", None, peer, None, list(clocks_of(bucket, came))))
                if asked := new & awaited:
                    ids.put(peer, bucket, ids.AWAITED, awaited & ~asked)
                    queue += [(c, p, (at, peer), x) for at in clocks_of(bucket, asked) for c, p, x in self.waiting.take(at, peer)]

    def close(self) -> None:
        pass


class CausalMessages(Causal):
    """The same of messages, whose ids and texts are packed."""

    def ops(self, frame: pd.DataFrame) -> Iterator[tuple]:
        for cell, path, ids, text, dead in zip(*(frame[c] for c in ("cell", "path", "ids", "text", "dead")), strict=True):
            yield cell, path, (codec.unpack_longs(ids, 5), codec.unpack_text(text), codec.unpack_longs(dead, 2))


def causal_messages(messages: DataFrame) -> DataFrame:
    """What ``causal_runs`` gives, of a stream of messages (path, ids, text, dead), each some ops of a path (``replicas.MESSAGES``): a log's runs are never rows."""
    return sharded(messages.select("path", "ids", "text", "dead"), "path").groupBy("shard").transformWithStateInPandas(CausalMessages(), PLACED, "Append", "None")


def causal_runs(ops: DataFrame) -> DataFrame:
    """Pieces of op logs (path, kind, clock, peer, o_clock, o_peer, text, clocks) of a stream once what they name is there.

    Gives (path, kind, clock, peer, text, clocks): each character once, in any order of arrival. Runs wait for the origin of their first character, deletes (`clocks`
    of a writer) for their targets, and follow those. What waits has no time limit: an origin may come in any later batch.
    Ops are packed by path where they are read, before they are shuffled. Needs the RocksDB state store, which ``drained`` sets.
    """
    # Many rows with a list each are slow to hand to Python, as the size of a batch is looked at for every row; so lists of deletes stay with Spark.
    single = ops.filter("kind <> 'del' or clocks is null").select("path", "clock", "peer", "o_clock", "o_peer", "text", (F.col("kind") == "del").alias("dead"))
    none = F.array().cast("array<bigint>")
    lists = ops.filter("kind = 'del' and clocks is not null").select("path", *(none.alias(c) for c in ("clock", "peer", "o_clock", "o_peer", "n")), F.lit("").alias("text"), F.array_repeat(ops["peer"].cast("long"), F.size("clocks")).alias("d_peer"), F.col("clocks").cast("array<bigint>").alias("d_clock"))
    return sharded(single.mapInArrow(packed_ops, PACKED).unionByName(lists), "path").groupBy("shard").transformWithStateInPandas(Causal(), PLACED, "Append", "None")


def causal(ops: DataFrame) -> DataFrame:
    """``causal_runs`` of single characters (path, clock, peer, o_clock, o_peer, ch[, kind]): (path, clock, peer, ch, kind). Without a kind all are inserts."""
    kind = F.col("kind") if "kind" in ops.columns else F.lit("ins")
    runs = causal_runs(ops.select("path", kind.alias("kind"), "clock", "peer", "o_clock", "o_peer", F.col("ch").alias("text"), F.lit(None).cast("array<bigint>").alias("clocks")))
    none = F.lit(None).cast("string")
    chars = F.transform(F.filter(F.split("text", ""), lambda c: c != ""), lambda c, i: F.struct((F.col("clock") + i).alias("clock"), c.alias("ch")))
    gone = F.transform("clocks", lambda c: F.struct(c.alias("clock"), none.alias("ch")))
    return runs.select("path", "peer", "kind", F.explode(F.when(F.col("kind") == "ins", chars).otherwise(gone)).alias("x")).select("path", "x.clock", "peer", "x.ch", "kind")


def still_blocked(state: Callable[..., DataFrame]) -> DataFrame:
    """(path, n): the runs and the deleted characters whose origin or target has not come at all, from what a drained ``causal_runs`` holds.

    Those that wait for what waits itself aren't blocked by anything missing of their own.
    """
    waiting = state(stateVarName="waiting").select("user_map_key.path", "user_map_key.peer", "user_map_key.bucket", F.col("user_map_value.ids").alias("runs"), F.lit(None).cast("string").alias("early"))
    early = state(stateVarName="ids").select("user_map_value.rows").mapInArrow(_early, "path string, peer long, bucket long, early string").withColumn("runs", F.lit(None).cast("binary"))
    return sequence.by_document(waiting.unionByName(early), _blocked, "path string, n long").filter("n > 0")


def _early(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bit maps of cells that say what was deleted before it came."""
    for batch in batches:
        for cell in batch.column(0):
            rows = [(*key, fields[Ids.EARLY]) for key, fields in json.loads(zlib.decompress(cell.as_py())) if fields[Ids.EARLY] != "0"]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "peer", "bucket", "early"])


def _blocked(part: pa.Table) -> pa.Table:
    paths, doc = sequence._documents(part)
    asked, there = [np.zeros((0, 3), np.int64)], [np.zeros((0, 6), np.int64)]  # (document, writer, clock), of runs also their own writer, clock and length
    for at, peer, bucket, runs, early in zip(doc.tolist(), *(part.column(c).to_pylist() for c in ("peer", "bucket", "runs", "early")), strict=True):
        if early is not None:
            bits = int(early, 16)
            clocks = (bucket << BITS) + np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(-(-bits.bit_length() // 8), "little"), np.uint8), bitorder="little"))
            asked.append(np.stack([np.full(len(clocks), at), np.full(len(clocks), peer), clocks], axis=1))
            continue
        o_clock, clock, own, n = codec.unpack_longs(runs, 4)
        there.append(np.stack([np.full(len(clock), at), np.full(len(clock), peer), o_clock, own, clock, n], axis=1))
    # A run that is in several entries counts once.
    runs = np.unique(np.concatenate(there), axis=0)
    want = np.concatenate([*asked, runs[:, :3]])
    held = sequence.held(runs[:, [0, 3]], runs[:, 4], runs[:, 5], want[:, :2], want[:, 2])
    return pa.table([paths, pa.array(np.bincount(want[~held, 0], minlength=len(paths)))], ["path", "n"])


class Held(StatefulProcessor):
    """Of each path: when it was removed, while the delete is held back. A timer of event time ends the hold."""

    def __init__(self, hold_us: int) -> None:
        self.hold_us = hold_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gone = handle.getValueState("gone", "removed_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        before = gone = int(self.gone.get()[0]) if self.gone.exists() else -1
        out = []
        for us, kind in sorted((int(us), kind) for frame in rows for us, kind in zip(frame.us, frame.kind, strict=True)):
            if 0 <= gone <= us - self.hold_us:
                out.append((key[0], gone + self.hold_us, "removed"))
                gone = -1
            if kind == "removed":
                gone = max(gone, us)
            else:
                if us >= gone:  # back in time: the delete never was
                    gone = -1
                out.append((key[0], us, "touched"))
        if gone != before:
            if before >= 0:
                self.handle.deleteTimer(self.at(before))
            if gone >= 0:
                self.gone.update((gone,))
                self.handle.registerTimer(max(self.at(gone), timerValues.getCurrentWatermarkInMs() + 1))
            else:
                self.gone.clear()
        yield pd.DataFrame(out, columns=["path", "us", "kind"])

    def at(self, gone: int) -> int:
        return max(-(-(gone + self.hold_us) // 1000), 1)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.gone.exists():
            gone = int(self.gone.get()[0])
            if self.at(gone) <= timerValues.getCurrentWatermarkInMs():
                out.append((key[0], gone + self.hold_us, "removed"))
                self.gone.clear()
        yield pd.DataFrame(out, columns=["path", "us", "kind"])

    def close(self) -> None:
        pass


def delayed_deletes(events: DataFrame, hold_us: int, late: str = "1 day") -> DataFrame:
    """Touches at once; removes only when the path didn't come back within the hold.

    The path's next event shows that, or the watermark, which is `late` behind the latest event of all paths; at the
    end of what is there, ``drained`` gives the removals still held.
    """
    out = _timed(events, late, "path", "us", "kind").groupBy("path").transformWithStateInPandas(Held(hold_us), "path string, us long, kind string", "Append", "EventTime")
    out._rest = lambda state: state(stateVarName="gone").select(F.col("key.path").alias("path"), (F.col("value.removed_us") + hold_us).alias("us"), F.lit("removed").alias("kind"))
    return out


TRANSFER = "peer long, path string, hash string, outcome string, packed binary"
#: A transfer that is done: its key's digest, and when it is forgotten, in milliseconds; 0 is never.
DONE = np.dtype([("id", "V16"), ("due", "<i8")])


class Receiver(StatefulProcessor):
    """Of the transfers of a shard, by cell: those that are open, as JSON, and digests of those that are done. A chunk that comes again counts once.

    A transfer that is whole within a frame of rows is never stored; of others, what a frame adds is one entry, and the entries are read when the last chunk comes.
    """

    def __init__(self, patience_us: int | None) -> None:
        self.patience_us = patience_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "cell long", "rows string")
        self.done = handle.getMapState("done", "cell long", "ids binary")
        self.parts = handle.getMapState("parts", "id string, nth long", "chunks binary")
        self.next = handle.getValueState("next", "due long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        soonest = None
        for frame in rows:
            held: dict[int, dict[str, list[tuple]]] = {}
            for cell, name, *chunk in zip(*(frame[c].tolist() for c in ("cell", "name", "seq", "total", "us", "part")), strict=True):
                held.setdefault(cell, {}).setdefault(name, []).append(chunk)
            out: list[tuple] = []
            for cell, transfers in held.items():
                due = self.chunks(cell, transfers, timerValues, out)
                soonest = min((x for x in (soonest, due) if x is not None), default=None)
            yield _transfers(out)
        if soonest is not None and (not self.next.exists() or soonest < int(self.next.get()[0])):
            self.handle.registerTimer(soonest)
            self.next.update((soonest,))

    def chunks(self, cell: int, transfers: dict[str, list[tuple]], timerValues: object, out: list[tuple]) -> int | None:  # noqa: N803
        """Takes the chunks of a cell's transfers; gives when the first of those that it opened is due."""
        before = self.open.getValue((cell,))[0] if self.open.containsKey((cell,)) else "{}"
        rows: dict[str, list] = json.loads(before)
        ids = bytes(self.done.getValue((cell,))[0]) if self.done.containsKey((cell,)) else b""
        known, new, opened = set(np.frombuffer(ids, DONE)["id"].tolist()), [], []
        for name, chunks in transfers.items():
            ident = digest(name)
            if ident in known:
                continue
            total, bits, many, due = rows.get(name, (0, "0", 0, None))
            there, came = int(bits, 16), {}
            for seq, _, _, part in chunks:
                if not there >> seq & 1:
                    came.setdefault(seq, part)
            total = max(total, *(n for _, n, _, _ in chunks))
            if there.bit_count() + len(came) >= total:
                for nth in range(many):
                    came |= unpaired(self.parts.getValue((ident.hex(), nth))[0])
                    self.parts.removeKey((ident.hex(), nth))
                out.append((name, "whole", b"".join(came[seq] for seq in sorted(came))))
                rows.pop(name, None)
                new.append((ident, due or 0))
                known.add(ident)
                continue
            if due is None:
                due = 0
                if self.patience_us is not None:
                    first = min(us for _, _, us, _ in chunks)
                    due = max(-(-(first + self.patience_us) // 1000), timerValues.getCurrentWatermarkInMs() + 1)
                    opened.append(due)
            if came:
                self.parts.updateValue((ident.hex(), many), (paired(came),))
                many += 1
            rows[name] = [total, f"{there | sum(1 << seq for seq in came):x}", many, due]
        put(self.open, cell, before, json.dumps(rows) if rows else "{}", "{}")
        if new:
            self.done.updateValue((cell,), (ids + np.array(new, DONE).tobytes(),))
        return min(opened, default=None)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out, left = timerValues.getCurrentWatermarkInMs(), [], []
        for (cell,), (before,) in list(self.open.iterator()):
            rows = json.loads(before)
            for name in [name for name, (*_, due) in rows.items() if 0 < due <= now]:
                *_, many, _ = rows.pop(name)
                out.append((name, "missing chunks", None))
                for nth in range(many):
                    self.parts.removeKey((digest(name).hex(), nth))
            put(self.open, cell, before, json.dumps(rows) if rows else "{}", "{}")
            left += [due for *_, due in rows.values() if due]
        for (cell,), (ids,) in list(self.done.iterator()):
            held = np.frombuffer(bytes(ids), DONE)
            kept = held[(held["due"] == 0) | (held["due"] > now)]
            put(self.done, cell, bytes(ids), kept.tobytes(), b"")
            left += kept["due"][kept["due"] > 0].tolist()
        if left:
            self.handle.registerTimer(max(min(left), now + 1))
            self.next.update((max(min(left), now + 1),))
        else:
            self.next.clear()
        yield _transfers(out)

    def close(self) -> None:
        pass


def put(state: object, cell: int, before: object, after: object, none: object) -> None:
    """Writes a cell's entry if it changed; one that is empty goes."""
    if after == before:
        return
    state.updateValue((cell,), (after,)) if after != none else state.removeKey((cell,))


def digest(name: str) -> bytes:
    """128 bits that stand for a transfer."""
    return hashlib.blake2b(name.encode(), digest_size=16).digest()


def paired(chunks: dict[int, bytes]) -> bytes:
    return b"".join(x for seq, part in chunks.items() for x in (struct.pack("<qI", seq, len(part)), part))


def unpaired(data: bytes) -> dict[int, bytes]:
    out, at, data = {}, 0, bytes(data)
    while at < len(data):
        seq, n = struct.unpack_from("<qI", data, at)
        out[seq] = data[at + 12 : at + 12 + n]
        at += 12 + n
    return out


def _transfers(rows: list[tuple]) -> pd.DataFrame:
    out = [(*map(json.loads(name).get, ("peer", "path", "hash")), outcome, packed) for name, outcome, packed in rows]
    return pd.DataFrame(out, columns=[x.split()[0] for x in TRANSFER.split(", ")], dtype=object).astype({"peer": "Int64"})


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns[:-1], pa.array(blocks.packed(batch.column("ops")), pa.binary())], ["name", "seq", "total", "us", "part"])


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([*batch.columns[:-1], blocks.unpacked(batch.column("packed"))], ["peer", "path", "hash", "outcome", "ops"])


def _still_open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [json.loads(name) for rows in batch.column(0).to_pylist() for name in json.loads(rows)]
        yield pa.record_batch([pa.array([key.get(c) for key in keys], t) for c, t in (("peer", pa.int64()), ("path", pa.string()), ("hash", pa.string()))], ["peer", "path", "hash"])


def transfers(chunks: DataFrame, patience_us: int = 60_000_000, late: str = "1 minute") -> DataFrame:
    """Transfers of a stream of chunks (peer, path, hash, seq, total, ops[, us]): (peer, path, hash, outcome, ops), each sender's on its own.

    "whole" with all ops in order once the last chunk came; "missing chunks" where chunks have a time and the watermark, `late` behind the latest, is
    beyond the patience of the first one that came, or, when ``drained``, where one hasn't come at the end. Without a time a transfer may take for ever.
    Transfers are dealt to shards and to cells of their state, as a call of Python and an entry for each would cost more than its chunks.
    """
    timed = "us" in chunks.columns
    rows = chunks.select(F.to_json(F.struct("peer", "path", "hash")).alias("name"), F.col("seq").cast("long"), F.col("total").cast("long"), (F.col("us") if timed else F.lit(0)).cast("long").alias("us"), "ops")
    rows = rows.mapInArrow(_packed, "name string, seq long, total long, us long, part binary")
    rows = sharded(_timed(rows, late, *rows.columns) if timed else rows, "name", cells=2 * SHARDS)
    out = rows.groupBy("shard").transformWithStateInPandas(Receiver(patience_us if timed else None), TRANSFER, "Append", "EventTime" if timed else "None")
    done = out.mapInArrow(_unpacked, f"peer long, path string, hash string, outcome string, ops {blocks.OPS}")
    none = F.lit(None).cast(done.schema["ops"].dataType)
    done._rest = lambda state: state(stateVarName="open").select("user_map_value.rows").mapInArrow(_still_open, "peer long, path string, hash string").select("*", F.lit("missing chunks").alias("outcome"), none.alias("ops"))
    return done


def kept(changes: DataFrame, path: str, schema: str, key: str, checkpoint: str, compare: Callable[[DataFrame], None] | None = None, settings: Settings = Settings()) -> None:  # noqa: B008  frozen
    """Merges a stream's rows into the versioned state at `path`, batch by batch, over all input that is there.

    Of a batch's rows of a key the last by ``seq`` counts; a row with ``gone`` removes its key. The state carries the number of the batch that it came from, so one that was saved before a crash and
    runs again is left out. `compare` gets the state whenever a report is due. Batches hold as many files as the stream's source was told (``Settings.files_per_batch``).
    """
    reported = [0.0]

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = tables.load_state(session, path, f"{schema}, batch long")
        done = before.agg(F.max("batch")).first()[0]
        if done is not None and number <= done:
            return
        columns = [c for c in before.columns if c != "batch"]
        last = batch.groupBy(key).agg(F.max_by(F.struct(*(c for c in columns if c != key), "gone"), "seq").alias("x")).select(key, "x.*")
        new = last.filter("not gone").select(*columns)
        after = before.join(last.select(key), key, "left_anti").select(*columns).unionByName(new)
        tables.save_state(after.withColumn("batch", F.lit(number).cast("long")), path)
        now = time.monotonic() * 1000
        if compare and (not reported[0] or now - reported[0] >= settings.report_ms):
            reported[0] = now
            compare(tables.load_state(session, path, f"{schema}, batch long").drop("batch"))

    changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
