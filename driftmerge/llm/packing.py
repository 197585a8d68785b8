"""Best-fit packing with a grouping genetic algorithm on islands.

Texts become token ids and an end mark. The strings of the vocabulary's added tokens are those tokens where they stand
in a text, as its tokenizer has it. A document longer than a sequence is cut from its end into full pieces, so
only its first piece may be shorter. Full pieces are sequences of their own; all others are packed.

The other pieces are dealt by hash into groups of about ``GROUP`` pieces. Each group evolves on ``ISLANDS`` islands (a task each), which
start from best-fit packings in different orders. An individual is a partition of the pieces into bins. Crossover
copies well-filled bins of one parent into the other as wholes, drops the receiver's bins that hold a piece of
theirs, and puts the displaced pieces back by best fit; mutation empties a few badly filled bins the same way. Between
epochs the best individuals of a group's islands migrate to all its islands. Fitness is the number of bins, then the
mean squared filling. The pieces of each group's not quite full bins go into a second, much smaller round of groups,
so that the last bins of the groups do not stay half empty.

Defined results: null and empty texts are the end mark alone; rows with equal ids are documents of their own; a table
without rows gives none.
"""

from __future__ import annotations

import bisect
import random
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import materialize, release, table

CAPACITY, END_ID = 1024, 2
GROUP, ISLANDS, EPOCHS, POPULATION, GENERATIONS = 4096, 2, 2, 4, 6
#: The vocabulary's ranks, and the tokenizer that adds whole tokens to them.
VOCABULARY, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
CACHE = 300_000

_BLANKS = re.compile(r" \s|\s ")


class Encoder:
    """Byte-level BPE ids as little-endian 32-bit bytes.

    A blank between two other characters always begins a new pre-token, so texts are looked up by their
    blank-separated chunks; texts in which a blank touches other white space are encoded whole.
    """

    def __init__(self, vocabulary: str = VOCABULARY, tokenizer: str = TOKENIZER) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(tokenizer), encoding="utf-8") as f:
            self.added = {x["content"]: np.array([x["id"]], np.uint32).tobytes() for x in json.load(f)["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        self.seen: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), np.uint32).tobytes()

    def __call__(self, text: str) -> bytes:
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += (self.plain(text[at : m.start()]), self.added[m[0]])
            at = m.end()
        return b"".join((*out, self.plain(text[at:])))

    def plain(self, text: str) -> bytes:
        """Ids of text between added tokens."""
        if _BLANKS.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        out = [self.whole(first)]
        try:
            out += map(self.seen.__getitem__, rest)
        except KeyError:
            if len(self.seen) > CACHE:
                self.seen.clear()
            seen = self.seen
            del out[1:]
            for chunk in rest:
                got = seen.get(chunk)
                if got is None:
                    got = self.whole(" " + chunk)
                    if len(chunk) < 64:
                        seen[chunk] = got
                out.append(got)
        return b"".join(out)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: A piece's number within its task: it deals equal rows apart.
CUT = f"{PIECES}, nth long"


def pieces(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, nth) of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth = Encoder(vocabulary), 0
        mark = np.array([end_id], np.uint32).tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py()) + mark if text.is_valid else mark
                size = len(ids) // 4
                first = (size - 1) % capacity + 1
                at = 0
                for k in range(-(-size // capacity)):
                    n = first if k == 0 else capacity
                    rows.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), nth))
                    at += n
                    nth += 1
            kinds = (pa.int64(), pa.int32(), *[pa.int64()] * 4)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "nth"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(run, CUT)


class Packing:
    """Bins of piece numbers, with a list of bins by free room for best fit."""

    def __init__(self, sizes: list[int], capacity: int = CAPACITY) -> None:
        self.sizes, self.capacity = sizes, capacity
        self.bins: list[list[int]] = []
        self.room: list[int] = []

    def copy_of(self, bins: list[list[int]]) -> Packing:
        out = Packing(self.sizes, self.capacity)
        out.bins = [list(b) for b in bins]
        out.room = [self.capacity - sum(map(self.sizes.__getitem__, b)) for b in bins]
        return out

    def best_fit(self, loose: list[int]) -> None:
        """Puts each piece, in the order given, into the fullest bin that can hold it."""
        by: dict[int, list[int]] = {}
        for k, r in enumerate(self.room):
            if r:
                by.setdefault(r, []).append(k)
        rooms = sorted(by)
        for x in loose:
            size = self.sizes[x]
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                r = rooms[at]
                k = by[r].pop()
                if not by[r]:
                    del by[r], rooms[at]
                self.bins[k].append(x)
            else:
                k, r = len(self.bins), self.capacity
                self.bins.append([x])
                self.room.append(r)
            left = self.room[k] = r - size
            if left:
                if left in by:
                    by[left].append(k)
                else:
                    by[left] = [k]
                    bisect.insort(rooms, left)

    def fitness(self) -> tuple[int, float]:
        """Smaller is better: bins, then minus the summed squared filling."""
        return len(self.bins), -sum((self.capacity - r) ** 2 for r in self.room) / self.capacity**2

    def genome(self) -> bytes:
        out = np.zeros(len(self.sizes), np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out.tobytes()


def of_genome(genome: bytes, sizes: list[int], capacity: int) -> Packing:
    bins: dict[int, list[int]] = {}
    for x, k in enumerate(np.frombuffer(genome, np.int32).tolist()):
        bins.setdefault(k, []).append(x)
    return Packing(sizes, capacity).copy_of(list(bins.values()))


def cross(giver: Packing, taker: Packing, rng: random.Random) -> Packing:
    """Injects whole well-filled bins of one parent into the other and best-fits what they displace."""
    order = sorted(range(len(giver.bins)), key=lambda k: giver.room[k])
    full = order[: max(1, len(order) // 2)]
    share = rng.uniform(0.2, 0.8)
    gift = [giver.bins[k] for k in full if rng.random() < share]
    given = {x for b in gift for x in b}
    stay, loose = [], []
    for b in taker.bins:
        if given.isdisjoint(b):
            stay.append(b)
        else:
            loose += [x for x in b if x not in given]
    child = taker.copy_of([*gift, *stay])
    child.best_fit(sorted(loose, key=lambda x: -taker.sizes[x]))
    return child


def mutate(one: Packing, rng: random.Random) -> Packing:
    """Empties the emptiest bins and some others, and best-fits their pieces."""
    order = sorted(range(len(one.bins)), key=lambda k: -one.room[k])
    n = max(2, len(order) // 20)
    gone = set(order[:n]) | {rng.randrange(len(order)) for _ in range(n)}
    loose = [x for k in gone for x in one.bins[k]]
    rng.shuffle(loose)
    loose.sort(key=lambda x: -one.sizes[x] // 8)
    child = one.copy_of([b for k, b in enumerate(one.bins) if k not in gone])
    child.best_fit(loose)
    return child


def evolve(sizes: list[int], seed: int, settlers: list[bytes] = (), capacity: int = CAPACITY, population: int = POPULATION, generations: int = GENERATIONS) -> Packing:
    """One epoch on one island: the best packing found. Ends early at the bound that no packing can beat."""
    rng = random.Random(seed)
    least = -(-sum(sizes) // capacity)
    people = [of_genome(g, sizes, capacity) for g in settlers]
    while len(people) < population:
        one = Packing(sizes, capacity)
        loose = list(range(len(sizes)))
        rng.shuffle(loose)
        step = (1, 16, 64, 128)[len(people) % 4]
        loose.sort(key=lambda x: -(sizes[x] // step))
        one.best_fit(loose)
        people.append(one)
    people.sort(key=Packing.fitness)
    for _ in range(generations):
        if len(people[0].bins) <= least:
            break
        a, b = rng.sample(range(len(people)), 2)
        people += [cross(people[min(a, b)], people[max(a, b)], rng), cross(people[max(a, b)], people[min(a, b)], rng), mutate(people[0], rng)]
        people = sorted(people, key=Packing.fitness)[:population]
    return people[0]


ELITE = "bunch long, island int, bins long, filling double, genome binary"
_ITEM = ["length", "doc_id", "piece", "start", "ids_crc32", "nth"]


def _ordered(part: pa.Table) -> pa.Table:
    return part.sort_by([("length", "descending"), *((c, "ascending") for c in _ITEM[1:])])


def pack_bunches(items: DataFrame, capacity: int = CAPACITY, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The rows of `items` (CUT and bunch) with bin, place and filling; bins are numbered within their bunch."""
    spread = items.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)])))

    def land(part: pa.Table, settlers: list[bytes], epoch: int) -> pa.Table:
        bunch, island = part.column("bunch")[0].as_py(), part.column("island")[0].as_py()
        best = evolve(_ordered(part).column("length").to_pylist(), hash((bunch, island, epoch)), settlers, capacity)
        bins, filling = best.fitness()
        return pa.table([pa.array([bunch]), pa.array([island], pa.int32()), pa.array([bins]), pa.array([filling]), pa.array([best.genome()], pa.binary())], ["bunch", "island", "bins", "filling", "genome"])

    def settling(epoch: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        return lambda part, settlers: land(part, settlers.sort_by([("bins", "ascending"), ("filling", "ascending")]).column("genome").to_pylist(), epoch)

    elites = materialize(spread.groupBy("bunch", "island").applyInArrow(lambda part: land(part, [], 0), ELITE), "elites")
    for epoch in range(1, epochs):
        migrants = elites.select("bunch", "bins", "filling", "genome", F.explode(F.array(*[F.lit(k) for k in range(islands)])).alias("island"))

        before, elites = elites, materialize(spread.groupBy("bunch", "island").cogroup(migrants.groupBy("bunch", "island")).applyInArrow(settling(epoch), ELITE), "elites")
        release(before)
    best = elites.groupBy("bunch").agg(F.min_by("genome", F.struct("bins", "filling", "island")).alias("genome"))

    def place(part: pa.Table, winner: pa.Table) -> pa.Table:
        part = _ordered(part)
        bins = np.frombuffer(winner.column("genome")[0].as_py(), np.int32)
        length = part.column("length").to_numpy()
        order = np.argsort(bins, kind="stable")
        run = np.cumsum(length[order]) - length[order]
        first = np.r_[True, np.diff(bins[order]) != 0]
        place_ = np.empty(len(bins), np.int64)
        place_[order] = run - run[first][np.cumsum(first) - 1]
        filled = np.bincount(bins, length)[bins].astype(np.int64)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "bunch"]
        return pa.table([*(part.column(c) for c in names), pa.array(bins.astype(np.int64)), pa.array(place_), pa.array(filled)], [*names, "bin", "offset", "filled"])

    return items.groupBy("bunch").cogroup(best.groupBy("bunch")).applyInArrow(place, f"{CUT}, bunch long, bin long, offset long, filled long")


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", capacity: int = CAPACITY, group: int = GROUP, vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    cut = materialize(pieces(docs, id_column, text_column, capacity, vocabulary=vocabulary), "pieces")
    part = cut.filter(F.col("length") < capacity)

    def dealt(items: DataFrame, count: int, salt: int) -> DataFrame:
        bunches = max(1, -(-count // group))
        return items.withColumn("bunch", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "nth", F.lit(salt)), F.lit(bunches)))

    first = materialize(pack_bunches(dealt(part, part.count(), 1), capacity), "packed")
    # The bins that waste most go once more through groups of their own; at the bound of waste nothing is left to gain.
    bound = capacity - max(1, capacity // 64)
    done = first.filter(F.col("filled") >= bound)
    loose = first.filter(F.col("filled") < bound).select("doc_id", "piece", "start", "length", "ids_crc32", "nth")
    second = materialize(pack_bunches(dealt(loose, loose.count(), 2), capacity), "packed")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    number = lambda k: (F.col("bunch") * 2 + k) * (1 << 24) + F.col("bin")
    full = cut.filter(F.col("length") >= capacity).select(*names, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = materialize(full.union(done.select(*names, number(0).alias("sequence_id"), "offset")).union(second.select(*names, number(1).alias("sequence_id"), "offset")), "sequences")
    release(cut, first, second)
    return out


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
