r"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Tokens are the runs of letters and digits of the lower-cased text. Every run of ``SEED`` tokens of a benchmark item
is a seed; documents that hold none of an item's seeds cannot share a tile of that length with it and go no further.
Other pairs of document and item are tiled: the longest common run whose tokens are all unmarked becomes a tile, its
tokens are marked in both, and so on with falling length down to ``SEED``. Runs are found by running Karp-Rabin
values at a search length that falls by halves, from the shorter text's length to ``SEED``: at each length the
unmarked windows of both texts are hashed and joined, matches are verified and extended, and tiles marked until none
of that length is left. A token is in one tile at most, and the order of tiles doesn't matter, so passages whose
sentences were dealt anew are caught. A document is contaminated by an item if its tiles cover at least ``COVERAGE``
of the item's tokens.

A benchmark of at most ``BROADCAST_BYTES`` of text is an index that travels to the executors, and documents aren't
shuffled. A larger one stays distributed: executors get a bit map of fixed size of its seeds, documents give out the
seeds that it lets through, these are joined with the benchmark's, and the pairs that remain are joined with the
texts of both sides. Both ways give the same rows.

Defined results: null and empty texts match nothing; items of fewer than ``SEED`` tokens are too short to tell a leak
from everyday words and are never found; several rows of an item id are items of their own; repeated documents are
judged alike.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import INVERSE, Digests, materialize, mix, powers, release, table

SEED, COVERAGE, BROADCAST_BYTES = 5, 0.5, 16 << 20
#: Bits of the seeds' map, a power of two and whole buckets of Spark's bitmap functions: 16 MB.
MAP_BITS, BUCKET_BITS = 1 << 27, 1 << 15
WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _runs(ids: np.ndarray, width: int) -> np.ndarray:
    """Karp-Rabin values of all runs of `width` ids, by prefix sums: a value costs the same at every width."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(len(ids)), powers(n, INVERSE)
    with np.errstate(over="ignore"):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
        return mix((run[width:] - run[:-width]) * down)


def _open(free: np.ndarray, width: int) -> np.ndarray:
    """Starts of the windows without a marked token."""
    run = np.concatenate([np.zeros(1, np.int64), np.cumsum(free)])
    return np.flatnonzero(run[width:] - run[:-width] == width)


def _matches(doc: np.ndarray, item: np.ndarray, free_d: np.ndarray, free_i: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, start in doc, start in item) of unmarked tokens, of `width` or more."""
    open_d, open_i = _open(free_d, width), _open(free_i, width)
    if not len(open_d) or not len(open_i):
        return []
    keys_d, keys_i = _runs(doc, width), _runs(item, width)
    by: dict[int, list[int]] = {}
    for j in open_i.tolist():
        by.setdefault(int(keys_i[j]), []).append(j)
    out: list[tuple[int, int, int]] = []
    # Diagonals that a longer match already went along are not walked again.
    walked: dict[int, int] = {}
    for i in open_d[np.isin(keys_d[open_d], np.fromiter(by, np.uint64, len(by)))].tolist():
        for j in by[int(keys_d[i])]:
            if walked.get(i - j, -1) > i:
                continue
            most = min(len(doc) - i, len(item) - j)
            same = (doc[i : i + most] == item[j : j + most]) & free_d[i : i + most] & free_i[j : j + most]
            n = most if same.all() else int(same.argmin())
            if n >= width:  # equal hashes of other tokens end here
                out.append((n, i, j))
                walked[i - j] = i + n
    return out


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in doc, start in item, length), the longest first, ties by doc then item start."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    width = min(len(doc), len(item))
    while width >= least > 0:
        while found := _matches(doc, item, free_d, free_i, width):
            longest = max(m[0] for m in found)
            for n, i, j in sorted(m for m in found if m[0] == longest):
                # A match that an earlier tile cut is found again, as what is left of it.
                if free_d[i : i + n].all() and free_i[j : j + n].all():
                    free_d[i : i + n] = False
                    free_i[j : j + n] = False
                    out.append((i, j, n))
        if width == least:
            break
        width = max(least, width // 2)
    return out


def judged(doc: np.ndarray, item: np.ndarray, coverage: float, seed: int) -> tuple[int, int, float, int] | None:
    """(item's tokens, covered tokens, coverage, tiles) if the tiles cover enough of the item."""
    found = tiles(doc, item, seed)
    covered = sum(n for _, _, n in found)
    return (len(item), covered, covered / len(item), len(found)) if covered >= coverage * len(item) else None


class Index:
    """Seeds of a benchmark of bounded size."""

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED) -> None:
        self.seed = seed
        self.vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        self.owners: dict[int, list[int]] = {}
        for ident, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64)
            if len(ids) < seed:
                continue
            for value in set(_runs(ids, seed).tolist()):
                self.owners.setdefault(value, []).append(len(self.items))
            self.items.append((ident, ids))
        self.sorted = np.sort(np.fromiter(self.owners, np.uint64, len(self.owners)))

    def find(self, text: str, coverage: float) -> list[tuple[int, int, int, float, int]]:
        """(item, item's tokens, covered tokens, coverage, tiles) of each item found in a text."""
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in words(text)], np.int64)
        keys = _runs(ids, self.seed)
        if not len(keys) or not len(self.sorted):
            return []
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        pairs = {k for value in np.unique(keys[self.sorted[at] == keys]).tolist() for k in self.owners[value]}
        return [(self.items[k][0], *hit) for k in sorted(pairs) if (hit := judged(ids, self.items[k][1], coverage, self.seed))]


FOUND = "doc_id long, item_id long, item_tokens long, covered_tokens long, coverage double, tiles long"


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def _size(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", coverage: float = COVERAGE, seed: int = SEED, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row for each document and benchmark item that it holds."""
    items = _items(benchmark)
    own = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    if _size(items) > broadcast_bytes:
        return _joined(own, items, coverage, seed).select(*(x.split()[0] for x in FOUND.split(", ")))
    held = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in items.collect()], seed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if text.is_valid for hit in held.value.find(text.as_py(), coverage)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, KINDS, strict=True)], NAMES)

    return own.mapInArrow(run, FOUND)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, text_column: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    items = _items(benchmark)
    if _size(items) > broadcast_bytes:
        # Equal texts are judged alike, so what goes is a list of texts' digests.
        found = _joined(docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text_column).alias("text")), items, coverage, SEED)
        name = "_text" + "_" * max(map(len, docs.columns))  # no column can have this name
        gone = found.select(F.col("digest").alias(name)).distinct()
        return docs.withColumn(name, F.sha2(F.col(text_column).cast("binary"), 256)).join(gone, name, "left_anti").select(*docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in items.collect()]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [not (t.is_valid and held.value.find(t.as_py(), coverage)) for t in batch.column(text_column)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


NAMES = ["doc_id", "item_id", "item_tokens", "covered_tokens", "coverage", "tiles"]
KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())


def _keys(text: str, memo: Digests) -> np.ndarray:
    """64 bits for each token, the same on every executor."""
    return np.frombuffer(b"".join(map(memo.__getitem__, words(text))), np.int64)


def _digest(word: str) -> bytes:
    return xxhash.xxh3_64_digest(word.encode())


def _seeds(texts: DataFrame, seed: int, bits: object = None) -> DataFrame:
    """Adds seeds, the distinct ones of each text; with a map of bits, those that it lets through, and only texts with any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Digests(_digest)
        for batch in batches:
            found = []
            for text in batch.column("text"):
                own = np.unique(_runs(_keys(text.as_py(), memo), seed)) if text.is_valid else np.zeros(0, np.uint64)
                if bits is not None:
                    at = (own & np.uint64(MAP_BITS - 1)).astype(np.int64)
                    own = own[bits.value[at >> 3] >> (at & 7) & 1 == 1]
                found.append(own.view(np.int64))
            keep = pa.array([bits is None or len(x) > 0 for x in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "seeds"]).filter(keep)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema)
    return texts.mapInArrow(run, f"{kinds}, seeds array<long>")


def _joined(docs: DataFrame, items: DataFrame, coverage: float, seed: int) -> DataFrame:
    """FOUND and the digest of the document's text, by joins on seeds; neither side is ever held whole."""
    spark = docs.sparkSession
    bench = materialize(_seeds(items.select("item_id", "text"), seed).withColumn("item", F.monotonically_increasing_id()), "items")
    index = bench.select("item", F.explode("seeds").alias("seed"))
    place = F.col("seed").bitwiseAND(MAP_BITS - 1)
    chunks = index.select(F.floor(place / BUCKET_BITS).cast("long").alias("bucket"), (place % BUCKET_BITS).alias("bit")).groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("chunk")).collect()  # MAP_BITS at most
    bits = np.zeros(MAP_BITS // 8, np.uint8)
    for r in chunks:
        at = r.bucket * BUCKET_BITS // 8
        bits[at : at + BUCKET_BITS // 8] = np.frombuffer(r.chunk, np.uint8)
    asked = materialize(_seeds(docs, seed, spark.sparkContext.broadcast(bits)).withColumn("row", F.monotonically_increasing_id()), "asked")
    pairs = asked.select("row", F.explode("seeds").alias("seed")).join(index, "seed").select("row", "item").distinct()
    both = pairs.join(asked.select("row", "doc_id", "text"), "row").join(bench.select("item", "item_id", F.col("text").alias("item_text")), "item")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Digests(_digest)
        for batch in batches:
            rows = []
            for doc, text, item, item_text in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "item_id", "item_text")), strict=True):
                if hit := judged(_keys(text, memo), _keys(item_text, memo), coverage, seed):
                    rows.append((doc, item, *hit, hashlib.sha256(text.encode()).hexdigest()))
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, (*KINDS, pa.string()), strict=True)], [*NAMES, "digest"])

    out = materialize(both.select("doc_id", "text", "item_id", "item_text").mapInArrow(run, f"{FOUND}, digest string"), "found")
    release(bench, asked)
    return out


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
