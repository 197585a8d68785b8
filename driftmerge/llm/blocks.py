"""Questions that blocks of documents ask the whole corpus.

A block is some documents that one task read, 128 MB of text at most, most often far less, or one longer text. Blocks are written once, bucketed by block, to the shared
folder; so the assignment is fixed whatever is computed again later, and a join by block moves only the answers, not
the texts. A block asks about each of its distinct keys (hashes of words, windows, ...) once: a key that a third of
all documents share is one row per block, not one per document. Keys are dealt by hash and sorted by Spark, which
spills; an answering task streams over them and holds the rows of one key at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.llm.common import release, shared_dir

#: Rows of a block, as a power of two, by the longest text that it may hold; a longer text is a block of its own.
BLOCK_SHIFTS = ((1 << 16, 11), (1 << 20, 7))
#: A document without an id sorts after all others.
NO_ID = (1 << 63) - 1


def block_table(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (block, doc_id, text), bucketed and sorted by block. Null texts become empty, null ids NO_ID with has_id false."""
    row = F.monotonically_increasing_id()
    size, shift, sort = F.octet_length("text"), F.lit(0), F.lit(len(BLOCK_SHIFTS))
    for k, (most, bits) in reversed(list(enumerate(BLOCK_SHIFTS))):
        shift, sort = F.when(size <= most, bits).otherwise(shift), F.when(size <= most, k).otherwise(sort)
    # Task, place of the row within it, sort of block.
    block = F.shiftleft(F.shiftright(row, 33), 36) + F.call_function("shiftleft", F.call_function("shiftright", row.bitwiseAND((1 << 33) - 1), shift), F.lit(2)) + sort
    kept = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kept = kept.select(block.alias("block"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.col("doc_id").isNotNull().alias("has_id"), "text")
    return stored_by_block(kept)


def stored_by_block(rows: DataFrame) -> DataFrame:
    """Rows with a block, as a table bucketed and sorted by it."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"driftmerge_blocks_{uuid.uuid4().hex}"
    rows.write.bucketBy(n, "block").sortBy("block").option("compression", "zstd").option("path", f"{shared_dir(spark)}/{name}").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._driftmerge_table, out._driftmerge_path = name, f"{shared_dir(spark)}/{name}"
    return out


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Neighbouring rows of one block, batch by batch: a block may come in several parts."""
    for batch in batches:
        block = batch.column("block").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.diff(block)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if hi > lo:
                yield int(block[lo]), batch.slice(lo, hi - lo)


def drop_blocks(blocks: DataFrame) -> None:
    """Deletes a block table that nothing reads any more."""
    blocks.sparkSession.sql(f"DROP TABLE IF EXISTS {blocks._driftmerge_table}")
    release(blocks)


def answer(asked: DataFrame, reply: Callable[[np.ndarray, np.ndarray, dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str, last: Callable[[], dict[str, np.ndarray] | None] | None = None, start: Callable[[], None] | None = None) -> DataFrame:
    """Streams over `asked` (key, block, ...) by key; where it has a column ``check``, equal keys are one group only if that is equal too.

    reply(group numbers, starts of groups, columns) gets whole groups of equal keys in their order and gives output
    columns; `start` is called before and `last` after all groups of a partition.
    """
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if start:
            start()
        held: list[dict[str, np.ndarray]] = []
        rows = 0

        def out(columns: dict[str, np.ndarray]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(v) for v in columns.values()], list(columns))

        def whole(parts: list[dict[str, np.ndarray]]) -> pa.RecordBatch:
            columns = {k: np.concatenate([x[k] for x in parts]) for k in names}
            new = np.r_[True, columns["key"][1:] != columns["key"][:-1]]
            if "check" in columns:
                new[1:] |= columns["check"][1:] != columns["check"][:-1]
            return out(reply(np.cumsum(new) - 1, np.flatnonzero(new), columns))

        for batch in batches:
            if not len(batch):
                continue
            one = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in names}
            rows += len(batch)
            # A batch is cut before its last key; one that only goes on with the key held is put aside as it is, so each row is copied once.
            if rows >= 1 << 17 and (cut := int(np.searchsorted(one["key"], one["key"][-1], "left"))):
                yield whole([*held, {k: v[:cut] for k, v in one.items()}])
                held, rows = [{k: v[cut:] for k, v in one.items()}], len(batch) - cut
            elif rows >= 1 << 17 and held and held[-1]["key"][-1] != one["key"][0]:
                yield whole(held)
                held, rows = [one], len(batch)
            else:
                held.append(one)
        if rows:
            yield whole(held)
        if last and (final := last()) is not None:
            yield out(final)

    return asked.repartition("key").sortWithinPartitions("key", *(["check"] if "check" in names else [])).mapInArrow(run, schema)
