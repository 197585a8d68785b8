r"""Fill-in-middle by an index of distinct texts.

A text's boundaries are the ends of its units, ``[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+``, in code points. A
rising list like this one is kept in Elias-Fano form: the low bits of each number side by side, the high ones as a bit map in
unary, about two bits and the logarithm of the mean gap for a number, from which any one can be read.

Blocks of documents (``blocks``) are written once. Within a block equal texts are one *place*. Places ask by a hash of
their text; only those whose hash stands elsewhere too send the text, once for each block, however many documents there hold it. Where
places of a hash meet, their contents are compared, so a hash that two texts share does no harm; each distinct text's list is made once and goes back
to every place that holds it. Then a block reads the seeded cuts of its documents off the lists of its places; a text that stands in one place
only has its list made there. So a text that a third of all documents hold moves once for each block.

Defined results: null texts are empty, empty texts and those that hold a mark stay plain; so do rows without an id, which have no
seed; rows that repeat an id or a text are cut by their own id and text; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.blocks import BLOCK_SHIFTS, by_block, drop_blocks, stored_by_block
from driftmerge.llm.common import materialize, release, table, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_RATE = 42, 50, 80


def boundaries(text: str) -> np.ndarray:
    """Ends of the units of a text, in code points."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    blank = (code == 32) | ((code >= 9) & (code <= 13))
    last = ~blank & np.r_[blank[1:], True]
    if len(code):
        last[-1] = True
    return np.flatnonzero(last) + 1


def elias_fano(numbers: np.ndarray) -> bytes:
    """A rising list of numbers above -1: how many there are and of how many low bits, the low bits, then the high ones."""
    n = len(numbers)
    low = max(0, int(numbers[-1]) // n).bit_length() - 1 if n else 0
    low = max(0, low)
    bits = (numbers[:, None] >> np.arange(low)) & 1
    high = np.zeros((int(numbers[-1] >> low) + n if n else 0), np.uint8)
    if n:
        high[(numbers >> low) + np.arange(n)] = 1
    return np.array([n, low], "<u4").tobytes() + np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


class EliasFano:
    """Reads numbers out of what elias_fano() made."""

    def __init__(self, held: bytes) -> None:
        self.n, self.low = np.frombuffer(held, "<u4", 2).tolist()
        cut = 8 + -(-self.n * self.low // 8)
        self.lows, self.highs = held[8:cut], np.frombuffer(held, np.uint8, offset=cut)
        self.ones = np.cumsum(np.bitwise_count(self.highs), dtype=np.int64)

    def __getitem__(self, k: int) -> int:
        """The number at place k, from 0."""
        at = int(np.searchsorted(self.ones, k + 1))
        left = k - (int(self.ones[at - 1]) if at else 0)
        byte = int(self.highs[at])
        for _ in range(left):
            byte &= byte - 1
        high = 8 * at + (byte & -byte).bit_length() - 1 - k
        if not self.low:
            return high
        first, skip = divmod(k * self.low, 8)
        part = int.from_bytes(self.lows[first : first + -(-(skip + self.low) // 8)], "little")
        return high << self.low | part >> skip & (1 << self.low) - 1


def cut(doc: int | None, text: str, ends: EliasFano, marked: bool, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> tuple[str, int, int]:
    """Form, and where prefix and middle end."""
    if doc is None or not text or marked:
        return "plain", 0, 0
    digest = hashlib.sha256(f"{seed}:{doc}".encode()).digest()
    h = np.frombuffer(digest, ">u4", 4).tolist()
    if h[2] % 100 >= rate:
        return "plain", 0, 0
    a, z = sorted((h[0] % (ends.n + 1), h[1] % (ends.n + 1)))
    return "spm" if h[3] % 100 < spm_rate else "psm", ends[a - 1] if a else 0, ends[z - 1] if z else 0


def written(text: str, form: str, a: int, z: int) -> str:
    if form == "plain":
        return text
    head, middle, tail = text[:a], text[a:z], text[z:]
    return f"{PREFIX}{head}{SUFFIX}{tail}{MIDDLE}{middle}" if form == "psm" else f"{SUFFIX}{tail}{PREFIX}{head}{MIDDLE}{middle}"


def restored(output: str, form: str) -> str:
    """The text that was written in a form."""
    if form == "plain":
        return output
    inner, middle = output.split(MIDDLE)
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, two = inner.removeprefix(first).split(second)
    return one + middle + two if form == "psm" else two + middle + one


FIM = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def document_blocks(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (block, row, doc_id, text), bucketed by block; row is unique."""
    row = F.monotonically_increasing_id()
    kept = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")).withColumn("row", row)
    size, shift, sort = F.octet_length("text"), F.lit(0), F.lit(len(BLOCK_SHIFTS))
    for k, (most, bits) in reversed(list(enumerate(BLOCK_SHIFTS))):
        shift, sort = F.when(size <= most, bits).otherwise(shift), F.when(size <= most, k).otherwise(sort)
    # A task's rows stay apart from another's: the upper bits of their numbers are the task's.
    block = F.call_function("shiftleft", F.call_function("shiftright", F.col("row"), shift), F.lit(2)) + sort
    return stored_by_block(kept.select(block.alias("block"), "row", "doc_id", "text"))


def distinct(part: pa.RecordBatch | pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct texts of some rows, the number of each row's, and the smallest row of each."""
    coded = pc.dictionary_encode(texts(part.column("text")))
    code = coded.indices.to_numpy(zero_copy_only=False)
    least = np.full(len(coded.dictionary), np.iinfo(np.int64).max)
    np.minimum.at(least, code, part.column("row").to_numpy())
    return coded.dictionary, code, least


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, row, ends) of rows (key, block, row, text) sorted by key: a list for each distinct text of a key."""
    last, known = None, {}
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
            if key != last:
                last, known = key, {}
            text = text.as_py()
            if text not in known:  # a hash that two texts share has two lists
                known[text] = elias_fano(boundaries(text))
            out.append(known[text])
        yield pa.record_batch([batch.column(1), batch.column(2), pa.array(out, pa.binary())], ["block", "row", "ends"])


def index(blocks: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(block, row, ends): the list of each text that stands in several places, for each of them; and what to release then."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in by_block(batches):
            held, _, least = distinct(part)
            keys = [xxhash.xxh3_64_intdigest(x.as_buffer()) for x in held]
            yield pa.record_batch([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(np.full(len(keys), block)), pa.array(least)], ["key", "block", "row"])

    places = materialize(blocks.mapInArrow(ask, "key long, block long, row long"), "places")
    several = places.groupBy("key").count().filter("count > 1").select("key")
    asked = places.join(several, "key", "left_semi")

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["key", "block", "row", "text"])
        at = pc.index_in(right.column("row"), value_set=left.column("row"))
        return pa.table([right.column("key"), right.column("block"), right.column("row"), left.column("text").take(at)], ["key", "block", "row", "text"])

    moved = blocks.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(send, "key long, block long, row long, text string")

    met = materialize(moved.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "block long, row long, ends binary"), "lists")
    return met, [places, met]


def transformed(blocks: DataFrame, lists: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """The cut documents of block tables."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[list] = [[] for _ in range(6)]
        if left.num_rows:
            given = dict(zip(right.column("row").to_pylist(), right.column("ends").to_pylist(), strict=True))
            held, code, least = distinct(left)
            ids = left.column("doc_id").to_pylist()
            order = np.argsort(code, kind="stable")
            edges = np.searchsorted(code[order], np.arange(len(held) + 1)).tolist()
            for k, first in enumerate(least.tolist()):
                text = held[k].as_py()
                ends = EliasFano(given.get(first) or elias_fano(boundaries(text)))
                marked = any(m in text for m in (PREFIX, SUFFIX, MIDDLE))
                for r in order[edges[k] : edges[k + 1]].tolist():
                    form, a, z = cut(ids[r], text, ends, marked, seed, rate, spm_rate)
                    plain = form == "plain"
                    for cell, x in zip(rows, (ids[r], ends.n, form, None if plain else a, None if plain else z - a, written(text, form, a, z)), strict=True):
                        cell.append(x)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.table([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return blocks.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(run, FIM)


def transform(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Rows (doc_id, n, form, prefix_chars, middle_chars, output); `rate` and `spm_rate` are percentages."""
    blocks = document_blocks(docs, id_column, text_column)
    lists, held = index(blocks)
    out = materialize(transformed(blocks, lists, seed, rate, spm_rate), "middles")
    release(*held)
    drop_blocks(blocks)
    return out


def op12_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the outputs and of the texts rebuilt from them."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, back = [], []
            for form, output in zip(batch.column("form").to_pylist(), batch.column("output"), strict=True):
                output = output.as_py()
                out.append(hashlib.sha256(output.encode()).hexdigest())
                back.append(hashlib.sha256(restored(output, form).encode()).hexdigest())
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.string()), pa.array(back, pa.string())], [*names, "output_sha256", "restored_sha256"])

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    blocks = document_blocks(table(spark, sf_dir, "documents"), "doc_id", "text")
    lists, held = index(blocks)
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
    out = materialize(transformed(blocks, lists).mapInArrow(digest, schema), "middles")
    release(*held)
    drop_blocks(blocks)
    return out


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents
), s AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS z,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM s
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS head, array_to_string(u[a + 1:z], '') AS middle, array_to_string(u[z + 1:], '') AS tail FROM c
)
SELECT doc_id, n, form, CAST(CASE WHEN form <> 'plain' THEN length(head) END AS BIGINT) AS prefix_chars, CAST(CASE WHEN form <> 'plain' THEN length(middle) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || head || '<S>' || tail || '<M>' || middle ELSE '<S>' || tail || '<P>' || head || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p
"""
