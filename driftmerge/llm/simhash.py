r"""SimHash near-duplicates, linked by a self-join of a binary trie.

Texts are lower-cased (A-Z), cut into words ``[^\x20\x09-\x0D]+`` and hashed by 3-word shingles (XXH64, seed 42); a
fingerprint bit is set if it is set in over half of them. Fingerprints link if at most three bits differ.

The trie: of four 16-bit blocks of a fingerprint at least one is equal in both ends of a link. So each distinct
fingerprint goes to four tries, each with one of the blocks as its first levels; the node under those levels is the
unit of distribution. Below it, pairs of nodes are traversed together from (node, node): each level splits both nodes
by one bit, adds one to the distance where the bits differ, and drops pairs over the budget. A pair whose leaves are
already one component is dropped as well, which keeps dense groups of copies from making all their pairs. A task
gives a star of links per component, and the stars are joined by connected components.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; equal texts are one
class; a table without rows gives none. A row with a null id is kept and has the component of the rows with its
fingerprint. A fingerprint of rows without ids alone links to no other, and its component is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import materialize, release, table
from driftmerge.llm.components import connected_components

SHINGLE, SEED, BUDGET, BLOCK = 3, 42, 3, 16
#: A node with more fingerprints than this is dealt over several tasks, by pairs of chunks.
NODE_ROWS = 1_000_000
PAIRS = 1 << 19


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[: -SHINGLE]].tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:z], SEED) for a, z in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        counts += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_buffer().to_pybytes()) if x.is_valid else 0 for x in batch.column(1)], np.uint64)
            yield pa.record_batch([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(run, "doc_id long, fp long")


def settle(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking a[i] with b[i]: each node's label is the smallest node of its component."""
    while True:
        x, y = label[a], label[b]
        odd = x != y
        if not odd.any():
            return label
        x, y = x[odd], y[odd]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


def trie_join(prints: np.ndarray, groups: np.ndarray, budget: int = BUDGET, first_bit: int = 63 - BLOCK) -> np.ndarray:
    """Component labels of sorted fingerprints: row i links with j of the same group if at most `budget` bits differ.

    prints: ascending within each group, groups ascending; all bits above `first_bit` are equal in a group. A trie
    node is a range of rows, so the trie needs no storage besides the sorted array and, for a level, one running sum.
    """
    n = len(prints)
    label = np.arange(n)
    edge = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[edge[1:], n]
    many = ends - edge > 1
    lo, hi = edge[many], ends[many]
    sums: dict[int, np.ndarray] = {}
    stack = [(first_bit, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, far = stack.pop()
        if len(alo) > PAIRS:
            half = len(alo) // 2
            stack += [(bit, alo[half:], ahi[half:], blo[half:], bhi[half:], far[half:]), (bit, alo[:half], ahi[:half], blo[:half], bhi[:half], far[:half])]
            continue
        changes = np.cumsum(np.r_[0, (label[1:] != label[:-1]).astype(np.int64)])
        keep = ~((label[alo] == label[blo]) & (changes[alo] == changes[ahi - 1]) & (changes[blo] == changes[bhi - 1]))
        single = (ahi - alo == 1) & (bhi - blo == 1)
        leaf = keep & single & (alo != blo)
        if leaf.any():
            a, b = alo[leaf], blo[leaf]
            near = np.bitwise_count(prints[a] ^ prints[b]) <= budget
            label = settle(label, a[near], b[near])
        keep &= ~single
        if bit < 0 or not keep.any():  # below the last bit a range holds equal prints only
            if bit < 0 and keep.any():
                raise AssertionError("prints must be distinct within a group")
            continue
        alo, ahi, blo, bhi, far = alo[keep], ahi[keep], blo[keep], bhi[keep], far[keep]
        if bit not in sums:
            sums[bit] = np.r_[0, np.cumsum((prints >> np.uint64(bit) & np.uint64(1)).astype(np.int64))]
        ones = sums[bit]
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        self_pair = alo == blo
        parts = []
        for x0, x1, y0, y1, more, which in ((alo, amid, blo, bmid, 0, None), (amid, ahi, bmid, bhi, 0, None), (alo, amid, bmid, bhi, 1, None), (amid, ahi, blo, bmid, 1, ~self_pair)):
            ok = (x1 > x0) & (y1 > y0) & (far + more <= budget)
            if which is not None:
                ok &= which
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], far[ok] + np.int8(more)))
        stack.append((bit - 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))
    return label


def links(classes: DataFrame, node_rows: int = NODE_ROWS) -> DataFrame:
    """Star links (u, v) between the ids of `classes` (fp, rep; distinct fp) whose fingerprints are near."""
    rotated = [F.struct(F.lit(k).alias("block"), (F.shiftleft("fp", k * BLOCK).bitwiseOR(F.shiftrightunsigned("fp", 64 - k * BLOCK)) if k else F.col("fp")).alias("key")) for k in range(64 // BLOCK)]
    spread = classes.select("rep", F.explode(F.array(*rotated)).alias("x")).select("rep", "x.block", "x.key", F.shiftrightunsigned("x.key", 64 - BLOCK).alias("node"))
    # Nodes over the bound are few: at most four rows for every node_rows fingerprints.
    large = spread.groupBy("block", "node").count().filter(F.col("count") > node_rows).select("block", "node", F.ceil(F.col("count") * 2 / node_rows).cast("int").alias("m"))
    dealt = spread.join(large, ["block", "node"], "left").withColumn("m", F.coalesce("m", F.lit(1)))
    dealt = dealt.withColumn("c", F.pmod(F.xxhash64("key"), "m").cast("int"))
    dealt = dealt.select("block", "node", "key", "rep", "c", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("j"))
    dealt = dealt.select("block", "node", F.least("c", "j").alias("i"), F.greatest("c", "j").alias("j"), "key", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def join(columns: list[np.ndarray]) -> pa.RecordBatch:
            block, node, i, j, key, rep = columns
            group = np.cumsum(np.r_[0, (np.diff(block) != 0) | (np.diff(node) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)])
            prints = key.view(np.uint64)
            order = np.lexsort((prints, group))
            prints, group, rep = prints[order], group[order], rep[order]
            label = trie_join(prints, group)
            odd = np.flatnonzero(label != np.arange(len(label)))
            return pa.record_batch([pa.array(rep[odd]), pa.array(rep[label[odd]])], ["u", "v"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(columns[0]):
                continue
            held.append(columns)
            rows += len(columns[0])
            if rows >= 1 << 17:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                same = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1]) & (whole[2] == whole[2][-1]) & (whole[3] == whole[3][-1])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield join([x[:cut] for x in whole])
                held = [[x[cut:] for x in whole]]
                rows = len(whole[0]) - cut
        if rows:
            yield join([np.concatenate(x) for x in zip(*held, strict=True)])

    keys = ["block", "node", "i", "j"]
    return dealt.repartition(*keys).sortWithinPartitions(*keys).select(*keys, "key", "rep").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, fp, component_id) for every document."""
    prints = materialize(fingerprints(docs, id_column, text_column), "fingerprints")
    classes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = connected_components(links(classes.filter("rep is not null").select("fp", "rep")))
    named = classes.join(roots, classes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    out = materialize(prints.join(named, "fp").select("doc_id", "fp", "component_id"), "near")
    release(prints, classes)
    return out


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
