r"""Substring dedup by relative Lempel-Ziv parsing.

Words are ``[^\x20\x09-\x0D]+``, unchanged. Every document is a reference block for those with a larger id. The index
maps each phrase of ``WINDOW`` words to the smallest document that holds it and to its first place there. A document
is factored greedily from the left: at a phrase that the index knows, a factor begins, and it takes the words that
follow for as long as they stand side by side in that reference too; so a factor (start, length, reference, place) is
a copy of the reference's words from that place on. Where it ends, the phrases that cross its end are looked up in
their turn: a factor of another block, or of another place, that begins inside the last one is not missed. Words
outside factors stay.

To keep the index small, three rounds of questions are asked by block of documents:

0. whole texts: a text that a smaller document holds as a whole is one factor of it, and takes no part in the rest;
   its phrases are there already.
1. anchors: the minimal 5-word hash of each window. A window that two documents share has an anchor that they share,
   so only windows over anchors of several documents go on; about one word in six asks.
2. windows over such anchors: the answer is the smallest document that holds the window, and where.

Neither rounds nor lists are capped. Windows and texts are told apart by 128 bits: both halves of the words' XXH3-128 digests,
combined over the window by two polynomials. Equal bits count as equal words; among 10^13 different windows a pair
with equal bits is expected with a probability of about 10^-13. Anchors only choose what is asked, so theirs of 64
bits can't change a result.

Defined results: null, empty and blank texts have no words; a text of fewer than ``WINDOW`` words keeps all; rows with
equal ids don't count as smaller than each other; a row without an id counts as larger than all others and comes
back with a null id; a table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.blocks import answer, block_table, by_block, drop_blocks
from driftmerge.llm.common import Digests, cells, materialize, mix, powers, raw, release, slices, table, texts

WINDOW, ANCHOR = 13, 5


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` neighbours."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    up = powers(width)
    out = np.zeros(len(h) - width + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out += h[k : len(h) - width + 1 + k] * up[k]
    return mix(out)


def minimal(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Parsed(NamedTuple):
    """Some rows of a block, without those left out: their numbers, the words of each, and of all words both halves of the digest and the row."""

    rows: np.ndarray
    count: np.ndarray
    h: np.ndarray
    other: np.ndarray
    row: np.ndarray


def parsed(part: pa.RecordBatch | pa.Table, memo: Digests, out: np.ndarray) -> Iterator[Parsed]:
    """The words of a block, some rows at a time, without the rows that `out` marks."""
    column = texts(part.column("text"))
    _, offs = raw(column)
    for lo, hi in slices(offs):
        rows = lo + np.flatnonzero(~out[lo:hi])
        words = [column[r].as_buffer().to_pybytes().split() for r in rows.tolist()]
        count = np.fromiter(map(len, words), np.int64, len(rows))
        halves = np.frombuffer(b"".join([memo[w] for row in words for w in row]), np.uint64).reshape(-1, 2)
        yield Parsed(rows, count, halves[:, 0].copy(), halves[:, 1].copy(), np.repeat(rows, count))


def windows(h: np.ndarray, row: np.ndarray, width: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Start words of the windows that lie in one row, and the anchor of each."""
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    inside = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
    return inside, minimal(rolled(h, anchor), width - anchor + 1)[inside]


def places(key: np.ndarray, check: np.ndarray, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Where each (key, check) stands in the sorted rows of (keys, checks), -1 if it isn't there."""
    out = np.full(len(key), -1)
    if not len(keys):
        return out
    at = np.searchsorted(keys, key)
    left = np.flatnonzero(at < len(keys))
    while len(left):  # equal keys with other checks stand side by side; as good as always the first one is it
        here = at[left]
        same = keys[here] == key[left]
        hit = same & (checks[here] == check[left])
        out[left[hit]] = here[hit]
        left = left[same & ~hit]
        at[left] += 1
        left = left[at[left] < len(keys)]
    return out


def among(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """True for each x that the sorted array holds."""
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def factors(refs: np.ndarray, at: np.ndarray, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """Greedy factors (first word, words, reference, first word there) of a document.

    refs[i], at[i]: the reference of the window at i and its place there; -1 if none. A factor takes the windows that
    follow at the next place of the same reference. The next one is the next window with a reference, which may cross
    this factor's end.
    """
    found = np.flatnonzero(refs >= 0)
    if not len(found):
        return []
    new = np.r_[True, (np.diff(found) != 1) | (np.diff(refs[found]) != 0) | (np.diff(at[found]) != 1)]
    first = found[new]
    last = found[np.r_[np.flatnonzero(new)[1:], len(found)] - 1]
    return list(zip(first.tolist(), (last - first + window).tolist(), refs[first].tolist(), at[first].tolist(), strict=True))


def whole_texts(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of each text's digest."""
    halves = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in cells(texts(part.column("text")))]), np.uint64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


class Known(NamedTuple):
    """What a block was answered, sorted."""

    keys: np.ndarray
    checks: np.ndarray
    least: np.ndarray
    at: np.ndarray

    @classmethod
    def of(cls, answers: pa.Table) -> Known:
        keys, checks = (answers.column(c).to_numpy().view(np.uint64) for c in ("key", "check"))
        order = np.lexsort((checks, keys))
        return cls(keys[order], checks[order], answers.column("least").to_numpy()[order], answers.column("at").to_numpy()[order])

    def smaller(self, key: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Places of those that a document smaller than ids holds, -1 for the others."""
        place = places(key, check, self.keys, self.checks)
        return np.where((place >= 0) & (self.least[place] < ids), place, -1) if len(self.keys) else place


ANCHORS = "key long, block long, several boolean"
QUESTION = "key long, check long, block long, least long, at int, several boolean"
ANSWER = "block long, key long, check long, least long, at int"
FACTORS = "array<struct<start:int,length:int,reference:long,place:int>>"
DEDUPED = f"doc_id long, n_words long, n_removed long, kept_text string, factors {FACTORS}"


def _asked(block: int, found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """A block's distinct windows, each with the smallest document that holds it, its first place there, and whether more do."""
    key, check, ids, at = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((at, ids, check, key))
    key, check, ids, at = key[order], check[order], ids[order], at[order]
    first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (check[1:] != check[:-1])][: len(key)])
    several = np.maximum.reduceat(ids, first) > ids[first] if len(first) else np.zeros(0, bool)
    columns = (key[first].view(np.int64), check[first].view(np.int64), np.full(len(first), block), ids[first], at[first].astype(np.int32), several)
    return pa.record_batch([pa.array(c) for c in columns], ["key", "check", "block", "least", "at", "several"])


def _earliest(group: np.ndarray, at: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """To each block that has more than the smallest document with a key: that document, and where it holds it."""
    best = np.lexsort((columns["least"], group))[at][group]
    keep = (columns["least"][best] < columns["least"]) | columns["several"]
    out = {"block": columns["block"], "key": columns["key"], "check": columns["check"], "least": columns["least"][best], "at": columns["at"][best]}
    return {k: v[keep] for k, v in out.items()}


def dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_text, factors): factors are (start, length, reference, place) in words."""
    return _cut(block_table(docs, id_column, text_column), window)[0]


def _cut(blocks: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """What dedup gives, and what it reads beside the blocks."""
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, part in by_block(batches):
            ids = part.column("doc_id").to_numpy()
            yield _asked(block, [(*whole_texts(part), ids, np.zeros(len(ids), np.int64))])

    copies = materialize(answer(blocks.mapInArrow(whole, QUESTION), _earliest, ANSWER), "copies")

    def copied(left: pa.Table, right: pa.Table) -> np.ndarray:
        """The smaller document with the same text of each row of a block, -1 if there is none."""
        known = Known.of(right)
        place = known.smaller(*whole_texts(left), left.column("doc_id").to_numpy())
        return np.where(place >= 0, known.least[place], -1) if len(known.keys) else place

    def anchors(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if left.num_rows:
            ids = left.column("doc_id").to_numpy()
            for p in parsed(left, Digests(xxhash.xxh3_128_digest), copied(left, right) >= 0):
                inside, a = windows(p.h, p.row, window)
                if len(a):
                    own = p.row[inside]
                    new = np.r_[True, (a[1:] != a[:-1]) | (own[1:] != own[:-1])]
                    keys.append(a[new])
                    owners.append(ids[own[new]])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        key, owner = key[order], owner[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        several = np.minimum.reduceat(owner, first) < np.maximum.reduceat(owner, first) if len(first) else np.zeros(0, bool)
        block = left.column("block")[0].as_py() if left.num_rows else 0
        return pa.table([pa.array(key[first].view(np.int64)), pa.array(np.full(len(first), block, np.int64)), pa.array(several)], ["key", "block", "several"])

    def shared_anchors(group: np.ndarray, at: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        # Rows of two blocks are of two documents, or of equal ids, which the windows tell apart.
        many = np.diff(np.r_[at, len(group)]) > 1
        keep = (many | np.logical_or.reduceat(columns["several"], at))[group]
        return {"block": columns["block"][keep], "key": columns["key"][keep]}

    asked_anchors = blocks.groupBy("block").cogroup(copies.groupBy("block")).applyInArrow(anchors, ANCHORS)
    shared = answer(asked_anchors, shared_anchors, "block long, key long")
    # A block gets two sorts of answers at once: check is null for anchors, which have no other columns.
    none = F.lit(None)
    shared = shared.select("block", "key", none.cast("long").alias("check"), none.cast("long").alias("least"), none.cast("int").alias("at")).unionByName(copies)

    def sorts(right: pa.Table) -> tuple[pa.Table, pa.Table]:
        whole = right.column("check").is_valid()
        return right.filter(whole), right.filter(pc.invert(whole))

    def candidates(left: pa.Table, right: pa.Table) -> pa.Table:
        memo, found = Digests(xxhash.xxh3_128_digest), []
        own, anchored = sorts(right)
        if left.num_rows and anchored.num_rows:
            wanted = np.sort(anchored.column("key").to_numpy().view(np.uint64))
            ids = left.column("doc_id").to_numpy()
            first = np.zeros(left.num_rows, np.int64)  # words of a slice before each row
            for p in parsed(left, memo, copied(left, own) >= 0):
                first[p.rows] = np.cumsum(p.count) - p.count
                inside, a = windows(p.h, p.row, window)
                if len(a):
                    new = np.r_[True, a[1:] != a[:-1]]
                    at = inside[among(a[new], wanted)[np.cumsum(new) - 1]]
                    found.append((rolled(p.h, window)[at], rolled(p.other, window)[at], ids[p.row[at]], at - first[p.row[at]]))
        if found:
            return pa.Table.from_batches([_asked(left.column("block")[0].as_py(), found)])
        return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.int32(), pa.bool_())], ["key", "check", "block", "least", "at", "several"])

    asked = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(candidates, QUESTION)

    index = answer(asked, _earliest, ANSWER)
    index = index.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("whole", F.lit(True)))

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_numpy()
        column = texts(left.column("text")) if left.num_rows else None
        is_whole = right.column("whole")
        known = Known.of(right.filter(pc.invert(is_whole)))
        same = copied(left, right.filter(is_whole)) if left.num_rows else np.zeros(0, np.int64)
        n_words, n_removed, kept, found = ([None] * left.num_rows for _ in range(4))
        for r in np.flatnonzero(same >= 0).tolist():
            body = column[r].as_buffer().to_pybytes().split()
            gone = len(body) >= window
            n_words[r], n_removed[r], kept[r] = len(body), len(body) * gone, b"" if gone else b" ".join(body)
            found[r] = [{"start": 0, "length": len(body), "reference": int(same[r]), "place": 0}] if gone else []
        for p in parsed(left, Digests(xxhash.xxh3_128_digest), same >= 0) if left.num_rows else ():
            refs, at = np.full(len(p.h), -1, np.int64), np.full(len(p.h), -1, np.int64)
            if len(known.keys) and len(p.h) >= window:
                inside = np.flatnonzero(p.row[: len(p.row) - window + 1] == p.row[window - 1 :])
                place = known.smaller(rolled(p.h, window)[inside], rolled(p.other, window)[inside], ids[p.row[inside]])
                hit = place >= 0
                refs[inside[hit]], at[inside[hit]] = known.least[place[hit]], known.at[place[hit]]
            ends = np.cumsum(p.count)
            for r, n, end in zip(p.rows.tolist(), p.count.tolist(), ends.tolist(), strict=True):
                listed = factors(refs[end - n : end], at[end - n : end], window)
                body = column[r].as_buffer().to_pybytes().split()
                if listed:
                    stay = np.ones(n, bool)
                    for start, length, _, _ in listed:
                        stay[start : start + length] = False
                    body = [body[i] for i in np.flatnonzero(stay).tolist()]
                n_words[r], n_removed[r], kept[r] = n, n - len(body), b" ".join(body)
                found[r] = [{"start": a, "length": b, "reference": c, "place": e} for a, b, c, e in listed]
        has = left.column("has_id").combine_chunks() if left.num_rows else pa.array([], pa.bool_())
        doc = pa.array([i if ok else None for i, ok in zip(ids.tolist(), has.to_pylist(), strict=True)], pa.int64())
        kinds = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("reference", pa.int64()), ("place", pa.int32())]))
        return pa.table([doc, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(found, kinds)], ["doc_id", "n_words", "n_removed", "kept_text", "factors"])

    return blocks.groupBy("block").cogroup(index.groupBy("block")).applyInArrow(cut, DEDUPED), copies


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [hashlib.sha256(x.as_buffer()).hexdigest() for x in batch.column("kept_text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), batch.column("n_removed"), pa.array(hashes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    blocks = block_table(table(spark, sf_dir, "documents"))
    done, copies = _cut(blocks, WINDOW)
    out = materialize(done.select("doc_id", "n_words", "n_removed", "kept_text").mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"), "deduped")
    release(copies)
    drop_blocks(blocks)
    return out


#: Windows as lists of words; each is looked up by its first document.
OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), x AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, (SELECT doc_id AS id2, unnest(range(1, len(w) - 11)) AS i FROM d) r WHERE d.doc_id = r.id2
), f AS (
  SELECT win, min(doc_id) AS first_id FROM x GROUP BY win
), g AS (
  SELECT DISTINCT x.doc_id, x.i + k.k AS pos FROM x JOIN f USING (win), (SELECT unnest(range(0, 13)) AS k) k WHERE f.first_id < x.doc_id
), r AS (
  SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda p: NOT list_contains(gone, p)), lambda p: w[p]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
