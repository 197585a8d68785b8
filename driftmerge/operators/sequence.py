"""Ordered-sequence merge: runs, document order, union of logs and compaction.

A document is stored as pieces: runs of chained characters with a byte for each that says whether it is deleted, and
deletes as lists of clocks; an unedited text is one row, however long (``pieces`` says what columns they have).
Everything here takes pieces as well as single characters, which are packed where they are read, before anything is
shuffled. Relational, except for document order (a pre-order walk over the tree of origins), runs, merge and
compression, which are Arrow-batched and hold one document at a time.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmerge.operators import columns
from driftmerge.sources.shared import dealt

IDS = ["path", "clock", "peer", "o_clock", "o_peer"]
PIECE = "path string, {order} long, clock long, peer long, o_clock long, o_peer long, text string, n long"


def pieces(rows: DataFrame, order: str) -> DataFrame:
    """Characters packed as they lie, before any shuffle: (path, order, clock, peer, o_clock, o_peer, text, n) and

    ``kind`` and ``clocks`` (of a delete's targets) or ``gone`` ("0" or "1" for each character) where rows have
    ``kind`` or ``deleted``. Only chained rows whose `order` has no gap are packed, so no other row can belong between
    them; deletes stay rows of their own. Rows that don't lie in order are pieces of one character: what is made of
    the pieces is the same. Rows that are pieces already come back as they are.
    """
    if "n" in rows.columns and "text" in rows.columns:
        return rows.select("path", order, *IDS[1:], "text", "n", *(c for c in ("kind", "clocks", "gone") if c in rows.columns))
    extra = [c for c in ("kind", "deleted") if c in rows.columns]
    schema = PIECE.format(order=order) + "".join({"kind": ", kind string, clocks array<long>", "deleted": ", gone string"}[c] for c in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.Table.from_batches([batch])
            at = _numbers(part, order)
            lone = _gone(part) if "kind" in extra else np.zeros(len(at), bool)
            joined = _chain(part, np.ones(len(at), np.int64)) & (at[1:] == at[:-1] + 1) & ~lone[1:] & ~lone[:-1]
            start = np.flatnonzero(np.r_[True, ~joined][: len(at)])
            heads = part.take(pa.array(start))
            cells = [heads.column(c).combine_chunks() for c in ("path", order, *IDS[1:])]
            cells += [_joined(part.column("ch").combine_chunks().fill_null(" "), start), pa.array(np.diff(np.r_[start, len(at)]))]
            if "kind" in extra:
                clocks = pa.ListArray.from_arrays(pa.array(np.arange(len(start) + 1, dtype=np.int32)), pa.array(_numbers(heads, "clock")), mask=pa.array(~lone[start]))
                cells += [heads.column("kind").combine_chunks(), clocks]
            if "deleted" in extra:
                flags = (part.column("deleted").to_numpy().astype(np.uint8) + ord("0")).tobytes().decode()
                cells.append(pa.array([flags[i:j] for i, j in zip(start, np.r_[start[1:], len(at)], strict=True)], pa.string()))
            names = ["path", order, *IDS[1:], "text", "n", *(x for c in extra for x in (["gone"] if c == "deleted" else ["kind", "clocks"]))]
            yield pa.record_batch(cells, names)

    return rows.select("path", order, *IDS[1:], "ch", *extra).mapInArrow(run, schema)


def _numbers(part: pa.Table, name: str) -> np.ndarray:
    """A column of ids as longs; -1, which no clock or writer has, stands for null."""
    return part.column(name).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)


def _gone(part: pa.Table) -> np.ndarray:
    return pc.equal(part.column("kind"), "del").to_numpy()


def _joined(texts: pa.StringArray, start: np.ndarray) -> pa.StringArray:
    """Texts without nulls, joined from each start to the next: the characters stay where they are, with fewer offsets."""
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(edges[np.r_[start, len(texts)]].tobytes()), data)


def _chain(part: pa.Table, n: np.ndarray) -> np.ndarray:
    """For each row but the first: it goes on, in the same path, where the n characters of the one before stopped."""
    clock, peer, o_clock, o_peer = (_numbers(part, c) for c in IDS[1:])
    path = part.column("path").combine_chunks()
    same = ~_turns(path)[1:]
    end = clock[:-1] + n[:-1]
    return same & (peer[1:] == peer[:-1]) & (clock[1:] == end) & (o_clock[1:] == end - 1) & (o_peer[1:] == peer[:-1])


WIRE = "path string, run long, kind string, clock long, peer long, o_clock long, o_peer long, text string, n long, ids array<struct<clock:long,peer:long>>"


def sizes(elems: DataFrame) -> DataFrame:
    """(path, n_raw, n_visible, n_deleted, clock) of elements: counted on pieces, so no character becomes a row."""
    gone = F.length(F.translate("gone", "0", "")).cast("long")
    held = pieces(elems, "pos").select("path", "n", gone.alias("gone"), (F.col("clock") + F.col("n") - 1).alias("last"))
    return held.groupBy("path").agg(F.sum("n").alias("n_raw"), F.sum(F.col("n") - F.col("gone")).alias("n_visible"), F.sum("gone").alias("n_deleted"), F.max("last").alias("clock"))


def op_counts(ops: DataFrame) -> DataFrame:
    """(path, ins, del) of op logs, counted on pieces."""
    part = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0)).cast("long").alias(kind)
    return pieces(ops, "seq").groupBy("path").agg(part("ins"), part("del"))


def compress(ops: DataFrame) -> DataFrame:
    """Wire form of op logs: (path, run, kind, clock, peer, o_clock, o_peer, text, n, ids).

    Neighbouring deletes are one ``dels`` row with their ids; chained inserts one ``run``; others are ``ins``.

    Pieces are packed before the one shuffle and sort; then a pass over Arrow batches holds the last island only.
    Window functions and an aggregate would send every character through two shuffles, two sorts and a list of structs.
    """
    names = ["path", "kind", *IDS[1:], "text", "n", "clocks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, number = None, None, 0
        for batch in batches:
            part = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            start = _breaks(part)
            cut = int(start[-1]) if len(start) else 0  # the last island may go on in the next batch
            held = part.slice(cut)
            if cut:
                done, last, number = _packed(part.slice(0, cut), start[:-1], last, number)
                yield done
        if held is not None and held.num_rows:
            yield _packed(held, np.zeros(1, np.int64), last, number)[0]

    return dealt(pieces(ops, "seq")).sortWithinPartitions("path", "seq").select(*names).mapInArrow(run, WIRE)


def _breaks(part: pa.Table) -> np.ndarray:
    """Pieces at which an island starts."""
    gone = _gone(part)
    path = part.column("path").combine_chunks()
    same = ~_turns(path)[1:]
    chain = _chain(part, _numbers(part, "n")) & ~gone[1:] & ~gone[:-1]
    return np.flatnonzero(np.r_[True, ~(chain | (same & gone[1:] & gone[:-1]))][: len(gone)])


def _packed(part: pa.Table, start: np.ndarray, last: str | None, number: int) -> tuple[pa.RecordBatch, str, int]:
    """A row for each island; runs count on within a path over batches."""
    n = np.add.reduceat(_numbers(part, "n"), start)
    heads = part.take(pa.array(start))
    paths = heads.column("path").to_pylist()
    runs = []
    for p in paths:
        number = number + 1 if p == last else 1
        last = p
        runs.append(number)
    gone = _gone(heads)
    kinds = np.where(gone, "dels", np.where(n > 1, "run", "ins"))
    texts = pc.if_else(pa.array(gone), pa.scalar(None, pa.string()), _joined(part.column("text").combine_chunks(), start))
    targets = part.column("clocks").combine_chunks()
    many = pc.list_value_length(targets).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = pa.StructArray.from_arrays([targets.flatten(), pa.array(np.repeat(_numbers(part, "peer"), many))], ["clock", "peer"])
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)][np.r_[start, part.num_rows]].astype(np.int32)), ids, mask=pa.array(~gone))
    cells = [heads.column("path").combine_chunks(), pa.array(runs, pa.int64()), pa.array(kinds.tolist(), pa.string()), *(heads.column(c).combine_chunks() for c in IDS[1:]), texts, pa.array(n), lists]
    return pa.record_batch(cells, ["path", "run", "kind", "clock", "peer", "o_clock", "o_peer", "text", "n", "ids"]), last, number


def expand(wire: DataFrame) -> DataFrame:
    """Inverse of compress: op rows with seq counted within the path by (run, place)."""
    ins = wire.filter("kind <> 'dels'").select("path", "run", "clock", "peer", "o_clock", "o_peer", F.posexplode(F.filter(F.split("text", ""), lambda c: c != "")).alias("i", "ch"))
    ins = ins.select("path", "run", "i", F.lit("ins").alias("kind"), (F.col("clock") + F.col("i")).alias("clock"), "peer", F.when(F.col("i") == 0, F.col("o_clock")).otherwise(F.col("clock") + F.col("i") - 1).alias("o_clock"), F.when(F.col("i") == 0, F.col("o_peer")).otherwise(F.col("peer")).alias("o_peer"), "ch")
    gone = wire.filter("kind = 'dels'").select("path", "run", F.posexplode("ids").alias("i", "x")).select("path", "run", "i", F.lit("del").alias("kind"), "x.clock", "x.peer", F.lit(None).cast("long").alias("o_clock"), F.lit(None).cast("long").alias("o_peer"), F.lit(None).cast("string").alias("ch"))
    return ins.unionByName(gone)


RUNS = "path string, run long, pos long, clock long, peer long, o_clock long, o_peer long, text string, deleted boolean, n long"


#: Bytes of documents that are worked on at once; a larger document is alone.
AT_ONCE = 1 << 20


def by_document(rows: DataFrame, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """What run() gives for the rows of some whole documents at once, by rising path.

    A group a document would cost a batch, a schema and a call for each, far more than the work on a short one.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one document, whose last rows may not have come
        size = 0
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                path = batch.column("path")
                other = np.flatnonzero(_turns(path)[1:]) + 1
                if held and held[-1].column("path")[-1] != path[0]:
                    other = np.r_[0, other]
                held.append(batch)
                size += batch.nbytes
                if size >= AT_ONCE and len(other):
                    held[-1:] = [batch.slice(0, int(other[-1]))]
                    yield from run(pa.Table.from_batches(held).combine_chunks()).to_batches()
                    held = [batch.slice(int(other[-1]))]
                    size = held[0].nbytes
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return dealt(rows).sortWithinPartitions("path").mapInArrow(each, schema)


def _turns(path: pa.Array) -> np.ndarray:
    """Rows whose path isn't that of the row before; null is a path."""
    a, b = path[1:], path[:-1]
    other = pc.coalesce(pc.not_equal(a, b), pc.not_equal(a.is_null(), b.is_null()))
    return np.r_[True, other.to_numpy(zero_copy_only=False)][: len(path)].astype(bool)


def _documents(part: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The paths of rows that lie by path, each once, and the number of each row's."""
    path = part.column("path").combine_chunks()
    new = _turns(path)
    return path.filter(pa.array(new)), np.cumsum(new) - 1


def adopt(elems: DataFrame) -> DataFrame:
    """Stored runs of elements in document order: (path, run, pos, clock, peer, o_clock, o_peer, text, deleted, n).

    A run goes on while the writer, the chain of origins and liveness do; of rows with the same id the first one counts.
    """

    def run(part: pa.Table) -> pa.Table:
        paths, doc = _documents(part)
        path, pos, clock, peer, o_clock, o_peer, code, gone = _united(part, first=True, doc=doc)
        same = (path[1:] == path[:-1]) & (peer[1:] == peer[:-1]) & (clock[1:] == clock[:-1] + 1) & (o_clock[1:] == clock[:-1]) & (o_peer[1:] == peer[:-1]) & (gone[1:] == gone[:-1])
        start = np.flatnonzero(np.r_[True, ~same][: len(pos)])
        n, text = np.diff(np.r_[start, len(pos)]), code.tobytes().decode("utf-32-le")
        none, of = o_clock[start] < 0, path[start]
        number = np.arange(len(of)) - np.searchsorted(of, of) + 1
        cells = [*map(pa.array, (number, pos[start], clock[start], peer[start])), pa.array(o_clock[start], mask=none), pa.array(o_peer[start], mask=none), pa.array([text[a : a + m] for a, m in zip(start.tolist(), n.tolist(), strict=True)], pa.string()), pa.array(gone[start]), pa.array(n)]
        return pa.table([paths.take(pa.array(of)), *cells], [x.split()[0] for x in RUNS.split(", ")])

    return by_document(pieces(elems, "pos"), run, RUNS)


def visible(runs: DataFrame, *also: str) -> DataFrame:
    """Live runs with the rank of their first character: (path, run, clock, peer, n, start), and other columns of theirs."""
    by = W.partitionBy("path").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return runs.filter("not deleted").select("path", "run", "pos", "clock", "peer", "n", *also, (F.sum("n").over(by) - F.col("n")).alias("start"))


def at_rank(ranks: DataFrame, spans: DataFrame) -> DataFrame:
    """Ids at visible ranks: an as-of join, as a union and one pass per path instead of a range join.

    ranks: (path, rank); spans: from visible(). Ranks beyond the end give null ids.
    """
    both = spans.select("path", F.col("start").alias("at"), F.lit(0).alias("side"), F.struct("start", "n", "clock", "peer").alias("span")).unionByName(ranks.select("path", F.col("rank").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<start:bigint,n:bigint,clock:bigint,peer:bigint>").alias("span")))
    by = W.partitionBy("path").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    held = both.withColumn("span", F.last("span", ignorenulls=True).over(by)).filter("side = 1")
    inside = F.col("at") < F.col("span.start") + F.col("span.n")
    return held.select("path", F.col("at").alias("rank"), F.when(inside, F.col("span.clock") + F.col("at") - F.col("span.start")).alias("clock"), F.when(inside, F.col("span.peer")).alias("peer"))


#: Clocks of a writer whose ids and runs are sorted together, as a power of two.
BUCKET = 16


def _beside(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """Each row of ids (path, clock, peer) as (path, clock, peer, run, inside): the last run of its bucket that starts before it, and whether that holds it.

    A band join, as a union sorted by clock: linear in ids and runs, where a join on path and writer would hold each id against each
    run. Clocks are dealt by ranges; a long run stands in each one that it reaches into. Runs of a writer don't overlap.
    """
    first, last = F.col("clock"), F.col("clock") + F.col("n") - 1
    held = runs.select("path", "peer", F.explode(F.sequence(F.shiftright(first, BUCKET), F.shiftright(last, BUCKET))).alias("bucket"), F.col("clock").alias("at"), F.lit(0).alias("side"), F.struct("clock", "n").alias("run"))
    asked = ids.select("path", "peer", F.shiftright("clock", BUCKET).alias("bucket"), F.col("clock").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<clock:bigint,n:bigint>").alias("run"))
    by = W.partitionBy("path", "peer", "bucket").orderBy("at", "side").rowsBetween(W.unboundedPreceding, 0)
    found = held.unionByName(asked).withColumn("run", F.last("run", ignorenulls=True).over(by)).filter("side = 1")
    return found.select("path", F.col("at").alias("clock"), "peer", "run", F.coalesce(F.col("at") < F.col("run.clock") + F.col("run.n"), F.lit(False)).alias("inside"))


def held(of: np.ndarray, start: np.ndarray, n: np.ndarray, asked_of: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each asked number whether one of the runs of `n` from `start` on, of the same group (a row of longs), holds it. Runs may overlap."""
    if not len(start) or not len(asked):
        return np.zeros(len(asked), bool)
    both = np.concatenate([of, asked_of])
    by = np.lexsort(both.T)
    group = np.zeros(len(both), np.int64)
    group[by[1:]] = np.cumsum((both[by[1:]] != both[by[:-1]]).any(axis=1))
    points, rank = np.unique(np.concatenate([start, start + n, asked]), return_inverse=True)
    k, wide = len(start), len(points) + 1
    first, end, want = group[:k] * wide + rank[:k], group[:k] * wide + rank[k : 2 * k], group[k:] * wide + rank[2 * k :]
    order = np.argsort(first)
    # Groups lie apart, so what ends last before a number is of its group or ends before it.
    last = np.r_[-1, np.maximum.accumulate(end[order])]
    return last[np.searchsorted(first[order], want, side="right")] > want


def locate(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """The run and offset that hold each id (path, clock, peer); runs of a writer don't overlap."""
    return _beside(ids, runs).filter("inside").select("path", "clock", "peer", F.col("run.clock").alias("run_clock"), (F.col("clock") - F.col("run.clock")).alias("offset"))


def outside(ids: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of ids (path, clock, peer) that no run (path, clock, peer, n) holds; repeated ones stay repeated."""
    return _beside(ids, runs).filter("not inside").select("path", "clock", "peer")


def blocked_runs(ops: DataFrame) -> DataFrame:
    """(path, clock, peer): the ids that runs hang on, or deletes name, and that no run holds; ops are pieces whose inserts don't overlap.

    A run asks for the origin of its first character alone, so only deletes cost a row a character.
    """
    ins = ops.filter("kind = 'ins'")
    origins = ins.filter("o_clock is not null").select("path", F.col("o_clock").alias("clock"), F.col("o_peer").alias("peer"))
    targets_ = ops.filter("kind = 'del'").select("path", F.explode("clocks").alias("clock"), "peer")
    return outside(origins.unionByName(targets_), ins.select("path", "clock", "peer", "n"))


def fresh(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Ops that are new: each once, and none that is known."""
    key = ["path", "kind", "clock", "peer"]
    return incoming.dropDuplicates(key).join(known.select(*key), key, "left_anti")


FRESH = "path string, kind string, clock long, peer long, o_clock long, o_peer long, text string, n long, clocks array<long>"


def fresh_runs(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """What ``fresh`` gives, of pieces and as pieces: cut to what is new, each id once, the first by `seq` that has it.

    No character becomes a row, and of what is known only ids are shuffled. A task holds one document.
    """
    names = [c.split()[0] for c in FRESH.split(", ")]

    def run(part: pa.Table) -> pa.Table:
        path, held, out = part.column("path")[0].as_py(), defaultdict(list), []
        for row in part.sort_by([("side", "ascending"), ("seq", "ascending")]).to_pylist():
            ids = np.array(row["clocks"], np.int64) if row["kind"] == "del" else np.arange(row["clock"], row["clock"] + row["n"])
            held[row["kind"], row["peer"]].append((row, ids))
        for (kind, peer), rows in held.items():
            ids = np.concatenate([x for _, x in rows])
            new = np.zeros(len(ids), bool)
            new[np.unique(ids, return_index=True)[1]] = True  # those known come first
            at = 0
            for row, own in rows:
                mask, at = new[at : at + len(own)], at + len(own)
                if row["side"] == 0 or not mask.any():
                    continue
                if kind == "del":
                    kept = own[mask].tolist()
                    out.append((path, kind, kept[0], peer, None, None, "", len(kept), kept))
                    continue
                edges = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).tolist()
                for i, j in zip(edges[::2], edges[1::2], strict=True):
                    clock = row["clock"] + i
                    origin = (row["o_clock"], row["o_peer"]) if i == 0 else (clock - 1, peer)
                    out.append((path, kind, clock, peer, *origin, row["text"][i:j], j - i, None))
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.int64(), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)

    sided = [pieces(rows, "seq").withColumn("side", F.lit(side)) for side, rows in ((0, known), (1, incoming))]
    sided[0] = sided[0].withColumn("text", F.lit(""))
    return dealt(sided[0].unionByName(sided[1])).groupBy("path").applyInArrow(run, FRESH)


def blocked(ops: DataFrame, known: DataFrame) -> DataFrame:
    """Inserts whose origin, and deletes whose target, is neither known nor among the ops."""
    there = ops.filter("kind = 'ins'").select("path", "clock", "peer").union(known.filter("kind = 'ins'").select("path", "clock", "peer")).distinct()
    need = ops.withColumn("n_clock", F.when(F.col("kind") == "del", F.col("clock")).otherwise(F.col("o_clock"))).withColumn("n_peer", F.when(F.col("kind") == "del", F.col("peer")).otherwise(F.col("o_peer"))).filter("n_clock is not null")
    gone = there.select("path", F.col("clock").alias("n_clock"), F.col("peer").alias("n_peer"))
    return need.join(gone, ["path", "n_clock", "n_peer"], "left_anti").drop("n_clock", "n_peer")


MERGED = ["path", "pos", "clock", "peer", "o_clock", "o_peer", "ch", "deleted"]


def _united(part: pa.Table, first: bool = False, doc: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Pieces as arrays (document, pos, clock, peer, o_clock, o_peer, code point, deleted), each id once, by document and pos; `doc` numbers each row's document.

    An element is deleted if any of its rows says so or, with `first`, if the first one does.
    """
    n = _numbers(part, "n")
    base = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(base)) - np.repeat(np.cumsum(n) - n, n)
    doc = np.zeros(len(n), np.int64) if doc is None else doc
    path = doc[base]
    pos, clock, peer, o_clock, o_peer = (_numbers(part, c)[base] for c in ("pos", *IDS[1:]))
    pos, clock = pos + off, clock + off
    o_clock, o_peer = np.where(off > 0, clock - 1, o_clock), np.where(off > 0, peer, o_peer)
    code = np.frombuffer("".join(part.column("text").to_pylist()).encode("utf-32-le"), np.uint32)
    gone = np.frombuffer("".join(part.column("gone").to_pylist()).encode(), np.uint8) & 1
    if (np.diff(doc) > 0).all():  # the ids of one piece differ, and stand in order
        return path, pos, clock, peer, o_clock, o_peer, code, gone.astype(bool)
    by_id = np.lexsort((pos, peer, clock, path))
    at = np.flatnonzero(np.r_[True, (np.diff(path[by_id]) != 0) | (np.diff(clock[by_id]) != 0) | (np.diff(peer[by_id]) != 0)])
    gone = (gone[by_id][at] if first else np.maximum.reduceat(gone[by_id], at)).astype(bool)
    kept = by_id[at]
    order = np.lexsort((peer[kept], clock[kept], pos[kept], path[kept]))
    return *(x[kept][order] for x in (path, pos, clock, peer, o_clock, o_peer, code)), gone[order]


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union of two replicas' elements: an element is deleted if it is in either; commutative and idempotent.

    Pieces are what is shuffled. A task holds one document at a time.
    """

    def run(part: pa.Table) -> pa.Table:
        paths, doc = _documents(part)
        path, pos, clock, peer, o_clock, o_peer, code, gone = _united(part, doc=doc)
        none = o_clock < 0
        cells = [paths.take(pa.array(path)), *map(pa.array, (pos, clock, peer)), pa.array(o_clock, mask=none), pa.array(o_peer, mask=none), pa.array(list(code.tobytes().decode("utf-32-le")), pa.string()), pa.array(gone)]
        return pa.table(cells, MERGED)

    return by_document(_both(a, b), run, "path string, pos long, clock long, peer long, o_clock long, o_peer long, ch string, deleted boolean")


def merged_text(a: DataFrame, b: DataFrame) -> DataFrame:
    """(path, text, n_raw, n_deleted) of the merge of two replicas, without making its rows."""

    def run(part: pa.Table) -> pa.Table:
        paths, doc = _documents(part)
        path, *_, code, gone = _united(part, doc=doc)
        raw, dead = (np.bincount(x, minlength=len(paths)) for x in (path, path[gone]))
        text, edges = code[~gone].tobytes().decode("utf-32-le"), np.r_[0, np.cumsum(raw - dead)].tolist()
        return pa.table([paths, pa.array([text[i:j] for i, j in zip(edges, edges[1:], strict=False)], pa.string()), pa.array(raw), pa.array(dead)], ["path", "text", "n_raw", "n_deleted"])

    return by_document(_both(a, b), run, "path string, text string, n_raw long, n_deleted long")


def _both(a: DataFrame, b: DataFrame) -> DataFrame:
    return pieces(a, "pos").unionByName(pieces(b, "pos"))


def compact_runs(runs: DataFrame) -> DataFrame:
    """Live runs of adopt(), renumbered from 1 as parts of one writer's run: (path, old_clock, old_peer, clock, n, text)."""
    return visible(runs, "text").select("path", F.col("clock").alias("old_clock"), F.col("peer").alias("old_peer"), (F.col("start") + 1).alias("clock"), "n", "text")


def live_text(elems: DataFrame) -> DataFrame:
    """(path, text) of the live elements by pos."""
    return elems.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("deleted"), F.struct("pos", "ch")))), lambda x: x["ch"]), "").alias("text"))


def compact(elems: DataFrame) -> DataFrame:
    """Only live elements, renumbered from 1 as one run of one writer."""
    by = W.partitionBy("path").orderBy("pos")
    new = F.row_number().over(by).cast("long")
    return elems.filter("not deleted").select("path", "pos", F.col("clock").alias("old_clock"), new.alias("clock"), F.lit(0).cast("long").alias("peer"), F.when(new > 1, new - 1).alias("o_clock"), "ch")


def ordered_pieces(runs: list[tuple]) -> list[tuple[int, int, str]]:
    """What ordered_runs gives, without origins."""
    return [(clock, peer, text) for clock, peer, _, text in ordered_runs(runs)]


def ordered_runs(runs: list[tuple]) -> list[tuple[int, int, tuple[int, int] | None, str]]:
    """Document order of inserts given as runs (clock, peer, o_clock, o_peer, text): (clock, peer, origin, text) pieces.

    The order is the pre-order walk of the tree of origins with siblings by falling (clock, peer). Runs are cut where
    another run hangs on one of their inner characters, so a document of a few runs has a few nodes, however long.
    Runs whose origin never came are left out, as they wait for it. Repeated and overlapping runs count once.
    """
    chains: list[tuple[int, int, tuple | None, str]] = []
    last_peer, covered = None, 0
    for clock, peer, o_clock, o_peer, text in sorted(runs, key=lambda r: (r[1], r[0], -len(r[4]))):
        # By rising clocks, what a writer's earlier runs cover has no gap between this run's start and the furthest end.
        start = max(clock, covered) if peer == last_peer else clock
        if start < clock + len(text):
            origin = (None if o_clock is None else (o_clock, o_peer)) if start == clock else (start - 1, peer)
            chains.append((start, peer, origin, text[start - clock :]))
            last_peer, covered = peer, clock + len(text)
    # Each writer's starts and ends, sorted and apart: the run that holds an id is found by bisection.
    starts, ends = defaultdict(list), defaultdict(list)
    for clock, peer, _, text in chains:
        starts[peer].append(clock)
        ends[peer].append(clock + len(text))
    cuts: dict[tuple[int, int], set[int]] = defaultdict(set)
    for _, _, origin, _ in chains:
        if origin and origin[1] in starts:
            k = bisect.bisect_right(starts[origin[1]], origin[0]) - 1
            if k >= 0 and origin[0] < ends[origin[1]][k] - 1:
                cuts[(starts[origin[1]][k], origin[1])].add(origin[0] + 1)
    children: dict[tuple | None, list[tuple[int, int, tuple | None, str]]] = defaultdict(list)
    for clock, peer, origin, text in chains:
        edges = [clock, *sorted(cuts[(clock, peer)]), clock + len(text)]
        for a, z in zip(edges, edges[1:], strict=False):
            above = origin if a == clock else (a - 1, peer)
            children[above].append((a, peer, above, text[a - clock : z - clock]))
    by_id = lambda x: x[:2]
    out, stack = [], sorted(children[None], key=by_id)
    while stack:
        one = stack.pop()
        out.append(one)
        stack += sorted(children.get((one[0] + len(one[3]) - 1, one[1]), ()), key=by_id)
    return out


def document_text(ops: DataFrame) -> DataFrame:
    """(path, text, n_raw, n_deleted): each path's op log replayed to its text, in any order of arrival.

    Ops are run-compressed before the shuffle by path, so a group is some rows, and its deletes are one list.
    """
    return _replayed(compress(ops).select("path", "kind", "clock", "peer", "o_clock", "o_peer", "text", "ids"))


def _replayed(wire: DataFrame) -> DataFrame:
    def replay(part: pa.Table) -> pa.Table:
        paths, doc = _documents(part)
        cells = {c: part.column(c).combine_chunks() for c in ("kind", *IDS[1:], "text", "ids")}
        # A list of deletes may name several writers: an op for each.
        ids = cells["ids"]
        many = pc.list_value_length(ids).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        gone = np.repeat(doc, many)
        clock, peer = (x.to_numpy(zero_copy_only=False) for x in ids.flatten().flatten())
        new = np.flatnonzero(np.r_[True, (np.diff(gone) != 0) | (np.diff(peer) != 0)][: len(gone)])
        dels = pa.ListArray.from_arrays(pa.array(np.r_[new, len(gone)].astype(np.int32)), pa.array(clock, pa.int64()))
        ins = pc.not_equal(cells["kind"], "dels")
        d_doc, m = np.r_[doc[ins.to_numpy(zero_copy_only=False)], gone[new]], len(new)
        own = {c: cells[c].filter(ins) for c in (*IDS[1:], "text")}
        none = pa.nulls(m, pa.int64())
        fields = {
            "kind": pa.array(["ins"] * (len(d_doc) - m) + ["del"] * m, pa.string()), "clock": pa.concat_arrays([own["clock"], none]), "peer": pa.concat_arrays([own["peer"], pa.array(peer[new], pa.int64())]),
            "o_clock": pa.concat_arrays([own["o_clock"], none]), "o_peer": pa.concat_arrays([own["o_peer"], none]), "text": pa.concat_arrays([own["text"], pa.array([""] * m, pa.string())]), "clocks": pa.concat_arrays([pa.nulls(len(d_doc) - m, dels.type), dels]),
        }
        by = pa.array(np.argsort(d_doc, kind="stable"))
        ops = pa.StructArray.from_arrays([fields[f.name].take(by) for f in columns.OP.value_type], fields=list(columns.OP.value_type))
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.sort(d_doc), np.arange(len(paths) + 1)).astype(np.int32)), ops)
        runs = pa.array([[]] * len(paths), columns.RUN)
        text, raw, dead = columns.live(columns.apply(runs, lists)[0])
        return pa.table([paths, text, raw, dead], ["path", "text", "n_raw", "n_deleted"])

    return by_document(wire, replay, "path string, text string, n_raw long, n_deleted long")
