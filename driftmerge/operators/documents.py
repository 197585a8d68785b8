"""Documents of a replica and what happens to them: local edits, ops and snapshots of others, compaction.

A document is a row (path, base, runs): its lineage and its pieces in document order (see ``sequence``). Ops travel as
pieces too. Every operator joins on path, so a hot path is one document, never a group; the Arrow-batched functions
work on the columns of some documents at once (``columns``). Null texts are empty ones; a path without a row is an unknown document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.functions import scalars
from driftmerge.operators import columns, reconcile
from driftmerge.sources.shared import dealt, materialize, release

RUNS = "array<struct<clock:long,peer:long,o_clock:long,o_peer:long,text:string,gone:string>>"
OPS = "array<struct<kind:string,clock:long,peer:long,o_clock:long,o_peer:long,text:string,clocks:array<long>>>"
_RUN, _OP = columns.RUN, columns.OP
Runs = list[dict]
Ops = list[dict]


def from_text(docs: DataFrame) -> DataFrame:
    """(path, base, runs) of new texts (path, text): one run, whose writer is the lineage, so equal texts share it."""
    base = scalars.lineage(F.col("path"), F.col("text"))
    none = F.lit(None).cast("long")
    one = F.array(F.struct(F.lit(1).cast("long").alias("clock"), F.col("base").alias("peer"), none.alias("o_clock"), none.alias("o_peer"), F.col("text"), F.repeat(F.lit("0"), F.char_length("text")).alias("gone")))
    plain = docs.select("path", F.coalesce("text", F.lit("")).alias("text")).select("path", base.alias("base"), "text")
    return plain.select("path", "base", F.when(F.col("text") == "", F.array().cast(RUNS)).otherwise(one).alias("runs"))


def live_text(runs: Runs) -> str:
    return "".join(r["text"] if "1" not in r["gone"] else "".join(c for c, g in zip(r["text"], r["gone"], strict=True) if g == "0") for r in runs)


def detect(runs: Runs, new: str, peer: int) -> Ops:
    """Ops that turn a document's live text into a new one: ids go on from its last clock, deletes mint none."""
    return _cells(columns.detect(pa.array([runs], _RUN), pa.array([new], pa.string()), peer))[0]


def _gone(runs: Runs) -> dict[int, list[np.ndarray]]:
    out: dict[int, list[np.ndarray]] = {}
    for r in runs:
        if "1" in r["gone"]:
            out.setdefault(r["peer"], []).append(r["clock"] + np.flatnonzero(np.frombuffer(r["gone"].encode(), np.uint8) == ord("1")))
    return out


def apply(runs: Runs, ops: Ops) -> tuple[Runs, int, int, int]:
    """The document after ops, in any order and repeated: (runs, inserted, deleted, waiting characters)."""
    return tuple(_cells(x)[0] for x in columns.apply(pa.array([runs], _RUN), pa.array([ops], _OP)))


def merge(a: Runs, b: Runs) -> Runs:
    """The union of two replicas of one lineage: commutative and idempotent."""
    deletes = [{"kind": "del", "peer": p, "clocks": np.concatenate(x).tolist(), "text": ""} for p, x in _gone(b).items()]
    return apply(a, [*({**r, "kind": "ins"} for r in b), *deletes])[0]


#: Documents that are Python objects at once.
AT_ONCE = 32


def _cells(column: pa.Array) -> list:
    """What column.to_pylist() gives, made field by field: rows of runs and ops are many, and each would be a few scalars."""
    kind = column.type
    if pa.types.is_list(kind):
        many = pc.list_value_length(column)
        edges = np.r_[0, np.cumsum(many.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))].tolist()
        inner = _cells(column.flatten())
        out = [inner[i:j] for i, j in zip(edges, edges[1:], strict=False)]
    elif pa.types.is_struct(kind):
        names = [kind.field(i).name for i in range(kind.num_fields)]
        out = [dict(zip(names, x, strict=True)) for x in zip(*(_cells(f) for f in column.flatten()), strict=True)]
    elif pa.types.is_integer(kind):
        out = column.fill_null(0).to_numpy(zero_copy_only=False).tolist()
    elif pa.types.is_string(kind):
        return column.to_numpy(zero_copy_only=False).tolist()
    else:
        return column.to_pylist()
    if column.null_count:
        for i in np.flatnonzero(column.is_null().to_numpy(zero_copy_only=False)).tolist():
            out[i] = None
    return out


def _mapped(rows: DataFrame, columns: list[str], make: Callable[..., tuple], out: list[tuple[str, str, pa.DataType]], keep: list[str]) -> DataFrame:
    """Rows of `keep` and what make(*columns) gives for each row, as objects; `out` says names and types. Runs and ops of many documents are ``_columned``."""
    names = [n for n, _, _ in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                made = [make(*x) for x in zip(*(_cells(batch.column(c)) for c in columns), strict=True)]
                cells = [pa.array(c, t) for c, (_, _, t) in zip(zip(*made, strict=True), out, strict=True)]
                yield pa.record_batch([*(batch.column(k) for k in keep), *cells], [*keep, *names])

    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema), *(f"{n} {t}" for n, t, _ in out)])
    return rows.select(*dict.fromkeys([*keep, *columns])).mapInArrow(run, kinds)


def _columned(rows: DataFrame, cells: list[str], make: Callable[..., list[pa.Array]], out: list[tuple[str, str]], keep: list[str]) -> DataFrame:
    """Rows of `keep` and the columns that make(*cells) gives for some rows at once; `out` says names and types."""
    names = [n for n, _ in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in columns.parts(whole):
                yield pa.record_batch([*(batch.column(k) for k in keep), *make(*(batch.column(c) for c in cells))], [*keep, *names])

    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keep).schema), *(f"{n} {t}" for n, t in out)])
    return rows.select(*dict.fromkeys([*keep, *cells])).mapInArrow(run, kinds)


def texts(state: DataFrame) -> DataFrame:
    """(path, base, text, n_raw, n_deleted) of documents."""
    return _columned(state, ["runs"], columns.live, [("text", "string"), ("n_raw", "long"), ("n_deleted", "long")], ["path", "base"])


def manifest(state: DataFrame) -> DataFrame:
    """Digest rows (path, hash, base, tombstones)."""
    return texts(state).select("path", F.sha2("text", 256).alias("hash"), "base", F.col("n_deleted").alias("tombstones"))


def detected(state: DataFrame, new: DataFrame, peer: int) -> DataFrame:
    """(path, base, ops) of the known documents whose new text (path, text) differs: equal texts give no row."""
    both = dealt(state.select("path", "base", "runs")).join(dealt(new.select("path", F.coalesce("text", F.lit("")).alias("new"))), "path")
    return _columned(both, ["runs", "new"], lambda runs, text: [columns.detect(runs, text, peer)], [("ops", OPS)], ["path", "base"]).filter("size(ops) > 0")


APPLIED = [("runs", RUNS), ("inserted", "long"), ("deleted", "long"), ("waiting", "long")]


def applied(state: DataFrame, ops: DataFrame) -> DataFrame:
    """All documents after others' ops (path, base, ops): state and (dropped, inserted, deleted, waiting).

    Ops of another lineage are dropped: snapshots bring the lineages together first. An unknown path becomes an empty
    document of the ops' (lowest) lineage. `waiting` characters hang on others that never came. Only documents with
    inserted or deleted characters have something to write and to pass on.
    """
    known = state.select("path", "base", "runs")
    fresh = ops.join(known.select("path"), "path", "left_anti").groupBy("path").agg(F.min("base").alias("base")).select("path", "base", F.array().cast(RUNS).alias("runs"))
    everything = known.unionByName(fresh)
    mine = everything.select("path", "base").join(ops.withColumnRenamed("base", "o_base"), "path")
    sent = mine.groupBy("path").agg(F.flatten(F.collect_list(F.when(F.col("base") == F.col("o_base"), F.col("ops")))).alias("ops"), F.count_if(F.col("base") != F.col("o_base")).alias("dropped"))
    both = dealt(everything).join(dealt(sent), "path", "left").withColumn("dropped", F.coalesce("dropped", F.lit(0).cast("long")))
    touched = both.filter("size(ops) > 0")
    same = both.filter("coalesce(size(ops), -1) <= 0").select("path", "base", "dropped", "runs", *(F.lit(0).cast("long").alias(c) for c in ("inserted", "deleted", "waiting")))
    return _columned(touched, ["runs", "ops"], columns.apply, APPLIED, ["path", "base", "dropped"]).unionByName(same)


def absorbed(state: DataFrame, disk: DataFrame, own_writes: DataFrame, peer: int) -> DataFrame:
    """Ops (path, base, ops) for edits on disk (path, content) that nobody has noticed, to be applied before others' changes.

    What we wrote ourselves (path, hash), binary contents and unknown paths are no edits; bytes that aren't UTF-8 are
    read as the replacement character.
    """
    text = disk.filter(~scalars.is_binary(F.col("content"))).select("path", scalars.lossy_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("hash"))
    return detected(state, reconcile.unwritten(text, own_writes), peer)


def received_ops(state: DataFrame, ops: DataFrame, disk: DataFrame, own_writes: DataFrame, peer: int) -> DataFrame:
    """What ``applied`` gives, with local edits absorbed first."""
    touched = state.join(ops.select("path").distinct(), "path", "left_semi")
    local = materialize(absorbed(touched, disk, own_writes, peer), "edits")
    before = materialize(applied(state, local).select("path", "base", "runs"), "documents")
    release(local)
    return applied(before, ops)


def received_snapshots(local: DataFrame, remote: DataFrame, local_peer: int, remote_peer: int) -> DataFrame:
    """Remote documents (path, base, runs, mtime) taken into ours: (path, outcome, base, runs, ops, relay, conflict, conflict_text).

    Unknown ones are adopted; those of our lineage merged. Of two lineages the lower base stays. Ours lower: nothing
    changes. Theirs lower: their document is adopted; if the texts differ, the larger (mtime, peer) has the content:
    ours becomes edits on their history (`ops`, for all others), or theirs stays and ours goes to a conflict copy.
    `relay` says that others must hear of it.
    """
    text = lambda side: texts(side).select("path", F.sha2("text", 256).alias("hash"), "base")
    outcome = reconcile.snapshot_outcome(text(remote).join(remote.select("path", "mtime"), "path"), text(local).join(local.select("path", "mtime"), "path"), remote_peer, local_peer)
    both = dealt(outcome).join(remote.select("path", F.col("base").alias("r_base"), F.col("runs").alias("r_runs")), "path").join(local.select("path", F.col("base").alias("l_base"), F.col("runs").alias("l_runs")), "path", "left")

    def make(outcome: pa.Array, theirs: pa.Array, ours: pa.Array) -> list[pa.Array]:
        what = np.array(outcome.to_pylist(), object)
        at = lambda *kinds: np.flatnonzero(np.isin(what, kinds))
        of = lambda column, rows: column.take(pa.array(rows))
        runs, ops, lost, relay = [], [], [], np.isin(what, ("adopt", "rebase", "conflict"))
        if len(rows := at("merge")):
            one = columns.apply(of(ours, rows), columns.as_ops(of(theirs, rows)))[0]
            relay[rows] = [x != y for x, y in zip(columns.live(one)[0].to_pylist(), columns.live(of(ours, rows))[0].to_pylist(), strict=True)]
            runs.append((rows, one))
        if len(rows := at("rebase")):
            sent = columns.detect(of(theirs, rows), columns.live(of(ours, rows))[0], local_peer)
            runs.append((rows, columns.apply(of(theirs, rows), sent)[0]))
            ops.append((rows, sent))
        if len(rows := at("conflict")):
            lost.append((rows, columns.live(of(ours, rows))[0]))
        runs += [(rows, of(side, rows)) for rows, side in ((at("ignore"), ours), (np.flatnonzero(~np.isin(what, ("merge", "rebase", "ignore"))), theirs))]
        return [_placed(runs, len(what), _RUN), _placed(ops, len(what), _OP), pa.array(relay), _placed(lost, len(what), pa.string())]

    base = F.when(F.col("outcome").isin("ignore", "merge"), F.col("l_base")).otherwise(F.col("r_base"))
    rows = both.withColumn("base", base)
    out = [("runs", RUNS), ("ops", OPS), ("relay", "boolean"), ("conflict_text", "string")]
    return _columned(rows, ["outcome", "r_runs", "l_runs"], make, out, ["path", "outcome", "base", "conflict"])


def _placed(parts: list[tuple[np.ndarray, pa.Array]], n: int, kind: pa.DataType) -> pa.Array:
    """A column of n cells from some rows' cells each; the rows that none names are null."""
    to = np.full(n, -1)
    at = 0
    for rows, _ in parts:
        to[rows] = np.arange(at, at + len(rows))
        at += len(rows)
    cells = pa.concat_arrays([x.cast(kind) for _, x in parts]) if parts else pa.array([], kind)
    return cells.take(pa.array(to, mask=to < 0))


def compacted(state: DataFrame, reports: DataFrame, live: DataFrame, known: DataFrame, peer: int, least: int) -> DataFrame:
    """One round of compaction: checkpoints (path, base, runs, text_hash, n_before, n_after) for what may be compacted.

    Only the lowest live peer does it, and only while every known peer is live. Documents with at least `least`
    tombstones that are at least half of them, and whose (hash, base) every live peer reports, become their live text
    alone, in the lineage of that text; those that have it already are left. Peers are (peer), reports are
    (peer, path, hash, base).
    """
    # One row: may this peer compact now?
    leader = live.agg((F.coalesce(F.min("peer"), F.lit(-1)) > peer).alias("leads"))
    absent = reconcile.absent(known, live).agg((F.count("*") == 0).alias("whole"))
    # Read three times below.
    wanted = materialize(reconcile.compaction(texts(state), least).select("path", "base", F.sha2("text", 256).alias("hash"), "text", "n_raw"), "wanted")
    agreed = reconcile.unanimous(wanted.select("path", "hash", "base"), reports, live)
    new = from_text(wanted.select("path", "text"))
    return (
        wanted.join(agreed.select("path"), "path", "left_semi").join(new.select("path", F.col("base").alias("new_base"), "runs"), "path").filter("new_base <> base")
        .join(F.broadcast(leader), F.col("leads")).join(F.broadcast(absent), F.col("whole"))  # one row each
        .select("path", F.col("new_base").alias("base"), "runs", F.col("hash").alias("text_hash"), F.col("n_raw").alias("n_before"), F.char_length("text").cast("long").alias("n_after"))
    )


def changed(state: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State after others' deletes and renames (seq, kind "delete" or "rename", path, target), and the changes to pass on.

    Of several changes of a path in one batch the last counts. A rename replaces what is at its target. Only changes
    of known paths are passed on: so they end, where peers are linked in rings.
    """
    last = changes.groupBy("path").agg(F.max_by(F.struct("kind", "target"), "seq").alias("x")).select("path", "x.kind", "x.target")
    relayed = last.join(state.select("path").distinct(), "path", "left_semi")
    moved = state.join(relayed.filter("kind = 'rename'").select("path", "target"), "path").drop("path").withColumnRenamed("target", "path").select(*state.columns)
    gone = relayed.select("path").union(moved.select("path")).distinct()
    return state.join(gone, "path", "left_anti").unionByName(moved), relayed


def forwards(messages: DataFrame, links: DataFrame, most_bytes: int) -> DataFrame:
    """Where messages (peer, sender, bytes) go on: each link (src, dst) of a peer once, not back, not to itself; too large ones nowhere."""
    ways = links.filter("src <> dst").dropDuplicates(["src", "dst"])
    own = messages.filter(F.col("bytes") <= most_bytes)
    return own.join(ways, own.peer == ways.src).filter("dst <> sender").drop("src")


def conflict_copies(outcomes: DataFrame) -> DataFrame:
    """The files (path, text) that lost and are kept under another name."""
    return outcomes.filter("conflict is not null").select(F.col("conflict").alias("path"), F.col("conflict_text").alias("text"))
