import glob
import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from driftmerge.config import Settings
from driftmerge.operators import blocks, codec, sequence
from driftmerge.plans import files
from driftmerge.sources import replicas as R
from driftmerge.sources import tables
from driftmerge.streaming import streams

OPS = "path string, kind string, clock long, peer long, o_clock long, o_peer long, text string, clocks array<long>"


def batches(spark, path, parts, schema):
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k}")
        for f in glob.glob(f"{path}/{k}/*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    return streams.source(spark, f"{path}/*", schema, files_per_batch=1)


def history(rng):
    """Runs of several writers, each hanging on a character that there was, and deletes; some are lost, some come twice."""
    ids, runs = [], []
    for k in range(60):
        clock = max((c for c, _ in ids), default=0) + 1 + rng.randrange(3)
        peer, text = rng.randrange(1, 4), "".join(rng.choices("abcde€", k=rng.randrange(1, 6)))
        origin = rng.choice(ids) if ids and k else (None, None)
        runs.append(("ins", clock, peer, *origin, text, None))
        ids += [(clock + i, peer) for i in range(len(text))]
    for _ in range(30):
        peer = rng.randrange(1, 4)
        runs.append(("del", None, peer, None, None, None, [c for c, p in rng.sample(ids, 5) if p == peer]))
    kept = [r for r in runs if rng.random() < 0.9]
    kept += rng.sample(kept, 10)
    rng.shuffle(kept)
    return kept


def settled(ops):
    """Placed and deleted ids by going over all ops until nothing changes, and how many runs and deletes hang on what isn't there."""
    placed, came = {}, {}
    for _, clock, peer, o_clock, o_peer, text, _ in (o for o in ops if o[0] == "ins"):
        for i, c in enumerate(text):
            came[clock + i, peer] = (c, (None if o_clock is None else (o_clock, o_peer)) if i == 0 else (clock + i - 1, peer))
    while True:
        new = {i: c for i, (c, o) in came.items() if i not in placed and (o is None or o in placed)}
        if not new:
            break
        placed |= new
    gone = {(c, o[2]) for o in ops if o[0] == "del" for c in o[6]}
    blocked = len({(o[1], o[2], o[5]) for o in ops if o[0] == "ins" and o[3] is not None and (o[3], o[4]) not in came}) + len(gone - came.keys())
    return placed, gone & placed.keys(), blocked


def test_causal_runs_equal_brute_force(spark, tmp_path):
    rng = random.Random(8)
    ops = {f"p{k}": history(rng) for k in range(6)}
    rows = [(p, *o) for p, x in ops.items() for o in x]
    rng.shuffle(rows)
    stream = streams.causal_runs(batches(spark, f"{tmp_path}/in", [rows[k::4] for k in range(4)], OPS))
    stream._rest = lambda state: streams.still_blocked(state).select("path", F.lit("blocked").alias("kind"), F.col("n").alias("clock"), F.lit(None).cast("long").alias("peer"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<long>").alias("clocks"))
    placed, gone, blocked = {p: {} for p in ops}, {p: [] for p in ops}, dict.fromkeys(ops, 0)
    for r in streams.drained(stream).collect():
        if r.kind == "blocked":
            blocked[r.path] = r.clock
        elif r.kind == "ins":
            for i, c in enumerate(r.text):
                assert (r.clock + i, r.peer) not in placed[r.path]
                placed[r.path][r.clock + i, r.peer] = c
        else:
            gone[r.path] += [(c, r.peer) for c in r.clocks]
    for p, x in ops.items():
        want = settled(x)
        assert placed[p] == want[0] and sorted(gone[p]) == sorted(want[1]) and blocked[p] == want[2], p


class Memory(dict):
    """A map state in memory that counts what is read and written."""

    reads = writes = 0

    def containsKey(self, key):  # noqa: N802
        return key in self

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        self.writes += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        del self[key]


def test_what_waits_for_one_origin_is_not_rewritten_for_each_waiter():
    entries, many = Memory(), Memory()
    for k in range(50):  # batches
        w = streams.Waiting(entries, many)
        for i in range(20):
            w.add((5, 1), [100 + 20 * k + i, 2, "x"])
            w.add((9000, 1), [100 + 20 * k + i, 3, "y"])
        w.save()
    assert entries.writes == 100 and entries.reads == 0 and max(len(v[0]) for v in entries.values()) < 600
    w = streams.Waiting(entries, many)
    assert sorted(w.take(5, 1)) == [[100 + i, 2, "x"] for i in range(1000)] and w.take(6, 1) == []
    w.save()
    assert len(json.loads(entries[1, 2, 0][0])) == 20 and len(entries) == 50 and dict(many) == {(1, 2): (50,)}


def test_messages_are_the_log_without_what_is_lost(spark):
    text = "The quick brown fox é🌍 jumps over the lazy dog. "
    docs = spark.createDataFrame([(f"p{k}", k, text[: k * 3]) for k in range(16)] + [("q", 40, text * 400), ("n", 41, None)], "path string, doc_id long, text string")
    for lost, of in (("clock % 11 = 5", lambda c: c % 11 == 5), ("clock < 3", lambda c: c < 3), ("clock % 2 = 0", lambda c: c % 2 == 0), ("false", lambda c: c < 0)):
        want, gone, got, dead = set(), set(), set(), set()
        for r in R.without(R.op_runs(docs), lost).collect():
            if r.kind == "del":
                gone |= {(r.path, r.peer, c) for c in r.clocks}
            else:
                want.add((r.path, r.clock, r.peer, r.o_clock, r.o_peer, r.text))
        for kind in ("ins", "del"):
            for r in R.messages(docs, kind, of).collect():
                ids, body, at = codec.unpack_longs(r.ids, 5), codec.unpack_text(r.text), 0
                for clock, peer, o_clock, o_peer, n in ids.T.tolist():
                    got.add((r.path, clock, peer, *((None, None) if o_clock < 0 else (o_clock, o_peer)), body[at : at + n]))
                    at += n
                assert at == len(body)
                dead |= {(r.path, *x) for x in codec.unpack_longs(r.dead, 2).T.tolist()}
        assert got == want and dead == gone


def test_a_stream_of_messages_gives_what_one_of_runs_gives(spark, tmp_path):
    """Deletes first, then inserts in two parts, the later ones first; the log's files are many, the batches few. What waits is an entry a bucket, not a call a run."""
    text = "some words that stand in a text, é and 🌍 among them; "
    docs = spark.createDataFrame([(f"p{k}", k, text * (k * k)) for k in range(1, 14)], "path string, doc_id long, text string")
    lost, of = "clock % 11 = 5 and clock > 3000", lambda c: (c % 11 == 5) & (c > 3000)
    found = []
    for messages in (True, False):
        if messages:
            log = f"{tmp_path}/messages"
            R.messages(docs, "del", of).coalesce(1).write.parquet(f"{log}/1")
            R.messages(docs.filter("doc_id % 2 = 0"), "ins", of).coalesce(1).write.parquet(f"{log}/2")
            R.messages(docs, "ins", of).coalesce(1).write.parquet(f"{log}/3")
            stream = streams.causal_messages(streams.source(spark, f"{log}/*", R.MESSAGES, files_per_batch=1))
        else:
            log, runs = f"{tmp_path}/runs", R.without(R.op_runs(docs), lost)
            runs.filter("kind = 'del'").coalesce(1).write.parquet(f"{log}/1")
            runs.filter("kind = 'ins' and clock > 2000").coalesce(1).write.parquet(f"{log}/2")
            runs.filter("kind = 'ins'").coalesce(1).write.parquet(f"{log}/3")
            stream = streams.causal_runs(streams.source(spark, f"{log}/*", R.PIECES, files_per_batch=1))
        stream._rest = lambda state: streams.still_blocked(state).select("path", F.lit("blocked").alias("kind"), F.col("n").alias("clock"), *(F.lit(None).cast(t).alias(c) for c, t in (("peer", "long"), ("text", "string"), ("clocks", "array<bigint>"))))
        chars = set()
        for r in streams.drained(stream, most_tasks=3).collect():
            chars |= {("blocked", r.path, r.clock)} if r.kind == "blocked" else {(r.path, r.peer, c) for c in r.clocks} if r.kind == "del" else {(r.path, r.peer, r.clock + i, c) for i, c in enumerate(r.text)}
        found.append(chars)
    assert found[0] == found[1] and sum(x[0] == "blocked" for x in found[0]) > 3
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_a_log_has_few_files_whatever_the_session_shuffles_over(spark, tmp_path):
    """And it goes, with the state, when its stream is drained."""
    rows = [(k, f"text number {k} " * (k % 9), "s") for k in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "300")
        log = files._lossy(spark, str(tmp_path))
        assert all(files.LOG_FILES // 2 < len(glob.glob(f"{log.removeprefix('file://')}/{k}/*.parquet")) <= files.LOG_FILES for k in (1, 2))
        got = files._drained(streams.causal_messages(streams.source(spark, f"{log}/*", R.MESSAGES, files_per_batch=64)), log)
        assert got.select("path").distinct().count() == sum(k % 9 > 0 for k in range(300))
        assert not os.path.exists(log.removeprefix("file://")) and not glob.glob(f"{os.path.dirname(log.removeprefix('file://'))}/stream-*/state/state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_runs_that_wait_are_added_at_once():
    entries, many = Memory(), Memory()
    for k in range(3):  # batches
        w = streams.WaitingRuns(entries, many)
        clock = 100 * k + np.arange(0, 40, 2)
        w.add_all((1, 0), np.stack([clock - 1, clock, np.full(20, 1), np.full(20, 2)]), "ab" * 20)
        w.add((7, 1), [500 + k, 2, "é🌍"])
        w.save()
    assert (len(entries), entries.reads, entries.writes) == (3, 0, 3) and dict(many) == {(1, 0): (3,)}
    w = streams.WaitingRuns(entries, many)
    assert sorted(w.take(7, 1)) == [[8, 1, "ab"], *([500 + k, 2, "é🌍"] for k in range(3))] and w.take(107, 1) == [[108, 1, "ab"]]
    w.save()
    assert len(entries) == 1 and len(w.unpacked(entries[1, 0, 0])) == 58 and dict(many) == {(1, 0): (1,)}


def test_transfers_of_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(2)
    kind = f"peer long, path string, hash string, seq long, total long, ops {blocks.OPS}"
    rows = []
    for k in range(40):
        total = rng.randint(1, 4)
        for seq in range(total):
            if k % 5 or seq:
                rows += [(7 + k % 2, f"p{k // 2}", "h", seq, total, [("lit", None, bytearray(f"{k}-{seq}é".encode())), ("copy", seq, None)])] * rng.randint(1, 2)
    rng.shuffle(rows)
    stream = batches(spark, f"{tmp_path}/in", [rows[k::3] for k in range(3)], kind)
    got = {(r.peer, r.path): (r.outcome, r.ops) for r in streams.drained(streams.transfers(stream)).collect()}
    batch = blocks.reassemble(spark.createDataFrame(rows, kind), blocks.TRANSFER).collect()
    want = {(r.peer, r.path): ("whole", r.ops) if r.complete else ("missing chunks", None) for r in batch}
    assert got == want and {x for x, _ in want.values()} == {"whole", "missing chunks"}


def test_the_watermark_ends_the_wait_for_a_chunk(spark, tmp_path):
    kind, second = f"peer long, path string, hash string, seq long, total long, us long, ops {blocks.OPS}", 1_000_000
    chunk = lambda path, seq, us: (7, path, "h", seq, 2, us * second, [("lit", None, bytearray(b"x"))])
    parts = [[chunk("a", 0, 0), chunk("b", 0, 0)], [chunk("b", 1, 30)], [chunk("c", 0, 300)], [chunk("c", 0, 301)], [chunk("a", 1, 310)]]
    out = streams.transfers(batches(spark, f"{tmp_path}/in", parts, kind), 60 * second, "0 seconds")
    got = sorted((r.path, r.outcome) for r in streams.drained(out.select("*")).collect())
    # The chunk that came too late opens a transfer of its own, as it would for a receiver that gave up.
    assert got == [("a", "missing chunks"), ("b", "whole")]


def test_a_batch_that_is_saved_twice_leaves_the_state_as_it_was(spark, tmp_path):
    schema, seen = "path string, hash string, seq long, gone boolean", []
    parts = [[("a", "1", 1, False), ("b", "1", 2, False), ("b", "2", 3, False)], [("a", None, 4, True), ("c", "1", 5, False)], [("c", "2", 6, False), ("a", "3", 7, False)]]
    stream = batches(spark, f"{tmp_path}/in", parts[:2], schema)
    place = f"{tmp_path}/state"
    run = lambda s, check: streams.kept(s, place, "path string, hash string", "path", check, lambda state: seen.append(state.count()), Settings(report_ms=0))
    state = lambda: sorted((r.path, r.hash) for r in tables.load_state(spark, place, "path string, hash string, batch long").collect())
    run(stream, f"{tmp_path}/check")
    assert state() == [("b", "2"), ("c", "1")] and seen == [2, 2]
    version = tables._current(spark, place)
    # Killed before it was noted: another checkpoint begins with the same batches again.
    run(stream, f"{tmp_path}/again")
    assert tables._current(spark, place) == version and state() == [("b", "2"), ("c", "1")]
    spark.createDataFrame(parts[2], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run(streams.source(spark, f"{tmp_path}/in/*", schema, files_per_batch=1), f"{tmp_path}/check")
    assert state() == [("a", "3"), ("b", "2"), ("c", "2")]


def test_the_sessions_state_store_stays(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    stream = batches(spark, f"{tmp_path}/in", [[("a", 0, "removed")]], "path string, us long, kind string")
    assert streams.drained(streams.delayed_deletes(stream, 120)).count() == 1
    assert spark.conf.get(key) == before


def test_a_log_without_some_characters_is_cut_there(spark):
    docs = spark.createDataFrame([("p", 0, "abcdefghijklmnopqrstuvwxyz"), ("q", 1, "abcde"), ("r", 2, "x"), ("s", 3, "")], "path string, doc_id long, text string")
    whole = {tuple(r) for r in R.op_log(docs).filter("NOT (clock % 11 = 5)").select("path", "kind", "clock", "peer", "o_clock", "o_peer", "ch").collect()}
    cut = R.without(R.op_runs(docs), "clock % 11 = 5").collect()
    got = set()
    for r in cut:
        if r.kind == "del":
            got |= {(r.path, "del", c, r.peer, None, None, None) for c in r.clocks}
        else:
            assert r.n == len(r.text)
            got |= {(r.path, "ins", r.clock + i, r.peer, r.o_clock if i == 0 else r.clock + i - 1, r.o_peer if i == 0 else r.peer, c) for i, c in enumerate(r.text)}
    assert got == whole


def test_locating_ids_equals_all_pairs(spark):
    rng = random.Random(6)
    runs, clock = [], 1
    for _ in range(80):
        n = rng.choice([1, 3, 70_000])
        runs.append((rng.choice("pq"), clock, rng.randrange(2), n))
        clock += n + rng.randrange(3)
    ids = [(rng.choice("pq"), rng.randrange(clock + 5), rng.randrange(2)) for _ in range(500)]
    want = sorted((p, c, w, rc, c - rc) for p, c, w in ids for rp, rc, rw, n in runs if p == rp and w == rw and rc <= c < rc + n)
    a, b = spark.createDataFrame(ids, "path string, clock long, peer long"), spark.createDataFrame(runs, "path string, clock long, peer long, n long")
    assert sorted((r.path, r.clock, r.peer, r.run_clock, r.offset) for r in sequence.locate(a, b).collect()) == want
    out = sequence.outside(a, b).count()
    assert out == len(ids) - len(want)


def test_blocked_runs_equal_blocked_characters(spark):
    docs = spark.createDataFrame([(f"p{k}", k, "abcdefghijklmnopqrstuvwxyz"[: k * 3]) for k in range(9)], "path string, doc_id long, text string")
    for lost in ("clock % 11 = 5", "clock % 2 = 0", "clock < 3", "false"):
        ops = R.op_log(docs).filter(f"NOT ({lost})")
        want = {r.path: r["count"] for r in sequence.blocked(ops, ops.limit(0)).groupBy("path").count().collect()}
        got = sequence.blocked_runs(R.without(R.op_runs(docs), lost))
        assert {r.path: r["count"] for r in got.groupBy("path").count().collect()} == want


def test_many_paths_cost_one_entry_of_a_cell():
    causal = streams.Causal()
    causal.state, causal.waits = Memory(), Memory()
    column = lambda *x: np.array(x, np.int64)
    row = lambda p: (p, column(1, 9), column(1, 2), column(-1, 7), column(-1, 1), column(3, 2), "abcxy", column(1, 1), column(2, 8))
    frame = pd.DataFrame([(5, *row(f"p{k}")) for k in range(200)], columns=["cell", *(c.split()[0] for c in streams.PACKED.split(", "))])
    out = pd.concat(causal.handleInputRows((5,), iter([frame]), None))
    assert causal.state.writes == 1 and len(causal.state) == 1 and len(causal.waits) == 200
    assert sorted(set(out.kind)) == ["del", "ins"] and set(out[out.kind == "ins"].text) == {"abc"} and len(out) == 400
    # What they waited for comes: the run that waited is placed, and what came too early is deleted.
    more = (column(4), column(1), column(3), column(1), column(5), "defgh", column(), column())
    frame = pd.DataFrame([(5, f"p{k}", *more) for k in range(200)], columns=frame.columns)
    out = pd.concat(causal.handleInputRows((5,), iter([frame]), None))
    assert set(out[out.kind == "ins"].text) == {"defgh", "xy"} and [c for x in out.clocks.dropna() for c in x] == [8] * 200 and not causal.waits


def test_numbers_held_by_runs_equal_all_pairs():
    rng = np.random.default_rng(3)
    of, start, n = rng.integers(0, 3, (60, 2)), rng.integers(0, 400, 60), rng.integers(0, 9, 60)
    asked_of, asked = rng.integers(0, 3, (500, 2)), rng.integers(-5, 420, 500)
    want = [bool(((of == g).all(axis=1) & (start <= x) & (x < start + n)).any()) for g, x in zip(asked_of, asked, strict=True)]
    assert sequence.held(of, start, n, asked_of, asked).tolist() == want and 0 < sum(want) < 500


class Store(dict):
    """A map state that counts its calls."""

    calls = 0

    def containsKey(self, key):  # noqa: N802
        self.calls += 1
        return key in self

    def getValue(self, key):  # noqa: N802
        self.calls += 1
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls += 1
        self[key] = value

    def removeKey(self, key):  # noqa: N802
        self.calls += 1
        del self[key]


def test_transfers_of_a_cell_share_its_entries():
    got = streams.Receiver(None)
    got.open, got.done, got.parts = Store(), Store(), Store()
    name = lambda k: json.dumps({"peer": 7, "path": f"p{k}", "hash": "h"})
    out = []
    got.chunks(5, {name(k): [(1, 2, 0, b"b"), (0, 2, 0, b"a"), (0, 2, 0, b"a")] for k in range(1000)}, None, out)
    assert [(w, x) for _, w, x in out] == [("whole", b"ab")] * 1000
    assert not got.open and not got.parts and len(got.done) == 1 and got.open.calls + got.done.calls + got.parts.calls < 10
    out.clear()
    got.chunks(5, {name(k): [(1, 3, 0, b"b"), (1, 3, 0, b"b")] for k in range(999, 1002)}, None, out)  # one of them is done
    got.chunks(5, {name(1000): [(2, 3, 0, b"c"), (1, 3, 0, b"x")]}, None, out)
    assert not out and len(got.parts) == 3
    got.chunks(5, {name(1000): [(0, 3, 0, b"a")]}, None, out)
    assert out == [(name(1000), "whole", b"abc")] and list(json.loads(got.open[5,][0])) == [name(1001)] and len(got.parts) == 1
