import glob
import os
import random
from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from driftmerge import catalog
from driftmerge.operators import events
from driftmerge.streaming import streams

SF = "/root/testdata/sf0.001"
@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = entry_module.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    result = duck.execute(entry_module.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    assert got == sorted(repr(tuple(row[names.index(c)] for c in cols)) for row in result.fetchall())


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_debounce_fires_at_exactly_the_gap(spark):
    rows = [(k, datetime(2024, 1, 1) + timedelta(milliseconds=ms), "p", kind) for k, (ms, kind) in enumerate([(0, "a"), (39, "b"), (79, "c"), (118, "d")])]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, path string, kind string")
    assert sorted((r.kind, r.n) for r in events.debounce(df, "40 milliseconds").collect()) == [("b", 2), ("d", 2)]


@pytest.mark.parametrize("late", ["0 seconds", "1 day"])
def test_bursts_of_a_stream_equal_the_batch(spark, tmp_path, late):
    rng, second = random.Random(3), 1_000_000
    rows = sorted(((f"p{rng.randint(0, 5)}", rng.randint(0, 400) * second, k, rng.choice("ab")) for k in range(300)), key=lambda r: r[1])
    schema = "path string, us long, event_id long, kind string"
    for k in range(6):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in glob.glob(f"{tmp_path}/in/{k}/*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = streams.source(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    got = sorted(map(tuple, streams.drained(streams.bursts(stream, 5 * second, late)).collect()))
    batch = spark.createDataFrame(rows, schema).select("path", F.timestamp_micros("us").alias("ts"), "event_id", "kind")
    want = sorted(map(tuple, events.debounce(batch, "5 seconds").select("path", F.unix_micros("ts"), "kind", "n").collect()))
    assert got == want and len(want) > 50


def test_messages_reach_every_peer_of_a_dense_mesh(spark):
    rows = [("mesh", a, b) for a in range(50) for b in range(50) if a != b] + [("chain", k, k + 1) for k in range(12)] + [("apart", 3, 4)]
    got = {(r.topology, r.peer): r.hops for r in events.reach(spark.createDataFrame(rows, "topology string, src long, dst long"), 0).collect()}
    assert got == {**{("mesh", k): min(k, 1) for k in range(50)}, **{("chain", k): k for k in range(13)}, ("apart", 0): 0}


def test_renames_are_one_to_one_and_first_come(spark):
    second = 1_000_000
    schema = "hash long, ts timestamp, event_id long"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    removes = spark.createDataFrame([(1, at(0), 10), (1, at(5), 11), (1, at(100), 12), (2, at(0), 13)], schema)
    creates = spark.createDataFrame([(1, at(6), 20), (1, at(7), 21), (1, at(8), 22), (2, at(61), 23)], schema)
    assert sorted((r.removed, r.created) for r in events.rename_pairs(removes, creates, 60 * second).collect()) == [(10, 20), (11, 21)]


def test_rename_pairs_equal_brute_force(spark):
    rng = random.Random(4)
    at = lambda us: datetime(2024, 1, 1) + timedelta(microseconds=us)
    removes = [(rng.randint(0, 3), rng.randint(0, 500), k) for k in range(80)]
    creates = [(rng.randint(0, 3), rng.randint(0, 500), 1000 + k) for k in range(80)]
    pending, want = list(sorted(removes, key=lambda r: (r[1], r[2]))), []
    for hash_, us, ident in sorted(creates, key=lambda r: (r[1], r[2])):
        first = next((r for r in pending if r[0] == hash_ and r[1] <= us <= r[1] + 60), None)
        if first:
            pending.remove(first)
            want.append((hash_, first[2], ident))
    frames = (spark.createDataFrame([(h, at(us), i) for h, us, i in rows], "hash long, ts timestamp, event_id long") for rows in (removes, creates))
    assert sorted(map(tuple, events.rename_pairs(*frames, 60).collect())) == sorted(want) and len(want) > 20


def test_raw_events(spark):
    rows = [("2024-01-01", "a", "access", False, True), ("2024-01-01", "b", "modify", True, True), ("2024-01-01", "c", "remove", False, True), ("2024-01-01", "d", "modify", False, False)]
    df = spark.createDataFrame(rows, "ts string, path string, kind string, is_dir boolean, exists boolean")
    assert [(r.path, r.kind) for r in events.touched(df).collect()] == [("c", "touched"), ("d", "removed")]


def test_causal_stream_waits_for_origins(spark, tmp_path):
    schema = "path string, clock long, peer long, o_clock long, o_peer long, ch string"
    spark.createDataFrame([("p", 3, 1, 2, 1, "c"), ("p", 3, 1, 2, 1, "c"), ("q", 1, 1, None, None, "z")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([("p", 2, 1, 1, 1, "b"), ("p", 1, 1, None, None, "a"), ("q", 9, 1, 8, 1, "never")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = streams.drained(streams.causal(stream)).collect()
    assert sorted((r.path, r.ch) for r in got) == [("p", "a"), ("p", "b"), ("p", "c"), ("q", "z")]


def test_delayed_deletes(spark, tmp_path):
    spark.createDataFrame([("a", 0, "removed"), ("a", 50, "touched"), ("b", 0, "removed"), ("b", 500, "touched")], "path string, us long, kind string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("path string, us long, kind string").parquet(f"{tmp_path}/in")
    got = streams.drained(streams.delayed_deletes(stream, 120)).collect()
    assert sorted((r.path, r.us, r.kind) for r in got) == [("a", 50, "touched"), ("b", 120, "removed"), ("b", 500, "touched")]


def test_causal_stream_keeps_deletes_for_their_target(spark, tmp_path):
    schema = "path string, clock long, peer long, o_clock long, o_peer long, ch string, kind string"
    spark.createDataFrame([("p", 2, 1, None, None, None, "del"), ("p", 1, 1, None, None, "a", "ins"), ("p", 9, 1, None, None, None, "del")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    spark.createDataFrame([("p", 2, 1, 1, 1, "b", "ins"), ("p", 1, 1, None, None, None, "del"), ("p", 2, 1, None, None, None, "del")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = streams.drained(streams.causal(stream)).collect()
    assert sorted((r.clock, r.kind) for r in got) == [(1, "del"), (1, "ins"), (2, "del"), (2, "ins")]


@pytest.mark.parametrize("late", ["0 seconds", "1 day"])
def test_deletes_without_a_later_event(spark, tmp_path, late):
    schema, second = "path string, us long, kind string", 1_000_000
    batches = [[("gone", 0, "removed"), ("back", 9 * second, "removed")], [("x", 20 * second, "touched"), ("back", 10 * second, "touched")], [("late", 5 * second, "touched"), ("y", 30 * second, "touched")], [("last", 30 * second, "removed")]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        for f in glob.glob(f"{tmp_path}/in/{k}/*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = streams.drained(streams.delayed_deletes(stream, 2 * second, late)).collect()
    want = [("back", 10, "touched"), ("gone", 2, "removed"), ("last", 32, "removed"), ("late", 5, "touched"), ("x", 20, "touched"), ("y", 30, "touched")]
    assert sorted((r.path, r.us // second, r.kind) for r in got) == want


def test_the_watermark_ends_a_hold_within_the_stream(spark, tmp_path):
    schema, second = "path string, us long, kind string", 1_000_000
    spark.createDataFrame([("gone", 0, "removed"), ("x", 20 * second, "touched"), ("held", 20 * second, "removed")], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = streams.delayed_deletes(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 2 * second, "0 seconds")
    assert sorted((r.path, r.kind) for r in streams.drained(stream.select("*")).collect()) == [("gone", "removed"), ("x", "touched")]


def test_rename_candidates_are_joined_by_hash_and_span_of_time(spark):
    rng = random.Random(5)
    rows = [(k, rng.randrange(2), rng.randrange(-40_000, 40_000)) for k in range(300)]
    table = spark.createDataFrame(rows, "event_id long, hash long, s long").selectExpr("event_id", "hash", "timestamp_seconds(s) as ts")
    got = events.rename_candidates(table.filter("event_id < 150"), table.filter("event_id >= 150"), "1 hour")
    want = sorted((h, a, b) for a, h, s in rows[:150] for b, g, t in rows[150:] if h == g and s <= t <= s + 3600)
    assert sorted(tuple(r) for r in got.collect()) == want and want
    # One hash alone would hold each remove against each create.
    join = next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)
    assert "span" in join
