import random

import pytest
from pyspark.sql import functions as F

from driftmerge.operators import blocks, columns, diffing, documents, reconcile
from driftmerge.sources import tables


def state(spark, rows):
    return documents.from_text(spark.createDataFrame(rows, "path string, text string"))


def text_of(rows):
    return {r.path: r.text for r in documents.texts(rows).collect()}


def random_text(rng, n):
    return "".join(rng.choices("ab é🌍\n", k=n))


def test_replicas_converge_whatever_the_order():
    """Several peers edit one document, ops arrive shuffled, repeated and in parts; all end alike, with each edit in it."""
    for seed in range(60):
        rng = random.Random(seed)
        base = random_text(rng, rng.randint(0, 30))
        start = [{"clock": 1, "peer": 1, "o_clock": None, "o_peer": None, "text": base, "gone": "0" * len(base)}] if base else []
        sides, log = [], []
        for peer in range(2, 2 + rng.randint(2, 4)):
            runs = start
            for _ in range(rng.randint(1, 3)):
                text = documents.live_text(runs)
                at = rng.randint(0, len(text))
                new = text[:at] + random_text(rng, rng.randint(0, 4)) + text[at + rng.randint(0, 4) :]
                ops = documents.detect(runs, new, peer)
                runs, inserted, deleted, waiting = documents.apply(runs, ops)
                assert documents.live_text(runs) == new and waiting == 0
                assert (inserted, deleted) == (sum(len(o["text"]) for o in ops), sum(len(o["clocks"] or ()) for o in ops))
                log += ops
            sides.append(runs)
        found = set()
        for _ in range(3):
            shuffled = [*log, *rng.sample(log, len(log) // 3)]
            rng.shuffle(shuffled)
            runs = start
            for lo in range(0, len(shuffled), 4):  # what waits is sent again, as nothing here keeps it
                runs = documents.apply(runs, shuffled[: lo + 4])[0]
            found.add(documents.live_text(runs))
        merged = start
        for side in rng.sample(sides, len(sides)):
            merged = documents.merge(merged, side)
            assert documents.merge(merged, side) == merged
        found.add(documents.live_text(merged))
        assert len(found) == 1
        again = documents.apply(merged, log)
        assert again[1:] == (0, 0, 0) and again[0] == merged


def test_ops_that_hang_on_nothing_wait(spark):
    s = state(spark, [("known", "abc")])
    other = state(spark, [("known", "abc"), ("unknown", "xyz")])
    new = spark.createDataFrame([("known", "aXbc"), ("unknown", "xyzW")], "path string, text string")
    ops = documents.detected(other, new, 9)
    rows = {r.path: r for r in documents.applied(s, ops).collect()}
    assert (rows["known"].inserted, rows["known"].waiting) == (1, 0)
    assert (rows["unknown"].inserted, rows["unknown"].waiting, rows["unknown"].runs) == (0, 1, [])
    far = ops.withColumn("base", F.col("base") + 2)
    rows = {r.path: r for r in documents.applied(s, far).collect()}
    assert (rows["known"].dropped, rows["known"].inserted) == (1, 0)
    twice = documents.applied(s, ops.union(ops))
    assert text_of(twice)["known"] == "aXbc" and {r.inserted for r in twice.filter("path = 'known'").collect()} == {1}


def test_what_replaces_the_first_characters_hangs_on_them(spark):
    """So it waits for them where the document is unknown, as all else that is inserted."""
    cases = [("abc", "Xbc"), ("a", "X"), ("aab", "Xab"), ("aaaaab", "Xaaaab"), ("abcabd", "Xabd"), ("aa" + "b" * 60 + "c", "X" + "a" + "b" * 60 + "cX"), ("a" * 90, "X" + "a" * 52 + "Y" + "a" * 35), ("abcd", "XYcdZ"), ("xay", "MNaPQ")]
    for old, new in cases:
        runs = [{"clock": 1, "peer": 1, "o_clock": None, "o_peer": None, "text": old, "gone": "0" * len(old)}]
        ops = documents.detect(runs, new, 9)
        assert all(o["o_clock"] for o in ops if o["kind"] == "ins")
        after, inserted, deleted, waiting = documents.apply(runs, ops)
        assert documents.live_text(after) == new and (inserted - deleted, waiting) == (len(new) - len(old), 0)
        assert documents.apply([], ops)[:2] == ([], 0)
    known = state(spark, [(f"p{k}", old) for k, (old, _) in enumerate(cases)])
    ops = documents.detected(known, spark.createDataFrame([(f"p{k}", new) for k, (_, new) in enumerate(cases)], "path string, text string"), 9)
    assert all(r.runs == [] and r.waiting > 0 for r in documents.applied(known.limit(0), ops).collect())
    # What stands before all that is kept hangs on nothing.
    assert [o["o_clock"] for o in documents.detect([{"clock": 1, "peer": 1, "o_clock": None, "o_peer": None, "text": "abc", "gone": "000"}], "Xabc", 9)] == [None]


def test_edits_without_kept_characters_between_are_one_delete_and_one_insertion():
    rng = random.Random(3)
    for _ in range(400):
        old, new = random_text(rng, rng.randint(1, 40)), random_text(rng, rng.randint(1, 40))
        runs = [{"clock": 1, "peer": 1, "o_clock": None, "o_peer": None, "text": old, "gone": "0" * len(old)}]
        plain = diffing.places(old, new) if old != new else []
        edits = columns._deletes_first(old, plain)
        size = lambda rows, kind: sum(n for *_, move, n in rows if move == kind)
        assert (size(edits, 0), size(edits, 1)) == (size(plain, 0), size(plain, 1))
        at, made = 0, ""
        for k, (x, y, move, n) in enumerate(edits):
            made += old[at:x]
            assert len(made) == y
            made, at = (made + new[y : y + n], x) if move else (made, x + n)
            assert k == 0 or not move or edits[k - 1][2] == 0 or edits[k - 1][0] < x
        assert made + old[at:] == new
        assert documents.live_text(documents.apply(runs, documents.detect(runs, new, 9))[0]) == new


def test_nothing_new_gives_no_ops(spark):
    s = state(spark, [("a", "same"), ("b", None), ("c", "")])
    new = spark.createDataFrame([("a", "same"), ("b", ""), ("c", None), ("d", "unknown")], "path string, text string")
    assert documents.detected(s, new, 9).count() == 0
    assert documents.detected(s.limit(0), new, 9).count() == 0 and documents.applied(s, documents.detected(s, new, 9)).count() == 3


def test_edits_on_disk_are_absorbed_before_remote_ones(spark):
    s = state(spark, [("a", "one two"), ("b", "one"), ("c", "one"), ("d", "plain")])
    remote = documents.detected(s, spark.createDataFrame([("a", "one three"), ("b", "one!"), ("c", "one!")], "path string, text string"), 9)
    disk = spark.createDataFrame([("a", bytearray(b"zero one two")), ("b", bytearray(b"one?")), ("c", bytearray(b"one\0")), ("d", bytearray(b"\xffx")), ("new", bytearray(b"n"))], "path string, content binary")
    own = spark.createDataFrame([("b", bytearray(b"one?"))], "path string, content binary").select("path", F.sha2("content", 256).alias("hash"))
    got = text_of(documents.received_ops(s, remote, disk, own, 2))
    assert got == {"a": "zero one three", "b": "one!", "c": "one!", "d": "plain"}


def test_compaction_waits_for_every_known_peer(spark):
    text = "x" * 100
    runs = spark.createDataFrame([("a", 5, 1, text, "1" * 80 + "0" * 20), ("few", 5, 1, text, "1" * 20 + "0" * 80)], "path string, base long, peer long, text string, gone string")
    none = F.lit(None).cast("long")
    s = runs.select("path", "base", F.array(F.struct(F.lit(1).cast("long").alias("clock"), "peer", none.alias("o_clock"), none.alias("o_peer"), "text", "gone")).alias("runs"))
    peers = lambda *x: spark.createDataFrame([(p,) for p in x], "peer int")
    seen = documents.manifest(s)
    reports = seen.select(F.lit(7).alias("peer"), "path", "hash", "base").union(seen.select(F.lit(8).alias("peer"), "path", "hash", "base"))
    rows = documents.compacted(s, reports, peers(7, 8), peers(7, 8), 3, 10).collect()
    assert [(r.path, r.n_before, r.n_after) for r in rows] == [("a", 100, 20)] and documents.live_text([x.asDict() for x in rows[0].runs]) == "x" * 20
    assert documents.compacted(s, reports, peers(7, 8), peers(7, 8, 9), 3, 10).count() == 0  # one is away
    assert documents.compacted(s, reports, peers(2, 7, 8), peers(7, 8), 3, 10).count() == 0  # a lower one does it
    assert documents.compacted(s, reports.filter("peer = 7"), peers(7, 8), peers(7, 8), 3, 10).count() == 0  # one says nothing
    assert documents.compacted(s, reports, peers(), peers(), 3, 10).count() == 0


def test_changes_of_unknown_paths_end_here(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    changes = spark.createDataFrame([(1, "delete", "a", None), (2, "rename", "b", "c"), (3, "delete", "gone", None), (4, "rename", "gone2", "x")], "seq int, kind string, path string, target string")
    after, relayed = documents.changed(s, changes)
    assert {tuple(r) for r in after.collect()} == {("c", "2")} and {r.path for r in relayed.collect()} == {"a", "b"}
    assert documents.changed(after, changes)[1].count() == 0  # the second time nothing is passed on


def test_transfers_by_peer_and_hash(spark):
    new = b"the new content of the file " * 20
    old = b"the old content of the file " * 20
    at = lambda rows: spark.createDataFrame(rows, "path string, content binary")
    parts = blocks.chunks(blocks.deltas(at([("p", bytearray(new))]), blocks.signatures(at([("p", bytearray(old))]), 16), 16), 64)
    total = parts.count()
    assert total > 2
    good = parts.withColumn("hash", F.sha2(F.lit(new), 256))
    sent = good.withColumn("peer", F.lit(1)).unionByName(good.withColumn("peer", F.lit(2)).filter("seq <> 1")).unionByName(parts.withColumn("hash", F.lit("00")).withColumn("peer", F.lit(3)))
    sent = sent.unionByName(sent.filter("seq = 0"))  # repeated chunks
    got = blocks.received(sent, at([("p", bytearray(old))]), 16)
    assert {(r.peer, r.outcome, None if r.content is None else bytes(r.content)) for r in got.collect()} == {(1, "verified", new), (2, "missing chunks", None), (3, "other content", None)}
    done = blocks.committed(got.withColumn("version", F.lit(4).cast("long")), spark.createDataFrame([("p", "other", 9)], "path string, hash string, version long")).first()
    assert (done.version, done.len, done.relay) == (9, len(new), True)


def test_own_writes_stop_any_number_of_touches(spark):
    touches = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2")], "path string, hash string")
    assert [r.hash for r in reconcile.unwritten(touches, touches.filter("hash = '1'").limit(1)).collect()] == ["2"]


def test_a_replica_keeps_its_identity(spark, tmp_path):
    from driftmerge.config import Settings, peer_id

    first = peer_id(spark, f"{tmp_path}/ids", "a")
    other = peer_id(spark, f"{tmp_path}/ids", "b")
    assert first != other and first > 0 and peer_id(spark, f"{tmp_path}/ids", "a") == first
    assert Settings().hold_ms == 120 and Settings(debounce_ms=1).hold_ms == 60


def test_cells_are_the_columns_objects():
    import pyarrow as pa

    op = lambda kind, clock, clocks: {"kind": kind, "clock": clock, "peer": 2, "o_clock": None, "o_peer": 1, "text": "é", "clocks": clocks}
    column = pa.array([None, [], [op("ins", 1, None), op("del", None, [1, 2])], None, [op(None, 3, [])]], documents._OP)
    for lo in range(6):
        for n in range(6 - lo):
            assert documents._cells(column.slice(lo, n)) == column.slice(lo, n).to_pylist()


def test_few_documents_are_objects_at_once():
    """However many rows a batch has."""
    seen = []
    real, documents._cells = documents._cells, lambda column: seen.append(len(column)) or column.to_pylist()
    try:
        import pyarrow as pa

        class Rows:
            columns, schema = ["path", "runs"], []

            def select(self, *_):
                return self

            def mapInArrow(self, run, kinds):  # noqa: N802
                return list(run(iter([pa.record_batch([pa.array(["p"] * 100), pa.array([[]] * 100, documents._RUN)], ["path", "runs"])])))

        out = documents._mapped(Rows(), ["runs"], lambda runs: (len(runs),), [("n", "long", pa.int64())], ["path"])
    finally:
        documents._cells = real
    assert sum(b.num_rows for b in out) == 100 and max(seen) <= documents.AT_ONCE


def test_documents_of_a_batch_are_worked_on_together():
    """Many documents at once, as columns, give what each gives alone; nulls, empty ones and those that wait among them."""
    import pyarrow as pa

    from driftmerge.operators import columns, sequence

    rng, runs, news = random.Random(4), [], []
    for k in range(80):
        text = random_text(rng, rng.randint(0, 50))
        gone = "".join(rng.choices("01", k=len(text)))
        runs.append(None if k % 9 == 0 else [{"clock": 3, "peer": 1, "o_clock": None, "o_peer": None, "text": text, "gone": gone}] if text else [])
        news.append(None if k % 7 == 0 else random_text(rng, 30))
    column = pa.array(runs, columns.RUN)
    ops = columns.detect(column, pa.array(news, pa.string()), 9)
    assert ops.to_pylist() == [documents.detect(r or [], n or "", 9) for r, n in zip(runs, news, strict=True)]
    lost = [{"kind": "ins", "clock": 7, "peer": 5, "o_clock": 6, "o_peer": 4, "text": "lost", "clocks": None}]
    sent = pa.array([[*x, *lost] for x in ops.to_pylist()], columns.OP).slice(11)
    after, inserted, deleted, waiting = columns.apply(column.slice(11), sent)
    for one, mine, new, extra in zip(after.to_pylist(), sent.to_pylist(), news[11:], runs[11:], strict=True):
        assert documents.live_text(one) == (new or "")
        rows = [(r["clock"], r["peer"], r["o_clock"], r["o_peer"], r["text"]) for r in [*(extra or []), *(o for o in mine if o["kind"] == "ins")]]
        assert [(r["clock"], r["peer"], r["text"]) for r in one] == sequence.ordered_pieces(rows)
    assert set(waiting.to_pylist()) == {4} and columns.live(after)[0].to_pylist() == [n or "" for n in news[11:]]
    large = pa.record_batch([pa.array(["x" * (1 << 20)] * 64)], ["text"])
    assert max(p.num_rows for p in columns.parts(large)) <= 4 and sum(p.num_rows for p in columns.parts(large)) == 64
