import random

import pytest
from pyspark.sql import functions as F

from driftmerge.operators import codec, diffing, sequence

SCHEMA = "path string, seq long, kind string, clock long, peer long, o_clock long, o_peer long, ch string"


def typed(path, text, peer=1, clock=0, origin=(None, None), seq=0):
    out = []
    for k, ch in enumerate(text):
        out.append((path, seq + k, "ins", clock + k + 1, peer, *origin, ch))
        origin = (clock + k + 1, peer)
    return out


def replayed(spark, ops):
    rows = sequence.document_text(spark.createDataFrame(ops, SCHEMA)).collect()
    return {r.path: r.text for r in rows}


def test_literal_histories(spark):
    word = typed("reversed", "abcdef")
    ops = [(p, 100 - s, *rest) for p, s, *rest in word]
    ops += typed("twice", "abc") + [(p, s + 10, *rest) for p, s, *rest in typed("twice", "abc")]
    ops += [("gone", 0, "del", 2, 1, None, None, None), *typed("gone", "abc", seq=1)]
    ops += typed("tie", "12345") + typed("tie", "hello", 10, 5, (5, 1), 10) + typed("tie", "world", 20, 5, (5, 1), 20)
    ops += typed("middle", "abcdef") + typed("middle", "X", 2, 6, (3, 1), 10)
    ops += typed("late", "x", 3, 9, (8, 7))
    assert replayed(spark, ops) == {"reversed": "abcdef", "twice": "abc", "gone": "ac", "tie": "12345worldhello", "middle": "abcXdef", "late": ""}


def slow_order(chars):
    """Integration one at a time: right of the origin, past larger ids, before the first smaller one."""
    doc, waiting = [], list(chars)
    while waiting:
        rest = []
        for c in waiting:
            clock, peer, origin, ch = c
            ids = [x[0] for x in doc]
            if origin is not None and origin not in ids:
                rest.append(c)
                continue
            at = ids.index(origin) + 1 if origin is not None else 0
            while at < len(doc) and doc[at][0] > (clock, peer):
                at += 1
            doc.insert(at, ((clock, peer), ch))
        if len(rest) == len(waiting):
            break
        waiting = rest
    return "".join(ch for _, ch in doc)


def test_order_equals_one_by_one_integration():
    for seed in range(150):
        rng = random.Random(seed)
        chars, clock = [], 0
        known = [None]
        for _ in range(rng.randint(1, 12)):
            peer, origin = rng.randint(1, 4), rng.choice(known)
            clock += rng.randint(1, 2)
            for ch in "".join(rng.choices("abcdef", k=rng.randint(1, 5))):
                chars.append((clock, peer, origin, ch))
                origin = (clock, peer)
                known.append(origin)
                clock += 1
        runs = [(c, p, *(o or (None, None)), ch) for c, p, o, ch in chars]
        rng.shuffle(runs)
        got = "".join(t for _, _, t in sequence.ordered_pieces([*runs, *runs[:3]]))
        assert got == slow_order(chars)


def test_compress_and_expand(spark):
    ops = typed("a", "x" * 41) + [("a", 50 + k, "del", k + 1, 1, None, None, None) for k in range(3)] + typed("a", "z", 2, 90, (1, 1), 60) + typed("b", "é🌍")
    df = spark.createDataFrame(ops, SCHEMA)
    wire = sequence.compress(df)
    assert [(r.path, r.kind, r.n) for r in wire.orderBy("path", "run").collect()] == [("a", "run", 41), ("a", "dels", 3), ("a", "ins", 1), ("b", "run", 2)]
    back = sequence.expand(wire).select("path", "kind", "clock", "peer", "o_clock", "o_peer", "ch")
    assert back.exceptAll(df.select(*back.columns)).isEmpty() and back.count() == len(ops)


def test_adopt_locate_ranks_and_merge(spark):
    elems = spark.createDataFrame([("p", k, k, 1, k - 1 or None, 1 if k > 1 else None, c, k in (3, 4)) for k, c in enumerate("abcdef", 1)] + [("p", 9, 2, 1, 1, 1, "b", False)], "path string, pos long, clock long, peer long, o_clock long, o_peer long, ch string, deleted boolean")
    runs = sequence.adopt(elems)
    assert [(r.text, r.deleted) for r in runs.orderBy("run").collect()] == [("ab", False), ("cd", True), ("ef", False)]
    ranks = spark.createDataFrame([("p", k) for k in (0, 2, 3, 4)], "path string, rank long")
    assert {r.rank: r.clock for r in sequence.at_rank(ranks, sequence.visible(runs)).collect()} == {0: 1, 2: 5, 3: 6, 4: None}
    ids = spark.createDataFrame([("p", 4, 1), ("p", 6, 1), ("p", 7, 1)], "path string, clock long, peer long")
    assert {(r.clock, r.run_clock, r.offset) for r in sequence.locate(ids, runs).collect()} == {(4, 3, 1), (6, 5, 1)}
    other = elems.withColumn("deleted", F.col("clock") == 1)
    merged = sequence.merge(elems, other)
    assert sequence.live_text(merged).first().text == "bef"
    assert sequence.live_text(sequence.merge(merged, other)).first().text == "bef"
    assert sorted(sequence.merge(other, elems).collect()) == sorted(merged.collect())
    assert sequence.merged_text(elems, other).collect() == [("p", "bef", 6, 3)]
    assert [r.clock for r in sequence.compact(merged).orderBy("clock").collect()] == [1, 2, 3]


def test_merge_equals_a_union_of_sets(spark):
    rng = random.Random(5)
    sides = []
    for _ in range(2):
        side = []
        for path in ("p", "q", "é"):
            text = "ab é🌍\n" * 9
            side += [(path, k + 1, k + 1, 1, k or None, 1 if k else None, c, rng.random() < 0.3) for k, c in enumerate(text)]
            side += [(path, 100 + k, 60 + 7 * k, rng.randint(2, 3), 5, 1, "z", False) for k in rng.sample(range(20), 12)]
        rng.shuffle(side)
        sides.append(side)
    schema = "path string, pos long, clock long, peer long, o_clock long, o_peer long, ch string, deleted boolean"
    want = {}
    for r in sides[0] + sides[1]:
        want[(r[0], r[2], r[3])] = (*r[:7], r[7] or want.get((r[0], r[2], r[3]), r)[7])
    a, b = (spark.createDataFrame(side, schema) for side in sides)
    assert {tuple(r) for r in sequence.merge(a, b).collect()} == set(want.values())
    live = {p: "".join(r[6] for r in sorted((r for r in want.values() if r[0] == p and not r[7]), key=lambda r: (r[1], r[2], r[3]))) for p in ("p", "q", "é")}
    assert {r.path: r.text for r in sequence.merged_text(a, b).collect()} == live
    assert sequence.merge(a.limit(0), b.limit(0)).count() == 0


def test_pieces_need_chained_rows_without_a_gap(spark):
    ops = typed("a", "abcdef") + [("a", 6, "del", 1, 1, None, None, None), ("a", 7, "del", 2, 1, None, None, None)] + typed("b", "é🌍")
    ops[3] = (*ops[3][:1], 30, *ops[3][2:])  # another row may come between
    got = sequence.pieces(spark.createDataFrame(ops, SCHEMA).coalesce(1), "seq").collect()
    assert [(r.path, r.seq, r.kind, r.n) for r in got] == [("a", 0, "ins", 3), ("a", 30, "ins", 1), ("a", 4, "ins", 2), ("a", 6, "del", 1), ("a", 7, "del", 1), ("b", 0, "ins", 2)]
    assert [r.text for r in got if r.kind == "ins"] == ["abc", "d", "ef", "é🌍"]


def random_text(rng, n):
    return "".join(rng.choices("ab é🌍\n", k=n))


def test_scripts_are_exact_and_short():
    rng = random.Random(7)
    for _ in range(400):
        old, new = random_text(rng, rng.randint(0, 25)), random_text(rng, rng.randint(0, 25))
        edits = diffing.script(old, new)
        assert diffing.applied(old, edits) == new
        table = [[0] * (len(new) + 1) for _ in range(len(old) + 1)]
        for i, a in enumerate(old, 1):
            for j, b in enumerate(new, 1):
                table[i][j] = table[i - 1][j - 1] + 1 if a == b else max(table[i - 1][j], table[i][j - 1])
        assert sum(len(t) for k, t in edits if k != "keep") == len(old) + len(new) - 2 * table[-1][-1]
        assert diffing.applied(old, diffing.script(old, new, 2)) == new
    assert sum(len(t) for k, t in diffing.script("The fox jumps over", "The fox leaps over") if k != "keep") <= 10


def test_scripts_of_many_edits_are_short(monkeypatch):
    old = "".join(chr(97 + k * k % 23) for k in range(90_000))
    new = "".join(("" if k % 37 == 0 else c) + ("\ue000" if k % 53 == 0 else "") for k, c in enumerate(old))
    edits = diffing.script(old, new)
    size = {kind: sum(len(t) for k, t in edits if k == kind) for kind in ("ins", "del")}
    assert size == {"ins": -(-90_000 // 53), "del": -(-90_000 // 37)} and diffing.applied(old, edits) == new
    ids = [(k + 1, 1) for k in range(len(old))]
    assert len(diffing.detect(ids, old, new, 2, len(old))) == sum(size.values())
    rng = random.Random(8)
    pairs = [(random_text(rng, 60), random_text(rng, 50)) for _ in range(50)]
    whole = [diffing.script(*pair) for pair in pairs]
    monkeypatch.setattr(diffing, "BLOCK", 3)
    assert [diffing.script(*pair) for pair in pairs] == whole


def test_detected_ops_lead_to_the_new_text(spark):
    old, new = "hello world", "help the world!"
    ids = [(k + 1, 1) for k in range(len(old))]
    ops = [("p", k, *op) for k, op in enumerate(diffing.detect(ids, old, new, 2, len(old)))]
    base = typed("p", old)
    assert replayed(spark, [*base, *[(p, s + 100, *r) for p, s, *r in ops]]) == {"p": new}


def test_codec():
    elems = [(1, 1, None, None, "h", False), (2, 1, 1, 1, "é", True), (9, 3, 2, 1, "🌍", False), (10, 2, 1, 1, "x", True), (11, 2, 10, 2, "→", False)]
    data = codec.encode(elems)
    assert codec.decode(data) == elems and codec.decode(codec.encode([])) == []
    assert all(codec.decode(data[:k]) is None for k in range(len(data))) and codec.decode(data + b"x") is None
    long = [(k, 1 << 40, k - 1 or None, (1 << 40) if k > 1 else None, "a", False) for k in range(1, 1001)]
    assert codec.decode(codec.encode(long)) == long and len(codec.encode(long)) < 3000
    rng = random.Random(1)
    for _ in range(500):
        codec.decode(rng.randbytes(rng.randint(0, 40)))


def test_codec_size_is_the_length_of_the_bytes(spark):
    rng = random.Random(2)
    rows, plain = [], {}
    for path in "abc":
        elems = []
        for k in range(60):
            origin = rng.choice(elems)[:2] if elems and rng.random() < 0.5 else elems[-1][:2] if elems and rng.random() < 0.8 else (None, None)
            elems.append((k + 1 if rng.random() < 0.7 else rng.randint(1, 100_000) * 200 + k, rng.choice([1, 300, 70_000]), *origin, rng.choice("aé🌍"), rng.random() < 0.2))
        plain[path] = elems
        rows += [(path, k, *e) for k, e in enumerate(elems)]
    df = spark.createDataFrame(rows, "path string, pos long, clock long, peer long, o_clock long, o_peer long, ch string, deleted boolean")
    assert {r.path: r.bytes for r in codec.encoded_size(df).collect()} == {p: len(codec.encode(e)) for p, e in plain.items()}


@pytest.mark.parametrize("value", [0, 1, 127, 128, 16_383, 16_384, 1 << 40])
def test_varint_length(spark, value):
    from driftmerge.functions import scalars

    out = bytearray()
    codec.put(out, value)
    assert spark.range(1).select(scalars.varint_length(F.lit(value).cast("long")).alias("n")).first().n == len(out)


def test_fresh_runs_are_the_fresh_ops(spark):
    from driftmerge.operators import sequence
    from driftmerge.sources import replicas

    rng, rows, old = random.Random(5), [], []
    for path in "pq":
        for k in range(12):
            clock, n, peer = rng.randint(1, 30), rng.randint(1, 12), rng.choice([1, 2])
            if k % 3 == 2:
                rows.append((path, 100 * k, "del", clock, peer, None, None, "", n, list(range(clock, clock + n))))
            else:
                (old if k % 4 == 0 else rows).append((path, 100 * k, "ins", clock, peer, None, None, "".join(chr(97 + i % 26) for i in range(clock, clock + n)), n, None))
    pieces, known = (spark.createDataFrame(x, replicas.PIECES) for x in ([*rows, *rows[:5]], old))
    chars = lambda x: spark.createDataFrame([(p, s + i, k, c + i, w, t[i : i + 1] or None) for p, s, k, c, w, _, _, t, n, _ in x for i in range(n)], "path string, seq long, kind string, clock long, peer long, ch string")
    want = {(r.path, r.kind, r.clock, r.peer, r.ch) for r in sequence.fresh(chars([*rows, *rows[:5]]), chars(old)).collect()}
    got = [(r.path, r.kind, c, r.peer, None if r.kind == "del" else r.text[i]) for r in sequence.fresh_runs(pieces, known).collect() for i, c in enumerate(r.clocks or range(r.clock, r.clock + r.n))]
    assert len(got) == len(set(got)) and set(got) == want


def test_edits_that_lie_apart_are_found_without_the_search(monkeypatch):
    rng = random.Random(9)
    for _ in range(200):
        old = "".join(rng.choices("abc ", k=rng.randint(0, 80)))
        new = list(old)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(new))
            new[at : at + rng.randint(0, 1)] = rng.choices("abX", k=rng.randint(0, 1))
        new = "".join(new)
        edits = diffing.script(old, new)
        with monkeypatch.context() as m:
            m.setattr(diffing, "_local", lambda a, b, most: None)
            least = diffing.script(old, new)
        size = lambda script: sum(len(t) for kind, t in script if kind != "keep")
        assert diffing.applied(old, edits) == new and size(edits) == size(least)
    monkeypatch.setattr(diffing, "_Search", None)
    old = "".join(rng.choices("abcdefgh ", k=20_000))
    new = "".join(("" if k % 37 == 0 else c) + ("X" if k % 53 == 0 else "") for k, c in enumerate(old))
    assert diffing.applied(old, diffing.script(old, new)) == new


def test_cuts_carry_no_whole_texts(spark):
    from driftmerge.sources import replicas

    log = spark.createDataFrame([("p", 1, "ins", 1, 1, None, None, "abcdefghij", 10, None), ("p", 11, "del", 3, 1, None, None, "", 2, [3, 4])], replicas.PIECES)
    cut = replicas.without(log, "clock in (1, 4, 5)")
    assert "Generate" not in cut._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, cut.collect()), key=str) == [("p", 11, "del", 3, 1, None, None, "", 1, [3]), ("p", 2, "ins", 2, 1, 1, 1, "bc", 2, None), ("p", 6, "ins", 6, 1, 5, 1, "fghij", 5, None)]


def test_decoded_runs_are_the_decoded_elements(spark):
    rng, elems = random.Random(4), []
    for _ in range(300):
        if elems and rng.random() < 0.9:
            clock, peer = elems[-1][:2]
            elems.append((clock + 1, peer, clock, peer, rng.choice("aé🌍\x1a\x1b"), rng.random() < 0.4))
        else:
            elems.append((rng.randint(1, 500), rng.randint(1, 300), *rng.choice([(None, None), (3, 7)]), rng.choice("aé🌍"), False))
    data = codec.encode(elems)
    assert codec.decode(data) == elems and 10 < len(codec.decode_pieces(data)) < 100
    rows = codec.decoded_runs(spark.createDataFrame([("p", bytearray(data)), ("q", bytearray(data[:-1])), ("r", None)], "path string, data binary")).collect()
    assert {r.path for r in rows} == {"p"} and len(rows) < 100
    assert [(r.pos, r.text, r.gone) for r in rows] == sorted((r.pos, r.text, r.gone) for r in rows) and sum(r.n for r in rows) == len(elems)
    assert "".join(r.text for r in rows) == "".join(e[4] for e in elems) and "".join(r.gone for r in rows) == "".join("01"[e[5]] for e in elems)


def test_documents_are_dealt_over_all_tasks(spark):
    """However few bytes they have."""
    from driftmerge.operators import sequence

    rows = spark.createDataFrame([("p", 1, 1, 1, None, None, "ab", 2, "01")], "path string, pos long, clock long, peer long, o_clock long, o_peer long, text string, n long, gone string")
    for made in (sequence.adopt(rows), sequence.merged_text(rows, rows), codec.encoded(rows)):
        assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    runs = sequence.compact_runs(sequence.adopt(rows))
    assert "Join" not in runs._jdf.queryExecution().executedPlan().toString()
    assert [(r.old_clock, r.clock, r.n, r.text) for r in runs.collect()] == [(1, 1, 1, "a")]


def test_documents_are_worked_on_together(spark, monkeypatch):
    """Runs, merges and replayed logs of many documents share a call, wherever batches end; a null path is a document."""
    calls, real = [], sequence._documents
    rows = [(None if k == 7 else f"p{k:02}", s, s, 1, s - 1 or None, 1 if s > 1 else None, "é🌍ab"[s % 4], (s + k) % 3 == 0) for k in range(40) for s in range(1, 12)]
    elems = spark.createDataFrame(rows, "path string, pos long, clock long, peer long, o_clock long, o_peer long, ch string, deleted boolean").coalesce(1)
    want = {p: "".join(r[6] for r in rows if r[0] == p and not r[7]) for p in {r[0] for r in rows}}
    got = sequence.adopt(elems).collect()
    assert {p: "".join(r.text for r in sorted((r for r in got if r.path == p), key=lambda r: r.run) if not r.deleted) for p in want} == want
    assert {(r.path, r.text) for r in sequence.merged_text(elems, elems.withColumn("deleted", F.lit(False))).collect()} == set(want.items())
    ops = elems.select("path", F.col("pos").alias("seq"), F.lit("ins").alias("kind"), "clock", "peer", "o_clock", "o_peer", "ch").unionByName(elems.filter("deleted").select("path", (F.col("pos") + 100).alias("seq"), F.lit("del").alias("kind"), "clock", "peer", *(F.lit(None).cast("long").alias(c) for c in ("o_clock", "o_peer")), F.lit(None).cast("string").alias("ch")))
    assert {(r.path, r.text, r.n_raw) for r in sequence.document_text(ops).collect()} == {(p, t, 11) for p, t in want.items()}

    class Rows:
        def sortWithinPartitions(self, _):  # noqa: N802
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            batches = [[k // 700, (k + 99) // 700] for k in range(0, 6_000, 100)]
            return sum((b.num_rows for b in run(pa.record_batch([pa.array([str(p).zfill(2) for p in x])], ["path"]) for x in batches)), 0)

    import pyarrow as pa

    monkeypatch.setattr(sequence, "dealt", lambda rows: rows)
    monkeypatch.setattr(sequence, "AT_ONCE", 40)
    assert sequence.by_document(Rows(), lambda part: calls.append(real(part)[0].to_pylist()) or part, "") == 120
    assert sorted(p for c in calls for p in c) == sorted({p for c in calls for p in c}) and 1 < len(calls)
