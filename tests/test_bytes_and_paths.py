import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftmerge.functions import paths, scalars
from driftmerge.operators import blocks
from driftmerge.sources import tables


def slow_weak(x):
    return sum((len(x) - i) * b for i, b in enumerate(x)) % 65521 << 16 | sum(x) % 65521


def signed(data, size):
    parts = [data[i : i + size] for i in range(0, len(data), size)]
    return np.array([slow_weak(p) for p in parts], np.int64), [scalars.hashlib.sha256(p).digest()[:8] for p in parts]


def test_rolling_equals_the_definition_at_every_offset():
    data = random.Random(1).randbytes(3000)
    assert blocks.rolling(data, 100).tolist() == [slow_weak(data[k : k + 100]) for k in range(2901)]
    assert len(blocks.rolling(b"ab", 3)) == 0


def test_block_sums_equal_the_definition():
    rng = random.Random(3)
    for n in (0, 1, 7, 8, 9, 64, 999):
        data = rng.randbytes(n)
        assert blocks.block_sums(data, 8).tolist() == [slow_weak(data[k : k + 8]) for k in range(0, n, 8)]
    assert blocks.block_sums(b"\xff" * (1 << 20), 1 << 20).tolist() == [slow_weak(b"\xff" * (1 << 20))]


def test_signature_rows(spark, monkeypatch):
    rows = [("a", bytes(range(200)) * 3), ("empty", b""), ("none", None), ("short", b"xyz")]
    monkeypatch.setattr(blocks, "SIGNATURE_BATCH", 5)
    got = blocks.signatures(spark.createDataFrame(rows, "path string, content binary"), 64).collect()
    for path, data in rows:
        weak, strong = signed(data or b"", 64)
        mine = sorted((r.block_no, r.weak, bytes(r.strong)) for r in got if r.path == path)
        assert mine == list(zip(range(len(strong)), weak.tolist(), strong, strict=True))


def apply(ops, old, size):
    return b"".join(old[b * size : b * size + size] if k == "copy" else x for k, b, x in ops)


def test_deltas_rebuild_and_stay_small():
    rng = random.Random(2)
    for _ in range(300):
        old = bytes(rng.choices(b"abc", k=rng.randint(0, 200)))
        new = bytearray(old)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(new))
            new[at : at + rng.randint(0, 9)] = bytes(rng.choices(b"abcd", k=rng.randint(0, 9)))
        assert apply(blocks.delta(bytes(new), *signed(old, 8), 8), old, 8) == new
    old = rng.randbytes(64 * 20)
    lit = lambda new: sum(len(x) for k, _, x in blocks.delta(new, *signed(old, 64), 64) if k == "lit")
    assert lit(old) == 0
    assert lit(old[:500] + bytes([old[500] ^ 1]) + old[501:]) <= 128
    assert lit(old[:500] + b"nineteen new bytes." + old[500:]) < 3 * 64
    assert blocks.delta(b"", *signed(old, 64), 64) == [] and lit(b"new") == 3


def slow_delta(new, old, size):
    """The definition: at each place the first equal block, else a literal byte; one try for the tail."""
    blocks_, out, at = [old[i : i + size] for i in range(0, len(old), size)], [], 0
    while at + size <= len(new):
        if new[at : at + size] in blocks_:
            out.append(("copy", blocks_.index(new[at : at + size])))
            at += size
        else:
            out.append(("lit", new[at : at + 1]))
            at += 1
    if at < len(new):
        out += [("copy", blocks_.index(new[at:]))] if new[at:] in blocks_ else [("lit", new[at:])]
    return out


def flat(ops):
    out = []
    for kind, block, data in ops:
        if kind == "lit" and out and out[-1][0] == "lit":
            out[-1] = ("lit", out[-1][1] + data)
        else:
            out.append((kind, data if kind == "lit" else block))
    return out


def test_deltas_of_parts_equal_the_definition(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    for _ in range(400):
        old = bytes(rng.choices(b"ab", k=rng.randint(0, 60)))
        new = bytes(rng.choices(b"ab", k=rng.randint(0, 60))) if rng.random() < 0.3 else old[rng.randint(0, 5) :] + bytes(rng.choices(b"abc", k=rng.randint(0, 5)))
        want = flat((k, x if k == "copy" else None, x if k == "lit" else None) for k, x in slow_delta(new, old, 4))
        assert flat(blocks.delta(new, *signed(old, 4), 4)) == want
        cuts = sorted(rng.choices(range(len(new) + 1), k=3))
        parts = [new[a:z] for a, z in zip([0, *cuts], [*cuts, len(new)], strict=True)]
        assert flat(blocks.delta_stream(parts, *signed(old, 4), 4)) == want
    monkeypatch.setattr(blocks, "READ", 100)
    old, new = rng.randbytes(3000), None
    new = old[:700] + b"inserted" + old[720:]
    for name, data in (("old", old), ("new", new), ("none", b"")):
        (tmp_path / name).write_bytes(data)
    files = spark.createDataFrame([("p", str(tmp_path / "old")), ("q", str(tmp_path / "none"))], "path string, uri string")
    sigs = blocks.file_signatures(files, 64)
    weak, strong = signed(old, 64)
    assert sorted((r.path, r.block_no, r.weak, bytes(r.strong)) for r in sigs.collect()) == [("p", k, int(w), s) for k, (w, s) in enumerate(zip(weak, strong, strict=True))]
    got = blocks.file_deltas(spark.createDataFrame([("p", str(tmp_path / "new"))], "path string, uri string"), sigs, 64).orderBy("n").collect()
    ops = [(r.op.kind, r.op.block_no, None if r.op.bytes is None else bytes(r.op.bytes)) for r in got]
    assert [r.n for r in got] == list(range(len(got))) and apply(ops, old, 64) == new and flat(ops) == flat(blocks.delta(new, weak, strong, 64))


def test_delta_stats_equal_the_definition(spark):
    rng = random.Random(6)
    rows = []
    for k in range(30):
        old = bytes(rng.choices(b"abc", k=rng.randint(0, 120)))
        at = rng.randint(0, 60)
        rows.append((f"p{k}", bytearray(old), bytearray(old[:at] + b"xyz" + old[at + 5 :])))
    frame = lambda c: spark.createDataFrame([(r[0], r[c]) for r in rows], "path string, content binary")
    got = {r.path: (r.literal_bytes, r.reused_blocks, r.n_ops) for r in blocks.stats(blocks.deltas(frame(2), blocks.signatures(frame(1), 8), 8)).collect()}
    for path, old, new in rows:
        ops = flat((k, x if k == "copy" else None, x if k == "lit" else None) for k, x in slow_delta(bytes(new), bytes(old), 8))
        assert got[path] == (sum(len(x) for k, x in ops if k == "lit"), sum(k == "copy" for k, _ in ops), len(ops))


def test_chunks_are_bounded_and_lossless():
    rng = random.Random(3)
    ops = [("lit", None, rng.randbytes(5000)), *[("copy", k, None) for k in range(400)], ("lit", None, b"a" * 3000)]
    parts = blocks.chunk(ops, 1000)
    assert all(sum(5 if k == "copy" else len(x) for k, _, x in p) <= 1000 for p in parts)
    flat = [("lit", None, scalars.inflate(x)) if k == "litz" else (k, b, x) for p in parts for k, b, x in p]
    assert b"".join(x or b"" for _, _, x in flat) == b"".join(x or b"" for _, _, x in ops) and any(k == "litz" for p in parts for k, _, _ in p)
    assert blocks.chunk([]) == [[]]


def test_missing_chunks_are_incomplete(spark):
    rows = spark.createDataFrame([("a", 0, 2, []), ("a", 0, 2, []), ("b", 0, 1, [])], f"path string, seq long, total long, ops {blocks.OPS}")
    assert {r.path: r.complete for r in blocks.reassemble(rows).collect()} == {"a": False, "b": True}


def test_compression_gate():
    assert scalars.deflate(b"a" * 255) is None and scalars.deflate(random.Random(4).randbytes(4096)) is None
    small = scalars.deflate(b"ab" * 500)
    assert scalars.inflate(small) == b"ab" * 500
    with pytest.raises(ValueError):
        scalars.inflate(small, 100)
    with pytest.raises(ValueError):
        scalars.inflate(small[:-2])


def test_proofs():
    base = dict(secret=b"s", role="initiator", nonce_i=b"1" * 32, nonce_r=b"2" * 32, binding=None)
    others = [dict(base, secret=b"t"), dict(base, role="responder"), dict(base, nonce_r=b"3" * 32), dict(base, binding=bytes(32))]
    assert len({scalars.proof(**x) for x in [base, *others]}) == 5


@pytest.mark.parametrize(
    ("pattern", "text", "hit"),
    [("*.log", "a.log", True), ("*.log", "a/b.log", False), ("**/*.tmp", "a/b/c.tmp", True), ("**/x", "x", False), ("a/**/b", "a/b", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("*", "", True), ("a.b", "axb", False), ("**", "a/b", True)],
)
def test_globs(pattern, text, hit):
    assert bool(re.fullmatch(paths.glob_regex(pattern), text, re.S)) == hit


def test_rule_file_and_scan(spark, tmp_path):
    (tmp_path / "rules").write_text("# comment\n\n  *.log \nbuild/\nnode_modules\n**/*.bak\n")
    rules = tables.load_rules(spark, str(tmp_path / "rules"))
    assert rules[len(paths.BUILT_IN) :] == ["*.log", "build", "node_modules", "**/*.bak"]
    root = tmp_path / "root"
    for name, data in {"a.txt": b"plain", "b.log": b"x", "build/c.txt": b"x", "deep/node_modules/d": b"x", "e/f.bak": b"x", "g/h.bin": b"a\0b", ".git/i": b"x", "u.bin": b"\xff\xfe\xfd", "w.txt": "🌍".encode()}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    got = {r.path: r.is_binary for r in tables.scan_files(spark, str(root), rules[len(paths.BUILT_IN) :]).collect()}
    assert got == {"a.txt": False, "g/h.bin": True, "u.bin": True, "w.txt": False}


def test_ignored_files_are_not_opened(spark, tmp_path):
    (tmp_path / "it's").mkdir()
    (tmp_path / "it's" / "a.txt").write_bytes(b"plain")
    (tmp_path / "it's" / "b.tmp").write_bytes(b"closed")
    scan = tables.scan_files(spark, str(tmp_path))
    (tmp_path / "it's" / "b.tmp").chmod(0)
    assert [(r.path, r.len) for r in scan.collect()] == [("it's/a.txt", 5)]


def test_state_round_trip(spark, tmp_path):
    assert tables.load_state(spark, f"{tmp_path}/none", "path string").count() == 0
    for n in (3, 5, 6):
        before = tables.load_state(spark, f"{tmp_path}/state", "id long")
        tables.save_state(spark.range(n).join(before, "id", "left_outer") if n > 3 else spark.range(n), f"{tmp_path}/state")
        assert tables.load_state(spark, f"{tmp_path}/state", "id long").count() == n
    assert len(list((tmp_path / "state").glob("v-*"))) == 2
    current = tables._current(spark, f"{tmp_path}/state")
    for f in (tmp_path / "state" / current).glob("part-*"):
        f.write_bytes(b"PAR1 damaged")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    assert tables.load_state(spark, f"{tmp_path}/state", "id long").count() == 0


def test_written_files_are_known_as_our_own(spark, tmp_path):
    rows = [("a/b.txt", bytearray(b"one")), ("c", None)]
    files = spark.createDataFrame(rows, "path string, content binary")
    wrote = {r.path: r.hash for r in tables.write_files(files, str(tmp_path / "root")).collect()}
    assert (tmp_path / "root" / "a" / "b.txt").read_bytes() == b"one" and (tmp_path / "root" / "c").read_bytes() == b""
    assert {r.path: r.hash for r in tables.scan_files(spark, str(tmp_path / "root")).collect()} == wrote
    assert not list((tmp_path / "root").rglob("*.dmtmp*"))
    with pytest.raises(ValueError):
        tables.write_files(spark.createDataFrame([("../x", bytearray(b"x"))], "path string, content binary"), str(tmp_path / "root"))


def test_relative_paths_and_lossy_texts(spark):
    p = spark.createDataFrame([("C:\\root\\a\\b",), ("C:/root/",), ("C:/root/x",)], "p string").select(paths.relative(F.col("p"), "C:/root").alias("r"))
    assert [r.r for r in p.collect()] == ["a/b", None, "x"]
    rows = spark.createDataFrame([(bytearray(b"a\xffb"),), (bytearray("é".encode()[:1]),), (None,)], "c binary").select(scalars.lossy_text(F.col("c")).alias("t"))
    assert [r.t for r in rows.collect()] == ["a\ufffdb", "\ufffd", None]


def test_safe_paths_and_sniff(spark):
    names = ["a/b", "../a", "/etc", "a/../b", "C:\\x", "..a/b"]
    rows = spark.createDataFrame([(n,) for n in names], "p string").select("p", paths.is_safe(F.col("p")).alias("ok")).collect()
    assert [r.ok for r in rows] == [True, False, False, False, False, True]
    long = spark.createDataFrame([(bytearray(b"a" * (scalars.SNIFF - 1) + "é".encode() * 9),)], "c binary")
    assert not long.select(scalars.is_binary(scalars.sniffed(F.col("c"))).alias("b")).first().b


def test_block_sizes(spark):
    sizes = [0, 131_072_000, 131_072_001, 300_000_000, 1 << 34, 1 << 45]
    want = []
    for n in sizes:
        raw, power = n // 32_000, 1
        while power < raw:
            power *= 2
        want.append(4096 if n <= 131_072_000 else min(max(power, 4096), 4 << 20))
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select(scalars.block_size(F.col("n")).alias("s")).collect()
    assert [r.s for r in got] == want


def test_compression_reads_arrow_values_in_place():
    """No batch is copied to pandas, and nulls and what doesn't shrink stay null."""
    import pyarrow as pa

    data = pa.array([None, b"", b"abc" * 200, bytes(range(256)), b"skipped"], pa.binary()).slice(0, 4)
    small = scalars.maybe_compress.func(data)
    assert isinstance(small, pa.Array) and [x is not None for x in small.to_pylist()] == [False, False, True, False]
    assert scalars.decompress.func(small).to_pylist() == [None, None, b"abc" * 200, None]


def test_transfers_are_put_together_in_one_pass(spark):
    rng = random.Random(8)
    old = {f"p{k}": rng.randbytes(rng.randint(0, 900)) for k in range(12)}
    new = {p: b[:200] + rng.randbytes(rng.randint(0, 40)) + b[200:] + b"z" * 600 for p, b in old.items()} | {"other": b"q" * 700, "empty": b""}
    frame = lambda x: spark.createDataFrame([(p, bytearray(b)) for p, b in x.items()], "path string, content binary")
    a, b = frame(old), frame(new).withColumn("hash", F.sha2("content", 256)).select("path", "hash", "content")
    parts = blocks.chunked_deltas(b, blocks.signed_contents(a, 64), 64, 128)
    slow = blocks.chunks(blocks.deltas(b, blocks.signatures(a, 64), 64), 128)
    chunks = lambda x: sorted((r.path, r.seq, r.total, r.ops) for r in x.collect())
    assert chunks(parts) == chunks(slow)
    # The first chunk comes twice, and one path's last chunk is lost.
    sent = parts.unionByName(parts.filter("seq = 0")).filter("path <> 'p3' or seq < total - 1").withColumn("peer", F.lit(7).cast("long"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # transfers go on over several batches
        made = blocks.assembled(sent, a, 64, blocks.TRANSFER)
        got = {r.path: (r.complete, r.content) for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {p: (p != "p3", None if p == "p3" else x) for p, x in new.items()}
    plan = blocks.received(sent, a, 64)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join") <= 2  # new contents beside signatures, in either part
