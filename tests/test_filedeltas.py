import hashlib
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftmerge.operators import blocks, filedeltas

SIZE = 64


def signed(data, size=SIZE):
    return blocks.block_sums(data, size), [hashlib.sha256(data[k : k + size]).digest()[:8] for k in range(0, len(data), size)]


def made_of(rng, old, n):
    """A new content: pieces of the old one from any offset, runs of one byte, new bytes."""
    out = b""
    while len(out) < n:
        at, m = rng.randrange(len(old) + 1), rng.randrange(1, 400)
        out += rng.choice([old[at : at + m], old[at // SIZE * SIZE :][:m], bytes([rng.randrange(3)]) * m, rng.randbytes(m // 4)])
    return out


def joined(ops):
    out = []
    for op in ops:
        if op[0] == "lit" and out and out[-1][0] == "lit":
            op = ("lit", None, out.pop()[2] + op[2])
        out.append(op)
    return out


def test_scans_from_any_offset_leave_where_the_step_function_says():
    rng = random.Random(1)
    for _ in range(60):
        old = bytes(200) + rng.randbytes(900) + b"\1" * 150
        data = made_of(rng, old, rng.randrange(100, 1500))
        weaks, strongs = signed(old)
        known = set(zip(weaks.tolist(), strongs, strict=True))
        at = [i for i in range(len(data) - SIZE + 1) if (int(blocks.block_sums(data[i : i + SIZE], SIZE)[0]), hashlib.sha256(data[i : i + SIZE]).digest()[:8]) in known]
        found = filedeltas.range_matches(data, weaks, known, SIZE)
        assert found.tolist() == at
        start, end = 0, max(SIZE, len(data) // 2)
        upto, leaves = filedeltas.exits(found[found < end], start, end, SIZE)
        for enter in range(start, min(end, start + SIZE)):
            p = enter
            while p < end:
                p = p + SIZE if p in set(at) else p + 1
            assert leaves[np.searchsorted(upto, enter)] == p


@pytest.mark.parametrize("seed", [1, 2])
def test_deltas_by_ranges_equal_the_sequential_one_and_rebuild_the_files(spark, tmp_path, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(filedeltas, "READ", 300)
    files, olds, want = [], [], {}
    for k in range(24):
        old = bytes(rng.randrange(300)) + rng.randbytes(rng.randrange(1500)) + b"\1" * rng.randrange(300)
        new = rng.choice([b"", old, old[:-3], b"x" + old, bytes(700)]) if k % 3 == 0 else made_of(rng, old, rng.randrange(2500))
        (tmp_path / f"old{k}").write_bytes(old)
        (tmp_path / f"new{k}").write_bytes(new)
        files.append((f"p/{k}", str(tmp_path / f"new{k}")))
        olds.append((f"p/{k}", str(tmp_path / f"old{k}"), hashlib.sha256(new).hexdigest()))
        want[f"p/{k}"] = (joined(blocks.delta(new, *signed(old), SIZE)), new)
    old = spark.createDataFrame(olds, "path string, uri string, hash string")
    ops = filedeltas.ranged_deltas(spark.createDataFrame(files, "path string, uri string"), blocks.file_signatures(old, SIZE), SIZE, span=200)
    got = {}
    for r in ops.orderBy("path", "n").collect():
        got.setdefault(r.path, []).append((r.op.kind, r.op.block_no, None if r.op.bytes is None else bytes(r.op.bytes)))
    assert {p: joined(got.get(p, [])) for p in want} == {p: x for p, (x, _) in want.items()}
    done = filedeltas.apply_deltas(ops, old, f"{tmp_path}/root", SIZE).collect()
    assert len(done) == len(want) and {r.outcome for r in done} == {"written"}
    for path, (_, new) in want.items():
        assert (tmp_path / "root" / path).read_bytes() == new
    assert not list((tmp_path / "root").rglob("*.dmtmp*"))


def test_files_take_the_places_of_the_old_ones_also_if_a_task_runs_twice(spark, tmp_path):
    rng = random.Random(9)
    files, olds, want = [], [], {}
    for k in range(6):
        old = rng.randbytes(rng.randrange(1, 3000))
        new = [old[1:], old + b"x", b"", made_of(rng, old, 2000), old[700:] + old[:700], old][k]
        for name, data in (("tree", old), ("new", new)):
            (tmp_path / name).mkdir(exist_ok=True)
            (tmp_path / name / f"f{k}").write_bytes(data)
        files.append((f"f{k}", str(tmp_path / "new" / f"f{k}")))
        olds.append((f"f{k}", str(tmp_path / "tree" / f"f{k}"), hashlib.sha256(new).hexdigest()))
        want[f"f{k}"] = new
    held = spark.createDataFrame(olds, "path string, uri string, hash string")
    ops = spark.createDataFrame(filedeltas.ranged_deltas(spark.createDataFrame(files, "path string, uri string"), blocks.signed_files(held, SIZE), SIZE, span=200).collect(), filedeltas.FILE_OP)
    for _ in range(2):
        got = filedeltas.apply_deltas(ops, held, str(tmp_path / "tree"), SIZE).collect()
        assert {(r.path, r.len, r.outcome) for r in got} == {(p, len(x), "written") for p, x in want.items()}
        assert {p: (tmp_path / "tree" / p).read_bytes() for p in want} == want and len(list((tmp_path / "tree").iterdir())) == 6


def test_ops_are_packed_and_unpacked():
    rng = random.Random(4)
    ops = [(f"p{k // 40}", k % 40 + (100 if k % 7 == 0 else 0), rng.choice([("copy", rng.randrange(9), None), ("lit", None, rng.randbytes(rng.randrange(5))), ("litz", None, rng.randbytes(3))])) for k in range(120)]
    kind = pa.struct([("kind", pa.string()), ("block_no", pa.int64()), ("bytes", pa.binary())])
    batch = pa.record_batch([pa.array([p for p, _, _ in ops]), pa.array([n for _, n, _ in ops], pa.int64()), pa.array([dict(zip(("kind", "block_no", "bytes"), op, strict=True)) for _, _, op in ops], kind)], ["path", "n", "op"])
    rows = [r for part in filedeltas._packed(iter([batch.slice(0, 50), batch.slice(50)])) for r in part.to_pylist()]
    got = [(r["path"], r["n"] + i, op) for r in rows for i, op in enumerate(filedeltas._unpacked(r["codes"], r["data"]))]
    assert got == ops and len(rows) < 60


def test_a_file_with_another_hash_is_not_seen(spark, tmp_path):
    (tmp_path / "old").write_bytes(b"a" * 100)
    ops = spark.createDataFrame([("x", 0, ("copy", 0, None)), ("x", 1, ("litz", None, bytearray(blocks.deflate(b"b" * 400)))), ("x", 2, ("copy", 1, None)), ("y", 0, ("lit", None, bytearray(b"q"))), ("z", 0, ("lit", None, bytearray(b"not announced")))], "path string, n long, op struct<kind:string,block_no:long,bytes:binary>")
    content = b"a" * 64 + b"b" * 400 + b"a" * 36
    told = spark.createDataFrame([("x", str(tmp_path / "old"), hashlib.sha256(content).hexdigest()), ("y", None, "0" * 64), ("empty", None, None)], "path string, uri string, hash string")
    got = {r.path: (r.len, r.outcome) for r in filedeltas.apply_deltas(ops, told, f"{tmp_path}/root", SIZE).collect()}
    assert got == {"x": (500, "written"), "y": (1, "other content"), "empty": (0, "written")}
    assert sorted(p.name for p in (tmp_path / "root").iterdir()) == ["empty", "x"] and (tmp_path / "root" / "x").read_bytes() == content


def test_a_file_larger_than_the_memory_limit_is_rebuilt(tmp_path):
    """In a process that may not allocate as much as the file has."""
    code = f"""
import resource, sys
sys.path[:0] = {sys.path!r}
from driftmerge.operators import filedeltas
held = filedeltas.Rebuilt({str(tmp_path)!r}, "new", {str(tmp_path / "old")!r}, None, 4096)
now = int(open("/proc/self/statm").read().split()[0]) * resource.getpagesize()
resource.setrlimit(resource.RLIMIT_AS, (now + (96 << 20),) * 2)
for k in range(1 << 16):
    held.add("copy", k, None)
held.add("lit", None, b"end")
print(held.close()[1:3])
"""
    block = bytes(range(256)) * 16
    with open(tmp_path / "old", "wb") as f:
        for _ in range(1 << 16):
            f.write(block)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    digest = hashlib.sha256()
    for _ in range(1 << 16):
        digest.update(block)
    digest.update(b"end")
    assert out.stdout.strip() == repr(((256 << 20) + 3, digest.hexdigest())), out.stderr
    assert (tmp_path / "new").stat().st_size == (256 << 20) + 3
    (tmp_path / "old").unlink()
    (tmp_path / "new").unlink()


def test_signatures_as_a_cell_a_file(spark, tmp_path):
    files = []
    for k in range(300):
        (tmp_path / f"{k}").write_bytes(b"%d" % k * 20)
        files.append((f"p/{k}", str(tmp_path / f"{k}")))
    frame = spark.createDataFrame(files, "path string, uri string").coalesce(1)
    cells = {r.path: r.sigs for r in blocks.signed_files(frame, SIZE).collect()}
    rows = blocks.signed_rows(blocks.file_signatures(frame, SIZE)).collect()
    assert {r.path: r.sigs for r in rows} == cells and len(cells) == 300
    ops = filedeltas.ranged_deltas(frame, blocks.signed_files(frame, SIZE), SIZE, span=200)
    got = filedeltas.apply_deltas(ops, frame.withColumn("hash", F.lit(None).cast("string")), str(tmp_path / "out"), SIZE).collect()
    assert {r.path: r.len for r in got} == {f"p/{k}": len(b"%d" % k * 20) for k in range(300)}
