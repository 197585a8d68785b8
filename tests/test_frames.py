import io
import struct

import pytest
from pyspark.sql import functions as F

from driftmerge.sources import frames


def test_frames_round_trip_in_several_tasks(spark, tmp_path):
    rows = spark.range(500).select("id", F.encode(F.concat(F.col("id").cast("string"), F.lit(" é"), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int"))), "utf-8").alias("payload")).repartition(3)
    frames.write_frames(rows, f"{tmp_path}/out", split=1000)
    back = frames.read_frames(spark, f"{tmp_path}/out")
    assert sorted(bytes(r.payload) for r in back.collect()) == sorted(bytes(r.payload) for r in rows.collect())
    assert back.rdd.getNumPartitions() > 6
    # Without an index, a file is one task's; offsets are where frames start.
    for f in (tmp_path / "out").glob("*.index"):
        f.unlink()
    again = frames.read_frames(spark, f"{tmp_path}/out")
    assert again.rdd.getNumPartitions() == 3 and again.count() == 500
    for r in again.limit(20).collect():
        data = (tmp_path / "out" / r.file).read_bytes()
        assert data[r.offset : r.offset + 4 + len(r.payload)] == frames.framed(bytes(r.payload))
    one = next((tmp_path / "out").glob("*.frames"))
    assert frames.read_frames(spark, str(one)).count() == again.filter(F.col("file") == one.name).count()


def test_appended_overwritten_empty_and_null(spark, tmp_path):
    two = spark.createDataFrame([(bytearray(b"a"),), (None,)], "payload binary")
    for mode, n in (("append", 2), ("append", 4), ("overwrite", 2)):
        frames.write_frames(two, f"{tmp_path}/out", mode)
        got = sorted(bytes(r.payload) for r in frames.read_frames(spark, f"{tmp_path}/out").collect())
        assert got == sorted([b"", b"a"] * (n // 2))
    frames.write_frames(two.limit(0), f"{tmp_path}/none")
    assert frames.read_frames(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(Exception, match="none2|No such|not found"):
        frames.read_frames(spark, f"{tmp_path}/none2").count()


def test_what_is_too_large_is_refused(spark, tmp_path):
    big = spark.createDataFrame([(bytearray(b"x" * 100),)], "payload binary")
    with pytest.raises(Exception, match="too large"):
        frames.write_frames(big, f"{tmp_path}/out", most=99)
    assert not list((tmp_path / "out").glob("*.frames"))
    (tmp_path / "bad.frames").write_bytes(frames.framed(b"fine") + struct.pack(">I", frames.MOST + 1) + b"x")
    with pytest.raises(Exception, match="the frame at 8 announces 67108865 bytes"):
        frames.read_frames(spark, f"{tmp_path}/bad.frames").count()


def test_no_body_is_read_for_an_announcement_beyond_the_bound():
    class Counted(io.BytesIO):
        asked = 0

        def read(self, n=-1):
            self.asked = max(self.asked, n)
            return super().read(n)

    f = Counted(struct.pack(">I", 1 << 31))
    with pytest.raises(ValueError):
        list(frames.unframed(f, 0, 4))
    assert f.asked == 4
    for cut in (b"\0\0", frames.framed(b"abc")[:-1]):
        with pytest.raises(EOFError):
            list(frames.unframed(io.BytesIO(cut), 0, len(cut)))
