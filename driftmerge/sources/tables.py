"""Table access, file scans, state and file sinks. All of them go through Spark, so any store that Spark reads will do."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.functions import paths
from driftmerge.sources.folders import scan_files, store_of
from driftmerge.sources.shared import materialize

__all__ = ["delete_files", "load_rules", "load_state", "save_state", "scan_files", "table", "write_files"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_rules(spark: SparkSession, path: str) -> list[str]:
    """A rule file's patterns after the built-in ones: trimmed, without blanks, comments and trailing slashes."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    rows = lines.select(F.regexp_replace("value", "/+$", "").alias("value"))
    return [*paths.BUILT_IN, *(r.value for r in rows.collect())]


def _files(spark: SparkSession, path: str):  # noqa: ANN202  Hadoop's file system and a path in it
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def save_state(df: DataFrame, path: str) -> None:
    """Persisted state: a new version beside the old one, then a pointer to it, so readers see one or the other whole.

    The version before stays for those who still read it; older ones go.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    before = _current(spark, path)
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.parquet(f"{path}/pointer-{version}")
    fs, where = _files(spark, path)
    new, old = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{x}") for x in (f"pointer-{version}", "pointer"))
    if fs.exists(old):
        fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"couldn't publish {version} of {path}")
    for status in fs.listStatus(where):
        if status.getPath().getName() not in ("pointer", version, before):
            fs.delete(status.getPath(), True)


def _current(spark: SparkSession, path: str) -> str | None:
    """The version that a state's pointer names, or that of a pointer that a crash left unpublished."""
    fs, where = _files(spark, path)
    if not fs.exists(where):
        return None
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().startswith("pointer"))
    return spark.read.schema("version string").parquet(f"{path}/{names[0]}").first().version if names else None


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last saved state; an empty one, with a warning, if there is none or it can't be read.

    The state is read once to find damage now and not later, in a query.
    """
    try:
        version = _current(spark, path)
        if version is None:
            return spark.createDataFrame([], schema)
        state = spark.read.schema(schema).parquet(f"{path}/{version}")
        state.write.format("noop").mode("overwrite").save()
        return state
    except Exception as e:  # noqa: BLE001  any way in which files can be damaged
        spark.sparkContext._jvm.org.apache.logging.log4j.LogManager.getLogger("driftmerge").warn(f"state at {path} can't be read, starting with none: {type(e).__name__}")
        return spark.createDataFrame([], schema)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Writes (path, content) below root, each file whole or not at all, and returns our writes (path, hash, ts).

    Executors write to the store's paths themselves, by a temporary name that is renamed; a task that runs twice
    writes the same bytes twice. Paths that would leave the root are refused. What comes back is what ``unechoed``
    and ``unwritten`` need to know our own changes. Use ``recent_writes`` to keep the last ones of each path.
    """
    unsafe = files.filter(~paths.is_safe(F.col("path"))).limit(1).collect()
    if unsafe:
        raise ValueError(f"{unsafe[0].path!r} is outside the root")

    def run(batches):  # noqa: ANN001, ANN202
        store, base = store_of(root)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                target = f"{base}/{path}"
                if (folder := target.rpartition("/")[0]) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{target}.dmtmp{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_py() or b"")
                store.move(part, target)
            yield pa.record_batch([batch.column(0), batch.column(2)], ["path", "hash"])

    rows = files.select("path", F.coalesce("content", F.lit(b"")).alias("content"), F.sha2(F.coalesce("content", F.lit(b"")), 256).alias("hash"))
    done = rows.mapInArrow(run, T.StructType([T.StructField("path", T.StringType()), T.StructField("hash", T.StringType())]))
    return materialize(done.withColumn("ts", F.current_timestamp()), "writes")  # the writing happens here, once


def delete_files(files: DataFrame, root: str) -> None:
    """Deletes the files (path) below root; those that are gone already are fine."""
    if not files.filter(~paths.is_safe(F.col("path"))).isEmpty():
        raise ValueError("a path is outside the root")

    def run(batches):  # noqa: ANN001, ANN202
        store, base = store_of(root)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                if store.get_file_info(f"{base}/{path}").type == pafs.FileType.File:
                    store.delete_file(f"{base}/{path}")
            yield batch

    files.select("path").mapInArrow(run, "path string").write.format("noop").mode("overwrite").save()
