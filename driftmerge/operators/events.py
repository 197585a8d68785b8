"""Event-stream logic on event time: debounce, echo suppression, rename pairing, reports and relays.

All windows are per path, so no operator gathers the whole stream in one task.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftmerge.config import Settings
from driftmerge.sources.shared import materialize


def touched(raw: DataFrame) -> DataFrame:
    """(ts, path, kind) of raw events (ts, path, kind, is_dir, exists): accesses and folders go; what exists was touched."""
    kept = raw.filter("kind <> 'access' and not is_dir")
    return kept.select("ts", "path", F.when(F.col("exists"), "touched").otherwise("removed").alias("kind"))


def debounce(events: DataFrame, gap: str) -> DataFrame:
    """The last event of each burst of a path, (path, ts, kind, n): a pause of at least `gap` ends a burst."""
    by = W.partitionBy("path").orderBy("ts", "event_id")
    new = F.coalesce(F.col("ts") - F.lag("ts").over(by) >= F.expr(f"interval {gap}"), F.lit(True))
    runs = events.withColumn("burst", F.sum(F.when(new, 1).otherwise(0)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("path", "burst").agg(F.max("ts").alias("ts"), F.max_by("kind", F.struct("ts", "event_id")).alias("kind"), F.count("*").alias("n")).drop("burst")


def unechoed(touches: DataFrame, writes: DataFrame, within: str) -> DataFrame:
    """Touches that aren't our own writes: the n-th touch of a (path, hash) uses up the n-th write, if it is recent."""
    by = lambda: W.partitionBy("path", "hash").orderBy("ts", "event_id")
    a = touches.withColumn("nth", F.row_number().over(by()))
    b = writes.withColumn("nth", F.row_number().over(by())).select("path", "hash", "nth", F.col("ts").alias("w_ts"))
    recent = (F.col("ts") >= F.col("w_ts")) & (F.col("ts") <= F.col("w_ts") + F.expr(f"interval {within}"))
    return a.join(b, (a.path == b.path) & (a.hash == b.hash) & (a.nth == b.nth) & recent, "left_anti").drop("nth")


def recent_writes(writes: DataFrame, most: int = 16) -> DataFrame:
    """The last `most` own writes of each path."""
    return writes.withColumn("nth", F.row_number().over(W.partitionBy("path").orderBy(F.desc("ts"), F.desc("event_id")))).filter(F.col("nth") <= most).drop("nth")


def rename_candidates(removes: DataFrame, creates: DataFrame, within: str) -> DataFrame:
    """Pairs of a remove and a later create of the same hash within the window.

    Times are dealt to spans of twice the window (a day may have 25 hours), so a create's remove is of its span or of the one before, and a hash isn't held against all its events.
    """
    wide = F.expr(f"greatest(2 * unix_micros(timestamp_micros(0) + interval {within}), 1)")
    span = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / wide).cast("long")
    a, b = removes.withColumn("span", F.explode(F.array(span, span + 1))).alias("a"), creates.withColumn("span", span).alias("b")
    near = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.span") == F.col("b.span")) & (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"interval {within}"))
    return a.join(b, near).select("a.hash", F.col("a.event_id").alias("removed"), F.col("b.event_id").alias("created"))


def rename_pairs(removes: DataFrame, creates: DataFrame, within_us: int) -> DataFrame:
    """Each create takes the first pending remove of its hash, and each is used once: (hash, removed, created).

    One pass over rows sorted by (hash, time); pending removes of one hash within the window are all that is held.
    """
    rows = removes.select("hash", "ts", F.lit(0).alias("side"), "event_id").unionByName(creates.select("hash", "ts", F.lit(1).alias("side"), "event_id"))
    rows = rows.select("hash", F.unix_micros("ts").alias("us"), "side", "event_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pending = None, deque()
        for batch in batches:
            out = []
            for hash_, us, side, ident in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if hash_ != key:
                    key, pending = hash_, deque()
                while pending and us - pending[0][0] > within_us:
                    pending.popleft()
                if side == 0:
                    pending.append((us, ident))
                elif pending:
                    out.append((hash_, pending.popleft()[1], ident))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in (list(zip(*out, strict=True)) or [[]] * 3)], ["hash", "removed", "created"])

    return rows.repartition("hash").sortWithinPartitions("hash", "us", "side", "event_id").mapInArrow(run, "hash long, removed long, created long")


def throughput(events: DataFrame, width: str = "30 seconds") -> DataFrame:
    """(path, at, n): events per tumbling window, only where the count differs from the window before it."""
    counts = events.groupBy("path", F.window("ts", width).alias("w")).agg(F.count("*").alias("n")).select("path", F.col("w.start").alias("at"), "n")
    before = F.lag("n").over(W.partitionBy("path").orderBy("at"))
    return counts.withColumn("before", before).filter("before is null or before <> n").drop("before")


def suppressed(events: DataFrame) -> DataFrame:
    """(path, ts, kind, suppressed): equal neighbours are one row, which says how many it stands for besides itself."""
    by = W.partitionBy("path").orderBy("ts", "event_id")
    runs = events.withColumn("new", ~F.lag("kind").over(by).eqNullSafe(F.col("kind"))).withColumn("run", F.sum(F.col("new").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("path", "run").agg(F.min("ts").alias("ts"), F.min("kind").alias("kind"), (F.count("*") - 1).alias("suppressed")).drop("run")


def percentiles(samples: DataFrame, ranks: tuple[float, ...] = (0.5, 0.9, 0.99, 1.0)) -> DataFrame:
    """(label, p, value): the value at place round((n - 1) p) of the sorted samples (label, value).

    Equal values are counted before the window, so a hot label costs its distinct values.
    """
    counts = samples.groupBy("label", "value").agg(F.count("*").alias("c"))
    by = W.partitionBy("label").orderBy("value")
    run = counts.withColumn("upto", F.sum("c").over(by.rowsBetween(W.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(W.partitionBy("label")))
    asked = run.withColumn("p", F.explode(F.array(*map(F.lit, ranks))))
    place = F.round((F.col("n") - 1) * F.col("p")).cast("long")
    return asked.filter((place < F.col("upto")) & (place >= F.col("upto") - F.col("c"))).select("label", "p", "value")


#: Hops that one round of reach() follows.
STRIDE = 4


def reach(edges: DataFrame, source: int) -> DataFrame:
    """(topology, peer, hops): how a message from `source` floods along edges (topology, src, dst), each peer once.

    A round follows the links of the peers that the last one reached by its last hop, a few hops at a time, each hop's
    peers once, and leaves out those that are known. So the work is the number of links, in sparse and in dense
    topologies, and there are a quarter as many rounds as hops.
    """
    ways = materialize(edges.select("topology", F.col("src").cast("long").alias("peer"), F.col("dst").cast("long").alias("dst")).distinct(), "links")
    seen = last = materialize(ways.select("topology", F.lit(source).cast("long").alias("peer"), F.lit(0).cast("long").alias("hops")).distinct(), "reached")
    base = 0
    while True:
        level, found = last, []
        for k in range(1, STRIDE + 1):
            level = level.join(ways, ["topology", "peer"]).select("topology", F.col("dst").alias("peer")).distinct()
            found.append(level.withColumn("hops", F.lit(base + k).cast("long")))
        both = reduce(DataFrame.unionByName, found).groupBy("topology", "peer").agg(F.min("hops").alias("hops"))
        new = materialize(both.join(seen, ["topology", "peer"], "left_anti"), "reached")
        seen, base = seen.unionByName(new), base + STRIDE
        last = new.filter(F.col("hops") == base).select("topology", "peer")
        if last.isEmpty():
            return seen


def backoff(attempts: DataFrame, settings: Settings = Settings()) -> DataFrame:  # noqa: B008  frozen
    """(path, event_id, attempt, delay_ms) of each failed attempt (path, ts, event_id, failed): the pause before the next one, without jitter.

    It doubles with each failure in a row, up to the longest; what doesn't fail starts over.
    """
    by = W.partitionBy("path").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    rows = attempts.withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(by))
    nth = F.row_number().over(W.partitionBy("path", "run").orderBy("ts", "event_id")).cast("long")
    failed = rows.filter("failed").withColumn("attempt", nth)
    # Beyond 30 doublings the longest pause holds anyway.
    return failed.select("path", "event_id", "attempt", F.least(F.lit(settings.retry_ms) * F.pow(F.lit(2), F.least("attempt", F.lit(30))).cast("long"), F.lit(settings.longest_retry_ms)).cast("long").alias("delay_ms"))


def admission(links: DataFrame) -> DataFrame:
    """The links with what comes of them (`result`), by whether our side (`ours`) and the other (`theirs`) ask for a secret: both "prove" it, none leaves the link "open", else "reject"."""
    return links.withColumn("result", F.when(F.col("ours") != F.col("theirs"), "reject").when(F.col("ours"), "prove").otherwise("open"))
