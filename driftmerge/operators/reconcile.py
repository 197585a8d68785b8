"""Replica reconciliation: manifests, last writer wins, lineages, agreement and compaction. Joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmerge.functions.paths import conflict_name


def compare(remote: DataFrame, local: DataFrame) -> DataFrame:
    """(path, status) of every remote manifest row (path, hash, base): agreed, differs or missing locally."""
    mine = local.select("path", F.col("hash").alias("l_hash"), F.col("base").alias("l_base"))
    same = (F.col("hash") == F.col("l_hash")) & (F.col("base") == F.col("l_base"))
    return remote.join(mine, "path", "left").select("path", F.when(F.col("l_hash").isNull(), "missing").when(same, "agreed").otherwise("differs").alias("status"))


def wanted(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote rows to ask for: those that aren't held with the same base and hash."""
    return remote.join(local.select("path", "base", "hash"), ["path", "base", "hash"], "left_anti")


def serve(state: DataFrame, requested: DataFrame) -> DataFrame:
    """State of the requested paths that exist."""
    return state.join(requested.select("path").distinct(), "path", "left_semi")


def binary_meta(remote: DataFrame, local: DataFrame, local_peer: int) -> DataFrame:
    """(path, action, version) for remote rows (path, hash, version, peer): pull, keep or reject.

    Equal bytes keep the larger version; else the larger (version, peer) wins.
    """
    mine = local.select("path", F.col("hash").alias("l_hash"), F.col("version").alias("l_version"))
    both = remote.join(mine, "path", "left")
    ours = F.struct(F.col("l_version"), F.lit(local_peer).cast("long").alias("peer")) > F.struct(F.col("version").alias("l_version"), F.col("peer"))
    action = F.when(F.col("l_hash").isNull(), "pull").when(F.col("l_hash") == F.col("hash"), "keep").when(ours, "reject").otherwise("pull")
    version = F.when(F.col("l_hash") == F.col("hash"), F.greatest("version", "l_version")).when(ours, F.col("l_version")).otherwise(F.col("version"))
    return both.select("path", action.alias("action"), version.alias("version"))


def last_writer(rows: DataFrame) -> DataFrame:
    """(path, hash, version) of the largest (version, peer)."""
    return rows.groupBy("path").agg(F.max_by("hash", F.struct("version", "peer")).alias("hash"), F.max("version").alias("version"))


def lineages(rows: DataFrame) -> DataFrame:
    """Contents at several paths, with the lowest base and its path: (hash, paths, base, path)."""
    return rows.groupBy("hash").agg(F.count("*").alias("paths"), F.min("base").alias("base"), F.min_by("path", F.struct("base", "path")).alias("path")).filter("paths > 1")


def unanimous(ours: DataFrame, reports: DataFrame, peers: DataFrame) -> DataFrame:
    """Our rows (path, hash, base) that every peer reports exactly so; a missing report is a no.

    Counting agreeing peers replaces the product of peers and paths.
    """
    agreeing = reports.join(ours.select("path", "hash", "base"), ["path", "hash", "base"], "left_semi").groupBy("path").agg(F.count_distinct("peer").alias("yes"))
    number = peers.agg(F.count_distinct("peer").alias("all"))
    return ours.join(agreeing, "path").join(F.broadcast(number), F.col("yes") == F.col("all")).drop("yes", "all")  # one row


def absent(known: DataFrame, live: DataFrame) -> DataFrame:
    """Known peers that aren't connected: compaction waits while there are any."""
    return known.select("peer").distinct().join(live.select("peer").distinct(), "peer", "left_anti")


def unwritten(touches: DataFrame, writes: DataFrame) -> DataFrame:
    """Touches (path, hash, ...) whose content we never wrote there ourselves; a write stops any number of them."""
    return touches.join(writes.select("path", "hash"), ["path", "hash"], "left_anti")


def compaction(sizes: DataFrame, least: int) -> DataFrame:
    """Paths (path, n_raw, n_deleted) with at least `least` tombstones that are at least half of all elements."""
    return sizes.filter((F.col("n_deleted") >= least) & (F.col("n_deleted") * 2 >= F.col("n_raw")))


def snapshot_outcome(remote: DataFrame, local: DataFrame, remote_peer: int, local_peer: int) -> DataFrame:
    """(path, outcome, conflict) for remote snapshots (path, hash, base, mtime).

    Unknown paths are adopted, one lineage is merged. Of two lineages the lower base stays: a higher remote one is
    ignored, a lower one adopted, and then the larger (mtime, peer) decides whose content survives; ours goes to a
    conflict copy if it loses.
    """
    mine = local.select("path", F.col("hash").alias("l_hash"), F.col("base").alias("l_base"), F.col("mtime").alias("l_mtime"))
    both = remote.join(mine, "path", "left")
    ours = (F.col("l_mtime") > F.col("mtime")) | ((F.col("l_mtime") == F.col("mtime")) & F.lit(local_peer > remote_peer))
    outcome = (
        F.when(F.col("l_base").isNull(), "adopt").when(F.col("base") == F.col("l_base"), "merge").when(F.col("base") > F.col("l_base"), "ignore")
        .when(F.col("hash") == F.col("l_hash"), "adopt-same").when(ours, "rebase").otherwise("conflict")
    )
    return both.select("path", outcome.alias("outcome")).select("path", "outcome", F.when(F.col("outcome") == "conflict", conflict_name(F.col("path"), F.lit(local_peer).cast("long"))).alias("conflict"))


def accept_checkpoint(announced: DataFrame, local: DataFrame) -> DataFrame:
    """Announced rows (path, hash, base) to adopt: our text is the announced one and our base another."""
    mine = local.select("path", "hash", F.col("base").alias("l_base"))
    return announced.join(mine, ["path", "hash"]).filter("base <> l_base").drop("l_base")
