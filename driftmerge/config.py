"""Settings of a replica, and its identity."""

from __future__ import annotations

import secrets
from dataclasses import dataclass

from pyspark.sql import SparkSession

from driftmerge.sources import tables


@dataclass(frozen=True)
class Settings:
    """Times in milliseconds. The defaults are fixed values of the model."""

    debounce_ms: int = 40
    #: How long a touch of content that we wrote is taken for our own.
    echo_ms: int = 10_000
    report_ms: int = 30_000
    save_ms: int = 2_000
    #: Tombstones that a document needs to be compacted, and how often is looked.
    compact_after: int = 4_096
    compact_ms: int = 30_000
    retry_ms: int = 1_000
    longest_retry_ms: int = 30_000
    #: Files of a micro-batch: what bounds how far a source may run ahead.
    files_per_batch: int | None = None

    @property
    def hold_ms(self) -> int:
        """How long a delete is held back, in case the file returns."""
        return max(3 * self.debounce_ms, 60)


def peer_id(spark: SparkSession, path: str, name: str) -> int:
    """The identity of a named replica: drawn once, kept in a state table, positive so that signed order is right."""
    known = tables.load_state(spark, path, "name string, peer long")
    row = known.filter(known.name == name).first()
    if row:
        return row.peer
    peer = secrets.randbits(62) | 1
    tables.save_state(known.union(spark.createDataFrame([(name, peer)], "name string, peer long")), path)
    return peer
