"""Registered queries over the test tables, each with the DuckDB SQL that says the same, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.functions import paths, scalars
from driftmerge.operators import blocks, codec, diffing, documents, events, reconcile, sequence
from driftmerge.sources import replicas as R
from driftmerge.sources.shared import dealt, materialize
from driftmerge.sources.tables import table
from driftmerge.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SIZE = 64


def query(sql: str | None = None) -> Callable[[Callable[[SparkSession, str], DataFrame]], Callable[[SparkSession, str], DataFrame]]:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


A, B, BASE, CHARS, OPS = R.SQL_A, R.SQL_B, R.SQL_BASE, R.SQL_CHARS, R.SQL_OPS
MAN_A = f"SELECT path, doc_id, sha256(text) AS hash, {BASE} AS base FROM ({A})"
MAN_B = f"SELECT path, doc_id, sha256(text) AS hash, {BASE} AS base FROM ({B})"


def man_a(spark: SparkSession, d: str) -> DataFrame:
    return R.manifest(R.replica_a(spark, d))


def man_b(spark: SparkSession, d: str) -> DataFrame:
    return R.manifest(R.replica_b(spark, d))


# Manifests and reconciliation


@query(f"SELECT path, hash, base FROM ({MAN_A})")
def manifest_text(spark: SparkSession, d: str) -> DataFrame:
    return man_a(spark, d).select("path", "hash", "base")


DIFF = f"SELECT a.path, CASE WHEN b.hash IS NULL THEN 'missing' WHEN a.hash = b.hash AND a.base = b.base THEN 'agreed' ELSE 'differs' END AS status FROM ({MAN_A}) a LEFT JOIN ({MAN_B}) b ON a.path = b.path"


@query(DIFF)
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.compare(man_a(spark, d), man_b(spark, d))


@query(f"SELECT status, count(*) AS n FROM ({DIFF}) GROUP BY status")
def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return manifest_diff(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT a.path, a.hash, length(d.text) AS n FROM ({MAN_A}) a JOIN ({A}) d ON a.path = d.path LEFT JOIN ({MAN_B}) b ON a.path = b.path AND a.hash = b.hash AND a.base = b.base WHERE b.path IS NULL")
def snapshot_request(spark: SparkSession, d: str) -> DataFrame:
    a = R.replica_a(spark, d)
    asked = reconcile.wanted(R.manifest(a), man_b(spark, d))
    return reconcile.serve(a.select("path", F.sha2("text", 256).alias("hash"), F.char_length("text").cast("long").alias("n")), asked)


@query(f"SELECT hash, count(*) AS paths, min(base) AS base, arg_min(path, base) AS path FROM ({MAN_A}) GROUP BY hash HAVING count(*) > 1")
def lineage_groups(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.lineages(man_a(spark, d))


VERSIONS = "length(text) % 5"


@query(f"""SELECT r.path, CASE WHEN l.hash IS NULL THEN 'pull' WHEN l.hash = r.hash THEN 'keep' WHEN l.version > r.version THEN 'reject' ELSE 'pull' END AS action,
  CASE WHEN l.hash = r.hash THEN greatest(l.version, r.version) WHEN l.version > r.version THEN l.version ELSE r.version END AS version
  FROM (SELECT path, sha256(text) AS hash, (length(text) + doc_id) % 5 AS version FROM ({A})) r LEFT JOIN (SELECT path, sha256(text) AS hash, length(text) % 5 AS version FROM ({B})) l ON r.path = l.path""")
def binary_meta_lww(spark: SparkSession, d: str) -> DataFrame:
    remote = R.replica_a(spark, d).select("path", F.sha2("text", 256).alias("hash"), ((F.char_length("text") + F.col("doc_id")) % 5).cast("long").alias("version"), F.lit(2).cast("long").alias("peer"))
    local = R.replica_b(spark, d).select("path", F.sha2("text", 256).alias("hash"), (F.char_length("text") % 5).cast("long").alias("version"))
    return reconcile.binary_meta(remote, local, 1)


@query(f"""SELECT path, arg_max(hash, version * 10 + peer) AS hash, max(version) AS version FROM (
  SELECT path, sha256(text) AS hash, (length(text) + doc_id) % 5 AS version, 2 AS peer FROM ({A}) UNION ALL SELECT path, sha256(text), length(text) % 5, 1 FROM ({B})) GROUP BY path""")
def last_writer_wins(spark: SparkSession, d: str) -> DataFrame:
    a = R.replica_a(spark, d).select("path", F.sha2("text", 256).alias("hash"), ((F.char_length("text") + F.col("doc_id")) % 5).cast("long").alias("version"), F.lit(2).cast("long").alias("peer"))
    b = R.replica_b(spark, d).select("path", F.sha2("text", 256).alias("hash"), (F.char_length("text") % 5).cast("long").alias("version"), F.lit(1).cast("long").alias("peer"))
    return reconcile.last_writer(a.unionByName(b))


@query("SELECT DISTINCT user_id AS peer FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-30 00:00:00')")
def known_peers_missing(spark: SparkSession, d: str) -> DataFrame:
    """Users who were seen, but didn't sign up in the last days."""
    e = table(spark, d, "events").select(F.col("user_id").alias("peer"), "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return reconcile.absent(e, e.filter("event_type = 'signup' and ts >= timestamp '2024-01-30 00:00:00'"))


@query(f"SELECT a.path, a.hash, a.base FROM ({MAN_A}) a JOIN ({MAN_B}) b ON a.path = b.path AND a.hash = b.hash AND a.base = b.base")
def unanimous_paths(spark: SparkSession, d: str) -> DataFrame:
    a, b = man_a(spark, d), man_b(spark, d)
    reports = a.select(F.lit(2).alias("peer"), "path", "hash", "base").unionByName(b.select(F.lit(3).alias("peer"), "path", "hash", "base"))
    return reconcile.unanimous(a.select("path", "hash", "base"), reports, spark.createDataFrame([(2,), (3,)], "peer int"))


THINNED = "clock % (2 + doc_id % 3) <> 0"


@query(f"""SELECT s.path, n_raw, n_deleted FROM (SELECT path, count(*) AS n_raw, count_if({THINNED}) AS n_deleted FROM ({CHARS}) GROUP BY path) s
  JOIN ({MAN_A}) a ON s.path = a.path JOIN ({MAN_B}) b ON a.path = b.path AND a.hash = b.hash AND a.base = b.base WHERE n_deleted >= 256 AND n_deleted * 2 >= n_raw""")
def compaction_candidates(spark: SparkSession, d: str) -> DataFrame:
    sizes = sequence.sizes(R.element_runs(R.replica_a(spark, d), THINNED)).select("path", "n_raw", "n_deleted")
    return reconcile.serve(reconcile.compaction(sizes, 256), unanimous_paths(spark, d))


@query(f"""SELECT path, outcome, CASE WHEN outcome = 'conflict' THEN path || '.conflict-00000007' END AS conflict FROM (
  SELECT r.path, CASE WHEN l.base IS NULL THEN 'adopt' WHEN r.base = l.base THEN 'merge' WHEN r.base > l.base THEN 'ignore' WHEN r.hash = l.hash THEN 'adopt-same'
    WHEN l.doc_id * 613 % 977 > r.doc_id * 331 % 977 THEN 'rebase' ELSE 'conflict' END AS outcome
  FROM ({MAN_A}) r LEFT JOIN ({MAN_B}) l ON r.path = l.path)""")
def snapshot_outcome(spark: SparkSession, d: str) -> DataFrame:
    remote = man_a(spark, d).withColumn("mtime", F.col("doc_id") * 331 % 977)
    local = man_b(spark, d).withColumn("mtime", F.col("doc_id") * 613 % 977)
    return reconcile.snapshot_outcome(remote, local, 9, 7)


@query(f"SELECT a.path, a.hash, a.base + 2 AS base FROM ({MAN_A}) a JOIN ({MAN_B}) b ON a.path = b.path AND a.hash = b.hash")
def checkpoint_accept(spark: SparkSession, d: str) -> DataFrame:
    announced = man_a(spark, d).select("path", "hash", (F.col("base") + 2).alias("base"))
    return reconcile.accept_checkpoint(announced, man_b(spark, d))


# Paths and small tables

RULES = ["en/*", "*5", "**/x*", "fr", "de/1??"]


@query(r"""SELECT page_id, p AS path FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^?#]*)', 1) AS p FROM pages) WHERE p <> ''
  AND NOT regexp_matches(p, '^(?:en/[^/]*|.*/x[^/]*|de/1[^/][^/])(?:/.*)?$', 's') AND NOT regexp_matches(p, '(?:^|/)(?:[^/]*5|fr|\.driftmerge|\.git|\.DS_Store|[^/]*\.swp|[^/]*\.swx|[^/]*~|\.#[^/]*|[^/]*\.dmtmp[^/]*|[^/]*\.tmp)(?:/|$)', 's')""")
def ignore_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://[^/]+/([^?#]*)", 1).alias("path")).filter("path <> ''")
    return p.filter(~paths.ignored(F.col("path"), [*paths.BUILT_IN, *RULES]))


@query(f"SELECT path, unicode(right(text, 1)) > 127 AS cut_is_binary, FALSE AS is_binary FROM ({A}) WHERE text <> ''")
def classify_binary(spark: SparkSession, d: str) -> DataFrame:
    b = R.replica_a(spark, d).filter("text <> ''").select("path", F.col("text").cast("binary").alias("content"))
    cut = F.substring(F.col("content"), F.lit(1), F.length("content") - 1)
    return b.select("path", scalars.is_binary(cut).alias("cut_is_binary"), scalars.is_binary(scalars.sniffed(F.col("content"))).alias("is_binary"))


@query("""SELECT doc_id, CASE WHEN len <= 131072000 THEN 4096 ELSE least(greatest(CAST(pow(2, ceil(log2(len // 32000))) AS BIGINT), 4096), 4194304) END AS block_size
  FROM (SELECT doc_id, strlen(text) * 1000003 AS len FROM documents)""")
def block_size_table(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", scalars.block_size(F.octet_length("text").cast("long") * 1000003).alias("block_size"))


@query("""WITH e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) AS attempt FROM e WHERE event_type = 'error')
  SELECT CAST(user_id AS VARCHAR) AS path, event_id, attempt, least(1000 * CAST(pow(2, least(attempt, 30)) AS BIGINT), 30000) AS delay_ms FROM n""")
def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """A user's errors in a row are failed attempts."""
    return events.backoff(by_user(spark, d).withColumn("failed", F.col("kind") == "error"))


@query("""SELECT DISTINCT o_custkey AS custkey, l_suppkey AS suppkey, c_acctbal >= 0 AS ours, s_acctbal >= 0 AS theirs, CASE WHEN (c_acctbal >= 0) <> (s_acctbal >= 0) THEN 'reject' WHEN c_acctbal >= 0 THEN 'prove' ELSE 'open' END AS result
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey""")
def admission_table(spark: SparkSession, d: str) -> DataFrame:
    """Customers and suppliers who trade are linked; who has money asks for a secret."""
    o, li = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("custkey")), table(spark, d, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("suppkey"))
    pairs = o.join(li, o.o_orderkey == li.l_orderkey).select("custkey", "suppkey").distinct()
    ours, theirs = table(spark, d, "customer").select(F.col("c_custkey").alias("custkey"), (F.col("c_acctbal") >= 0).alias("ours")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), (F.col("s_acctbal") >= 0).alias("theirs"))
    return events.admission(pairs.join(ours, "custkey").join(theirs, "suppkey"))


@query("SELECT o_orderkey, 'o/' || o_orderkey || '.conflict-' || lpad(lower(to_hex((o_orderkey * 2654435761) & 4294967295)), 8, '0') AS name FROM orders")
def conflict_names(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", paths.conflict_name(F.concat(F.lit("o/"), "o_orderkey"), F.col("o_orderkey") * 2654435761).alias("name"))


# Op logs and sequences


@query(f"SELECT path, count_if(kind = 'ins') AS ins, count_if(kind = 'del') AS del FROM ({OPS}) GROUP BY path")
def op_counts(spark: SparkSession, d: str) -> DataFrame:
    return sequence.op_counts(R.op_runs(R.replica_a(spark, d)))


@query(f"SELECT path, count(*) AS n_raw, count_if(NOT ({R.DELETED})) AS n_visible, count_if({R.DELETED}) AS n_deleted, max(clock) AS clock FROM ({CHARS}) GROUP BY path")
def doc_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sequence.sizes(R.element_runs(R.replica_a(spark, d), R.DELETED))


@query(f"""WITH o AS (SELECT *, lag(kind) OVER w AS pk, lag(clock) OVER w AS pc, lag(peer) OVER w AS pp FROM ({OPS}) WINDOW w AS (PARTITION BY path ORDER BY seq)),
  i AS (SELECT *, sum(CASE WHEN pk IS NOT NULL AND ((kind = 'del' AND pk = 'del') OR (kind = 'ins' AND pk = 'ins' AND peer = pp AND clock = pc + 1 AND o_clock IS NOT DISTINCT FROM pc AND o_peer IS NOT DISTINCT FROM pp)) THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seq) AS run FROM o)
  SELECT path, CAST(run AS BIGINT) AS run, CASE WHEN min(kind) = 'del' THEN 'dels' WHEN count(*) > 1 THEN 'run' ELSE 'ins' END AS kind, arg_min(clock, seq) AS clock, arg_min(CAST(peer AS BIGINT), seq) AS peer,
    sha256(coalesce(string_agg(ch, '' ORDER BY seq), '')) AS text_hash, count(*) AS n FROM i GROUP BY path, run""")
def run_compress(spark: SparkSession, d: str) -> DataFrame:
    w = sequence.compress(R.op_runs(R.replica_a(spark, d)))
    return w.select("path", "run", "kind", "clock", "peer", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"), "n")


@query(f"SELECT path, count(*) AS n, CAST(sum(clock * (1 + peer)) AS BIGINT) AS ids, CAST(sum(coalesce(o_clock, 0)) AS BIGINT) AS origins FROM ({OPS}) GROUP BY path")
def run_expand(spark: SparkSession, d: str) -> DataFrame:
    back = sequence.expand(sequence.compress(R.op_runs(R.replica_a(spark, d))))
    return back.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.col("clock") * (1 + F.col("peer"))).alias("ids"), F.sum(F.coalesce("o_clock", F.lit(0))).cast("long").alias("origins"))


ISLANDS = f"""WITH c AS (SELECT *, {R.DELETED} AS del, lag({R.DELETED}) OVER (PARTITION BY path ORDER BY clock) AS pd FROM ({CHARS})),
  i AS (SELECT *, sum(CASE WHEN pd IS NOT DISTINCT FROM del THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY clock) AS run FROM c),
  r AS (SELECT path, run, min(clock) AS clock, count(*) AS n, bool_or(del) AS del FROM i GROUP BY path, run),
  v AS (SELECT *, sum(n) OVER (PARTITION BY path ORDER BY clock) - n AS start FROM r WHERE NOT del)"""


@query(f"{ISLANDS} SELECT path, count(*) AS runs, CAST(sum(start) AS BIGINT) AS starts, CAST(max(start + n) AS BIGINT) AS n_visible FROM v GROUP BY path")
def visible_ranks(spark: SparkSession, d: str) -> DataFrame:
    v = sequence.visible(sequence.adopt(R.element_runs(R.replica_a(spark, d), R.DELETED)))
    return v.groupBy("path").agg(F.count("*").alias("runs"), F.sum("start").alias("starts"), F.max(F.col("start") + F.col("n")).alias("n_visible"))


@query(f"""{ISLANDS}, q AS (SELECT path, unnest([0, length(text) // 2, length(text) - 1]) AS rank FROM ({A}) WHERE text <> '')
  SELECT q.path, q.rank, CASE WHEN q.rank < v.start + v.n THEN v.clock + q.rank - v.start END AS clock, CASE WHEN q.rank < v.start + v.n THEN 1 END AS peer
  FROM q ASOF LEFT JOIN v ON q.path = v.path AND q.rank >= v.start""".replace("v.clock + q.rank - v.start", "CAST(v.clock + q.rank - v.start AS BIGINT)").replace("THEN 1 END AS peer", "THEN CAST(1 AS BIGINT) END AS peer"))
def rank_lookup(spark: SparkSession, d: str) -> DataFrame:
    a = R.replica_a(spark, d)
    n = F.char_length("text").cast("long")
    asked = a.filter("text <> ''").select("path", F.explode(F.array(F.lit(0).cast("long"), F.floor(n / 2), n - 1)).alias("rank"))
    return sequence.at_rank(asked, sequence.visible(sequence.adopt(R.element_runs(a, R.DELETED))))


@query(f"""{ISLANDS} SELECT q.path, q.clock, CAST(1 AS BIGINT) AS peer, r.clock AS run_clock, q.clock - r.clock AS "offset"
  FROM (SELECT path, 1 + doc_id * 31 % length(text) AS clock FROM ({A}) WHERE text <> '') q JOIN r ON q.path = r.path AND q.clock >= r.clock AND q.clock < r.clock + r.n""")
def locate_ids(spark: SparkSession, d: str) -> DataFrame:
    a = R.replica_a(spark, d)
    ids = a.filter("text <> ''").select("path", (F.col("doc_id") * 31 % F.char_length("text") + 1).alias("clock"), F.lit(1).cast("long").alias("peer"))
    return sequence.locate(ids, sequence.adopt(R.element_runs(a, R.DELETED)))


@query(f"SELECT path, count(*) AS n_raw, count_if({R.DELETED} OR {R.DELETED_B}) AS n_deleted, sha256(coalesce(string_agg(CASE WHEN {R.DELETED} OR {R.DELETED_B} THEN NULL ELSE ch END, '' ORDER BY clock), '')) AS text_hash FROM ({CHARS}) GROUP BY path")
def merge_snapshot(spark: SparkSession, d: str) -> DataFrame:
    a = R.replica_a(spark, d)
    both = sequence.merged_text(R.element_runs(a, R.DELETED), R.element_runs(a, R.DELETED_B))
    return both.select("path", "n_raw", "n_deleted", F.sha2("text", 256).alias("text_hash"))


LIVE = "list_filter(list_transform(range({a}, {z}), lambda i: CASE WHEN (i * 7 + doc_id) % 5 = 0 THEN NULL ELSE cs[i] END), lambda c: c IS NOT NULL)"


@query(f"""SELECT path, sha256(t) AS text_hash, length(t) AS n_visible, n + 10 AS n_raw FROM (SELECT path, n, array_to_string({LIVE.format(a='1', z='k + 1')}, '') || 'worldhello' || array_to_string({LIVE.format(a='k + 1', z='n + 1')}, '') AS t
  FROM (SELECT path, doc_id, string_split(text, '') AS cs, length(text) AS n, doc_id % length(text) + 1 AS k FROM ({A}) WHERE text <> ''))""")
def rga_text(spark: SparkSession, d: str) -> DataFrame:
    t = sequence.document_text(R.op_runs(R.replica_a(spark, d)))
    return t.select("path", F.sha2("text", 256).alias("text_hash"), F.char_length("text").cast("long").alias("n_visible"), "n_raw")


@query(f"SELECT path, count(*) AS n FROM ({OPS}) WHERE NOT (kind = 'ins' AND peer = 1) GROUP BY path")
def fresh_ops(spark: SparkSession, d: str) -> DataFrame:
    ops = R.op_runs(R.replica_a(spark, d))
    new = sequence.fresh_runs(ops.unionByName(ops.filter("peer > 1")), ops.filter("kind = 'ins' and peer = 1"))
    return new.groupBy("path").agg(F.sum("n").alias("n"))


@query(f"""WITH o AS (SELECT * FROM ({OPS})), l AS (SELECT * FROM o WHERE clock % 11 <> 5) SELECT l.path, count(*) AS n FROM l LEFT JOIN (SELECT path, clock, peer FROM l WHERE kind = 'ins') t
  ON t.path = l.path AND t.clock = CASE WHEN l.kind = 'del' THEN l.clock ELSE l.o_clock END AND t.peer = CASE WHEN l.kind = 'del' THEN l.peer ELSE l.o_peer END
  WHERE CASE WHEN l.kind = 'del' THEN l.clock ELSE l.o_clock END IS NOT NULL AND t.path IS NULL GROUP BY l.path""")
def causal_waiting(spark: SparkSession, d: str) -> DataFrame:
    lossy = R.without(R.op_runs(R.replica_a(spark, d)), "clock % 11 = 5")
    return sequence.blocked_runs(lossy).groupBy("path").agg(F.count("*").alias("n"))


@query(f"""SELECT path, count(*) AS n, CAST(sum(new_clock * clock) AS BIGINT) AS moved, sha256(string_agg(ch, '' ORDER BY clock)) AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY clock) AS new_clock FROM ({CHARS}) WHERE NOT ({R.DELETED})) GROUP BY path""")
def compact_renumber(spark: SparkSession, d: str) -> DataFrame:
    c = sequence.compact_runs(sequence.adopt(R.element_runs(R.replica_a(spark, d), R.DELETED)))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("clock", "text"))), lambda x: x["text"]), "")
    # Over a run of n characters: the sum of (clock + k) (old_clock + k).
    moved = F.expr("n * clock * old_clock + (clock + old_clock) * (n * (n - 1) div 2) + (n - 1) * n * (2 * n - 1) div 6")
    return c.groupBy("path").agg(F.sum("n").alias("n"), F.sum(moved).alias("moved"), F.sha2(text, 256).alias("text_hash"))


VAR = "(1 + CAST({x} >= 128 AS BIGINT) + CAST({x} >= 16384 AS BIGINT) + CAST({x} >= 2097152 AS BIGINT))"


@query(f"SELECT path, 1 + 1 + {VAR.format(x='n')} + n + CAST(sum(strlen(ch)) AS BIGINT) + 1 AS bytes FROM ({CHARS}) GROUP BY path, n")
def codec_size(spark: SparkSession, d: str) -> DataFrame:
    return codec.encoded_size(R.element_runs(R.replica_a(spark, d), R.DELETED))


@query(f"SELECT path, count(*) AS n, count_if({R.DELETED}) AS n_deleted, CAST(sum(clock * (1 + pos)) AS BIGINT) AS ids, CAST(sum(clock - 1) AS BIGINT) AS origins, sha256(string_agg(ch, '' ORDER BY clock)) AS text_hash FROM (SELECT *, clock AS pos FROM ({CHARS})) GROUP BY path")
def codec_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Elements as bytes and back: ids, order, origins, characters and liveness are what they were."""
    back = codec.decoded_runs(codec.encoded(R.element_runs(R.replica_a(spark, d), R.DELETED)))
    ids = F.expr("n * clock * (1 + pos) + (clock + 1 + pos) * (n * (n - 1) div 2) + (n - 1) * n * (2 * n - 1) div 6")
    origins = F.expr("if(o_clock is null, 0, o_clock) + (n - 1) * clock + (n - 1) * (n - 2) div 2")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "")
    gone = F.length(F.translate("gone", "0", ""))
    return back.filter("peer = 1").groupBy("path").agg(F.sum("n").alias("n"), F.sum(gone).cast("long").alias("n_deleted"), F.sum(ids).alias("ids"), F.sum(origins).alias("origins"), F.sha2(text, 256).alias("text_hash"))


# Documents of a replica: edits, ops, snapshots, compaction

C = R.SQL_C
#: Our peer, and the one whose changes come.
US, THEM = 3, 7
ABC = f"(SELECT a.path, a.doc_id, a.text AS a, c.text AS c, {BASE.replace('text', 'a.text').replace('path', 'a.path')} AS base FROM ({A}) a JOIN ({C}) c ON a.path = c.path)"


def state_a(spark: SparkSession, d: str) -> DataFrame:
    return documents.from_text(R.replica_a(spark, d))


def with_id(rows: DataFrame) -> DataFrame:
    """Adds doc_id, which paths end with."""
    return rows.withColumn("doc_id", F.element_at(F.split("path", "/"), -1).cast("long"))


@query(f"SELECT path, base, sha256(a) AS hash, CAST(0 AS BIGINT) AS tombstones FROM {ABC} WHERE doc_id % 2 = 1 UNION ALL SELECT path, base, sha256(c), (length(a) + doc_id) // 37 - doc_id // 37 FROM {ABC} WHERE doc_id % 2 = 0")
def manifest_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Manifests after half of the documents were edited."""
    edits = materialize(documents.detected(state_a(spark, d), R.replica_c(spark, d).filter("doc_id % 2 = 0"), THEM), "ops")
    return documents.manifest(documents.applied(state_a(spark, d), edits)).select("path", "base", "hash", "tombstones")


@query(f"SELECT path, (length(a) + doc_id) // 53 - doc_id // 53 AS inserted, (length(a) + doc_id) // 37 - doc_id // 37 AS deleted, length(a) + (length(a) + doc_id) // 53 - doc_id // 53 AS last_clock, sha256(c) AS hash FROM {ABC} WHERE a <> c")
def detected_ops(spark: SparkSession, d: str) -> DataFrame:
    """Ops that lead from A to C: counted, and applied to A again."""
    state = state_a(spark, d)
    ops = materialize(documents.detected(state, R.replica_c(spark, d), THEM), "ops")
    after = materialize(documents.applied(state, ops).join(ops.select("path"), "path", "left_semi"), "documents")
    last = F.array_max(F.transform("runs", lambda r: r["clock"] + F.char_length(r["text"]) - 1)).alias("last_clock")
    return after.select("path", "inserted", "deleted", last).join(documents.texts(after).select("path", F.sha2("text", 256).alias("hash")), "path")


KNOWN, LOCAL_EDIT, OTHER_BASE = "doc_id % 5 <> 1", "doc_id % 5 <> 1 AND doc_id % 3 = 0 AND doc_id % 6 <> 0", "doc_id % 4 = 0"


@query(f"""SELECT path, NOT ({KNOWN}) AND a <> c AS waiting, CAST(({KNOWN}) AND a <> c AND {OTHER_BASE} AS BIGINT) AS dropped,
  sha256(CASE WHEN NOT ({KNOWN}) THEN '' ELSE CASE WHEN a <> c AND NOT {OTHER_BASE} THEN c ELSE a END || CASE WHEN a <> c AND {LOCAL_EDIT} THEN ' local' ELSE '' END END) AS hash
  FROM {ABC} WHERE ({KNOWN}) OR a <> c AND (length(a) + doc_id) // 53 > doc_id // 53""")
def remote_ops(spark: SparkSession, d: str) -> DataFrame:
    """Ops arrive for C: some of another lineage, some for unknown documents, some over edits on disk that we haven't noticed.

    Deletes of unknown documents hold no text, so only inserts can wait.
    """
    a = state_a(spark, d)
    state = with_id(a).filter(KNOWN).select("path", "base", "runs")
    sent = with_id(materialize(documents.detected(a, R.replica_c(spark, d), THEM), "ops"))
    ops = sent.select("path", F.when(F.expr(f"{OTHER_BASE} and {KNOWN}"), F.col("base") + 2).otherwise(F.col("base")).alias("base"), "ops")
    disk = R.replica_a(spark, d).select("path", "doc_id", F.when(F.expr("doc_id % 3 = 0"), F.concat("text", F.lit(" local"))).otherwise(F.col("text")).cast("binary").alias("content"))
    own = disk.filter("doc_id % 6 = 0").select("path", F.sha2("content", 256).alias("hash"))
    after = materialize(documents.received_ops(state, ops, disk.select("path", "content"), own, US), "documents")
    text = documents.texts(after).select("path", F.sha2("text", 256).alias("hash"))
    return after.filter("waiting > 0 or size(runs) > 0").select("path", (F.col("waiting") > 0).alias("waiting"), "dropped").join(text, "path")


OUTCOME = """CASE WHEN doc_id % 4 = 0 THEN 'adopt' WHEN doc_id % 4 = 1 THEN 'merge' WHEN doc_id % 4 = 2 THEN 'ignore' WHEN doc_id % 8 = 3 THEN 'adopt-same' WHEN doc_id % 16 = 7 THEN 'rebase' ELSE 'conflict' END"""


@query(f"""SELECT path, outcome, base, sha256(CASE outcome WHEN 'adopt' THEN c WHEN 'merge' THEN c || ' local' WHEN 'adopt-same' THEN a WHEN 'conflict' THEN c ELSE a || ' local' END) AS hash, outcome IN ('adopt', 'rebase', 'conflict') OR outcome = 'merge' AND a <> c AS relay,
  CASE WHEN outcome = 'conflict' THEN path || '.conflict-00000003' END AS conflict, CASE WHEN outcome = 'conflict' THEN sha256(a || ' local') END AS conflict_hash
  FROM (SELECT path, doc_id, a, c, {OUTCOME} AS outcome, base - CASE WHEN doc_id % 4 = 3 THEN 2 ELSE 0 END AS base FROM {ABC})""")
def snapshots_received(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of C meet our documents: unknown, of one lineage with edits on both sides, or of two lineages."""
    a = with_id(state_a(spark, d))
    mine = R.replica_a(spark, d).select("path", "doc_id", F.concat("text", F.lit(" local")).alias("text"))
    plain = lambda rows: rows.select("path", "base", "runs")
    edited = lambda new, peer: materialize(documents.applied(plain(a.filter("doc_id % 4 = 1")), documents.detected(plain(a.filter("doc_id % 4 = 1")), new, peer)).select("path", "base", "runs"), "documents")
    fresh = lambda rows, where: with_id(documents.from_text(rows.filter(where)))
    # Lineages are those of A; theirs are higher or lower by two where they differ.
    base = a.select("path", F.col("base").alias("own"))
    shifted = lambda rows, by: rows.join(base, "path").select("path", (F.col("own") + by).alias("base"), "runs")
    same = fresh(R.replica_a(spark, d), "doc_id % 8 = 3")
    theirs = (
        shifted(fresh(R.replica_c(spark, d), "doc_id % 4 = 0"), F.lit(0)).unionByName(edited(R.replica_c(spark, d), THEM)).unionByName(shifted(fresh(R.replica_c(spark, d), "doc_id % 4 = 2"), F.lit(2)))
        .unionByName(shifted(same, F.lit(-2))).unionByName(shifted(fresh(R.replica_c(spark, d), "doc_id % 8 = 7"), F.lit(-2)))
    )
    ours = edited(mine, US).unionByName(shifted(fresh(mine, "doc_id % 4 = 2 or doc_id % 8 = 7"), F.lit(0))).unionByName(shifted(same, F.lit(0)))
    time = lambda rows, when: with_id(rows).withColumn("mtime", F.expr(when)).drop("doc_id")
    out = materialize(documents.received_snapshots(time(ours, "if(doc_id % 16 = 7, 5L, 1L)"), time(theirs, "3L"), US, THEM), "snapshots")
    text = documents.texts(out).select("path", F.sha2("text", 256).alias("hash"))
    return out.select("path", "outcome", "base", "relay", "conflict", F.sha2("conflict_text", 256).alias("conflict_hash")).join(text, "path")


LEFT = f"SELECT path, count(*) AS n_before, count_if(NOT ({THINNED})) AS n_after, string_agg(CASE WHEN {THINNED} THEN NULL ELSE ch END, '' ORDER BY clock) AS text, any_value(doc_id) AS doc_id FROM ({CHARS}) GROUP BY path"


@query(f"SELECT path, {BASE} AS base, sha256(text) AS text_hash, n_before, n_after FROM ({LEFT}) WHERE n_before - n_after >= 256 AND (n_before - n_after) * 2 >= n_before AND doc_id % 7 <> 0")
def compaction_round(spark: SparkSession, d: str) -> DataFrame:
    """Checkpoints that the lowest peer gives out; one peer reports another lineage for every seventh document."""
    a = R.replica_a(spark, d)
    runs = R.element_runs(a, THINNED).select("path", F.array(F.struct("clock", "peer", "o_clock", "o_peer", "text", "gone")).alias("runs"))
    state = materialize(R.manifest(a).select("path", "base").join(runs, "path"), "documents")
    seen = materialize(with_id(documents.manifest(state)), "manifest")
    reports = seen.select(F.lit(20).alias("peer"), "path", "hash", "base").unionByName(seen.select(F.lit(30).alias("peer"), "path", "hash", (F.col("base") + F.when(F.expr("doc_id % 7 = 0"), 2).otherwise(0)).alias("base")))
    peers = spark.createDataFrame([(20,), (30,)], "peer int")
    return documents.compacted(state, reports, peers, peers, 10, 256).select("path", "base", "text_hash", "n_before", "n_after")


@query(f"""SELECT CASE WHEN doc_id % 10 = 7 THEN path || '.moved' ELSE path END AS path, sha256(text) AS hash FROM ({A}) WHERE doc_id % 10 <> 3""")
def changes_applied(spark: SparkSession, d: str) -> DataFrame:
    """State after deletes and renames."""
    return _changed(spark, d)[0]


@query(f"SELECT path, CASE WHEN doc_id % 10 = 3 THEN 'delete' ELSE 'rename' END AS kind FROM ({A}) WHERE doc_id % 10 IN (3, 7)")
def changes_relayed(spark: SparkSession, d: str) -> DataFrame:
    """Deletes and renames that others must hear of: those of unknown paths end here."""
    return _changed(spark, d)[1].select("path", "kind")


def _changed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = R.replica_a(spark, d)
    kind = F.when(F.expr("doc_id % 10 = 7"), "rename").otherwise("delete")
    path = F.when(F.expr("doc_id % 10 = 9"), F.concat(F.lit("ghost/"), "doc_id")).otherwise(F.col("path"))
    changes = a.filter("doc_id % 10 in (3, 7, 9)").select(F.lit(1).alias("seq"), kind.alias("kind"), path.alias("path"), F.concat("path", F.lit(".moved")).alias("target"))
    # An earlier change of the same path doesn't count.
    changes = changes.unionByName(changes.filter("kind = 'rename'").select(F.lit(0).alias("seq"), F.lit("delete").alias("kind"), "path", "target"))
    return documents.changed(R.manifest(a).select("path", "hash"), changes)


@query("""WITH l AS (SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey)
  SELECT CAST(o_orderkey AS BIGINT) AS message, CAST(dst AS BIGINT) AS dst FROM orders JOIN l ON src = o_custkey % 25 WHERE dst <> o_orderkey % 25 AND o_totalprice <= 150000""")
def message_forwards(spark: SparkSession, d: str) -> DataFrame:
    """Nations of a region are linked, twice, and each with itself; orders are messages."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    links = n.alias("a").join(n.alias("b"), "n_regionkey").select(F.col("a.n_nationkey").alias("src"), F.col("b.n_nationkey").alias("dst"))
    m = table(spark, d, "orders").select(F.col("o_orderkey").alias("message"), (F.col("o_custkey") % 25).alias("peer"), (F.col("o_orderkey") % 25).alias("sender"), F.col("o_totalprice").alias("bytes"))
    return documents.forwards(m, links.union(links), 150_000).select("message", F.col("dst").cast("long").alias("dst"))


@query(f"SELECT path, CASE WHEN unicode(right(text, 1)) > 127 THEN left(text, length(text) - 1) || chr(65533) ELSE left(text, length(text) - 1) END AS text FROM ({A}) WHERE text <> ''")
def lossy_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts whose last byte is lost."""
    b = R.replica_a(spark, d).filter("text <> ''").select("path", F.col("text").cast("binary").alias("content"))
    return b.select("path", scalars.lossy_text(F.substring(F.col("content"), F.lit(1), F.length("content") - 1)).alias("text"))


# Bytes


def contents(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.col("text").cast("binary").alias("content"))


HEX_A = f"SELECT path, hex(encode(text)) AS h, strlen(text) AS n FROM ({A}) WHERE text <> ''"
BLOCKS = f"SELECT path, b AS block_no, substr(h, 128 * b + 1, 128) AS bh, least({SIZE}, n - {SIZE} * b) AS m FROM (SELECT path, h, n, unnest(range(0, (n + {SIZE - 1}) // {SIZE})) AS b FROM ({HEX_A}))"
NIBBLES = "(strpos('0123456789ABCDEF', bh[2 * i + 1:2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', bh[2 * i + 2:2 * i + 2]) - 1"


@query(f"""SELECT path, block_no, ((CAST(list_sum(list_transform(range(0, m), lambda i: (m - i) * ({NIBBLES}))) AS BIGINT) % 65521) << 16) | (CAST(list_sum(list_transform(range(0, m), lambda i: {NIBBLES})) AS BIGINT) % 65521) AS weak,
  substr(sha256(unhex(bh)), 1, 16) AS strong FROM ({BLOCKS})""")
def block_signatures(spark: SparkSession, d: str) -> DataFrame:
    return blocks.signatures(contents(R.replica_a(spark, d)), SIZE).select("path", "block_no", "weak", F.lower(F.hex("strong")).alias("strong"))


#: Checksums of all windows of SIZE bytes, from running sums over the bytes.
WINDOWS = """SELECT path, i, CAST(((i + {k}) * s - q) % 65521 AS BIGINT) * 65536 + CAST(s % 65521 AS BIGINT) AS g FROM (
  SELECT path, i, sum(v) OVER w AS s, sum(i * v) OVER w AS q, count(*) OVER w AS c FROM (
    SELECT path, unnest(range(0, len(b))) AS i, CAST('0x' || unnest(b) AS INTEGER) AS v FROM (SELECT path, regexp_extract_all(hex(encode(text)), '..') AS b FROM ({rows}) WHERE text <> ''))
  WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN CURRENT ROW AND {last} FOLLOWING)) WHERE c = {k}"""
WINDOWS_A = WINDOWS.format(k=SIZE, last=SIZE - 1, rows=A)
WINDOWS_B = WINDOWS.format(k=SIZE, last=SIZE - 1, rows=B)


@query(f"SELECT a.path, count(g) AS windows, CAST(coalesce(sum(g), 0) AS BIGINT) AS digest_sum, max(g) AS digest_max FROM ({A}) a LEFT JOIN ({WINDOWS_A}) g ON a.path = g.path GROUP BY a.path")
def rolling_digests(spark: SparkSession, d: str) -> DataFrame:
    return blocks.rolling_digests(contents(R.replica_a(spark, d)), SIZE)


WEAK = f"((CAST(list_sum(list_transform(range(0, m), lambda i: (m - i) * ({NIBBLES}))) AS BIGINT) % 65521) << 16) | (CAST(list_sum(list_transform(range(0, m), lambda i: {NIBBLES})) AS BIGINT) % 65521)"


@query(f"""WITH f AS (SELECT path, min(block_no) AS b, bh, any_value({WEAK}) AS g FROM ({BLOCKS}) WHERE m = {SIZE} GROUP BY path, bh),
  c AS (SELECT w.path, w.i, f.b, f.bh FROM ({WINDOWS_B}) w JOIN f ON w.path = f.path AND w.g = f.g),
  j AS (SELECT c.path, c.i, c.b FROM c JOIN (SELECT path, hex(encode(text)) AS h FROM ({B})) t ON c.path = t.path WHERE substr(h, 2 * i + 1, {2 * SIZE}) = bh)
  SELECT d.path, count(i) AS matched, min(i) AS first_offset, count(DISTINCT b) AS blocks FROM ({B}) d LEFT JOIN j ON d.path = j.path GROUP BY d.path""")
def block_matches(spark: SparkSession, d: str) -> DataFrame:
    return blocks.match_counts(contents(R.replica_b(spark, d)), blocks.signed_contents(contents(R.replica_a(spark, d)), SIZE), SIZE)


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    return blocks.deltas(contents(R.replica_b(spark, d)), blocks.signed_contents(contents(R.replica_a(spark, d)), SIZE), SIZE)


@query()
def delta_stats(spark: SparkSession, d: str) -> DataFrame:
    return blocks.stats(_deltas(spark, d))


@query(f"SELECT path, TRUE AS complete, sha256(text) AS hash FROM ({B})")
def reassemble_check(spark: SparkSession, d: str) -> DataFrame:
    """Deltas, cut to chunks, put together again and applied: every path comes out as replica B has it."""
    a = contents(R.replica_a(spark, d))
    parts = blocks.chunked_deltas(contents(R.replica_b(spark, d)), blocks.signed_contents(a, SIZE), SIZE, 1024)
    # Every transfer's first chunk arrives twice.
    sent = parts.withColumn("copy", F.explode(F.when(F.col("seq") == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    rebuilt = blocks.assembled(sent, a, SIZE)
    return rebuilt.select("path", "complete", F.sha2("content", 256).alias("hash"))


@query(f"SELECT path, TRUE AS complete, sha256(text) AS hash FROM ({C})")
def reassemble_inner(spark: SparkSession, d: str) -> DataFrame:
    """The same for replica C, whose texts differ from A's inside."""
    a = contents(R.replica_a(spark, d))
    rebuilt = blocks.assembled(blocks.chunked_deltas(contents(R.replica_c(spark, d)), blocks.signed_contents(a, SIZE), SIZE, 1024), a, SIZE)
    return rebuilt.select("path", "complete", F.sha2("content", 256).alias("hash"))


TRANSFERS = f"""SELECT CAST(7 AS BIGINT) AS peer, path, CASE WHEN doc_id % 5 = 1 THEN 'missing chunks' WHEN doc_id % 5 = 2 THEN 'other content' ELSE 'verified' END AS outcome, CASE WHEN doc_id % 5 NOT IN (1, 2) THEN strlen(text) END AS len FROM ({C})
  UNION ALL SELECT 8, path, 'verified', strlen(text) FROM ({C}) WHERE doc_id % 10 = 1"""


@query(TRANSFERS)
def transfers_received(spark: SparkSession, d: str) -> DataFrame:
    return blocks.received(sent_chunks(spark, d), contents(R.replica_a(spark, d)), SIZE).select("peer", "path", "outcome", F.length("content").cast("long").alias("len"))


def sent_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Transfers of C from two peers: of one, some announce a chunk that never comes or another content; the other sends some whole."""
    content = F.col("text").cast("binary")
    new = R.replica_c(spark, d).filter("path is not null").select("path", "doc_id", F.sha2(content, 256).alias("hash"), content.alias("content"))
    parts = blocks.chunked_deltas(new, blocks.signed_contents(contents(R.replica_a(spark, d)), SIZE), SIZE, 1024)
    seven = F.struct(F.lit(7).cast("long").alias("peer"), (F.col("total") + F.when(F.expr("doc_id % 5 = 1"), 1).otherwise(0)).alias("total"), F.when(F.expr("doc_id % 5 = 2"), F.sha2("hash", 256)).otherwise(F.col("hash")).alias("hash"))
    eight = F.struct(F.lit(8).cast("long").alias("peer"), F.col("total"), F.col("hash"))
    each = F.explode(F.when(F.expr("doc_id % 10 = 1"), F.array(seven, eight)).otherwise(F.array(seven)))
    return parts.select("path", "seq", "ops", each.alias("x")).select("path", "seq", "ops", "x.*")


@query(f"SELECT path, sha256(text) AS hash FROM ({A})")
def compress_round_trip(spark: SparkSession, d: str) -> DataFrame:
    c = contents(R.replica_a(spark, d)).withColumn("z", scalars.maybe_compress("content"))
    return c.select("path", F.sha2(F.when(F.col("z").isNull(), F.col("content")).otherwise(scalars.decompress("z")), 256).alias("hash"))


@query(f"""SELECT b.path, CASE WHEN b.text = a.text THEN 0 ELSE 7 END AS inserted, 0 AS deleted, CASE WHEN b.text = a.text THEN 0 ELSE 1 END AS runs, TRUE AS exact FROM ({B}) b JOIN ({A}) a ON a.path = b.path""")
def diff_edit_counts(spark: SparkSession, d: str) -> DataFrame:
    old = R.replica_a(spark, d).select("path", F.col("text").alias("old_text"))
    return diffing.edit_counts(old.join(R.replica_b(spark, d).select("path", F.col("text").alias("new_text")), "path"))


@query(f"""SELECT path, (n + doc_id) // 53 - doc_id // 53 AS inserted, (n + doc_id) // 37 - doc_id // 37 AS deleted, TRUE AS exact FROM (SELECT path, doc_id, CAST(length(text) AS BIGINT) AS n FROM ({A}) WHERE text IS NOT NULL)""")
def diff_inner_counts(spark: SparkSession, d: str) -> DataFrame:
    """Edits inside every text."""
    old = R.replica_a(spark, d).filter("text is not null").select("path", F.col("text").alias("old_text"))
    pairs = dealt(old).join(dealt(R.replica_c(spark, d).select("path", F.col("text").alias("new_text"))), "path")
    return diffing.edit_counts(pairs).select("path", "inserted", "deleted", "exact")


@query("SELECT c_custkey, TRUE AS same, FALSE AS reflected, FALSE AS bound, FALSE AS stale FROM customer")
def proof_check(spark: SparkSession, d: str) -> DataFrame:
    """Proofs of all users: the right one passes; another role's, another channel's and a wrong secret's do not."""
    u = table(spark, d, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("secret"), F.unhex(F.sha2(F.col("c_name"), 256)).alias("n1"), F.unhex(F.sha2(F.concat("c_name", F.lit("r")), 256)).alias("n2"))
    none, zeros = F.lit(None).cast("binary"), F.unhex(F.lit("00" * 32))
    want = scalars.mac("secret", F.lit("initiator"), "n1", "n2", none)
    tries = {"same": want, "reflected": scalars.mac("secret", F.lit("responder"), "n1", "n2", none), "bound": scalars.mac("secret", F.lit("initiator"), "n1", "n2", zeros), "stale": scalars.mac("secret", F.lit("initiator"), "n2", "n1", none)}
    return u.select("c_custkey", *(scalars.verify(want, x).alias(k) for k, x in tries.items()))


# Events


def by_user(spark: SparkSession, d: str) -> DataFrame:
    """Events as changes of a user's path. The session's time zone is the tables'."""
    return table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("path"), F.col("event_type").alias("kind"), F.floor("value").cast("long").alias("hash"))


EV = "SELECT event_id, ts, CAST(user_id AS VARCHAR) AS path, event_type AS kind, CAST(floor(value) AS BIGINT) AS hash FROM events"
DEBOUNCED = f"""SELECT path, epoch_us(max(ts)) AS last_us, arg_max(kind, ts) AS kind, count(*) AS n FROM (SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY ts) AS burst
  FROM (SELECT *, lag(ts) OVER (PARTITION BY path ORDER BY ts) AS p FROM ({EV}))) GROUP BY path, burst"""


@query(DEBOUNCED)
def debounce_events(spark: SparkSession, d: str) -> DataFrame:
    return events.debounce(by_user(spark, d), "6 hours").select("path", F.unix_micros("ts").alias("last_us"), "kind", "n")


@query(DEBOUNCED)
def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.debounced(spark, f"{d}/event[s].parquet", 6 * 3600)


@query("SELECT event_type AS kind, count(*) AS n FROM (SELECT DISTINCT event_id, event_type FROM events) GROUP BY event_type")
def dedup_stream(spark: SparkSession, d: str) -> DataFrame:
    return streams.deduplicated(spark, f"{d}/event[s].parquet")


@query(f"SELECT b.hash, a.event_id AS removed, b.event_id AS created FROM ({EV}) a JOIN ({EV}) b ON a.hash = b.hash AND a.kind = 'error' AND b.kind = 'signup' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR")
def rename_candidates(spark: SparkSession, d: str) -> DataFrame:
    e = by_user(spark, d)
    return events.rename_candidates(e.filter("kind = 'error'"), e.filter("kind = 'signup'"), "1 hour")


@query()
def rename_pairs(spark: SparkSession, d: str) -> DataFrame:
    e = by_user(spark, d)
    return events.rename_pairs(e.filter("kind = 'error'"), e.filter("kind = 'signup'"), 3_600_000_000)


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY path, hash ORDER BY ts, event_id) AS nth FROM ({EV})), w AS (SELECT path, hash, ts - INTERVAL 5 SECOND AS ts, row_number() OVER (PARTITION BY path, hash ORDER BY ts, event_id) AS nth FROM ({EV}) WHERE kind = 'purchase')
  SELECT t.event_id, t.path, t.hash FROM t WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.path = t.path AND w.hash = t.hash AND w.nth = t.nth AND t.ts >= w.ts AND t.ts <= w.ts + INTERVAL 10 SECOND)""")
def echo_suppressed(spark: SparkSession, d: str) -> DataFrame:
    e = by_user(spark, d)
    writes = e.filter("kind = 'purchase'").withColumn("ts", F.col("ts") - F.expr("interval 5 seconds"))
    return events.unechoed(e, writes, "10 seconds").select("event_id", "path", "hash")


@query(f"SELECT event_id, path, hash FROM ({EV}) e WHERE NOT EXISTS (SELECT 1 FROM ({EV}) w WHERE w.kind = 'purchase' AND w.path = e.path AND w.hash = e.hash)")
def unwritten_touches(spark: SparkSession, d: str) -> DataFrame:
    """Touches whose content we never wrote there."""
    e = by_user(spark, d)
    return reconcile.unwritten(e, e.filter("kind = 'purchase'")).select("event_id", "path", "hash")


@query(f"SELECT event_id, path FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS nth FROM ({EV})) WHERE nth <= 16")
def recent_self_writes(spark: SparkSession, d: str) -> DataFrame:
    return events.recent_writes(by_user(spark, d)).select("event_id", "path")


@query(f"SELECT path, epoch_us(min(ts)) AS first_us, min(kind) AS kind, count(*) - 1 AS suppressed FROM (SELECT *, sum(CASE WHEN p IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY ts, event_id) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY path ORDER BY ts, event_id) AS p FROM ({EV}))) GROUP BY path, run")
def error_suppression(spark: SparkSession, d: str) -> DataFrame:
    return events.suppressed(by_user(spark, d)).select("path", F.unix_micros("ts").alias("first_us"), "kind", "suppressed")


@query("""SELECT kind, at_us, n FROM (SELECT *, lag(n) OVER (PARTITION BY kind ORDER BY at_us) AS p FROM (SELECT event_type AS kind, epoch_us(time_bucket(INTERVAL 30 SECOND, ts)) AS at_us, count(*) AS n FROM events GROUP BY ALL)) WHERE p IS NULL OR p <> n""")
def throughput_30s(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("path"), F.col("ts").cast("timestamp").alias("ts"))
    return events.throughput(e).select(F.col("path").alias("kind"), F.unix_micros("at").alias("at_us"), "n")


@query("SELECT label, p, CAST(s[CAST(round((len(s) - 1) * p) AS BIGINT) + 1] AS DOUBLE) AS value FROM (SELECT event_type AS label, list_sort(list(value)) AS s FROM events GROUP BY event_type), (SELECT unnest([0.5, 0.9, 0.99, 1.0])::DOUBLE AS p)")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return events.percentiles(table(spark, d, "events").filter("value is not null").select(F.col("event_type").alias("label"), "value"))


TOPOLOGY = """SELECT 'chain' AS topology, CAST(n_nationkey AS BIGINT) AS src, CAST(n_nationkey + 1 AS BIGINT) AS dst FROM nation WHERE n_nationkey < 24
  UNION ALL SELECT 'ring', CAST(n_nationkey AS BIGINT), CAST((n_nationkey + 1) % 25 AS BIGINT) FROM nation UNION ALL SELECT 'ring', CAST((n_nationkey + 1) % 25 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation
  UNION ALL SELECT 'star', CAST(0 AS BIGINT), CAST(n_nationkey AS BIGINT) FROM nation WHERE n_nationkey > 0"""


@query(f"""WITH RECURSIVE e AS ({TOPOLOGY}), r AS (SELECT DISTINCT topology, CAST(0 AS BIGINT) AS peer, CAST(0 AS BIGINT) AS hops FROM e UNION SELECT e.topology, e.dst, r.hops + 1 FROM r JOIN e ON e.topology = r.topology AND e.src = r.peer WHERE r.hops < 25)
  SELECT topology, peer, min(hops) AS hops FROM r GROUP BY ALL""")
def relay_reach(spark: SparkSession, d: str) -> DataFrame:
    return events.reach(spark.sql(TOPOLOGY.replace("FROM nation", "FROM {nation}"), nation=table(spark, d, "nation")), 0)
