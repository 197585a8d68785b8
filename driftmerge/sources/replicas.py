"""Replicas and op logs derived from the tables, over whole tables and whole texts.

Replica A is ``documents``. Replica B lacks the documents labelled as of low quality and has edited the toxic ones.
Replica C has edits inside every text. An op log holds a document's characters as one writer's inserts, two words that
other writers insert at the same place at the same time, and deletes. ``element_runs`` and ``op_runs`` give documents
and logs as pieces, a few rows each; ``elements`` and ``op_log`` the same as single characters, for operators that
join on ids. The SQL constants state the same for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.functions import scalars
from driftmerge.operators import codec
from driftmerge.sources.shared import dealt
from driftmerge.sources.tables import table

WRITER, LEFT, RIGHT = 1, 10, 20

SQL_A = "SELECT concat(source, '/', doc_id) AS path, doc_id, text FROM documents"
SQL_B = """SELECT concat(source, '/', d.doc_id) AS path, d.doc_id, CASE WHEN l.toxic = 1 THEN text || ' edited' ELSE text END AS text
  FROM documents d LEFT JOIN (SELECT doc_id, min(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
  WHERE coalesce(l.quality, 1) <> 0"""
#: A character that no text holds: what replica C inserts, so counts don't hang on which shortest script is found.
MARK = "\ue000"
#: Replica C lacks every 37th character of A and has a mark after every 53rd.
SQL_C = f"""SELECT path, doc_id, CASE WHEN text = '' THEN '' ELSE array_to_string(list_transform(range(1, len(cs) + 1), lambda i: CASE WHEN (i + doc_id) % 37 = 0 THEN '' ELSE cs[i] END || CASE WHEN (i + doc_id) % 53 = 0 THEN '{MARK}' ELSE '' END), '') END AS text
  FROM (SELECT path, doc_id, text, string_split(text, '') AS cs FROM ({SQL_A}))"""
SQL_BASE = "(CAST('0x' || substr(sha256(path || '|' || text), 1, 15) AS BIGINT) | 1)"
#: Characters of replica A: path, doc_id, n, clock, ch.
SQL_CHARS = f"SELECT path, doc_id, len(cs) AS n, unnest(range(1, len(cs) + 1)) AS clock, unnest(cs) AS ch FROM (SELECT path, doc_id, string_split(text, '') AS cs FROM ({SQL_A}) WHERE text <> '')"
DELETED = "(clock * 7 + doc_id) % 5 = 0"
DELETED_B = "(clock * 3 + doc_id) % 7 = 0"


def replica_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "doc_id", "text")


def replica_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    both = table(spark, sf_dir, "documents").join(labels, "doc_id", "left").filter(F.coalesce("quality", F.lit(1)) != 0)
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit(" edited"))).otherwise(F.col("text"))
    return both.select(F.concat("source", F.lit("/"), "doc_id").alias("path"), "doc_id", text.alias("text"))


def replica_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replica_a(spark, sf_dir).select("path", "doc_id", "text").mapInArrow(_edited, "path string, doc_id long, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's text without every 37th character and with a mark after every 53rd, counted from its id: all at once, as an expression would run for each character."""
    for batch in batches:
        out = []
        for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            code = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
            at = np.arange(1, len(code) + 1) + doc_id
            # A character stands before the mark that follows it.
            two = np.stack([code, np.full(len(code), ord(MARK), np.uint32)], axis=1)
            out.append(two[np.stack([at % 37 != 0, at % 53 == 0], axis=1)].tobytes().decode("utf-32-le"))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["path", "doc_id", "text"])


def cut(rows: DataFrame, schema: str) -> DataFrame:
    """Rows for each of the `parts` (a, z) of a row's text, with its other columns: (..., a, z, text); `schema` says those others.

    Places count from 0. An explode would carry the whole text into each part's row, and find its place by counting from the start.
    """
    names = [c for c in rows.columns if c not in ("text", "parts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                parts = batch.column("parts")
                many = parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                a, z = (x.to_numpy(zero_copy_only=False) for x in parts.flatten().flatten())
                row = np.repeat(np.arange(batch.num_rows), many)
                texts = batch.column("text").to_pylist()
                out = [texts[r][i:j] for r, i, j in zip(row.tolist(), a.tolist(), z.tolist(), strict=True)]
                kept = batch.select(names).take(pa.array(row))
                yield pa.record_batch([*kept.columns, pa.array(a, pa.int64()), pa.array(z, pa.int64()), pa.array(out, pa.string())], [*names, "a", "z", "text"])

    return rows.select(*names, F.col("parts").cast("array<struct<a:bigint,z:bigint>>").alias("parts"), "text").mapInArrow(run, f"{schema}, a long, z long, text string")


def element_runs(docs: DataFrame, deleted: str = "false") -> DataFrame:
    """Stored documents as pieces, a row each: (path, pos, clock, peer, o_clock, o_peer, text, n, gone, doc_id)."""
    none, one = F.lit(None).cast("long"), F.lit(1).cast("long")
    gone = F.expr(f"array_join(transform(sequence(1L, n), clock -> if({deleted}, '1', '0')), '')")
    sized = dealt(docs.filter("text <> ''")).withColumn("n", F.char_length("text").cast("long"))
    return sized.select("path", one.alias("pos"), one.alias("clock"), F.lit(WRITER).cast("long").alias("peer"), none.alias("o_clock"), none.alias("o_peer"), "text", "n", gone.alias("gone"), "doc_id")


def op_runs(docs: DataFrame) -> DataFrame:
    """The op log of ``op_log`` as pieces, four rows a document."""
    none, writer = F.lit(None).cast("long"), F.lit(WRITER).cast("long")
    n = F.char_length("text").cast("long")
    no_clocks = F.lit(None).cast("array<bigint>")
    deleted = F.col("deleted")

    def op(seq: Column, kind: str, clock: Column, peer: Column, o_clock: Column, o_peer: Column, text: Column, size: Column, clocks: Column) -> Column:
        return F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), clock.cast("long").alias("clock"), peer.alias("peer"), o_clock.alias("o_clock"), o_peer.alias("o_peer"), text.alias("text"), size.cast("long").alias("n"), clocks.alias("clocks"))

    word = lambda k, peer, text: op(n + 5 * k + 1, "ins", n + 1, F.lit(peer).cast("long"), F.col("doc_id") % n + 1, writer, F.lit(text), F.lit(5), no_clocks)
    log = F.array(op(F.lit(1), "ins", F.lit(1), writer, none, none, F.col("text"), n, no_clocks), word(0, LEFT, "hello"), word(1, RIGHT, "world"), op(n + 11, "del", F.get(deleted, F.lit(0)), writer, none, none, F.lit(""), F.size(deleted), deleted))
    ready = dealt(docs.filter("text <> ''")).withColumn("deleted", F.expr(f"filter(sequence(1L, char_length(text)), clock -> {DELETED})"))
    return ready.select("path", F.explode(log).alias("x")).select("path", "x.*").filter("n > 0")


#: The columns of a log as pieces.
PIECES = "path string, seq long, kind string, clock long, peer long, o_clock long, o_peer long, text string, n long, clocks array<long>"


def without(pieces: DataFrame, lost: str) -> DataFrame:
    """A log of pieces that lost the ops whose `clock` fulfils a condition: runs are cut there, what follows hangs on what is lost."""
    kept = F.expr(f"filter(clocks, clock -> NOT ({lost}))")
    gone = pieces.filter("kind = 'del'").withColumn("clocks", kept).withColumn("n", F.size("clocks").cast("long")).filter("n > 0")
    missing = F.expr(f"filter(sequence(clock, clock + n - 1), clock -> {lost})")
    # Between the lost ones: from the one before to the one after.
    before, after = F.concat(F.array(F.col("clock") - 1), missing), F.concat(missing, F.array(F.col("clock") + F.col("n")))
    parts = F.zip_with(before, after, lambda a, z: F.struct((a + 1).alias("a"), z.alias("z")))
    parts = F.filter(F.transform(parts, lambda x: F.struct((x["a"] - F.col("clock")).alias("a"), (x["z"] - F.col("clock")).alias("z"))), lambda x: x["a"] < x["z"])
    columns = "path string, seq long, kind string, clock long, peer long, o_clock long, o_peer long"
    cuts = cut(pieces.filter("kind = 'ins'").select("path", "seq", "kind", "clock", "peer", "o_clock", "o_peer", "text", parts.alias("parts")), columns)
    first = F.col("a") == 0
    ins = cuts.select(
        "path", F.col("seq") + F.col("a"), "kind", F.col("clock") + F.col("a"), "peer", F.when(first, F.col("o_clock")).otherwise(F.col("clock") + F.col("a") - 1), F.when(first, F.col("o_peer")).otherwise(F.col("peer")),
        "text", F.col("z") - F.col("a"), F.lit(None).cast("array<bigint>"),
    )
    return ins.toDF(*pieces.columns).unionByName(gone.select(*pieces.columns))


#: An op log as messages, a row for some ops of a path: the inserts' (clock, peer, o_clock, o_peer, n) as packed longs, no origin being -1, and their texts one after the other; the deletes' (peer, clock).
MESSAGES = "path string, ids binary, text binary, dead binary"


def messages(docs: DataFrame, kind: str, lost: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The op log of ``op_runs`` without the ops whose clocks are `lost`, as messages: a document's inserts ("ins") or its deletes ("del")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _inserts if kind == "ins" else _deletes
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                made = [make(doc_id, np.frombuffer(text.encode("utf-32-le"), np.uint32), lost) for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                cells = [pa.array(c, pa.binary()) for c in zip(*made, strict=True)]
                out = pa.record_batch([batch.column(0), *cells], ["path", "ids", "text", "dead"])
                yield out.filter(pa.array([x is not None or z is not None for x, _, z in made]))

    return docs.select("path", "doc_id", "text").filter("text <> ''").mapInArrow(run, MESSAGES)


def _deletes(doc_id: int, code: np.ndarray, lost: Callable[[np.ndarray], np.ndarray]) -> tuple:
    clocks = np.arange(1, len(code) + 1)
    clocks = clocks[((clocks * 7 + doc_id) % 5 == 0) & ~lost(clocks)]  # DELETED
    return None, None, codec.pack_longs(np.full(len(clocks), WRITER), clocks) if len(clocks) else None


def _inserts(doc_id: int, code: np.ndarray, lost: Callable[[np.ndarray], np.ndarray]) -> tuple:
    n = len(code)
    gone = lost(np.arange(1, n + 6))
    own = gone[:n]
    # Runs go on where no character is lost; what follows a lost one hangs on it.
    edge = np.empty(n + 1, bool)
    edge[0], edge[n], edge[1:n] = not own[0], not own[-1], own[1:] != own[:-1]
    turns = np.flatnonzero(edge)
    at, end = turns[::2], turns[1::2]
    ids = np.ones((5, len(at)), np.int64)
    ids[0], ids[1], ids[2], ids[3], ids[4] = at + 1, WRITER, at, WRITER, end - at
    if len(at) and at[0] == 0:
        ids[2:4, 0] = -1
    texts, words = [code[~own].tobytes().decode("utf-32-le")], []
    for word, peer in (("hello", LEFT), ("world", RIGHT)):
        before = True  # the character before is lost, or another's
        for i, (ch, no) in enumerate(zip(word, gone[n:].tolist(), strict=True)):
            if not no and before:
                words.append([n + 1 + i, peer, *((doc_id % n + 1, WRITER) if i == 0 else (n + i, peer)), 1])
            elif not no:
                words[-1][4] += 1
            texts.append("" if no else ch)
            before = no
    if words:
        ids = np.concatenate([ids, np.array(words, np.int64).T], axis=1)
    return (codec.pack_longs(*ids), codec.pack_text("".join(texts)), None) if ids.shape[1] else (None, None, None)


def characters(docs: DataFrame) -> DataFrame:
    """Rows (path, doc_id, n, clock, ch): clock counts from 1.

    Texts are dealt by path before they become characters. What is grouped or numbered by path later finds them in
    place, so texts are shuffled once and characters, some sixty times their size, not at all.
    """
    # Computed before the explode: after it, each would be done, and the text carried, for every character.
    ready = docs.repartition("path").select("path", "doc_id", F.filter(F.split("text", ""), lambda c: c != "").alias("cs"), F.char_length("text").cast("long").alias("n"))
    return ready.select("path", "doc_id", "n", F.posexplode("cs").alias("at", "ch")).select("path", "doc_id", "n", (F.col("at") + 1).cast("long").alias("clock"), "ch")


def elements(docs: DataFrame, deleted: str) -> DataFrame:
    """Stored characters in document order: (path, pos, clock, peer, o_clock, o_peer, ch, deleted)."""
    origin = F.when(F.col("clock") > 1, F.col("clock") - 1)
    return characters(docs).select(
        "path", F.col("clock").alias("pos"), "clock", F.lit(WRITER).cast("long").alias("peer"), origin.alias("o_clock"), F.when(origin.isNotNull(), F.lit(WRITER).cast("long")).alias("o_peer"), "ch",
        F.expr(deleted).alias("deleted"), "doc_id",
    )


def op_log(docs: DataFrame) -> DataFrame:
    """Rows (path, seq, kind, clock, peer, o_clock, o_peer, ch) of inserts and deletes.

    The second and third writer's words hang on character 1 + doc_id % n and have the clocks n + 1 to n + 5.
    """
    own = characters(docs)
    writer = F.lit(WRITER).cast("long")
    first = own.select("path", F.col("clock").alias("seq"), F.lit("ins").alias("kind"), "clock", writer.alias("peer"), F.when(F.col("clock") > 1, F.col("clock") - 1).alias("o_clock"), F.when(F.col("clock") > 1, writer).alias("o_peer"), "ch")
    words = []
    sized = docs.filter("text <> ''").select("path", "doc_id", F.char_length("text").cast("long").alias("n"))
    for k, (peer, word) in enumerate(((LEFT, "hello"), (RIGHT, "world"))):
        chars = sized.select("path", "doc_id", "n", F.posexplode(F.array(*map(F.lit, word))).alias("i", "ch"))
        clock = F.col("n") + F.col("i") + 1
        start = F.col("i") == 0
        words.append(chars.select(
            "path", (F.col("n") + 5 * k + F.col("i") + 1).alias("seq"), F.lit("ins").alias("kind"), clock.alias("clock"), F.lit(peer).cast("long").alias("peer"),
            F.when(start, F.col("doc_id") % F.col("n") + 1).otherwise(clock - 1).alias("o_clock"), F.when(start, writer).otherwise(F.lit(peer).cast("long")).alias("o_peer"), "ch",
        ))
    gone = own.filter(DELETED).select("path", (F.col("n") + 10 + F.col("clock")).alias("seq"), F.lit("del").alias("kind"), "clock", writer.alias("peer"), F.lit(None).cast("long").alias("o_clock"), F.lit(None).cast("long").alias("o_peer"), F.lit(None).cast("string").alias("ch"))
    return first.unionByName(words[0]).unionByName(words[1]).unionByName(gone)


SQL_OPS = f"""SELECT path, clock AS seq, 'ins' AS kind, clock, 1 AS peer, CASE WHEN clock > 1 THEN clock - 1 END AS o_clock, CASE WHEN clock > 1 THEN 1 END AS o_peer, ch FROM ({SQL_CHARS})
  UNION ALL SELECT path, n + i, 'ins', n + i, 10, CASE WHEN i = 1 THEN doc_id % n + 1 ELSE n + i - 1 END, CASE WHEN i = 1 THEN 1 ELSE 10 END, substr('hello', i, 1) FROM (SELECT concat(source, '/', doc_id) AS path, doc_id, length(text) AS n, unnest(range(1, 6)) AS i FROM documents WHERE text <> '')
  UNION ALL SELECT path, n + 5 + i, 'ins', n + i, 20, CASE WHEN i = 1 THEN doc_id % n + 1 ELSE n + i - 1 END, CASE WHEN i = 1 THEN 1 ELSE 20 END, substr('world', i, 1) FROM (SELECT concat(source, '/', doc_id) AS path, doc_id, length(text) AS n, unnest(range(1, 6)) AS i FROM documents WHERE text <> '')
  UNION ALL SELECT path, n + 10 + clock, 'del', clock, 1, NULL, NULL, NULL FROM ({SQL_CHARS}) WHERE {DELETED}"""


def manifest(docs: DataFrame) -> DataFrame:
    """Digest rows (path, hash, base, doc_id)."""
    return docs.select("path", F.sha2("text", 256).alias("hash"), scalars.lineage(F.col("path"), F.col("text")).alias("base"), "doc_id")
