r"""Language-model scoring with a hidden Markov model over word classes.

Tokens are the words ``[^\x20\x09-\x0D]+`` of a text with A-Z in lower case, then one end token. The model is
P(text) = sum over state paths of prod P(state | previous state) P(class | state) P(token | class):

* each of the ``FREQUENT`` most counted tokens and the end is a class of its own; every other token belongs to one of
  ``ENDINGS`` classes by its last two bytes;
* P(token | class) = (c + 1) / (C + W + 1) within a class of C counts and W distinct known tokens: one share is left
  for all unknown tokens of the class together, as in the base score;
* transitions, start and class emissions are trained by Baum-Welch. Every partition turns its documents into expected
  counts (states x classes and states x states); Spark adds them up, the driver normalises the small sums.

Counts of all training tokens are gathered by asking per block of documents (see blocks); texts are read once, and
kept as numbers from then on. The likelihood of a whole
text comes from the scaled forward recursion over all its tokens. Training runs over whole texts too: forward
probabilities of over ``TOKENS`` tokens are kept at every ``STRIDE``-th alone and made again from there on the way back,
so memory is a few numbers a token at any length, and the counts are exact. Tokens are told apart by XXH3-64: among 10^10 different words, two or three
pairs with equal hashes are expected, whose counts are then one.

Defined results: null and empty texts are the end token alone; without training documents c, N and V are 0; a null
id is null in the result and counts as held in; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.blocks import answer, drop_blocks, stored_by_block
from driftmerge.llm.common import Digests, cells, crc_remainder, materialize, raw, release, slices, table, texts

STATES, FREQUENT, ENDINGS, ROUNDS, STRIDE = 8, 2048, 512, 4, 64
#: Tokens that training takes at once; a longer text stands alone.
TOKENS = 1 << 19
#: Texts of more tokens than this are long; bytes of text in a block.
LONG, BLOCK_BYTES = 2048, 8 << 20
HOLD_MODULUS, HOLD_REMAINDER = 7, 2
#: The end token's key; no word hashes to it but by a 64-bit coincidence.
END = np.uint64(0x656E64)
TOPS_PER_TASK = 4096


_TOKEN = np.dtype([("key", "<u8"), ("tail", "<u2")])


def token(word: bytes) -> bytes:
    """A word's key and its ending."""
    tail = (word[-1] * 263 + (word[-2] if len(word) > 1 else 0)) % ENDINGS
    return xxhash.xxh3_64_intdigest(word).to_bytes(8, "little") + tail.to_bytes(2, "little")


_END = int(END).to_bytes(8, "little") + bytes(2)


def coded(column: pa.Array, lo: int, hi: int, memo: Digests) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens the rows have, and all their tokens; only one row's words are held at a time, as they take ten times what stands for them."""
    size, found = np.empty(hi - lo, np.int64), bytearray()
    for k in range(lo, hi):
        (text,) = cells(column, k, k + 1)
        words = text.lower().split()
        size[k - lo] = len(words) + 1
        found += b"".join([memo[w] for w in words])
        found += _END
    return size, np.frombuffer(found, _TOKEN)


STORED = "block long, doc_id long, held_out boolean, size long, tokens binary, keys binary, counts binary, tails binary"
STORED_NAMES = [x.split()[0] for x in STORED.split(", ")]


def indexed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Texts as numbers, so they are read and hashed once: a table by block, to be dropped by drop_blocks().

    A block is what one task read, ``BLOCK_BYTES`` of text or one longer text. Its documents are rows with their tokens
    as places in the block's sorted distinct keys; one more row has these keys, their counts in training documents and
    their endings.
    """
    held = F.expr(f"coalesce({crc_remainder('doc_id', HOLD_MODULUS)} = {HOLD_REMAINDER}, false)")
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).select("doc_id", held.alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, press, number = Digests(token), zstandard.ZstdCompressor(level=1), TaskContext.get().partitionId() << 32
        for batch in batches:
            column = texts(batch.column("text"))
            for lo, hi in slices(raw(column)[1], BLOCK_BYTES):
                size, found = coded(column, lo, hi, memo)
                own = batch.slice(lo, hi - lo)
                train = ~own.column("held_out").to_numpy(zero_copy_only=False)
                order = np.argsort(found["key"], kind="stable")
                keys = found["key"][order]
                new = np.concatenate([[True], keys[1:] != keys[:-1]])
                at = np.flatnonzero(new)
                counts = np.add.reduceat(np.repeat(train, size)[order].astype(np.int64), at)
                place = np.empty(len(order), np.uint32)
                place[order] = np.cumsum(new) - 1
                ends = np.cumsum(size)
                packed = [press.compress(place[e - n : e].tobytes()) for n, e in zip(size.tolist(), ends.tolist(), strict=True)]
                none = pa.nulls(hi - lo, pa.binary())
                yield pa.record_batch([pa.array(np.full(hi - lo, number)), own.column("doc_id"), own.column("held_out"), pa.array(size), pa.array(packed, pa.binary()), none, none, none], STORED_NAMES)
                lists = (keys[at].tobytes(), counts.tobytes(), found["tail"][order][at].tobytes())
                yield pa.record_batch([pa.array([number]), pa.array([None], pa.int64()), pa.array([None], pa.bool_()), pa.array([None], pa.int64()), pa.array([None], pa.binary()), *(pa.array([x], pa.binary()) for x in lists)], STORED_NAMES)
                number += 1

    return stored_by_block(rows.mapInArrow(run, STORED))


def ask_counts(stored: DataFrame) -> DataFrame:
    """Rows (key, block, n, tail): the distinct tokens of each block with their count in its training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, keys, counts, tails in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                k = np.frombuffer(keys.as_buffer(), np.int64)
                yield pa.record_batch([pa.array(k), pa.array(np.full(len(k), block)), pa.array(np.frombuffer(counts.as_buffer(), np.int64)), pa.array(np.frombuffer(tails.as_buffer(), np.uint16).astype(np.int64))], ["key", "block", "n", "tail"])

    return stored.filter("keys is not null").select("block", "keys", "counts", "tails").mapInArrow(run, "key long, block long, n long, tail long")


def answer_counts(asked: DataFrame) -> DataFrame:
    """Rows (block, key, n, tail): each block's keys with their count in all training documents.

    Rows of block -1 are for the driver: the largest counts of each task; of block -2: per task and ending, the
    known tokens (key) and their counts (n).
    """
    state: dict = {}

    def start() -> None:
        state.update(known=np.zeros(ENDINGS + 1, np.int64), total=np.zeros(ENDINGS + 1, np.int64), top=(np.zeros(0, np.int64),) * 3)

    def reply(group: np.ndarray, at: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n = np.add.reduceat(columns["n"], at)
        key, tail = columns["key"][at], columns["tail"][at]
        cls = np.where(key.view(np.uint64) == END, ENDINGS, tail)
        state["known"] += np.bincount(cls, n > 0, ENDINGS + 1).astype(np.int64)
        state["total"] += np.bincount(cls, n, ENDINGS + 1).astype(np.int64)
        k, c, t = (np.concatenate(x) for x in zip(state["top"], (key, n, tail), strict=True))
        best = np.lexsort((k, -c))[:TOPS_PER_TASK]
        state["top"] = k[best], c[best], t[best]
        return {"block": columns["block"], "key": columns["key"], "n": n[group], "tail": columns["tail"]}

    def last() -> dict[str, np.ndarray]:
        k, c, t = state["top"]
        cls = np.arange(ENDINGS + 1)
        return {"block": np.r_[np.full(len(k), -1), np.full(len(cls), -2)], "key": np.r_[k, state["known"]], "n": np.r_[c, state["total"]], "tail": np.r_[t, cls]}

    return answer(asked, reply, "block long, key long, n long, tail long", last, start)


class Classes:
    """Which class a token is in and its share there. Bounded by FREQUENT and ENDINGS, whatever the vocabulary."""

    def __init__(self, replies: DataFrame) -> None:
        tops = replies.filter("block = -1 and n > 0").orderBy(F.desc("n"), "key").limit(FREQUENT).select("key", "n", "tail").collect()
        shares = replies.filter("block = -2").groupBy("tail").agg(F.sum("key").alias("known"), F.sum("n").alias("total")).collect()
        known, total = np.zeros(ENDINGS + 1, np.int64), np.zeros(ENDINGS + 1, np.int64)
        for r in shares:
            known[r.tail], total[r.tail] = r.known, r.total
        self.n, self.v = int(total.sum()), int(known.sum())
        self.rest_known, self.rest_total = known[:ENDINGS], total[:ENDINGS]
        keys = []
        for r in tops:
            key = np.int64(r.key).view(np.uint64)
            if key != END:
                keys.append(key)
                self.rest_known[r.tail] -= 1
                self.rest_total[r.tail] -= r.n
        self.top = np.sort(np.array(keys, np.uint64))
        self.size = 1 + ENDINGS + len(self.top)

    def of(self, keys: np.ndarray, tails: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes (0: end, then endings, then frequent tokens) and log10 P(token | class)."""
        cls = tails + 1
        share = np.log10((n + 1) / (self.rest_total[tails] + self.rest_known[tails] + 1))
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, keys), len(self.top) - 1)
            hit = self.top[at] == keys
            cls = np.where(hit, 1 + ENDINGS + at, cls)
            share[hit] = 0
        end = keys == END
        cls[end], share[end] = 0, 0
        return cls, share


ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, inner double, classes binary"


def encode(stored: DataFrame, replies: DataFrame, classes: Classes) -> DataFrame:
    """A row per document: its class sequence and what doesn't depend on states."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key = right.column("key").to_numpy().view(np.uint64)
        order = np.argsort(key)  # the block's keys as indexed() sorted them
        c, tails = right.column("n").to_numpy()[order], right.column("tail").to_numpy()[order]
        cls, share = classes.of(key[order], tails, c)
        base, small, known = np.log10((c + 1) / (classes.n + classes.v + 1)), cls.astype(np.uint16), (c > 0).astype(np.int64)
        press, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        rows = []
        for cell in left.column("tokens"):
            at = np.frombuffer(unpack.decompress(cell.as_buffer()), np.uint32)
            rows.append((int(known[at].sum()), float(base[at].sum()), float(share[at].sum()), press.compress(small[at].tobytes())))
        kinds = (pa.int64(), pa.float64(), pa.float64(), pa.binary())
        made = [pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, kinds, strict=True)]
        return pa.table([left.column("doc_id"), left.column("held_out"), left.column("size"), *made], [x.split()[0] for x in ENCODED.split(", ")])

    return stored.filter("keys is null").groupBy("block").cogroup(replies.filter("block >= 0").groupBy("block")).applyInArrow(run, ENCODED)


def sequences(batch: pa.RecordBatch) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return [np.frombuffer(unpack.decompress(x.as_buffer()), np.uint16) for x in batch.column("classes")]


class Model:
    """Start (K), transitions (K x K) and emissions (classes x K)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> None:
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, classes: int, states: int = STATES, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        move = np.full((states, states), 0.02) + np.eye(states) + 0.02 * rng.random((states, states))
        emit = 0.5 + rng.random((classes, states))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        start, move, emit = start + 0.1, move + 0.01, emit + 0.01
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Lanes:
    """Class sequences side by side, by falling length."""

    def __init__(self, seqs: list[np.ndarray]) -> None:
        self.order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        size = np.array([len(seqs[i]) for i in self.order], np.int64)
        self.base, self.steps = np.cumsum(size) - size, int(size[0]) if len(size) else 0
        self.flat = np.concatenate([seqs[i] for i in self.order]) if len(size) else np.zeros(0, np.uint16)
        self.live = np.searchsorted(-size, -np.arange(self.steps), "left")  # lanes longer than t

    def seen(self, t: int) -> np.ndarray:
        """The classes at place t of all lanes that have one."""
        return self.flat[self.base[: self.live[t]] + t]

    def step(self, model: Model, alpha: np.ndarray | None, t: int) -> tuple[np.ndarray, np.ndarray]:
        """State probabilities at place t from those before, and the scale that made each lane's sum one."""
        now = (model.start if alpha is None else alpha[: self.live[t]] @ model.move) * model.emit[self.seen(t)]
        scale = now.sum(1)
        now /= scale[:, None]
        return now, scale


def forward(model: Model, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each class sequence."""
    lanes, logs, alpha = Lanes(seqs), np.zeros(len(seqs)), None
    for t in range(lanes.steps):
        alpha, scale = lanes.step(model, alpha, t)
        logs[: len(scale)] += np.log10(scale)
    out = np.zeros(len(seqs))
    out[lanes.order] = logs
    return out


def expected(model: Model, seqs: list[np.ndarray], stride: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of whole sequences: starts, transitions and emissions. Forward probabilities are kept for `stride` steps."""
    states, classes = len(model.start), len(model.emit)
    start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((classes, states))
    lanes, alpha, marks, kept = Lanes(seqs), None, [], []
    stride = stride or (STRIDE if len(lanes.flat) > TOKENS else max(1, lanes.steps))
    for t in range(lanes.steps):
        if t % stride == 0:
            marks.append(alpha)
            kept = []
        alpha, scale = lanes.step(model, alpha, t)
        kept.append((alpha, scale))
    beta = np.ones((len(seqs), states))
    while marks:
        before = marks.pop()
        first = len(marks) * stride
        steps, alpha = range(first, min(lanes.steps, first + stride)), before
        if not kept:  # all but the last
            for t in steps:
                alpha, scale = lanes.step(model, alpha, t)
                kept.append((alpha, scale))
        gammas = []
        for t in reversed(steps):
            k = lanes.live[t]
            alpha, scale = kept[t - first]
            gammas.append(alpha * beta[:k])
            if t:
                last = before if t == first else kept[t - first - 1][0]
                right = model.emit[lanes.seen(t)] * beta[:k] / scale[:, None]
                move += model.move * (last[:k].T @ right)
                beta[:k] = right @ model.move.T
        used, flat = np.concatenate([lanes.seen(t) for t in reversed(steps)]), np.concatenate(gammas)
        for s in range(states):
            emit[:, s] += np.bincount(used, flat[:, s], classes)
        if not first:
            start += gammas[-1].sum(0)
        kept = []
    return start, move, emit


def baum_welch(encoded: DataFrame, model: Model) -> Model:
    """One round over all training documents. Each task gives one row of sums for each state, so a few KB."""
    states, classes = len(model.start), len(model.emit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        # Long texts are gathered longer: there are few of them, and a step costs the same for one as for many.
        gathered = {False: ([], TOKENS), True: ([], 8 * TOKENS)}
        sizes = {False: 0, True: 0}

        def counted(long: bool) -> None:
            nonlocal total
            if gathered[long][0]:
                got = expected(model, gathered[long][0])
                total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
                gathered[long][0].clear()
                sizes[long] = 0

        for batch in batches:
            for seq in sequences(batch):
                long = len(seq) > LONG
                if sizes[long] + len(seq) > gathered[long][1]:
                    counted(long)
                gathered[long][0].append(seq)
                sizes[long] += len(seq)
        counted(False)
        counted(True)
        if total is not None:
            start, move, emit = total
            whole = np.concatenate([start[None, :], move, emit]).ravel()
            at = np.flatnonzero(whole)
            yield pa.record_batch([pa.array(at), pa.array(whole[at])], ["cell", "weight"])

    rows = encoded.filter("not held_out").select("classes").mapInArrow(run, "cell long, weight double").groupBy("cell").agg(F.sum("weight").alias("weight")).collect()
    whole = np.zeros((1 + states + classes) * states)
    for r in rows:
        whole[r.cell] = r.weight
    whole = whole.reshape(-1, states)
    return Model.of_counts(whole[0], whole[1 : states + 1], whole[states + 1 :])


def score_documents(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents."""
    stored = indexed(docs, id_column, text_column)
    replies = materialize(answer_counts(ask_counts(stored)), "counts")
    classes = Classes(replies)
    encoded = materialize(encode(stored, replies, classes), "encoded")
    release(replies)
    drop_blocks(stored)
    model = Model.first(classes.size)
    for _ in range(rounds):
        model = baum_welch(encoded, model)
    train_tokens = classes.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = forward(model, sequences(batch)) + batch.column("inner").to_numpy()
            yield pa.record_batch([batch.column("doc_id"), *(batch.column(k) for k in ("held_out", "n_tokens", "n_known")), pa.array(np.full(len(batch), train_tokens)), batch.column("base_score"), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return encoded.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
