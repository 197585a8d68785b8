"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nyström landmarks.

Kernel. A text unit is a word, in five-bit symbols: letters whatever their case, digits as the letters they stand for
in disguise, other scripts' bytes by five symbols. ASCII punctuation inside a word is dropped and runs of single
letters are one unit, so that ``i.d.i.o.t`` and ``i d i o t`` are what they spell. Two units are compared by their
common subsequences of ``ORDER`` symbols, each gap of one inserted symbol costing a factor ``DECAY``; the kernel is
normalised by a length term, which keeps it positive.

Landmarks. The units whose share of toxic training texts is surest (log-likelihood ratio), the clean units that the
last machine took for toxic, and a few frequent clean ones. The Nyström map K(x, landmarks) K(landmarks, landmarks)^-1/2 makes the machine linear.

Training. Only documents carry labels, so each toxic document is a bag: the surest
units of its sentences are its positive instances, units of clean documents are negative, and more rounds take each
bag's best unit under the last machine. A document's margin is that of its best unit, and a logistic fit over training
documents turns margins into scores. Because the kernel is a sum over subsequences, the machine is one table of
2^20 weights: each unit of every text is scored by lookups, at every length of text, without a window or prefix.

The sample that is trained on is bounded by these parameters, whatever the input: at most ``TRAIN_DOCS`` labelled
documents, the first by a hash of their id; of their units, the ``4 * LANDMARKS`` surest toxic ones, ``UNITS`` clean
ones (half the most frequent, half by a hash), and each document's best unit; ``LANDMARKS`` toxic and
``1.25 * CLEAN_LANDMARKS`` clean units as landmarks. Units of any length are trained on and scored. Labels, language,
source and id are never features.

Defined results: null, empty and blank texts have the lowest margin; without a toxic or without a clean training
document all scores are the share of toxic ones; several label rows of a document count once, toxic if any says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftmerge.llm.common import crc_remainder, materialize, raw, release, slices, table, texts

ORDER, DECAY, SYMBOLS = 4, 0.6, 32
TRAIN_DOCS, LANDMARKS, CLEAN_LANDMARKS, UNITS, ROUNDS, HARD = 20_000, 192, 160, 12_000, 3, 30
HOLD_MODULUS, HOLD_REMAINDER, THRESHOLD = 3, 1, 0.7
GAP, DROP = 31, 255

#: Symbol of each byte: 0-25 letters, 26-30 bytes of other scripts, 31 between units, 255 dropped.
SYMBOL = np.full(256, DROP, np.uint8)
SYMBOL[[9, 10, 11, 12, 13, 32]] = GAP
SYMBOL[97:123] = np.arange(26)
SYMBOL[65:91] = np.arange(26)
SYMBOL[128:] = 26 + np.arange(128, 256) % 5
#: Digits and signs that stand for letters in disguised words. Fixed values.
for _c, _l in zip("0134578@$", "oieastbas", strict=True):
    SYMBOL[ord(_c)] = ord(_l) - 97

_GAPS = [(a, b, c) for a in (1, 2) for b in (1, 2) for c in (1, 2)]
_WEIGHT = [DECAY ** (a + b + c - 3) for a, b, c in _GAPS]


def length_term(n: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of a unit's subsequences: depends on its length alone."""
    out = np.zeros(len(n))
    for (a, b, c), w in zip(_GAPS, _WEIGHT, strict=True):
        out += np.maximum(0, n + 4 - (a + b + c)) * w * w
    return np.sqrt(out)


def units(body: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols with two of GAP before and after each unit, starts and lengths of units, and how many each text has.

    Two, so that a skip of one symbol never leads into the next unit unseen; and GAP marks beginnings and ends.
    """
    at = offs - offs[0]
    sym = SYMBOL[body[offs[0] : offs[-1]]]
    keep = sym != DROP
    edge = np.r_[0, np.cumsum(keep)][at]
    sym = np.insert(sym[keep], edge, GAP)
    edge = edge + np.arange(len(edge))
    gap = sym == GAP
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[0] = True
    edge = (np.cumsum(keep) - 1)[edge]
    sym = sym[keep]
    gap = np.flatnonzero(sym == GAP)
    size = np.diff(gap) - 1
    if (size == 1).any():  # single letters in a row are one unit: the gaps between them go
        inner = gap[1:-1][(size[:-1] == 1) & (size[1:] == 1)]
        inner = np.setdiff1d(inner, edge)
        keep = np.ones(len(sym), bool)
        keep[inner] = False
        edge = (np.cumsum(keep) - 1)[edge]
        sym = sym[keep]
    twice = 1 + (sym == GAP)
    edge = (np.cumsum(twice) - twice)[edge]
    sym = np.repeat(sym, twice)
    gap = sym == GAP
    starts = np.flatnonzero(~gap[1:] & gap[:-1]) + 1
    stops = np.flatnonzero(gap[1:] & ~gap[:-1]) + 1
    return sym, starts, stops - starts, np.diff(np.searchsorted(starts, edge))


def unit_margins(sym: np.ndarray, starts: np.ndarray, size: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum over each unit's subsequences of their weights, divided by its length term."""
    if not len(starts):
        return np.zeros(0)
    # After the last two of GAP comes a letter, as after those between units: more of GAP would be taken for the unit's end.
    s = np.concatenate([sym, np.zeros(7, np.uint8)]).astype(np.int32)
    n = len(sym)
    near, far = s[: n + 5] * SYMBOLS + s[1 : n + 6], s[: n + 5] * SYMBOLS + s[2 : n + 7]
    pair = {1: near, 2: far}
    total = np.zeros(n, np.float32)
    for (a, b, c), w in zip(_GAPS, _WEIGHT, strict=True):
        total += np.float32(w) * weights[pair[a][:n] * (SYMBOLS * SYMBOLS) + pair[c][a + b : n + a + b]]
    return np.add.reduceat(total[: starts[-1] + size[-1]], starts - 2) / length_term(size)


def subsequences(unit: bytes) -> dict[int, float]:
    """Subsequence codes of a unit (symbols as bytes) between its marks, with their summed weights."""
    out: dict[int, float] = {}
    x = bytes([GAP, GAP]) + unit + bytes([GAP, GAP])
    for i in range(len(unit) + 2):
        for (a, b, c), w in zip(_GAPS, _WEIGHT, strict=True):
            j, k, m = i + a, i + a + b, i + a + b + c
            if m < len(x):
                code = ((x[i] * SYMBOLS + x[j]) * SYMBOLS + x[k]) * SYMBOLS + x[m]
                out[code] = out.get(code, 0.0) + w
    return out


class Encoded:
    """Subsequences of many units, flat."""

    def __init__(self, many: list[bytes]) -> None:
        rows = [subsequences(x) for x in many]
        size = np.array([len(r) for r in rows], np.int64)
        self.at = np.r_[0, np.cumsum(size)]
        self.codes = np.fromiter((c for r in rows for c in r), np.int32, int(self.at[-1]))
        self.weights = np.fromiter((w for r in rows for w in r.values()), np.float32, int(self.at[-1]))
        self.norm = length_term(np.array([len(x) for x in many]))

    def __len__(self) -> int:
        return len(self.norm)


class Machine:
    """Landmarks, the linear weights over them as one table of subsequences, and the logistic fit."""

    def __init__(self, landmarks: list[bytes]) -> None:
        self.codes: dict[int, int] = {}
        rows = []
        for x in landmarks:
            got = subsequences(x)
            for code in got:
                self.codes.setdefault(code, len(self.codes))
            rows.append(got)
        self.basis = np.zeros((len(self.codes), len(landmarks)))
        norm = length_term(np.array([len(x) for x in landmarks]))
        for j, got in enumerate(rows):
            for code, w in got.items():
                self.basis[self.codes[code], j] = w / norm[j]
        gram = self.basis.T @ self.basis
        value, vector = np.linalg.eigh(gram)
        keep = value > 1e-8 * value.max()
        self.map = (vector[:, keep] / np.sqrt(value[keep])).astype(np.float32)  # landmarks x features

    def features(self, many: Encoded) -> np.ndarray:
        row = np.full(SYMBOLS**ORDER, -1, np.int32)
        row[list(self.codes)] = np.arange(len(self.codes))
        basis = np.r_[self.basis, np.zeros((1, self.basis.shape[1]))].astype(np.float32)  # the last row is for all other codes
        out = np.empty((len(many), self.map.shape[1]), np.float32)
        for lo in range(0, len(many), 256):
            at = many.at[lo : lo + 257]
            codes, weights = many.codes[at[0] : at[-1]], many.weights[at[0] : at[-1]]
            sums = np.add.reduceat(basis[row[codes]] * weights[:, None], at[:-1] - at[0], axis=0)
            out[lo : lo + 256] = sums / many.norm[lo : lo + 256, None] @ self.map
        return out

    def table(self, w: np.ndarray) -> np.ndarray:
        """The machine's weight of each subsequence code. Codes that lead from a GAP at a unit's end into the next unit have none."""
        out = np.zeros(SYMBOLS**ORDER, np.float32)
        out[list(self.codes)] = self.basis @ (self.map @ w)
        return out


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss: Newton steps over the active set, halved until the loss falls; y is -1 or 1."""
    z = np.c_[x, np.ones(len(x), np.float32)]
    w = np.zeros(z.shape[1])
    ridge = np.ones(z.shape[1])
    ridge[-1] = 1e-3
    cost = weight * c

    def loss(v: np.ndarray) -> float:
        return float(0.5 * ridge @ (v * v) + 0.5 * cost @ np.maximum(0, 1 - y * (z @ v.astype(np.float32))) ** 2)

    now = loss(w)
    for _ in range(rounds):
        active = np.flatnonzero(y * (z @ w.astype(np.float32)) < 1)
        gram, right = np.diag(ridge), np.zeros(len(w))
        for lo in range(0, len(active), 4096):
            k = active[lo : lo + 4096]
            a = z[k].astype(float)
            gram = gram + a.T @ (a * cost[k, None])
            right += a.T @ (cost[k] * y[k])
        step = np.linalg.solve(gram, right) - w
        size = 1.0
        while size > 1e-6 and (after := loss(w + size * step)) >= now:
            size /= 2
        if size <= 1e-6 or now - after < 1e-7 * now:
            break
        w, now = w + size * step, after
    return w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and offset, with smoothed targets so that separable margins stay finite."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z = np.c_[x, np.ones(len(x))]
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.diag([1e-6, 1e-6])
        step = np.linalg.solve(h, z.T @ (target - p))
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


class Scorer:
    """A fitted model: margins and scores of texts."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, offset: float) -> None:
        self.weights, self.bias, self.slope, self.offset = weights, bias, slope, offset

    def margins(self, column: pa.Array) -> np.ndarray:
        """The best unit's margin of each text; a text without units has that of an unknown word."""
        body, offs = raw(texts(column))
        out = np.full(len(column), self.bias)
        for lo, hi in slices(offs):
            sym, starts, size, count = units(body, offs[lo : hi + 1])
            m = unit_margins(sym, starts, size, self.weights) + self.bias
            has = np.flatnonzero(count)
            if len(has):
                first = np.r_[0, np.cumsum(count)[:-1]][has]
                out[lo + has] = np.maximum(np.maximum.reduceat(m, first), self.bias)
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.offset, -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Rows (text, toxic) of at most `most` labelled documents outside the held-out part."""
    own = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(f"{crc_remainder('doc_id', HOLD_MODULUS)} <> {HOLD_REMAINDER}")
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic")


def unit_counts(rows: DataFrame) -> DataFrame:
    """Rows (unit, toxic, clean): the documents of either label that hold a unit of 2 symbols or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[bytes, list[int]] = {}
            for i, label in enumerate(batch.column(1).to_pylist()):
                for x in text_units(batch.column(0).slice(i, 1)):
                    found.setdefault(x, [0, 0])[0 if label else 1] += 1
            if found:
                yield pa.record_batch([pa.array(list(found), pa.binary()), pa.array([x[0] for x in found.values()], pa.int64()), pa.array([x[1] for x in found.values()], pa.int64())], ["unit", "toxic", "clean"])

    return rows.mapInArrow(run, "unit binary, toxic long, clean long").groupBy("unit").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def text_units(column: pa.Array) -> set[bytes]:
    body, offs = raw(texts(column))
    sym, starts, size, _ = units(body, offs)
    plain = sym.tobytes()
    return {plain[a : a + n] for a, n in zip(starts.tolist(), size.tolist(), strict=True) if n >= 2}


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Scorer:
    """Fits the machine. What reaches the driver is bounded by most, UNITS and LANDMARKS."""
    rows = materialize(training_rows(docs, labels, most), "toxic")
    totals = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sum(v for k, v in totals.items() if k), totals.get(0, 0)
    prior = n_toxic / max(1, n_toxic + n_clean)
    flat = Scorer(np.zeros(SYMBOLS**ORDER, np.float32), 0.0, 0.0, float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    if not n_toxic or not n_clean:
        release(rows)
        return flat
    counts = materialize(unit_counts(rows), "units")
    # Log-likelihood ratio against the prior; a unit must be surer than the luckiest of as many unrelated ones.
    both = F.col("toxic") + F.col("clean")
    part = lambda n, share: F.when(n > 0, n * F.log(n / both / share)).otherwise(0.0)
    ratio = 2 * (part(F.col("toxic"), prior) + part(F.col("clean"), 1 - prior))
    tested = counts.filter("toxic + clean >= 2").count()
    sure = 2 * float(np.log(max(tested, 2)))
    toxic = counts.withColumn("ratio", ratio).filter((F.col("toxic") > both * prior * 2) & (F.col("ratio") > sure)).orderBy(F.desc("ratio"), "unit").limit(LANDMARKS * 4).collect()
    clean = [bytes(r.unit) for r in counts.filter("clean > 0").orderBy(F.desc("clean"), "unit").limit(UNITS // 2).collect()]
    others = [bytes(r.unit) for r in counts.filter("clean > 0").orderBy(F.xxhash64("unit"), "unit").limit(UNITS // 2).collect()]
    if not toxic:
        release(rows, counts)
        return flat
    positive = {bytes(r.unit): float(r.ratio) for r in toxic}
    negative = sorted({*clean, *others} - positive.keys())
    hard: dict[bytes, int] = {}

    def machine_for(found: dict[bytes, float]) -> Scorer:
        nearest = sorted(hard, key=lambda u: (-hard[u], u))[:CLEAN_LANDMARKS]
        machine = Machine([*list(positive)[:LANDMARKS], *nearest, *[u for u in clean if u not in positive and u not in nearest][: CLEAN_LANDMARKS // 4]])
        x = np.r_[machine.features(Encoded(list(found))), machine.features(Encoded(negative))]
        y = np.r_[np.ones(len(found)), -np.ones(len(negative))]
        w, b = fit_svm(x, y, np.r_[np.array(list(found.values())) * len(negative) / sum(found.values()) / 2, np.array([1.0 + HARD * hard.get(x, 0) for x in negative])])
        return Scorer(machine.table(w), b, 1.0, 0.0)

    scorer = machine_for(positive)
    for _ in range(ROUNDS):
        best = _best_units(rows, scorer)
        hard = {}
        for x, label, margin in best:
            if not label and margin > -0.5:
                hard[x] = hard.get(x, 0) + 1
        wrong = sorted(hard.keys() - set(negative) - positive.keys())
        found = dict(positive)
        for x, label, margin in best:  # each toxic bag's best unit counts, if the machine takes it for toxic
            if label and margin > 0 and x not in positive and x not in hard:
                found[x] = found.get(x, 0.0) + sure / 4
        negative += wrong
        scorer = machine_for(found)
    pairs = _margins(rows, scorer)
    scorer.slope, scorer.offset = fit_logistic(pairs[:, 0], pairs[:, 1])
    release(rows, counts)
    return scorer


def _best_units(rows: DataFrame, scorer: Scorer) -> list[tuple[bytes, int, float]]:
    """The best unit of each training document: bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, label, margin = [], [], []
            for i, toxic in enumerate(batch.column(1).to_pylist()):
                body, offs = raw(texts(batch.column(0).slice(i, 1)))
                sym, starts, size, _ = units(body, offs)
                m = unit_margins(sym, starts, size, scorer.weights)
                m[size < 2] = -np.inf
                if len(m) and np.isfinite(m.max()):
                    k = int(m.argmax())
                    found.append(sym[starts[k] : starts[k] + size[k]].tobytes())
                    label.append(int(toxic))
                    margin.append(float(m[k] + scorer.bias))
            yield pa.record_batch([pa.array(found, pa.binary()), pa.array(label, pa.int32()), pa.array(margin, pa.float64())], ["unit", "toxic", "margin"])

    return [(bytes(r.unit), r.toxic, r.margin) for r in rows.mapInArrow(run, "unit binary, toxic int, margin double").collect()]


def _margins(rows: DataFrame, scorer: Scorer) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(scorer.margins(batch.column(0))), batch.column(1).cast(pa.float64())], ["margin", "toxic"])

    return np.array([(r.margin, float(r.toxic > 0)) for r in rows.mapInArrow(run, "margin double, toxic double").collect()]).reshape(-1, 2)


def score(docs: DataFrame, scorer: Scorer, text_column: str = "text", name: str = "score") -> DataFrame:
    """All columns of docs with the score of each text."""
    # One weight table of 4 MB travels to each executor once, whatever the input.
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = held.value.scores(batch.column(text_column))
            yield pa.record_batch([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, out)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(docs, table(spark, sf_dir, "labels"))
    held = F.expr(f"coalesce({crc_remainder('doc_id', HOLD_MODULUS)} = {HOLD_REMAINDER}, false)")
    return score(docs, scorer).select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
