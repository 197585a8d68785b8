r"""Personal data: labelers vote, expectation-maximisation weighs them, a span classifier decides.

Base spans are those of four fixed patterns and always stay: email, ip, card (Luhn) and phone; see ``base_spans``.
The method adds ``secret`` spans (keys, tokens, passwords), ``handle`` spans (addresses written out, as in
``name at host dot org``) and ``number`` spans (identity-like numbers outside the base patterns). Its candidates come
from broad patterns, and for each one labelers of three sorts vote yes, no or abstain:

* regex: the exact shape of a known kind (vendor prefix, hexadecimal, grouping of digits, character classes);
* gazetteer: a word list of names for such values, or of top-level domains, in or beside the span;
* context: an assignment or quotes around it, a cue before it, or a place inside a formula, version or price.

Votes and features of all candidates are counted by their combination, which is bounded, so the driver sees a small
table whatever the corpus. Expectation-maximisation over the votes estimates each labeler's reliability and each
candidate's probability. A logistic span classifier is trained towards those probabilities, weighted by the counts, on
features of the span and its surroundings (length, shares and changes of character classes, what stands on either
side) beside the votes, so spans that no or few labelers speak about are judged by what they look like. Spans that it
accepts are added where they don't overlap base spans.

Defined results: null and empty texts have no spans; very long texts are scanned once, in time linear in their length;
without candidates the classifier accepts none; equal texts have equal spans.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import table

KINDS = ("email", "ip", "card", "phone", "handle", "number", "secret")
Span = tuple[int, int, str]

_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the pattern, found from their @ signs: a long run without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        if at >= done and (m := _HOST.match(text, at + 1)):
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                done = m.end()
        at = text.find("@", at + 1)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers at a time out of each maximal dotted run; a group with a part over 255 is used up too."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for k in range(0, len(parts), 4):
            group = parts[k : k + 4]
            size = sum(map(len, group)) + len(group) - 1
            if len(group) == 4 and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in group):
                yield at, at + size
            at += size + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 10 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()
        at = text.find("+", m.end() if m else at + 1)


BASE = (("email", emails), ("ip", addresses), ("card", cards), ("phone", phones))


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by start, then kind as listed."""
    return sorted(((a, z, kind) for kind, find in BASE for a, z in find(text)), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# Candidates of the method: whole runs of one class of characters, written addresses of any length, grouped digits.
_TOKEN = re.compile(r"[A-Za-z0-9_+/=.-]{12,}")
_CUE = re.compile(r"([A-Za-z_]{2,24})[ \t]{0,2}[=:][ \t]{0,2}[\"']?$")
_WRITTEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ ]{0,2}[\[({ ](?:at|AT|@)[\])} ][ ]{0,2}[A-Za-z0-9-]++(?:[ ]{0,2}[\[({ ](?:dot|DOT|\.)[\])} ][ ]{0,2}[A-Za-z0-9-]++)+")
#: What every match of _WRITTEN holds.
_MARK = re.compile(r"[\[({ ](?:at|AT|@)[\])} ]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{2,4}[-/ .][0-9]{2,4}[-/ .][0-9]{3,6}(?![0-9A-Za-z-])")
#: Names of secret values, of identity numbers, and common top-level domains. Fixed values.
SECRET_WORDS = frozenset("token password passwd pwd secret key apikey api_key access_key secret_key auth bearer credential credentials private_key client_secret".split())
NUMBER_WORDS = frozenset("ssn social security passport phone tel telephone mobile fax account konto steuer numero iban id".split())
DOMAINS = frozenset("com org net edu gov io de fr es uk info".split())
#: Prefixes of keys that services hand out. Fixed values.
PREFIX = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{36}|sk[-_]|xox[abprs]-|AIza|eyJ")
_HEX = re.compile(r"[0-9a-f]{16,}$|[0-9A-F]{16,}$")


def entropy(text: str) -> float:
    """Bits for each character."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def candidates(text: str) -> Iterator[tuple[int, int, str, dict[str, int]]]:
    """(start, end, kind, votes): votes of the labelers are 1, -1 or, abstaining, 0."""
    has_digit = any(c in text for c in "0123456789")
    if has_digit or "=" in text or ":" in text:
        for m in _TOKEN.finditer(text):
            body = m[0].strip("=.-")
            digits = sum(c.isdigit() for c in body)
            start = m.start()
            # An assignment may be one run: the value begins after its last equals sign.
            name = ""
            if "=" in body:
                name, _, body = body.rpartition("=")
                start += m[0].index(name) + len(name) + 1
            else:
                start += m[0].index(body) if body else 0
            if len(body) < 12 or not digits or not any(c.isalpha() for c in body) or "@" in text[max(0, start - 1) : start + len(body) + 1]:
                continue
            before = text[max(0, start - 32) : start]
            cue = _CUE.search(before)
            word = (name or (cue[1] if cue else "")).lower()
            known = any(x in SECRET_WORDS for x in (word, *re.split(r"[_.-]", word)))
            votes = {
                "prefix": 1 if PREFIX.match(body) else 0, "hexadecimal": 1 if _HEX.match(body) else 0, "entropy": 1 if entropy(body) > 3.2 and digits * 8 >= len(body) else -1,
                "gazetteer": 1 if known else -1 if word else 0, "assigned": 1 if name or cue else 0, "quoted": 1 if before[-1:] in "\"'" and before else 0,
                "wordlike": -1 if re.fullmatch(r"[A-Za-z]+[.-]?[0-9]{1,3}(?:\.[0-9]+)*", body) or "." in body else 0,
            }
            yield start, start + len(body), "secret", votes
    if " at " in text or _MARK.search(text):
        for m in _WRITTEN.finditer(text):
            last = re.split(r"[^A-Za-z0-9-]+", m[0])[-1].lower()
            votes = {"bracketed": 1 if re.search(r"[\[({]", m[0]) else 0, "domain": 1 if last in DOMAINS else -1, "local": 1 if re.search(r"[0-9._]", m[0].split()[0]) else 0, "dots": 1 if re.search(r"(?i)\bdot\b", m[0]) else -1}
            yield *m.span(), "handle", votes
    if has_digit:
        for m in _NUMBER.finditer(text):
            before = re.findall(r"[A-Za-z]+", text[max(0, m.start() - 24) : m.start()].lower())
            groups = re.split(r"[-/ .]", m[0])
            votes = {
                "shape": 1 if re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{3}[-. ]\d{3}[-. ]\d{4}", m[0]) else -1, "cue": 1 if NUMBER_WORDS & set(before[-3:]) else 0,
                "date": -1 if re.fullmatch(r"\d{4}[-/.]\d{2}[-/.]\d{2,4}|\d{2}[-/.]\d{2}[-/.]\d{4}", m[0]) else 0, "formula": -1 if re.match(r"\s*[*/=^<>%]", text[m.end() : m.end() + 4]) else 0, "even": 1 if len(set(map(len, groups))) > 1 else 0,
            }
            yield *m.span(), "number", votes


#: Features of a span and how many values each has; all are small whole numbers, so their combinations are bounded.
LEVELS = {"length": 12, "digits": 5, "case": 4, "marks": 4, "turns": 4, "before": 6, "after": 6, "alone": 2}
_SIDES = {**dict.fromkeys(" \t\n\r", 1), **dict.fromkeys("\"'`", 2), **dict.fromkeys("=:", 3), **dict.fromkeys("()[]{}<>", 4)}
_TURN = re.compile(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]")


def features(text: str, start: int, end: int) -> dict[str, int]:
    """What a span and its surroundings look like."""
    body = text[start:end]
    before, after = text[start - 1 : start] if start else "", text[end : end + 1]
    digits = sum(map(str.isdigit, body))
    marks = len(set(body)) and sum(not c.isalnum() for c in set(body))
    return {
        "length": min(LEVELS["length"] - 1, len(body).bit_length()), "digits": digits * 4 // len(body), "case": (body != body.upper()) + 2 * (body != body.lower()), "marks": min(3, marks),
        "turns": min(3, sum(1 for _ in _TURN.finditer(body)) // 2), "before": _SIDES.get(before, 5) if before else 0, "after": _SIDES.get(after, 5) if after else 0, "alone": int(before in "\n" and after in "\n"),
    }


Votes = tuple[tuple[str, int], ...]
Counted = tuple[str, Votes, Votes, int]


def vote_counts(docs: DataFrame, text_column: str = "text") -> list[Counted]:
    """(kind, votes, features, count) of all candidates. Votes and features are small numbers, so combinations are few, whatever the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for cell in batch.column(0):
                if cell.is_valid:
                    text = cell.as_py()
                    seen.update((kind, tuple(sorted(votes.items())), tuple(sorted(features(text, a, z).items()))) for a, z, kind, votes in candidates(text))
        yield pa.record_batch([pa.array([k for k, _, _ in seen], pa.string()), pa.array([json.dumps(v) for _, v, _ in seen], pa.string()), pa.array([json.dumps(f) for _, _, f in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["kind", "votes", "looks", "n"])

    rows = docs.select(text_column).mapInArrow(run, "kind string, votes string, looks string, n long").groupBy("kind", "votes", "looks").agg(F.sum("n").alias("n")).orderBy("kind", "votes", "looks").collect()
    pairs = lambda x: tuple((k, v) for k, v in json.loads(x))
    return [(r.kind, pairs(r.votes), pairs(r.looks), r.n) for r in rows]


def reliabilities(votes: np.ndarray, n: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, float, np.ndarray]:
    """Expectation-maximisation for labelers that abstain: P(vote | truth), the prior, and each row's probability.

    votes: combinations x labelers of -1, 0, 1. Starts from the majority, and a labeler is smoothed towards being
    better than chance, so that yes stays yes.
    """
    p = np.clip(0.5 + votes.sum(1) / (2 * np.maximum(1, np.abs(votes).sum(1))), 0.05, 0.95)
    table_ = np.zeros((votes.shape[1], 3, 2))
    prior = 0.5
    for _ in range(rounds):
        for j in range(votes.shape[1]):
            for v in (-1, 0, 1):
                own = votes[:, j] == v
                for truth in (0, 1):
                    weight = n * (p if truth else 1 - p)
                    lean = 3.0 if v == 0 else 4.0 if (v > 0) == bool(truth) else 1.0
                    table_[j, v + 1, truth] = (weight[own].sum() + lean) / (weight.sum() + 8.0)
        prior = (n @ p + 1) / (n.sum() + 2)
        odds = np.full(len(n), math.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            odds += np.log(table_[j, votes[:, j] + 1, 1] / table_[j, votes[:, j] + 1, 0])
        now = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(now - p).max() < 1e-9:
            break
        p = now
    return table_, float(prior), p


def expand(votes: Votes, looks: Votes) -> np.ndarray:
    """Yes and no of each labeler, their sum, a one for each value of each feature, and a constant."""
    v = np.array([x for _, x in votes], float)
    ones = [np.zeros(LEVELS[name]) for name, _ in looks]
    for place, (_, value) in zip(ones, looks, strict=True):
        place[value] = 1
    return np.concatenate([v > 0, v < 0, [v.sum(), 1.0], *ones]).astype(float)


class SpanClassifier:
    """Logistic weights for each kind."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = weights
        self.known: dict[tuple, bool] = {}

    def accepts(self, kind: str, votes: dict[str, int], looks: dict[str, int]) -> bool:
        key = (kind, *votes.values(), *looks.values())
        if key not in self.known:
            w = self.weights.get(kind)
            self.known[key] = w is not None and float(expand(tuple(sorted(votes.items())), tuple(sorted(looks.items()))) @ w) > 0
        return self.known[key]

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans by start, then kind."""
        base = base_spans(text)
        added = sorted({(a, z, kind) for a, z, kind, votes in candidates(text) if self.accepts(kind, votes, features(text, a, z))})
        if not added:
            return base, base
        starts = sorted((a, z) for a, z, _ in base)
        furthest = list(accumulate((z for _, z in starts), max))
        out, last = list(base), 0
        for a, z, kind in added:
            k = bisect.bisect_left(starts, (z, 0))  # base spans that begin before z overlap if one ends after a
            if a >= last and not (k and furthest[k - 1] > a):
                out.append((a, z, kind))
                last = z
        return base, sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def train(counts: list[Counted], rounds: int = 200, ridge: float = 1.0) -> SpanClassifier:
    """Fits a classifier for each kind on the weak labels; counts are its weights."""
    weights = {}
    for kind in sorted({k for k, _, _, _ in counts}):
        rows = [(v, f, n) for k, v, f, n in counts if k == kind]
        voted: Counter = Counter()
        for v, _, n in rows:
            voted[v] += n
        _, _, found = reliabilities(np.array([[x for _, x in v] for v in voted]), np.array(list(voted.values()), float))
        truth = dict(zip(voted, found.tolist(), strict=True))
        n, p = np.array([x for _, _, x in rows], float), np.array([truth[v] for v, _, _ in rows])
        z = np.array([expand(v, f) for v, f, _ in rows])
        w = np.zeros(z.shape[1])
        share = n / n.sum() * 1000
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve(z.T @ (z * (share * q * (1 - q))[:, None]) + ridge * np.eye(len(w)), z.T @ (share * (p - q)) - ridge * w)
            w += step / max(1.0, np.abs(step).max())
            if np.abs(step).max() < 1e-9:
                break
        weights[kind] = w
    return SpanClassifier(weights)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, classifier: SpanClassifier, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each document with the counts and digest of its base spans and a list of all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, cell in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, spans = classifier.spans(cell.as_py() or "") if cell.is_valid else ([], [])
                n = Counter(kind for _, _, kind in base)
                rows.append((doc, *(n[k] for k in KINDS[:4]), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
            yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, kinds, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column)).mapInArrow(run, FOUND)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for a, z, kind in spans:
        if a < at:
            # The rest of an overlapping span goes as well.
            at = max(at, z)
            continue
        out += (text[at:a], f"[{kind.upper()}]")
        at = z
    return "".join((*out, text[at:]))


def redact(docs: DataFrame, classifier: SpanClassifier, text_column: str = "text", length_column: str | None = "n_chars") -> DataFrame:
    """All columns of docs, spans replaced in the texts; the length column follows. Null texts stay null."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [None if (t := cell.as_py()) is None else redacted(t, classifier.spans(t)[1]) for cell in batch.column(text_column)]
            columns = list(batch.columns)
            columns[names.index(text_column)] = pa.array(done, pa.string())
            yield pa.record_batch(columns, batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    if length_column in names:
        kind = docs.schema[length_column].dataType
        out = out.withColumn(length_column, F.when(F.col(text_column).isNotNull(), F.length(text_column).cast(kind)).otherwise(F.col(length_column)))
    return out.select(*names)


def op3_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(vote_counts(docs)))
