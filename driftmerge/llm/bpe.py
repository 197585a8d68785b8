"""Byte-level BPE by an index of pairs.

A block of texts is encoded as a whole. Texts are cut into chunks before each blank that stands between two other
characters, where a pre-token always begins; the vocabulary's own pre-tokenizer cuts the chunks into pre-tokens. The distinct
pre-tokens of a block lie behind each other in one array of symbols, linked to their neighbours. The index maps each pair
that the vocabulary merges to all its positions. Its ranks are taken in ascending order from a heap of those that have
positions; a rank is applied to all its positions at once, and the pairs that this makes are added to their lists. Positions
whose pair is gone are found when their rank's turn comes. Merges only make pairs of higher ranks (checked when a
vocabulary is read), so this gives what merging each pre-token by itself gives.

Chunks that were met before by a worker are looked up. That memory is bounded and changes no result.

Defined results: null and empty texts have no tokens (an empty list) and decode to the empty text; ids of a null list decode
to the empty text; the strings of added tokens are those tokens; repeated rows and ids stay as they are; a table without rows gives none.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmerge.llm.common import raw, slices, table, texts

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of text that one index holds (one longer text stands alone), chunks remembered by a task, and the longest of them.
INDEX_BYTES, CACHE, LONGEST = 5 << 20, 500_000, 64

#: Latin, Greek and Cyrillic letters lie below; no letters were added to Unicode there for long, so all libraries agree on them.
OLD_LETTERS = "\u0530"

_BLANKS = re.compile(r" \s|\s ")
_BETWEEN = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else one beyond 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Vocabulary:
    """Merges, tokens and pre-tokenizer of a byte-level BPE file."""

    def __init__(self, name: str = VOCABULARY) -> None:
        import public_tokenizers

        self.path = public_tokenizers.path(name)
        with open(self.path, encoding="utf-8") as f:
            held = json.load(f)
        model = held["model"]
        cut = held["pre_tokenizer"] or {}
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or held["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex"):
            raise ValueError(f"{name} is not a plain byte-level vocabulary")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in held["added_tokens"]):
            raise ValueError(f"{name} has added tokens that take their surroundings")
        letters, ids = byte_letters(), model["vocab"]
        self.added = {x["content"]: x["id"] for x in held["added_tokens"]}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        size = 1 + max([*ids.values(), *self.added.values()])
        self.bytes = [b""] * size
        for token, k in ids.items():
            self.bytes[k] = bytes(letters[c] for c in token)
        for token, k in self.added.items():
            self.bytes[k] = token.encode()
        self.shown = {b: c for c, b in letters.items()}
        #: The pre-tokenizer's pattern where all is ASCII.
        self.ascii = re.compile(public_tokenizers.PATTERN.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(" ?A-Za-z+", " ?[A-Za-z]+").replace(" ?0-9+", " ?[0-9]+"), re.ASCII)
        self.of_letter = np.full(512, -1, np.int32)
        for letter, b in letters.items():
            self.of_letter[ord(letter)] = ids[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left, right = (np.array([ids[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.left, self.right = left, right
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)
        made_at = np.full(size, -1, np.int64)
        made_at[self.made] = np.arange(len(pairs))
        if (np.maximum(made_at[left], made_at[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{name} merges a token before it makes it")
        self.size = size
        keys = left * size + right
        self.rank = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank]

    @functools.cached_property
    def pretokens(self) -> Callable[[str], list[tuple[str, tuple[int, int]]]]:
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 if it is never merged; symbols below 0 are ends."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.keys[at] == keys), self.rank[at], -1)


@functools.lru_cache(maxsize=2)
def vocabulary_of(name: str) -> Vocabulary:
    """One vocabulary for all tasks of a worker."""
    return Vocabulary(name)


class PairIndex:
    """Words' symbols, linked within each word, and the positions of each pair."""

    def __init__(self, words: list[str], vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        n = len(letters)
        # The last place is what lies beyond each word's ends.
        self.symbol = np.append(vocabulary.of_letter[letters], -1).astype(np.int32)
        self.start = np.cumsum(sizes) - sizes
        at = np.arange(n, dtype=np.int32)
        self.after, self.before = np.append(at + 1, n).astype(np.int32), np.append(at - 1, n).astype(np.int32)
        self.after[self.start + sizes - 1] = n
        self.before[self.start] = n
        self.lists: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.add(at)

    def add(self, at: np.ndarray) -> None:
        """Puts the pairs that begin at these positions into the lists of their ranks."""
        ranks = self.v.ranks(self.symbol[at], self.symbol[self.after[at]])
        hit = ranks >= 0
        at, ranks = at[hit], ranks[hit]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
            r = int(ranks[lo])
            if r in self.lists:
                self.lists[r].append(at[lo:hi])
            else:
                self.lists[r] = [at[lo:hi]]
                heapq.heappush(self.active, r)

    def merge(self) -> None:
        """Applies all active ranks."""
        symbol, after, before, end = self.symbol, self.after, self.before, len(self.symbol) - 1
        while self.active:
            r = heapq.heappop(self.active)
            at = np.unique(np.concatenate(self.lists.pop(r)))
            left, right = self.v.left[r], self.v.right[r]
            at = at[(symbol[at] == left) & (symbol[after[at]] == right)]
            if left == right and len(at) > 1:  # of overlapping places, every other one from the left
                new = np.r_[True, after[at[:-1]] != at[1:]]
                first = np.flatnonzero(new)[np.cumsum(new) - 1]
                at = at[(np.arange(len(at)) - first) % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            symbol[at], symbol[gone] = self.v.made[r], -2
            far = after[gone]
            after[at] = far
            inside = far < end
            before[far[inside]] = at[inside]
            near = before[at]
            self.add(np.r_[near[near < end], at])

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words, and how many each has."""
        alive = self.symbol[:-1] >= 0
        return self.symbol[:-1][alive].astype(np.int32), np.add.reduceat(alive, self.start, dtype=np.int64)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        self.v = vocabulary_of(vocabulary)
        self.known: dict[str, bytes] = {}

    def parts(self, text: str) -> list[tuple[int | None, str, list[str]]]:
        """What is between added tokens, each with the added token before it: its first chunk, and those that follow a blank, without it."""
        out, at, before = [], 0, None
        for m in self.v.cut.finditer(text):
            out.append((before, *self.plain(text[at : m.start()])))
            at, before = m.end(), self.v.added[m[0]]
        out.append((before, *self.plain(text[at:] if at else text)))
        return out

    @staticmethod
    def plain(text: str) -> tuple[str, list[str]]:
        if _BLANKS.search(text):
            first, *rest = _BETWEEN.split(text)
            return first, [x[1:] for x in rest]
        first, *rest = text.split(" ")
        return first, rest

    def pretokens(self, chunk: str) -> list[str]:
        if chunk.isascii():
            return [x.translate(self.v.shown) for x in self.v.ascii.findall(chunk)]
        body = chunk.rstrip(".,;:!?")
        if max(chunk) < OLD_LETTERS and body[0] == " " and body[1:].isalpha():  # a word and what ends a sentence
            word = body.encode().decode("latin-1").translate(self.v.shown)
            return [word] if len(body) == len(chunk) else [word, chunk[len(body) :]]
        return [w for w, _ in self.v.pretokens(chunk)]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of chunks, by one index over their distinct pre-tokens."""
        parts = list(map(self.pretokens, chunks))
        number = dict.fromkeys(w for p in parts for w in p)
        index = PairIndex(list(number), self.v)
        index.merge()
        ids, counts = index.tokens()
        edges = (4 * np.r_[0, np.cumsum(counts)]).tolist()
        body = ids.astype("<i4").tobytes()
        made = dict(zip(number, (body[a:z] for a, z in zip(edges, edges[1:], strict=False)), strict=True))
        return [made[p[0]] if len(p) == 1 else b"".join(map(made.__getitem__, p)) for p in parts]

    def __call__(self, rows: list[str]) -> list[bytes]:
        """The ids of each text of a block."""
        cut = list(map(self.parts, rows))
        known, missing, heads = self.known, set(), set()
        for parts in cut:
            for _, first, rest in parts:
                heads.add(first)
                missing.update(rest)
        heads.discard("")
        after = list(missing.difference(known))
        ids = self.learn([*heads, *(" " + x for x in after)]) if heads or after else []
        head = dict(zip(heads, ids, strict=False)) | {"": b""}
        known.update(zip(after, ids[len(heads) :], strict=True))
        out = []
        for parts in cut:
            cells = []
            for before, first, rest in parts:
                cells += (b"" if before is None else before.to_bytes(4, "little"), head[first], *map(known.__getitem__, rest))
            out.append(b"".join(cells))
        # Those that came first stay: frequent chunks are among them.
        for x in after:
            if len(x) > LONGEST or len(known) > CACHE:
                del known[x]
        return out


@functools.lru_cache(maxsize=2)
def encoder_of(vocabulary: str) -> Encoder:
    """One encoder for all tasks of a worker."""
    return Encoder(vocabulary)


def encode(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """Rows (doc_id, ids array<int>) of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(vocabulary)
        for batch in batches:
            column = texts(batch.column(1))
            _, offs = raw(column)
            for lo, hi in slices(offs, INDEX_BYTES):
                cells = encoder(column[lo:hi].to_pylist())
                edges = np.r_[0, np.cumsum([len(x) // 4 for x in cells])].astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(cells), "<i4")))
                yield pa.record_batch([batch.column(0)[lo:hi], ids], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of `encoded` (doc_id, ids) with the text of their ids; bytes that aren't UTF-8 become replacement characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary_of(vocabulary).bytes
        for batch in batches:
            column = batch.column(1)
            values = column.values.to_numpy(zero_copy_only=False)
            offs = column.offsets.to_numpy()
            out = [b"".join(map(token.__getitem__, values[a:z].tolist())).decode("utf-8", "replace") if ok else "" for a, z, ok in zip(offs, offs[1:], column.is_valid().to_pylist(), strict=False)]
            yield pa.record_batch([batch.column(0), column, pa.array(out, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return decode(encode(table(spark, sf_dir, "documents"))).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
