import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftmerge.llm import bpe, middle, whitening
from tests.llm.conftest import LONG

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PARTS = [" ", "  ", "\n", "\t", " ", "\x1c", "\x85", "a", "aa", "b", "the", "'s", "'re", "1", "22", "é", "é", "漢字", "😀", "<|endoftext|>", "<|endof", "|>", "!", "...", "A", "\0", "᠎", "ʰ", "Ⅷ", "​", "<P>", "<S>"]


def odd_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_the_tokenizers(tokenizer):
    rows = [*odd_texts(1, 4000), " été, naïve. où?! don't l'été: жизнь; ªº µm ǆ ΐ.\u0301x é\u0301, ²é é² _é é_ 1é é1.", "a" * 3000, "ab" * 2000, "".join(random.Random(2).choices("abcdefgh", k=9000)), LONG, ""]
    encoder = bpe.Encoder()
    for part in (rows, rows[::-1], rows[:500]):
        for row, ids in zip(part, encoder(part), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == tokenizer.encode(row, add_special_tokens=False).ids, row


def test_what_a_task_remembers_changes_nothing(monkeypatch):
    rows = odd_texts(3, 600)
    want = bpe.Encoder()(rows)
    monkeypatch.setattr(bpe, "CACHE", 10)
    monkeypatch.setattr(bpe, "LONGEST", 2)
    few = bpe.Encoder()
    assert [x for k in range(0, 600, 50) for x in few(rows[k : k + 50])] == want


def test_index_applies_each_rank_to_overlapping_places_from_the_left():
    v = bpe.Vocabulary()
    index = bpe.PairIndex(["a" * n for n in range(1, 40)], v)
    index.merge()
    ids, counts = index.tokens()
    at = 0
    for n, k in enumerate(counts.tolist(), 1):
        assert b"".join(v.bytes[i] for i in ids[at : at + k].tolist()) == b"a" * n
        at += k


def test_encode_and_decode_of_odd_rows(spark, odd, none, tokenizer):
    got = sorted(map(tuple, bpe.decode(bpe.encode(odd)).collect()), key=repr)
    want = []
    for r in odd.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, tokenizer.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.decode(bpe.encode(none)).count() == 0
    cut = spark.createDataFrame([(1, [int(tokenizer.encode("é").ids[0]), 222]), (2, None), (3, [50256])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(cut).collect()} == {1: tokenizer.decode([*tokenizer.encode("é").ids, 222]), 2: "", 3: "<|endoftext|>"}


def test_bpe_query_equals_the_tokenizer(spark, tmp_path, tokenizer):
    docs = [(k, t) for k, t in enumerate([*odd_texts(5, 200), None])]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for k, t in docs:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        want.add((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.op11_bpe(spark, str(tmp_path)).collect()} == want


def test_elias_fano_gives_back_each_number():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 8, 9, 500):
        for most in (1, 3, 40, 100_000):
            numbers = np.cumsum(rng.integers(0, most, n))
            held = middle.EliasFano(middle.elias_fano(numbers))
            assert [held[k] for k in range(held.n)] == numbers.tolist()
    many = np.cumsum(rng.integers(1, 12, 10_000))
    assert len(middle.elias_fano(many)) < 10_000 * 5 / 8


def test_boundaries_are_those_of_the_units():
    for text in odd_texts(7, 2000):
        assert middle.boundaries(text).tolist() == [m.end() for m in UNITS.finditer(text)]


def slow_middle(doc, text, seed=42):
    text = text or ""
    units = UNITS.findall(text)
    h = hashlib.sha256(f"{seed}:{doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, z = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if doc is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, len(units), "plain", None, None, text
    head, inner, tail = ("".join(x) for x in (units[:a], units[a:z], units[z:]))
    if h4 % 100 < 80:
        return doc, len(units), "spm", len(head), len(inner), f"<S>{tail}<P>{head}<M>{inner}"
    return doc, len(units), "psm", len(head), len(inner), f"<P>{head}<S>{tail}<M>{inner}"


def test_middles_equal_brute_force_and_go_back(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = sorted(map(tuple, middle.transform(odd).collect()), key=repr)
    assert got == sorted((slow_middle(*r) for r in rows), key=repr)
    assert middle.transform(none).count() == 0
    texts = odd_texts(9, 300)
    docs = [(k, random.Random(k).choice(texts[:3] if k % 3 else texts)) for k in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = middle.transform(df, seed=42).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((slow_middle(*r) for r in docs), key=repr)
    by = dict(docs)
    assert all(middle.restored(r.output, r.form) == by[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_texts_that_share_a_hash_have_lists_of_their_own():
    cells = [[7] * 6, [0] * 6, list(range(6)), ["a b", "c", "a b", "c d e", "c", "a b"]]
    batch = pa.record_batch(cells, ["key", "block", "row", "text"])
    made = [x for out in middle.meet([batch.slice(0, 4), batch.slice(4)]) for x in out.column("ends").to_pylist()]
    assert [middle.EliasFano(x).n for x in made] == [2, 1, 2, 3, 1, 2]


def slow_whitening(vectors):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    off = x - s / n
    v = off.T @ off / n
    e, q = np.linalg.eigh(v)
    return n, ((n * x - s) ** 2).sum(1), off, e[::-1], q[:, ::-1], np.trace(v)


def test_whitening_equals_the_dense_eigenproblem(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((400, 48)) * np.linspace(0.2, 2, 48)
    base[:130] = base[0]  # a third of all rows are one vector
    rows = [(k, [float(c) for c in v.astype(np.float32)]) for k, v in enumerate(base)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    model = whitening.fit(df)
    n, deviation, off, e, q, trace = slow_whitening([r[1] for r in rows])
    assert model.n == n and model.components.shape == (48, 32)
    assert np.abs(model.values - e[:32]).max() < 1e-10 * e[0] and abs(model.trace - trace) < 1e-9 * trace
    assert (model.residuals <= whitening.TOLERANCE * e[0]).all()
    got = whitening.transform(df, model).collect()
    assert len(got) == 400 * 32
    for r in got:
        k = r.component - 1
        assert r.n == n and r.deviation == int(deviation[r.vec_id]) and abs(r.explained - e[k] / trace) < 1e-9 and r.identity_error < 1e-9
        assert abs(abs(r.whitened) - abs(off[r.vec_id] @ q[:, k] / np.sqrt(e[k]))) < 1e-7
    # One sign a component, for all rows.
    signs = {}
    for r in got:
        want = off[r.vec_id] @ q[:, r.component - 1]
        if abs(want) > 1e-3:
            signs.setdefault(r.component, set()).add(np.sign(r.whitened) == np.sign(want))
    assert all(len(s) == 1 for s in signs.values())


def test_lobpcg_takes_steps_where_the_space_is_large():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.standard_normal((300, 300)))
    e = np.sort(rng.exponential(1, 300) ** 2)[::-1]
    values, x, residuals, steps = whitening.lobpcg(lambda b: (q * e) @ (q.T @ b), 300, 10, guards=4)
    assert steps > 3 and np.abs(values - e[:10]).max() < 1e-11 * e[0]
    assert (residuals <= whitening.TOLERANCE * e[0]).all() and np.abs(x.T @ x - np.eye(10)).max() < 1e-12
    with pytest.raises(RuntimeError):
        whitening.lobpcg(lambda b: (q * e) @ (q.T @ b), 300, 10, guards=4, most_steps=2)


def test_whitening_of_odd_rows(spark):
    schema = "vec_id long, embedding array<double>, n long, component string"
    rows = [
        (1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [0.5, -2.0, 3.0]), (3, None), (4, [1.0, None, 2.0]), (5, [float("nan"), 1.0, 1.0]), (6, [float("inf"), 1.0, 1.0]), (7, []), (8, [1.0, 2.0]), (9, [4.0, 4.0, 3.0]),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], schema).repartition(3)
    got = whitening.transform(df, whitening.fit(df)).collect()
    # Four vectors count; the last dimension is the same in all, so two components are left.
    assert sorted(((r.vec_id, r.component) for r in got), key=repr) == sorted([(k, c) for k in (1, 1, None, 9) for c in (1, 2)], key=repr)
    assert all(r.n == 4 and r.identity_error < 1e-10 for r in got)
    for few in (df.filter("vec_id = 1"), df.filter("vec_id = 3"), df.limit(0)):
        assert whitening.transform(few, whitening.fit(few)).count() == 0
    huge = spark.createDataFrame([(1, [1e300]), (2, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        whitening.fit(huge)


def test_whitening_query_has_a_row_for_each_component(spark):
    got = whitening.op13_whitening(spark, "/root/testdata/sf0.001").agg(F.count("*").alias("n"), F.countDistinct("vec_id").alias("ids"), F.max("identity_error").alias("e")).first()
    assert got.n == 32 * got.ids and got.e < 1e-9
