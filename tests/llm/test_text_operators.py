import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from driftmerge.llm import blocks, components, hmm, simhash, substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {i: i + 32 for i in range(65, 91)}


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Ab", "x" * 40]
    shared = [" ".join(rng.choices(vocabulary, k=25)) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 1), rng.choice(shared))
        out.append(rng.choice([" ", "\n", " \t "]).join(parts))
        if rng.random() < 0.2:
            words = out[-1].split(" ")
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
    return list(enumerate(out))


def slow_fingerprint(text):
    w = WORDS.findall((text or "").translate(LOW))
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if sum(v >> k & 1 for v in h) * 2 > len(h))


def slow_components(prints):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in ids}


def test_simhash_equals_brute_force(spark):
    docs = corpus(1, 150)
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = {d: slow_fingerprint(t) for d, t in docs}
    want = slow_components(prints)
    assert got == {d: (prints[d], want[d]) for d, _ in docs}
    assert len(set(want.values())) < len(want)


def test_trie_join_equals_all_pairs():
    rng = np.random.default_rng(0)
    for _ in range(20):
        base = rng.integers(0, 1 << 47, 4)
        near = [int(rng.choice(base)) ^ sum({1 << int(b) for b in rng.integers(0, 47, rng.integers(0, 5))}) for _ in range(120)]
        f = np.unique(np.array(near, np.uint64))
        a, b = np.triu_indices(len(f), 1)
        ok = np.bitwise_count(f[a] ^ f[b]) <= 3
        want = simhash.settle(np.arange(len(f)), a[ok], b[ok])
        assert (simhash.trie_join(f, np.zeros(len(f), int)) == want).all()


def test_large_nodes_are_dealt_over_tasks(spark):
    docs = corpus(2, 60)
    classes = spark.createDataFrame([(simhash.fingerprint(t.encode()) - (1 << 64) * (simhash.fingerprint(t.encode()) >> 63), d) for d, t in docs], "fp long, rep long").groupBy("fp").agg(F.min("rep").alias("rep"))
    whole = {tuple(r) for r in components.connected_components(simhash.links(classes)).collect()}
    dealt = {tuple(r) for r in components.connected_components(simhash.links(classes, node_rows=2)).collect()}
    assert whole == dealt and whole


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}


def test_simhash_odd_rows(spark, odd, none):
    got = [(r.doc_id, r.component_id, r.fp) for r in simhash.near_duplicates(odd).collect()]
    assert len(got) == odd.count()
    by = collections.defaultdict(set)
    for doc, component, fp in got:
        by[doc].add((component, fp))
    assert by[0] == by[1] == by[2] == {(0, 0)}
    assert by[4] == by[5] == by[10] and {c for c, _ in by[10]} == {4}
    assert simhash.near_duplicates(none).count() == 0


def slow_dedup(docs, window=13):
    words = {d: WORDS.findall(t or "") for d, t in docs}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out[d] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_substring_equals_brute_force(spark):
    docs = corpus(3, 200)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring.dedup(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = slow_dedup(docs)
    assert got == want and sum(x[1] for x in want.values()) > 100


def test_factors_are_copies_of_their_reference(spark):
    at = np.array([-1, 7, 8, 9, 0, 1, -1, -1, 5])
    assert substring.factors(np.array([-1, 4, 4, 4, 2, 2, -1, -1, 9]), at, 3) == [(1, 5, 4, 7), (4, 4, 2, 0), (8, 3, 9, 5)]
    assert substring.factors(np.full(5, -1), np.full(5, -1)) == []
    # One reference, but not one place of it: two factors.
    assert substring.factors(np.array([4, 4]), np.array([3, 9]), 3) == [(0, 3, 4, 3), (1, 3, 4, 9)]
    words = [f"w{k}" for k in range(14)]
    docs = [(10, " ".join([*words[:13], "X", *words[1:]])), (11, " ".join(words)), *((20 + d, t) for d, t in corpus(9, 120))]
    by = {d: WORDS.findall(t) for d, t in docs}
    rows = {r.doc_id: r.factors for r in substring.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [tuple(f) for f in rows[11]] == [(0, 13, 10, 0), (1, 13, 10, 14)]
    assert sum(map(len, rows.values())) > 50
    for d, listed in rows.items():
        for f in listed:
            assert f.reference < d and by[d][f.start : f.start + f.length] == by[f.reference][f.place : f.place + f.length]


def test_words_that_a_polynomial_confuses_are_told_apart(spark):
    thue = "".join("ad"[k.bit_count() % 2] for k in range(1024))
    other = thue.translate({97: "d", 100: "a"})
    rest = " ".join(f"r{k}" for k in range(12))
    df = spark.createDataFrame([(1, f"{thue} {rest}"), (2, f"{other} {rest}"), (3, f"{other} {rest}")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup(df).collect()} == {1: 0, 2: 0, 3: 13}
    rows = {r.doc_id: r for r in hmm.score_documents(df, rounds=1).collect()}
    c = collections.Counter(w for d, t in ((1, thue), (2, other), (3, other)) if not rows[d].held_out for w in [t, *rest.split(), None])
    n, v = sum(c.values()), len(c)
    for d, t in ((1, thue), (2, other), (3, other)):
        assert math.isclose(rows[d].base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [t, *rest.split(), None]), rel_tol=1e-9)


def test_equal_keys_with_other_checks():
    keys, checks = np.array([3, 3, 3, 8], np.uint64), np.array([1, 4, 6, 2], np.uint64)
    got = substring.places(np.array([3, 3, 3, 8, 8, 9], np.uint64), np.array([6, 1, 5, 2, 3, 2], np.uint64), keys, checks)
    assert got.tolist() == [2, 0, -1, 3, -1, -1]


def test_long_texts_are_blocks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_SHIFTS", ((40, 2), (400, 1)))
    docs = [(k, "a " * n) for k, n in enumerate([5, 300, 6, 7, 300, 8, 9, 100, 100, 101, 3])]
    found = blocks.block_table(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    by = collections.defaultdict(list)
    for r in found.collect():
        by[r.block].append(r.doc_id)
    assert sorted(map(sorted, by.values())) == [[0, 2, 3], [1], [4], [5, 6], [7], [8, 9], [10]]
    blocks.drop_blocks(found)
    assert not spark.catalog.tableExists(found._driftmerge_table)


def test_substring_odd_rows(odd, none):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring.dedup(odd).collect()}
    assert {(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 40_000, 0), (6, 32, 0), (7, 32, 30), (None, 5, 0)} <= got
    assert substring.dedup(none).count() == 0


def test_hmm_base_score_and_likelihood(spark):
    docs = corpus(4, 80)
    rows = {r.doc_id: r for r in hmm.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), rounds=2).collect()}
    tokens = {d: [*WORDS.findall(t.translate(LOW)), None] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(x for d, t in tokens.items() if not held[d] for x in t)
    n, v = sum(c.values()), len(c)
    for d, t in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(t), sum(c[x] > 0 for x in t), n)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), rel_tol=1e-9)
        assert r.score < 0


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(5)
    model = hmm.Model.first(6, 3)
    import itertools

    for size in (1, 2, 5):
        seq = rng.integers(0, 6, size)
        total = sum(model.start[p[0]] * model.emit[seq[0], p[0]] * math.prod(model.move[a, b] * model.emit[o, b] for a, b, o in zip(p, p[1:], seq[1:], strict=False)) for p in itertools.product(range(3), repeat=size))
        assert math.isclose(hmm.forward(model, [seq.astype(np.uint16)])[0], math.log10(total), rel_tol=1e-12)


def test_baum_welch_rounds_raise_the_likelihood():
    rng = np.random.default_rng(6)
    seqs = [rng.integers(0, 5, rng.integers(1, 60)).astype(np.uint16) for _ in range(50)]
    model = hmm.Model.first(5, 3)
    last = -np.inf
    for _ in range(5):
        now = hmm.forward(model, seqs).sum()
        assert now > last - 0.5
        last = now
        start, move, emit = hmm.expected(model, seqs)
        assert math.isclose(emit.sum(), sum(map(len, seqs)))
        assert math.isclose(start.sum(), len(seqs)) and math.isclose(move.sum(), sum(len(s) - 1 for s in seqs))
        model = hmm.Model.of_counts(start, move, emit)


def test_expected_counts_are_those_of_all_paths():
    import itertools

    rng = np.random.default_rng(7)
    model = hmm.Model.first(4, 2)
    seqs = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 2, 7, 7, 4)]
    start, move, emit = np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))
    for seq in seqs:
        paths = list(itertools.product(range(2), repeat=len(seq)))
        p = np.array([model.start[x[0]] * math.prod(model.emit[o, s] for o, s in zip(seq, x, strict=True)) * math.prod(model.move[a, b] for a, b in zip(x, x[1:], strict=False)) for x in paths])
        for x, w in zip(paths, p / p.sum(), strict=True):
            start[x[0]] += w
            for a, b in zip(x, x[1:], strict=False):
                move[a, b] += w
            for o, s in zip(seq, x, strict=True):
                emit[o, s] += w
    for stride in (None, 1, 2, 3, 64):
        for got, want in zip(hmm.expected(model, seqs, stride), (start, move, emit), strict=True):
            assert np.allclose(got, want)


def test_hmm_scores_are_the_models(spark):
    """The score column against the model's own definition, a document at a time, on a model that is trained anew here."""
    docs = corpus(10, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    rows = {r.doc_id: r for r in hmm.score_documents(df, rounds=2).collect()}
    tokens = {d: [w.encode() for w in WORDS.findall(t.translate(LOW))] for d, t in docs}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in tokens}
    c = collections.Counter(x for d, t in tokens.items() if not held[d] for x in [*t, None])
    ending = lambda w: (w[-1] * 263 + (w[-2] if len(w) > 1 else 0)) % hmm.ENDINGS
    assert len(c) <= hmm.FREQUENT  # so each known token is a class of its own
    order = sorted((int(np.uint64(hmm.xxhash.xxh3_64_intdigest(w))), w) for w in c if w is not None)
    cls = {w: 1 + hmm.ENDINGS + k for k, (_, w) in enumerate(order)} | {None: 0}
    size = 1 + hmm.ENDINGS + len(order)
    coded = {d: np.array([cls.get(x, 1 + ending(x) if x else 0) for x in [*t, None]], np.uint16) for d, t in tokens.items()}
    model = hmm.Model.first(size)
    for _ in range(2):
        model = hmm.Model.of_counts(*hmm.expected(model, [coded[d] for d in coded if not held[d]]))
    for d, seq in coded.items():
        # An unknown token has the one share of its class, in which nothing is known: log10 1.
        assert math.isclose(rows[d].score, hmm.forward(model, [seq])[0], rel_tol=1e-6), d


def test_hmm_odd_rows(odd, none):
    got = {(r.doc_id, r.n_tokens) for r in hmm.score_documents(odd, rounds=1).collect()}
    assert {(0, 1), (1, 1), (2, 1), (3, 40_001), (None, 6)} <= got
    assert hmm.score_documents(none, rounds=1).count() == 0


def test_kept_text_digest_of_the_query(spark, tmp_path):
    docs = corpus(8, 30)
    spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = slow_dedup(docs)
    for r in substring.op4_substring(spark, str(tmp_path)).collect():
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()
    prints = {d: f"{slow_fingerprint(t):016x}" for d, t in docs}
    assert {r.doc_id: r.fingerprint for r in simhash.op1_simhash(spark, str(tmp_path)).collect()} == prints


def test_answers_to_a_key_that_spans_many_batches(spark):
    """Each group comes whole and once, and a hot key's rows are put aside as they come."""
    asked = spark.range(400_000).select(F.when(F.col("id") % 3 > 0, 7).otherwise(F.col("id") % 1000).alias("key"), F.col("id").alias("block"))

    def reply(group, at, columns):
        count = np.diff(np.r_[at, len(group)])
        return {"key": columns["key"][at], "n": count.astype(np.int64), "total": np.add.reduceat(columns["block"], at)}

    got = {r.key: (r.n, r.total) for r in blocks.answer(asked, reply, "key long, n long, total long").collect()}
    want = {r.key: (r.n, r.total) for r in asked.groupBy("key").agg(F.count("*").alias("n"), F.sum("block").alias("total")).collect()}
    assert got == want
