import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import corpus_pipeline
from driftmerge.llm import privacy, tiling, toxicity

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"\D", "", m[0])
            ok = {
                "email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "phone": lambda: 10 <= len(digits) <= 15,
                "card": lambda: 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0,
            }[kind]()
            if ok:
                out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def test_base_spans_equal_the_patterns():
    rng = random.Random(1)
    for _ in range(8000):
        text = "".join(rng.choice(["a", "b@", "c.", "1", "22", "255", "256", ".", "+1 ", "4", "(", "-", " ", "@", "x.y", "é", "0", "9876", "_", "4111 1111 1111 1111"]) for _ in range(rng.randint(1, 30)))
        assert privacy.base_spans(text) == slow_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 1_000_000, "1" * 1_000_000, "1." * 500_000, "+" * 1_000_000, "@" * 1_000_000, "a@" * 500_000, "+1 " * 300_000):
        began = time.perf_counter()
        privacy.base_spans(text)
        for a, z, _, _ in privacy.candidates(text):
            privacy.features(text, a, z)
        assert time.perf_counter() - began < 30  # quadratic ones would take hours


def test_labelers_find_secrets_and_leave_words(spark):
    rng = random.Random(2)
    key = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    docs = [(k, f'some words token = "{key(40)}" and more') for k in range(40)] + [(100 + k, f"password={key(18)} more words") for k in range(40)] + [(200 + k, "AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16)) + " here") for k in range(20)]
    docs += [(300 + k, f"Version release-{k}.2024.11 of 12-34-5678{k} chapter{k}section in 2024-11-0{k % 9}") for k in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r.spans for r in privacy.find(df, privacy.train(privacy.vote_counts(df))).collect()}
    assert sum("secret" in found[k] for k in range(40)) == 40 and sum("secret" in found[100 + k] for k in range(40)) == 40
    assert not any("secret" in found[300 + k] for k in range(60))


def test_candidates_are_whole():
    for text in ("joe.doe[@]host[.]org", "joe.doe{at}host{dot}org", "joe.doe(@)host(dot)org", "joe.doe {@} host {.} org", "joe.doe[AT]host[DOT]org"):
        assert [(a, z, kind) for a, z, kind, _ in privacy.candidates(text)] == [(0, len(text), "handle")], text
    secret = "a1B2c3D4e5" * 41
    (found,) = privacy.candidates(f'token = "{secret}" and more')
    assert found[:3] == (9, 419, "secret") and found[3]["gazetteer"] == found[3]["assigned"] == found[3]["quoted"] == 1


def test_expectation_maximisation_finds_the_reliabilities():
    """Votes drawn from known reliabilities: the estimates come near them, and beat a majority."""
    rng = np.random.default_rng(1)
    right = np.array([0.95, 0.9, 0.6, 0.55, 0.55])
    truth = rng.random(20_000) < 0.3
    votes = np.where((rng.random((len(truth), 5)) < right) == truth[:, None], 1, -1) * (rng.random((len(truth), 5)) < 0.9)
    rows, inverse, n = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    table, prior, p = privacy.reliabilities(rows, n.astype(float))
    yes = table[:, 2, 1] / (table[:, 2, 1] + table[:, 0, 1])
    assert abs(prior - 0.3) < 0.03 and np.abs(yes - right).max() < 0.05
    found = (p[inverse.ravel()] > 0.5) == truth
    majority = (votes.sum(1) > 0) == truth
    assert found.mean() > majority.mean() + 0.03 and found.mean() > 0.93
    # The same by brute force over the rows as they are, not counted.
    again, _, q = privacy.reliabilities(votes, np.ones(len(votes)))
    assert np.allclose(again, table, atol=1e-6) and np.allclose(q, p[inverse.ravel()], atol=1e-6)


def test_the_classifier_judges_by_what_spans_look_like():
    """Labelers that abstain on a fifth of the candidates: their like among the others decides."""
    none, yes, no = ((("a", v), ("b", v)) for v in (0, 1, -1))
    look = lambda kind, size: tuple(sorted({**dict.fromkeys(privacy.LEVELS, 0), "case": 3 if kind else 1, "length": size}.items()))
    counts = [(("secret"), yes, look(True, 6), 400), ("secret", no, look(False, 6), 400), ("secret", none, look(True, 6), 100), ("secret", none, look(False, 6), 100)]
    model = privacy.train(counts)
    accepts = lambda votes, looks: model.accepts("secret", dict(votes), dict(looks))
    assert accepts(none, look(True, 6)) and not accepts(none, look(False, 6)) and accepts(yes, look(True, 6)) and not accepts(no, look(False, 6))


def test_added_spans_never_overlap_base_spans():
    text = "1.1.1.1." * 3 + "a1b2c3d4e5f6a7b8@host.example.org " + "+1 234 567 89 01 22 token=a1b2c3d4e5f6a7b8c9"
    model = privacy.SpanClassifier({k: np.r_[np.zeros(15), 100.0, np.zeros(400)][: len(privacy.expand(v, tuple(sorted(privacy.features("ab", 0, 2).items()))))] for k, v in (("secret", tuple((str(i), 1) for i in range(7))),)})
    model.accepts = lambda *x: True
    base, spans = model.spans(text)
    for a, z, kind in spans:
        assert kind in ("email", "ip", "card", "phone") or not any(x < z and y > a for x, y, _ in base)
    assert any(kind == "secret" for _, _, kind in spans)


def test_privacy_odd_rows(odd, none):
    model = privacy.train(privacy.vote_counts(odd))
    rows = {r.doc_id: r for r in privacy.find(odd, model).collect()}
    assert rows[0].spans == rows[1].spans == "" and rows[9].n_email == 1 and rows[9].n_phone == 1
    out = privacy.redact(odd, model)
    assert out.columns == odd.columns and out.count() == odd.count()
    texts = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert texts[9][0] == "Mail me: [EMAIL] or [PHONE]." and texts[9][1] == len(texts[9][0]) and texts[0][0] is None
    empty = privacy.train(privacy.vote_counts(none))
    assert privacy.find(none, empty).count() == 0


def slow_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                    n += 1
                best.append((n, -i, -j))
        n, i, j = max(best, default=(0, 0, 0))
        if n < least:
            return out
        out.append((-i, -j, n))
        for k in range(n):
            free_d[-i + k] = free_i[-j + k] = False


def test_tiles_equal_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        doc, item = (np.array([rng.randint(1, 4) for _ in range(rng.randint(3, 40))]) for _ in range(2))
        got, want = tiling.tiles(doc, item, 3), slow_tiles(doc, item, 3)
        assert got == want
    for width in (1, 2, 5):
        ids = np.array([1, 2, 3, 1, 2, 3, 1, 2, 4])
        keys = tiling._runs(ids, width).tolist()
        assert [keys.index(k) for k in keys] == [next(j for j in range(i + 1) if (ids[j : j + width] == ids[i : i + width]).all()) for i in range(len(keys))]


def test_contaminated_documents(spark, odd, none):
    item = " ".join(f"q{k}" for k in range(40))
    shuffled = " ".join(" ".join(f"q{k}" for k in range(a, a + 10)) for a in (30, 10, 20, 0))
    docs = [(1, f"before {item} after"), (2, f"x {shuffled.upper()} y"), (3, " ".join(f"q{k}" for k in range(0, 40, 2))), (4, "nothing here at all"), (5, None), (6, " ".join(f"q{k}" for k in range(15)))]
    bench = spark.createDataFrame([(7, item, 1), (8, "two words", 1), (9, None, 1), (10, "", 1)], "item_id long, text string, doc_id int")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.tiles) for r in tiling.contaminated(df, bench).collect()}
    assert got == {(1, 7, 1), (2, 7, 3)}  # q10 to q29 stand together
    assert sorted(r.doc_id for r in tiling.clean(df, bench).collect()) == [3, 4, 5, 6]
    # Beyond the size that is broadcast: the same rows by joins.
    whole, joined = (sorted(map(tuple, tiling.contaminated(df.union(df), bench, broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert whole == joined and len(joined) == 4
    assert sorted(r.doc_id for r in tiling.clean(df, bench, broadcast_bytes=0).collect()) == [3, 4, 5, 6]
    assert tiling.contaminated(none, bench, broadcast_bytes=0).count() == 0
    cleaned = tiling.clean(odd, bench, broadcast_bytes=0)
    assert cleaned.columns == odd.columns and cleaned.count() == odd.count()
    # An item of everyday words is no sign of a leak.
    short = spark.createDataFrame([(1, "the"), (2, "nothing here at all")], "item_id long, text string")
    assert tiling.contaminated(df, short).count() == 0 and tiling.clean(df, short).count() == len(docs)
    assert tiling.contaminated(df, bench.limit(0)).count() == 0 and tiling.contaminated(none, bench).count() == 0
    assert tiling.clean(odd, bench).columns == odd.columns


def toxic_corpus(n=300, seed=4):
    rng = random.Random(seed)
    clean = [f"{a}{b}{c}" for a in ("ren", "tal", "mos", "vi") for b in ("ka", "lo", "ste") for c in ("n", "ri", "du", "")]
    bad = ["grubnik", "grubnak", "snorvet"]
    docs, labels = [], []
    for k in range(n):
        words = rng.choices(clean, k=rng.randint(5, 60))
        toxic = k % 6 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_corpus()
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scorer = toxicity.train(df, lab)
    scores = {r.doc_id: r.score for r in toxicity.score(df, scorer).collect()}
    held = [(d, t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert len(held) > 80 and sum((scores[d] >= 0.7) == bool(t) for d, t in held) >= 0.98 * len(held)
    assert sum(scores[d] >= 0.7 for d, t in held if t) >= 0.9 * sum(t for _, t in held)
    odd = pa.array(["you g.r.u.b.n.i.k", "such a grubxnik", "s n o r v e t", "GRUBNIK!", "talkan moslori", "", None], pa.string())
    found = scorer.scores(odd)
    assert (found[[0, 2, 3]] >= 0.7).all() and found[1] > found[4] and (found[4:] < 0.5).all()


def test_toxicity_without_labels(spark, odd, none):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.s, 8) for r in toxicity.score(odd, toxicity.train(odd, lab), name="s").collect()} == {1e-6}
    assert toxicity.score(none, toxicity.train(none, lab), name="s").count() == 0


def test_kernel_features_reproduce_the_kernel():
    units = [bytes([8, 3, 8, 14, 19]), bytes([11, 14, 18, 4, 17]), bytes([0, 1, 2])]
    machine = toxicity.Machine(units)
    x = machine.features(toxicity.Encoded(units))

    def kernel(a, b):
        sa, sb = toxicity.subsequences(a), toxicity.subsequences(b)
        norm = toxicity.length_term(np.array([len(a), len(b)]))
        return sum(w * sb.get(c, 0) for c, w in sa.items()) / norm.prod()

    assert np.allclose(x @ x.T, [[kernel(a, b) for b in units] for a in units], atol=1e-4)


def test_scores_are_the_kernel_machines():
    """The table lookups of scoring against the kernel expansion over landmarks, unit by unit."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 12))) for _ in range(60)] + ["q" * 90]
    plain = lambda w: bytes(ord(c) - 97 for c in w)
    machine = toxicity.Machine([plain(w) for w in words[:12]])
    w = np.random.default_rng(3).normal(size=machine.map.shape[1])
    text = pa.array([" ".join(words), "", words[3]], pa.large_string())
    body, offs = toxicity.raw(text)
    sym, starts, size, count = toxicity.units(body, offs)
    assert count.tolist() == [61, 0, 1] and [sym[a : a + n].tobytes() for a, n in zip(starts, size, strict=True)] == [plain(x) for x in [*words, words[3]]]
    got = toxicity.unit_margins(sym, starts, size, machine.table(w))
    want = machine.features(toxicity.Encoded([plain(x) for x in [*words, words[3]]])) @ w
    assert np.allclose(got, want, atol=1e-3)
    scorer = toxicity.Scorer(machine.table(w), -0.5, 2.0, 0.1)
    assert np.allclose(scorer.margins(text), [max(want[:61].max(), 0) - 0.5, -0.5, max(want[61], 0) - 0.5], atol=1e-3)


def test_pipeline_stages_on_odd_rows(spark, odd, tmp_path):
    docs, labels = toxic_corpus(60)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item of some ten words that is unlike others")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for k, frame in enumerate((odd, odd.limit(0))):
            out = stage(spark, frame, str(tmp_path))
            place = f"{tmp_path}/{name}{k}"
            out.write.parquet(place)
            if name != "packing":
                assert out.columns == odd.columns
            if k:
                assert spark.read.parquet(place).count() == 0
    kept = corpus_pipeline.near_duplicates_stage(spark, odd, "").select("doc_id").collect()
    # 6 and 7 share 26 of 30 shingles of five words (0.867), so by the contract's 0.8 the larger one goes.
    assert {r.doc_id for r in kept} == {0, 3, 4, 6, 8, 9, None}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} >= {0, 3, 4, 6, 8, 9}
