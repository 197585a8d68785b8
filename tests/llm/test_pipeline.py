import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from driftmerge.llm import privacy, toxicity
from tests.llm.test_filters import slow_tiles, toxic_corpus
from tests.llm.test_records import check_packing


def documents():
    """Clean and toxic texts, near and exact copies, a benchmark passage in reordered parts, addresses."""
    rng = random.Random(11)
    docs, labels = toxic_corpus(120, seed=12)
    texts = [t for _, t in docs]
    item = " ".join(f"bench{k}" for k in range(30))
    for k in range(0, 20, 2):
        words = texts[k].split() + [f"tail{rng.randint(0, 99)}" for _ in range(60)]
        texts.append(" ".join(words))
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [texts[1], texts[1], f"x {item} y", " ".join(item.split()[15:] + ["and"] + item.split()[:15]), " ".join(item.split()[:9])]
    texts += [f"{texts[3]} write to joe{k}.doe@mail.example.org or +1 (555) 010-20{k}0" for k in range(4)]
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], labels, item


def slow_pipeline(docs, item, scorer, classifier):
    score = scorer.scores(pa.array([t for _, t in docs], pa.string()))
    docs = [d for d, s in zip(docs, score, strict=True) if s < 0.7]
    sets = [{" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for _, t in docs]
    root = list(range(len(docs)))
    for v in range(len(docs)):
        for u in range(v):
            if (not sets[u] and not sets[v]) or len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v]) > 0:
                old, new = max(root[u], root[v]), min(root[u], root[v])
                root = [new if x == old else x for x in root]
    docs = [d for k, d in enumerate(docs) if root[k] == k]
    ids: dict = {}
    number = lambda text: np.array([ids.setdefault(w, len(ids)) for w in re.findall(r"[^\W_]+", text.lower())])
    bench = number(item)
    docs = [(d, t) for d, t in docs if sum(n for _, _, n in slow_tiles(number(t).tolist(), bench.tolist(), 5)) < 0.5 * len(bench)]
    return {d: privacy.redacted(t, classifier.spans(t)[1]) for d, t in docs}


def test_the_pipeline_equals_its_stages_by_brute_force(spark, tmp_path):
    docs, labels, item = documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    scorer = toxicity.train(df, lab)
    plain = [(d, t) for d, t, *_ in docs]
    # The classifier is trained on what reaches its stage; the votes of these few kinds of spans agree on all of them.
    want = slow_pipeline(plain, item, scorer, privacy.train(privacy.vote_counts(df)))
    assert {r.doc_id for r in rows} == set(want) and 60 < len(want) < len(docs) - 25
    check_packing(rows, want)
    assert any("[EMAIL]" in t for t in want.values())
