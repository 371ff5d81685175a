import random

import corpus_pipeline
import numpy as np
import pytest
from quire.llm import jaccard


def slow_set(text):
    words = (text or "").lower().split()
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def slow_kept(rows):
    sets = [slow_set(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 10 * len(a & b) >= 8 * len(a | b):
                x, y = root[i], root[j]
                root = [y if r == x else r for r in root]
    return {min(i for (i, _), r in zip(rows, root) if r == own) for own in set(root)}


def near_texts():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = ["", None, " \n", "one", "One", "one two", "a b c d e", "a b c d e f"]
    for _ in range(40):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200, 700]))] + (shared.split() if rng.random() < 0.5 else [])
        texts.append(" ".join(words))
        for _ in range(rng.randrange(3)):
            other = list(words)
            for _ in range(rng.randrange(1, 2 + len(words) // 45)):
                other[rng.randrange(len(other))] = "changed"
            texts.append(" ".join(other))
    return [(1000 - i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("often", [3, 1])
def test_stage_equals_brute_force(spark, often, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    rows = near_texts()
    got = corpus_pipeline.near_dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == sorted(slow_kept(rows))


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == slow_kept(rows)


def test_stage_with_nulls_repeats_and_nothing(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "x"), (1, None), (2, ""), (3, "y z"), (3, "y z")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()), key=repr) == [(1, None), (3, "y z"), (None, "x")]
    assert corpus_pipeline.near_dedup_stage(spark, docs.limit(0), "").count() == 0


def test_cells_of_blocks_lose_nothing(spark):
    rows = near_texts()
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), cell=150).collect()
    assert sorted(r.doc_id for r in got) == sorted(slow_kept(rows))


def test_similar_sets_differ_within_the_budget():
    rng = random.Random(8)
    for n in [4, 5, 9, 20, 100, 500] * 60:
        words = [rng.randrange(10**9) for _ in range(n + 4)]
        other = words[: max(1, n // 10)] + [-x for x in words[max(1, n // 10) :]]
        kept = int(0.8 * n)
        a = " ".join(map(str, words))
        b = " ".join(map(str, words[: kept + 4] + other[kept + 4 :]))
        x, y = jaccard.shingles(a.encode()), jaccard.shingles(b.encode())
        if len(set(x) & set(y)) >= 0.8 * len(set(x) | set(y)):
            assert int(jaccard.fingerprint(x)[0] ^ jaccard.fingerprint(y)[0]).bit_count() <= jaccard.BUDGET
            for parts in (2, 4):
                both = np.stack([jaccard.fingerprint(x, parts), jaccard.fingerprint(y, parts)])
                assert jaccard.near(both, np.array([len(x), len(y)]), np.array([0]), np.array([1])).all()
