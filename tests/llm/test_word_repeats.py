import collections
import random

import corpus_pipeline
from quire.llm import suffixes


def slow(texts, words):
    """The words of each text that no repeated run of ``words`` words covers."""
    split = [t.split() for t in texts]
    starts = collections.Counter(tuple(w[i : i + words]) for w in split for i in range(len(w) - words + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - words + 1):
            if starts[tuple(w[i : i + words])] > 1:
                gone.update(range(i, i + words))
        out.append([x for i, x in enumerate(w) if i not in gone])
    return out


def test_stage_cuts_51_short_words_and_not_50(spark):
    rng = random.Random(1)
    fresh = lambda n: " ".join(f"{rng.randrange(10**6)}" for _ in range(n))
    short = [rng.choice("abcdefgh") for _ in range(51)]
    other = [rng.choice("ijklmnop") for _ in range(50)]
    texts = [f"{fresh(30)} {' '.join(short)} {fresh(9)}", f"{fresh(8)}\n{'  '.join(short)} {fresh(30)}", f"{fresh(4)} {' '.join(other)} {fresh(5)}", f"{fresh(3)} {' '.join(other)}", "é" * 250, "é" * 250]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in corpus_pipeline.suffix_dedup_stage(spark, docs, "").orderBy("doc_id").collect()]
    assert [t.split() for t in got[:4]] == slow(texts[:4], 51)
    assert len(got[0].split()) == 39 and got[2:4] == texts[2:4]
    assert got[4] == got[5] == ""  # few words, but long strings


def test_words_equal_brute_force(spark):
    rng = random.Random(2)
    base = [[rng.choice("a bb ccc dé".split()) for _ in range(40)] for _ in range(3)]
    texts = []
    for _ in range(60):
        i = rng.randrange(30)
        words = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(6))] + rng.choice(base)[i : i + rng.randrange(5, 20)] + [rng.choice("xyz") for _ in range(rng.randrange(9))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n"]) for w in words))
    texts += ["q " * 30, ""]
    docs = spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffixes.trimmed(docs, length=400, words=7).collect()}
    assert got.pop(99) is None
    assert [got[i].split() for i in range(len(texts))] == slow(texts, 7)
