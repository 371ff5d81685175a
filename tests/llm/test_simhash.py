import random

import numpy as np
import xxhash

from quire.llm import simhash


def slow_print(text):
    words = [w for w in text.encode().lower().replace(b"\n", b" ").split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for text in ("", "One", "a b", "A  b\nc", "the same word the same word the same word", "é É ü"):
        assert simhash.fingerprint(text.encode()) == slow_print(text)


def test_all_links_in_crowded_tries(spark):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(30)] + [0, 2**64 - 1]
    prints = [rng.choice(centres) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(9))) for _ in range(900)]
    prints = sorted({p & (2**64 - 1) for p in prints})
    want = components_of(prints)
    rows = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)),) for p in prints], "fp long")
    for node_rows in (1_000_000, 40, 3):
        edges = [(np.int64(r.u).astype(np.uint64), np.int64(r.v).astype(np.uint64)) for r in simhash.links(rows, node_rows=node_rows).collect()]
        place = {p: i for i, p in enumerate(prints)}
        root = list(range(len(prints)))
        for _ in range(len(prints)):
            before = list(root)
            for u, v in edges:
                a, b = place[int(u)], place[int(v)]
                root[a] = root[b] = min(root[a], root[b])
            if before == root:
                break
        assert root == want, node_rows


def test_whole_operator(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta".split()) for _ in range(60)) for _ in range(12)]
    texts = [t if rng.random() < 0.5 else t + rng.choice([" x", " y z", ""]) for t in (rng.choice(base) for _ in range(80))] + ["", None, " "]
    docs = spark.createDataFrame([(1000 - i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = [slow_print(t or "") for t in texts]
    own = components_of(prints)
    least = {}
    for i, c in enumerate(own):
        least[c] = min(least.get(c, 10**9), 1000 - i)
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(1000 - i, least[c]) for i, c in enumerate(own)}
    assert {r.doc_id for r in simhash.one_of_each(docs).collect()} == set(least.values())
