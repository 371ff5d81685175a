import collections
import hashlib
import random

import numpy as np
import pytest

from quire.llm import suffixes


def slow(texts, length):
    starts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if starts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length", [9, 20])
@pytest.mark.parametrize("hot", [20_000, 1])
def test_equals_brute_force(spark, length, hot, monkeypatch):
    rng = random.Random(length)
    texts = ["".join(rng.choice("abé") for _ in range(rng.choice([0, 5, 19, 20, 21, 60, 200]))) for _ in range(80)]
    base = ["".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(4)]
    for _ in range(80):
        i = rng.randrange(50)
        texts.append("".join(rng.choice("xyz") for _ in range(rng.randrange(9))) + rng.choice(base)[i : i + rng.randrange(15, 60)] + "zz")
    texts += ["a" * 100, None, ""]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (7, texts[7]), (7, texts[7])]
    monkeypatch.setattr(suffixes, "PIECE", 64)
    monkeypatch.setattr(suffixes, "SORT_BYTES", 300)
    got = suffixes.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, hot=hot).collect()
    want = [(i, *w) for (i, _), w in zip(rows, slow([(t or "").encode() for _, t in rows], length))]
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_trimmed_text(spark):
    shared = "".join(chr(97 + i * 7 % 26) for i in range(450))
    docs = spark.createDataFrame([(1, f"begin {shared} end", 460), (2, f"{shared} é", 452), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in suffixes.trimmed(docs).collect()}
    assert got[3] == ("clean", 5)
    assert got[1][0].startswith("begin") and got[1][0].endswith("end") and got[1][1] == len(got[1][0]) < 20
    assert got[2][0].strip().endswith("é") and len(got[2][0]) < 10


def test_equal_fingerprints_are_compared_byte_by_byte(monkeypatch):
    monkeypatch.setattr(suffixes, "rolling", lambda data, k: np.zeros(len(data) - k + 1, np.uint64))
    rng = random.Random(5)
    for length in (5, 16, 21):
        texts = ["".join(rng.choice("ab") for _ in range(length)) for _ in range(40)]
        texts += texts[:7]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        got = suffixes.repeated(data, np.arange(len(texts)) * length, np.arange(len(texts)) % 2, length)
        count = collections.Counter((i % 2, t) for i, t in enumerate(texts))
        assert got.tolist() == [count[i % 2, t] > 1 for i, t in enumerate(texts)]
