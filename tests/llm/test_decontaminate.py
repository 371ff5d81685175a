import random
import re

from quire.llm import decontaminate
from quire.llm.decontaminate import Index, fold, fold_table, stripped


def edits(item, text):
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for i, d in enumerate(text):
            new.append(min(row[i] + (c != d), row[i + 1] + 1, new[i] + 1))
        row = new
    return min(row)


def test_no_match_is_lost():
    rng, low, seen = random.Random(3), fold_table(), 0
    for _ in range(12):
        words = lambda n: "".join(rng.choice("abc de") for _ in range(n))
        items = [(i, words(rng.choice([5, 20, 26, 40, 55, 80, 120]))) for i in range(6)]
        texts = [None]
        for _ in range(20):
            text = words(rng.randrange(60))
            if rng.random() < 0.8:
                chars = list(rng.choice(items)[1])
                for _ in range(rng.randrange(9)):
                    p, what = rng.randrange(len(chars)), rng.random()
                    if what < 0.33:
                        chars[p] = rng.choice("abc de")
                    elif what < 0.66:
                        chars.insert(p, rng.choice("abcde"))
                    elif len(chars) > 1:
                        chars.pop(p)
                text += "".join(chars).upper() + words(rng.randrange(40))
            texts.append(text)
        found = {(t, i): (k, b, e) for t, i, b, e, k in Index(items).find(texts)}
        for t, text in enumerate(texts):
            plain = "".join(map(chr, fold(text or "", low)[0]))
            for i, item in items:
                own = "".join(map(chr, stripped(fold(item, low)[0])))
                least = edits(own, plain)
                want = least <= int(0.08 * len(own)) if len(own) >= 20 else bool(re.search(rf"(?<![^\W_]){re.escape(own)}(?![^\W_])", plain) if own.strip() else False)
                assert want == ((t, i) in found)
                if want:
                    seen += 1
                    k, b, e = found[t, i]
                    assert k == least and edits(own, "".join(map(chr, fold(text[b:e], low)[0]))) == k
    assert seen > 50


def test_passes_over_a_long_benchmark(spark):
    items = [(i, f"question number {i} about the subject of " + "xyz"[i % 3] * 30) for i in range(9)]
    docs = spark.createDataFrame([(i, f"Before.  {t.upper()} after") for i, t in items[:5]] + [(99, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**6, 150):
        got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, index_chars=chars).collect()}
        assert {(i, i) for i in range(5)} <= got and not any(d == 99 for d, _ in got)
        assert [r.doc_id for r in decontaminate.clean(docs, bench, index_chars=chars).collect()] == [99]


def test_short_items_match_as_whole_words():
    items = [(1, "Tiny bench item"), (2, "x"), (3, "?!"), (4, ""), (5, None), (6, "über"), (7, "C++")]
    texts = ["a tiny  BENCH item.", "a tiny bench items", "x", "xx", "say x, or y", "what ?! so", "Über uns", "darüber", "C++", "c++17", "vitamin c++"]
    found = {(t, i) for t, i, *_ in Index(items).find(texts)}
    assert found == {(0, 1), (2, 2), (4, 2), (6, 6), (8, 7), (9, 7), (10, 7)}
    assert [f[2:] for f in Index(items).find([texts[0]])] == [(2, 18, 0)]
