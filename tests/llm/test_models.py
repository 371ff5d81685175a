"""Language identification, toxicity, language-model scoring and extraction: held-out accuracy, exact counts, hand-made pages."""

import collections
import html
import math
import re
import zlib

import numpy as np
import pytest

from quire.llm import extraction, language, lm, toxicity

DATA = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect()}
    found = [r for r in language.op4_language(spark, DATA).collect() if r.held_out]
    assert len(found) > 200 and sum(truth[r.doc_id] == r.lang_pred for r in found) / len(found) > 0.99


def test_word_first_then_shorter_grams():
    index = [{"the": 0}] + [{} for _ in range(language.LONGEST)]
    index[2] = {"zz": 1}
    index[1] = {"z": 2}
    own = language.Identifier({"langs": ["a", "b"], "index": index, "matrix": np.array([[-1, -3], [-4, -2], [-9, -9]], np.float32)})
    assert own.identify("the the")[0] == "a"
    assert own.identify("zz")[0] == "b"  # the longest known n-gram decides, not the shorter
    assert own.identify(None) == own.identify("123 !?") == ("und", 0.0)


def test_letters_only():
    own = language.Identifier({"langs": ["en"], "index": [{"a": 0}] + [{} for _ in range(language.LONGEST)], "matrix": np.array([[-1]], np.float32)})
    assert own.identify("½ ² Ⅷ ① ٣ 7_") == ("und", 0.0) and own.identify("½a²")[0] == "en"
    assert language.words_of("Straße naïve_日本 x2y a½a") == {"straße": 1, "naïve": 1, "日本": 1, "x": 1, "y": 1, "a": 2}


def test_very_many_languages_and_ties(spark):
    rows = [(i, f"common {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10 % 10] * 3} own{'abcdefghij'[i % 70 // 10]}{'abcdefghij'[i % 10]}", f"l{i % 70:02d}") for i in range(700)] + [(900, "zzzq", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    from pyspark.sql import functions as F

    model = language.fit(docs, F.lit(True))
    found = {r.doc_id: r for r in language.identified(docs, model).collect()}
    assert len(model["langs"]) == 70 and len(found) == 701
    assert sum(found[i].lang_pred == lang for i, _, lang in rows[:700]) > 690
    even = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identified(even, language.fit(even, F.lit(True))).collect()} == {"a"}


def test_toxicity_held_out(spark):
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    found = [(marks[r.doc_id], r.predicted) for r in toxicity.op9_toxicity(spark, DATA).collect() if r.held_out and r.doc_id in marks]
    caught = sum(p for t, p in found if t)
    assert caught >= 0.8 * sum(t for t, _ in found) and not sum(p for t, p in found if not t)


def test_toxicity_recall_with_more_labels(spark):
    larger = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    found = [(marks[r.doc_id], r.predicted) for r in toxicity.op9_toxicity(spark, larger).collect() if r.held_out and r.doc_id in marks]
    assert sum(p for t, p in found if t) >= 0.9 * sum(t for t, _ in found) and sum(p for t, p in found if not t) <= 0.01 * len(found)


def test_a_repeated_or_dense_beginning_is_a_feature():
    assert {"insu*", "insu%", "insults$*"} <= toxicity.features("insults insults here") and "insu*" not in toxicity.features("insult here")
    long = "insulted insulting " + " ".join("wxyz"[i % 4] * 5 for i in range(999))
    assert "insu*" in toxicity.features(long) and "insu%" not in toxicity.features(long)


def test_risk_is_held_at_zero():
    positive = np.array([True, True, False, False])
    down = toxicity.non_negative_step(np.array([0.0, 0.0, 2.0, 2.0]), positive, 0.3)
    assert (down[:2] < 0).all() and (down[2:] > 0).all()
    back = toxicity.non_negative_step(np.array([9.0, 9.0, -9.0, -9.0]), positive, 0.3)
    assert (back[:2] > 0).all() and (back[2:] <= 0).all()


def test_base_score_and_outcomes(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(300)
    rows = docs.collect()
    words = {r.doc_id: [*r.text.encode().lower().split(), b""] for r in rows}
    learn = {i for i in words if zlib.crc32(str(i).encode()) % 10}
    count = collections.Counter(w for i in learn for w in words[i])
    n, types = sum(count.values()), len(count)
    from pyspark.sql import functions as F

    from quire.llm.common import fold

    got = lm.score(docs, fold(F.col("doc_id"), 10) != 0, bucket_bytes=50_000, shard_bytes=200_000).collect()
    for r in got:
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (types + 1))) for w in words[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words[r.doc_id]), sum(count[w] > 0 for w in words[r.doc_id]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    held = [r for r in got if r.doc_id not in learn]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_order_of_words_and_context(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(20)] + [(100, "the cat sat on the mat"), (101, "mat the on sat cat the"), (102, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in lm.score(docs, F.col("doc_id") < 100).collect()}
    assert got[100].score > got[101].score + 3 and got[100].base_score == pytest.approx(got[101].base_score)
    assert got[102].n_tokens == 1 and got[102].score < 0


@pytest.mark.parametrize("hot", [1e9, 1e-9])
def test_all_texts_add_up_to_one(spark, hot, monkeypatch):
    """Every text of up to six words of two known ones and one that isn't known; hot: whether contexts are dealt to all shards."""
    from itertools import product

    from pyspark.sql import functions as F

    monkeypatch.setattr(lm, "HOT_PART", hot)
    monkeypatch.setattr(lm, "HOT_SAMPLE", 1)
    learnt = ["a", "b", "a b", "b b a", "", "a a", "b"] * 30
    asked = [" ".join(t) for n in range(7) for t in product(["a", "b", "zz"], repeat=n)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(learnt)] + [(10_000 + i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = lm.score(docs, F.col("doc_id") < 10_000, bucket_bytes=2_000, shard_bytes=3_000).collect()
    total = sum(10.0**r.score for r in got if r.doc_id >= 10_000)
    assert 0.97 < total <= 1.0001


def test_held_out_is_better_than_a_plain_bigram(spark):
    found = [r for r in lm.op10_lm(spark, DATA).collect() if r.held_out]
    n = sum(r.n_tokens for r in found)
    assert sum(r.base_score for r in found) / n < -4 and sum(r.score for r in found) / n > -2.7  # a bigram with one discount has -3.1


def test_letters_add_up_to_one():
    rng = np.random.default_rng(0)
    words = [bytes(rng.integers(97, 101, int(rng.integers(0, 5))).astype(np.uint8)) for _ in range(500)]
    keys, counts = np.unique(lm.spelled(words)[0], return_counts=True)
    letters = lm.Letters(keys, counts)
    short = [b""] + [bytes([c]) for c in range(256) if c != 32] + [bytes([a, b]) for a in range(97, 101) for b in range(256) if b != 32]
    p = 10.0 ** letters.log_words(short)
    assert p[0] > 0.05 and 0 < p.sum() < 1  # a part of all words there could be
    for context in letters.contexts:
        key = context * lm.LETTERS + np.arange(lm.LETTERS)
        slot = np.minimum(np.searchsorted(letters.keys, key), len(letters.keys) - 1)
        cell = np.where(letters.keys[slot] == key, letters.cell[slot], 0)
        share = letters.share[np.searchsorted(letters.contexts, context)]
        assert (cell + share * letters.one[context % lm.LETTERS * lm.LETTERS + np.arange(lm.LETTERS)]).sum() == pytest.approx(1)


def test_seats_follow_the_process():
    rng = np.random.default_rng(3)
    tables = lm.seat(np.full(20_000, 40), np.full(20_000, 1.5), 0.3, rng)
    simple = []
    for _ in range(4000):
        t = 1
        for n in range(1, 40):
            t += rng.random() < 1.5 / (1.5 + n - 0.3 * t)
        simple.append(t)
    assert tables.mean() == pytest.approx(np.mean(simple), rel=0.03)


def test_extraction_of_generated_pages(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet").collect()
    for r in rows:
        body = r.html[r.html.index("<article>") :].partition("</article>")[0]
        want = html.unescape(re.sub("<[^>]*>", "", re.sub(r"</?(p|h1|br|div|article)[^>]*>", " ", body)))
        assert extraction.main_text(r.html) == " ".join(want.split())


def test_extraction_without_article_element():
    page = """<html><body class="page"><header id="top"><h1>Site</h1><p>Welcome, to the site. Hello, all.</p></header>
    <div id="cookie-notice">We use cookies. Accept, please, all of them.</div><nav><a href=/>Home</a></nav>
    <div class="sidebar"><p>Sidebar text, here. More text, about things.</p></div>
    <div class="post"><h2>Heading</h2><p>First paragraph, long enough, &amp; with points. It goes on.<p>Second <b>par</b>agraph, with a <a href=x>link</a>; and so on.
    <script>var x = "</p>";</script><div class="comments"><p>Great post, thanks! I liked it.</p></div><form><p>Leave a reply, please.</p></form></div>
    <div class="footer">Copyright, all rights. Reserved.</div></body></html>"""
    assert extraction.main_text(page) == "Heading First paragraph, long enough, & with points. It goes on. Second paragraph, with a link; and so on."


def test_article_marks_do_not_bypass_the_threshold():
    story = " ".join(f"<p>Paragraph {i} of the story is long enough, with points, and it goes on. It has two sentences, at least; so it counts.</p>" for i in range(5))
    plain = " ".join(re.sub("<[^>]*>", "", story).split())
    teaser = "<article><h3>Elsewhere</h3><p>A short one, read on.</p></article>"
    assert extraction.main_text(f'<body><div class="post"><h2>Heading</h2>{story}</div>{teaser}</body>') == f"Heading {plain}"
    junk = '<div class="x7">Filed under Politics Economy World</div><div class="x8"><a href=1>Print</a> <a href=2>Mail</a></div>'
    assert extraction.main_text(f"<body><article><h1>Heading</h1>{story}{junk}</article></body>") == f"Heading {plain}"


def test_a_word_of_a_wrapper_takes_nothing_with_it():
    story = "<h1>Heading</h1>" + "".join(f"<p>Paragraph {i} of the story is long enough, with points, and it goes on.</p>" for i in range(5))
    want = " ".join(re.sub("<[^>]*>", " ", story).split())
    side = '<div class="sidebar"><p>Sidebar text, here. More text, about things.</p></div>'
    talk = '<section class="comments"><article><p>Great post, thanks! I liked it.</p></article></section>'
    for wrapper in ('div class="content has-sidebar"', 'div class="layout no-comments"', 'section class="social-history"'):
        for inner in (story, f"<article>{story}</article>"):
            assert extraction.main_text(f"<body><{wrapper}>{inner}{side}{talk}</{wrapper.split()[0]}><footer>Copyright, all.</footer></body>") == want
    assert extraction.main_text(f'<body><div class="post">{story}</div>{side}{talk}</body>') == want


def built_page(rng):
    """A page of known parts, and the article's text; the article stands in any of several wrappers, few of them an article element."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    paragraph = lambda: " ".join(sentence(rng.randrange(6, 16)) for _ in range(rng.randrange(3, 7)))
    title, texts = sentence(5).rstrip("."), [paragraph() for _ in range(rng.randrange(3, 8))]

    def marked_up(text):
        words = text.split()
        for _ in range(rng.randrange(3)):
            i = rng.randrange(len(words))
            words[i] = rng.choice(["<b>{}</b>", "<a href='/x'>{}</a>", "<em>{}</em>"]).format(words[i])
        return "<p>" + "\n ".join(words) + "</p>"

    comments = rng.choice(["", f'<section class="comments"><div class="comment"><p>{paragraph()}</p></div><div class="comment"><p>{sentence(9)}</p></div></section>'])
    body = f"<h1>{title}</h1>" + "".join(map(marked_up, texts)) + rng.choice([comments, ""]) + rng.choice(["", '<div class="share"><a href=1>Tweet</a> <a href=2>Mail</a></div>', f"<form><label>{sentence(3)}</label><input name=q></form>"])
    opening, closing = rng.choice([("<article>", "</article>"), ('<div class="post">', "</div>"), ('<section class="social-science">', "</section>"), ('<div id="page-header-story">', "</div>"), ("<main><div>", "</div></main>"), ('<div class="content has-sidebar">', "</div>")])
    around = [
        f"<nav><ul>{''.join(f'<li><a href=/>{word()}</a></li>' for _ in range(8))}</ul></nav>",
        f'<div class="sidebar"><h3>{word()}</h3><p>{sentence(8)}</p></div>',
        f'<div id="cookie-notice">{sentence(9)}</div>',
        f'<div class="ad">{sentence(6)}</div>',
        f"<aside><p>{sentence(12)}</p></aside>",
        f"<header><h1>{word()}</h1><p>{sentence(4)}</p></header>",
    ]
    rng.shuffle(around)
    cut = rng.randrange(len(around) + 1)
    page = f"<html><head><title>{title}</title><style>p{{}}</style></head><body class='{word()}'>{''.join(around[:cut])}{opening}{body}{closing}{comments}{''.join(around[cut:])}<footer><p>{sentence(7)}</p></footer><script>var a = '<p>x</p>';</script></body></html>"
    return page, " ".join([title, *texts])


def test_extraction_of_built_pages(monkeypatch):
    import random

    rng = random.Random(11)
    pages = [built_page(rng) for _ in range(120)]
    for page, want in pages:
        assert extraction.main_text(page) == want
    monkeypatch.setattr(extraction, "SHARE", 0.0)
    assert sum(extraction.main_text(page) != want for page, want in pages) == len(pages)  # the threshold is what decides


def test_pages_without_an_article():
    for page in ("", None, "<nav><a href=/>Home</a> <a href=/>More, of it.</a></nav>", "<body><footer>Copyright, all.</footer></body>", '<div class="comments"><p>Great, thanks! So, yes.</p></div>', "<script>text</script>"):
        assert extraction.main_text(page) == ""
