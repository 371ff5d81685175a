"""Nulls everywhere, empty and very long texts, repeated rows, empty tables and columns whose names clash, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, extraction, jaccard, language, lm, mixing, search, simhash, suffixes, toxicity
from quire.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, component_id string, fp int, size string, key int, ranges string, score string, `a.b` int, copy int, _key string, Learn boolean"
LONG = "the quick brown fox jumps over the lazy dog and runs away " * 3000
ROWS = [
    (1, "plain words here and there", "en", "a", 26),
    (2, None, None, None, None),
    (None, "no id at all", "en", None, 12),
    (None, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \t\n ", "de", "b", 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, LONG, None, "c", None),
    (6, LONG, None, "c", None),
    (7, "idiot moron idiot", "en", "a", 17),
    (8, "ä" * 500 + "日本語" * 200, "xx", "ü", 1100),
]


def wide(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "X", "c", 1, "s", 2, "r", "sc", 3, 9, "k", True) for r in rows], SCHEMA)


@pytest.fixture(params=["rows", "empty"])
def docs(request, spark):
    return wide(spark, ROWS if request.param == "rows" else [])


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(7, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (7, 1, 1)], "doc_id long, quality int, toxic int")


def test_row_for_row(docs, labels):
    n = docs.count()
    assert mixing.mix(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert suffixes.without_repeats(docs).count() == n
    assert toxicity.scored(docs, {}).count() == n
    model = language.fit(docs, fold(F.col("doc_id"), 4) != 2)
    found = language.identified(docs, model).collect()
    assert len(found) == n and all(0 <= r.score <= 1 for r in found)
    assert lm.score(docs, F.lit(True)).count() == n


def test_stages_keep_the_columns(docs, labels, spark):
    bench = spark.createDataFrame([(1, "a benchmark question of some length"), (2, None), (None, ""), (3, "x")], "item_id long, text string")
    weights = toxicity.fit(docs, labels, F.lit(True))
    for stage in (toxicity.without_toxic(docs, weights), simhash.one_of_each(docs), suffixes.trimmed(docs), decontaminate.clean(docs, bench)):
        assert stage.columns == docs.columns and stage.dtypes == docs.dtypes
        assert stage.count() <= docs.count()
        assert (stage.count() > 0) == (docs.count() > 0)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == [*docs.columns, "mix_copy", "taken"]
    mixed.count()
    decontaminate.leaks(docs, bench).count()
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_repeated_rows_and_components(spark):
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(wide(spark)).collect()}
    assert (6, 5) in found and (5, 5) in found
    kept = simhash.one_of_each(wide(spark)).collect()
    assert sum(r[1] == LONG for r in kept) == 1
    # null, empty and blank texts are one group; its least id stays
    assert [r.doc_id for r in kept if not (r[1] or "").strip()] == [2]


def test_other_tables(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, "<p>a"), (2, "u", ""), (2, "u", "<div>" * 3000 + "deep"), (3, "u", "<")], "page_id long, url string, html string")
    assert extraction.extract(pages).count() == 5
    assert extraction.extract(pages.limit(0)).count() == 0
    talk = spark.createDataFrame([(None, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None)], "conv_id long, turn long, role string, text string")
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.digests(chat.format_windows(talk)).collect()} == {(None, 1, 0), (1, 2, 0)}
    assert chat.digests(chat.format_windows(talk.limit(0))).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (None, [1.0]), (3, [None, 1.0]), (4, [float("nan")]), (5, [float("inf")]), (6, []), (7, [0.5, -1.0])], "vec_id long, embedding array<float>")
    own = search.quantised(vectors)
    assert sorted(r.id for r in own.collect()) == [1, 6, 7]
    assert {(r.query_id, r.vec_id, r.score) for r in search.top_k(own, own.filter("id = 1")).collect()} == {(1, 6, 0), (1, 7, 256 * 128 - 512 * 256)}
    assert search.top_k(own.limit(0), own).count() == 0


def test_extra_columns_with_clashing_names(spark):
    pages = spark.createDataFrame([(1, "u", "<p>A text, of some length.</p>", "x", 9, "T")], "page_id long, url string, html string, text string, n_chars int, PAGE_ID string")
    assert [tuple(r) for r in extraction.extract(pages).collect()] == [(1, "u", "A text, of some length.", 23)]
    talk = spark.createDataFrame([(1, 0, "system", "s", 5, "w", "k", 1), (1, 1, "assistant", "a", 5, "w", "k", 1)], "conv_id long, turn long, role string, text string, segment int, window string, kind string, tokens int")
    assert [(r.n_turns, r.loss_chars) for r in chat.digests(chat.format_windows(talk)).collect()] == [(2, 1)]
    assert chat.format_windows(talk, segment=4).count() == 2
    vectors = spark.createDataFrame([(i, [float(i), 1.0], i, "x", 0.5, i, 2) for i in range(1, 6)], "vec_id long, embedding array<float>, id int, vector string, length double, query_id int, rank int")
    own = search.quantised(vectors)
    assert [(r.rank, r.vec_id) for r in search.top_k(own, own.filter("id = 1")).orderBy("rank").collect()] == [(1, 5), (2, 4), (3, 3), (4, 2)]


def test_very_long_words_and_one_repeated_word(spark):
    rows = [(1, "x" * 300_000), (2, "x" * 300_000 + " y"), (3, "na " * 100_000), (4, "na " * 100_000 + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert lm.score(docs, F.lit(True)).filter("score < 0").count() == 4
    assert suffixes.without_repeats(docs, digest_only=True).filter("n_removed >= 299000").count() == 4
    assert jaccard.one_of_each(docs).count() >= 2
    assert simhash.near_duplicates(docs).count() == 4
    weights = {"": -1.0, "na$": 0.5, "na$%": 2.0}
    assert {r.doc_id: r.predicted for r in toxicity.scored(docs, weights).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}


def test_clean_without_shared_folder_is_an_error(spark):
    from quire.llm import common

    class Context:
        master = "spark://elsewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, other=None):
                return other

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())


def test_spools_are_deleted(spark):
    import os

    from quire.llm import common

    made = common.spooled(spark.range(3).withColumn("kind", F.col("id") % 2), by="kind")
    folder = made.spool.removeprefix("file:")
    assert made.filter("kind = 1").count() == 1 and os.path.isdir(folder)
    common.discard(made, "kind=1")
    assert sorted(x for x in os.listdir(folder) if "=" in x) == ["kind=0"]
    common.discard(made)
    assert not os.path.exists(folder)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
