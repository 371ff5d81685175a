"""Language identification by words first, shorter and shorter character n-grams for words not seen."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import fold, pick, sliced, table, width

#: Bounds of what the model is fitted on: texts of a language, languages (those with most texts; rarer ones are not learnt), words and n-grams of a length that are kept in all.
MOST_TEXTS = 2_000
MOST_LANGUAGES = 1_000
MOST_WORDS = 120_000
MOST_GRAMS = 40_000
#: Numbers of the model, and of the words that a task has scored, at most: with more languages there are fewer pieces of each.
MOST_CELLS = 20_000_000
LONGEST = 5
WORDS = re.compile(r"[^\W\d_]+")
CACHE = 400_000
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    """The n-grams of a word with its borders marked."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def words_of(text: str) -> Counter:
    """The words of a text in lower case, runs of letters, with their numbers of times; fractions, Roman and other numbers are no letters."""
    found = Counter(WORDS.findall(text.lower()))
    for word in [w for w in found if not w.isalpha()]:
        n = found.pop(word)
        for piece in "".join(c if c.isalpha() else " " for c in word).split():
            found[piece] += n
    return found


def counted(sample: DataFrame) -> DataFrame:
    """(lang, size, piece, n) of a bounded sample: size 0 for words, else the n-gram's length; the piece '' holds the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in sliced(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, own in words.items():
            for size in range(LONGEST + 1):
                pieces: Counter = Counter()
                for word, n in own.items():
                    for piece in grams(word, size) if size else (word,):
                        pieces[piece] += n
                pieces[""] = sum(pieces.values())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(pieces)), pa.array([size] * len(pieces), pa.int32()), pa.array(list(pieces)), pa.array(list(pieces.values()), pa.int64())], ["lang", "size", "piece", "n"])

    return sample.select("lang", "text").mapInArrow(run, "lang string, size int, piece string, n long").groupBy("lang", "size", "piece").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: languages and, by size, the log10 share of each piece in each language.

    A piece that a language lacks costs what a piece seen half a time would. Of each language the
    commonest words and n-grams are kept, so that the model is of bounded size: of more than ``MOST_LANGUAGES`` languages those with
    most texts are learnt, ties by name. Null texts and languages are passed over; nothing to learn from: a model of no language.
    """
    rows = pick(docs, doc_id=id_col, text=text_col, lang=lang_col).filter("text IS NOT NULL AND lang IS NOT NULL").filter(learn)
    by = [tuple(r) for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()]
    if not by:
        return {"langs": [], "index": [{}] * (LONGEST + 1), "matrix": np.zeros((0, 0), np.float32)}
    shares = docs.sparkSession.createDataFrame([(lang, min(1.0, MOST_TEXTS / n)) for lang, n in by], "lang string, share double")
    chance = F.pmod(F.xxhash64(F.lit(4), "doc_id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    sample = rows.join(F.broadcast(shares), "lang").filter(chance).select("lang", "text").dropDuplicates().repartition(width(docs.sparkSession))
    order = W.partitionBy("lang", "size").orderBy(F.desc("n"), "piece")
    most_words, most_grams = (max(1, min(most // len(by), MOST_CELLS // (share * len(by) ** 2))) for most, share in ((MOST_WORDS, 2), (MOST_GRAMS, 2 * LONGEST)))
    most = F.when(F.col("size") == 0, most_words).otherwise(most_grams) + 1
    kept = counted(sample).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("lang", "size", "piece", "n").toArrow()
    lang, size, piece, n = (kept.column(c).to_pylist() for c in ("lang", "size", "piece", "n"))
    langs = sorted(set(lang))
    at = {name: i for i, name in enumerate(langs)}
    index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    for s, p in sorted(set(zip(size, piece))):
        if p:
            index[s][p] = len(index[s])
    for s in range(1, LONGEST + 1):
        before = sum(len(i) for i in index[:s])
        index[s] = {p: before + i for p, i in index[s].items()}
    total = np.ones((LONGEST + 1, len(langs)))
    matrix = np.full((sum(map(len, index)), len(langs)), 0.5)
    for own, s, p, count in zip(lang, size, piece, n):
        if p:
            matrix[index[s][p], at[own]] = count
        else:
            total[s, at[own]] = max(1, count)
    sizes = np.repeat(np.arange(LONGEST + 1), [len(i) for i in index])
    return {"langs": langs, "index": index, "matrix": np.log10(matrix / total[sizes]).astype(np.float32)}


class Identifier:
    """Scores words by a model; a word not seen before is scored once."""

    def __init__(self, model: dict):
        self.langs, self.index, self.known = model["langs"], model["index"], len(model["matrix"])
        self.cache = max(1_000, min(CACHE, MOST_CELLS // max(1, len(self.langs))))
        self.scores = np.zeros((self.known + self.cache, len(self.langs)), np.float32)
        self.scores[: self.known] = model["matrix"]
        self.forget()

    def forget(self) -> None:
        self.seen, self.next = dict(self.index[0]), self.known

    def add(self, words: list[str]) -> None:
        """Score words that the model lacks: the mean over a word's longest known n-grams, or nothing."""
        hits, sizes = [], []
        for word in words:
            padded, own = f" {word} ", []
            for n in range(min(LONGEST, len(padded)), 0, -1):
                known = self.index[n]
                own = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
                if own:
                    break
            hits += own or [-1]
            sizes.append(len(own) or 1)
        sizes = np.array(sizes)
        rows = self.scores[hits]
        rows[np.array(hits) < 0] = 0
        self.scores[self.next : self.next + len(words)] = np.add.reduceat(rows, np.cumsum(sizes) - sizes) / sizes[:, None]
        self.seen.update(zip(words, range(self.next, self.next + len(words))))
        self.next += len(words)

    def identify(self, text: str | None) -> tuple[str, float]:
        """(language, score): the language of the highest mean score over all words, ties to the first by name."""
        words = words_of(text or "")
        if not words or not self.langs:
            return UNKNOWN, 0.0
        total = np.zeros(len(self.langs))
        names, counts = list(words), np.fromiter(words.values(), float, len(words))
        half = self.cache // 2
        for at in range(0, len(names), half):  # no more at a time than the rows kept
            part = names[at : at + half]
            if self.next + len(part) > len(self.scores):
                self.forget()
            rows = list(map(self.seen.get, part))
            if None in rows:
                self.add([w for w, r in zip(part, rows) if r is None])
                rows = list(map(self.seen.get, part))
            total += counts[at : at + half] @ self.scores[rows]
        n = counts.sum()
        scores = total / n
        best = int(scores.argmax())
        # a short text's few words are weaker evidence: the posterior of at most ten of its average words
        odds = np.exp((scores - scores[best]) * math.log(10) * min(10.0, n))
        return self.langs[best], float(1 / odds.sum())


def identified(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text.

    Null text or one without a letter: ``und`` with score 0; so is every text if the model knows no language. Null or
    repeated ids: each row is returned. Empty table: no rows. Other columns don't matter. The model, of bounded size, is broadcast.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Identifier(shared.value)
        for batch in sliced(batches):
            found = [own.identify(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, fold(F.col("doc_id"), 4) != 2)
    return identified(docs, model).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
