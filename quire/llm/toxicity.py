"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import durable, fold, pick, release, sliced, table, thinned, width

#: Bounds of what the classifiers are fitted on: toxic texts, unlabelled texts, features.
MOST_TOXIC = 6_000
MOST_UNLABELLED = 12_000
MOST_FEATURES = 20_000
#: A feature needs this logarithm of its share among toxic texts over that among others, and so many toxic texts.
LEAST_RATIO = 1.5
LEAST_TEXTS = 8
PREFIXES = (3, 4, 5, 6, 7)
#: Words with one beginning are dense from this many on, if they are this part of a text's words.
TWICE = 2
DENSE = 0.01
THRESHOLD = 0.7
CLASSIFIERS = 3
STEPS = 400
WORDS = re.compile(r"[^\W\d_]+")
CACHE = 50_000
#: Features that a task counts before it hands them on.
HELD = 100_000


def of_word(word: str) -> list[str]:
    """The whole word, marked as such, and its beginnings, which inflected forms share."""
    return [word + "$", *[word[:n] for n in PREFIXES if len(word) >= n]]


def marked(pieces: Counter, words: int) -> set[str]:
    """The features of a text of so many words with these pieces: each that it has, and whether it has it more than once, and densely."""
    found = set(pieces)
    for piece, n in pieces.items():
        if n >= TWICE:
            found.add(piece + "*")
            if n >= DENSE * words:
                found.add(piece + "%")
    return found


def features(text: str) -> set[str]:
    words = Counter(WORDS.findall(text.lower()))
    pieces: Counter = Counter()
    for word, n in words.items():
        for piece in of_word(word):
            pieces[piece] += n
    return marked(pieces, words.total())


def sketch(text: str) -> int:
    """The least hash of the text's three-word shingles, which copies and most near copies share."""
    words = text.split()
    return min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=0)


def non_negative_step(g: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """The slope, by each text's logit ``g``, of prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]) for the logistic loss l.

    Where the second part would be negative, the slope is that which raises it again.
    """
    s = 1 / (1 + np.exp(-np.clip(g, -40, 40)))
    loss = np.logaddexp(0, g)
    p, u = max(1, positive.sum()), max(1, (~positive).sum())
    if loss[~positive].sum() / u - prior * loss[positive].sum() / p >= 0:
        return np.where(positive, -prior / p, s / u)
    return np.where(positive, prior * s / p, -s / u)


def train(owner: np.ndarray, feature: np.ndarray, ratio: np.ndarray, positive: np.ndarray, prior: float, seed: int) -> np.ndarray:
    """Weights (the last is the bias) of a linear classifier that minimises the non-negative risk over a seeded half and more of the texts."""
    rng = np.random.default_rng(seed)
    n = len(positive)
    used = rng.random(n) < 0.8
    keep = used[owner]
    owner, feature = owner[keep], feature[keep]
    weights = np.append(np.full(len(ratio), 0.1), np.log(prior / (1 - prior)))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        g = np.bincount(owner, weights[feature] * ratio[feature], n) + weights[-1]
        slope = np.zeros(n)
        slope[used] = non_negative_step(g[used], positive[used], prior)
        down = np.append(np.bincount(feature, slope[owner] * ratio[feature], len(ratio)) + 1e-5 * weights[:-1], slope.sum())
        mean, square = 0.9 * mean + 0.1 * down, 0.99 * square + 0.01 * down * down
        # features were chosen as typical of toxic texts, so none of them speaks against it
        weights -= 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights[:-1] = np.maximum(weights[:-1], 0.0)
    return np.append(weights[:-1] * ratio, weights[-1])


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label: str = "toxic") -> dict[str, float]:
    """Weight by feature, '' for the bias; empty without toxic texts.

    ``learn`` is the condition, on ``doc_id``, of rows that may be learnt from. Confirmed toxic texts and
    unlabelled ones (any rows, whatever their label) are samples of bounded size; the class prior is the share of toxic rows among
    the labelled. Features are counted where the texts are and added up by Spark; one task
    then fits the classifiers, on no more than the sample's selected features.
    """
    marks = pick(labels, doc_id=label_id, toxic=label).filter("toxic IS NOT NULL").filter(learn)
    total, toxic = marks.agg(F.countDistinct("doc_id"), F.countDistinct(F.when(F.col("toxic") == 1, F.col("doc_id")))).first()
    if not toxic:
        return {}
    prior = min(max(toxic / total, 1e-4), 0.9)
    rows = pick(docs, doc_id=id_col, text=text_col).filter("text IS NOT NULL").filter(learn)
    ids = thinned(marks.filter("toxic = 1").select("doc_id").distinct(), MOST_TOXIC, 1, toxic)
    confirmed = thinned(rows.join(F.broadcast(ids), "doc_id", "left_semi"), 2 * MOST_TOXIC, 3)
    unlabelled = thinned(rows, MOST_UNLABELLED, 2)
    sample = confirmed.select("text", F.lit(True).alias("positive")).unionByName(unlabelled.select("text", F.lit(False).alias("positive")))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("positive"), pa.array([sketch(t) for t in batch.column("text").to_pylist()], pa.int64())], ["text", "positive", "sketch"])

    # of copies one is enough: else what a group of them happens to share would look typical
    sample = sample.repartition(width(docs.sparkSession))
    sample = durable(sample.mapInArrow(sketched, "text string, positive boolean, sketch long").dropDuplicates(["positive", "sketch"]))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def handed_on() -> pa.RecordBatch:
            made = [*own[True].items(), *((f, -n) for f, n in own[False].items())]
            own[True].clear(), own[False].clear()
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in made], pa.string()), pa.array([n for _, n in made], pa.int64())], ["feature", "toxic"])

        for batch in sliced(batches):
            for positive, text in zip(batch.column("positive").to_pylist(), batch.column("text").to_pylist()):
                own[positive].update(features(text))
                own[positive][""] += 1
                if len(own[True]) + len(own[False]) > HELD:
                    yield handed_on()
        yield handed_on()

    counts = sample.mapInArrow(count, "feature string, toxic long").groupBy("feature").agg(F.sum(F.greatest("toxic", F.lit(0))).alias("p"), F.sum(F.greatest(-F.col("toxic"), F.lit(0))).alias("u"))
    size = counts.filter("feature = ''").first()
    if size is None or not size["p"]:
        return {}
    n_p, n_u = size["p"], max(1, size["u"])
    smooth = min(2 / n_p, 0.05)
    p, u = F.col("p") / n_p, F.col("u") / n_u
    rest = F.greatest(F.lit(0.0), u - prior * p) / (1 - prior)
    least = max(3, min(LEAST_TEXTS, n_p // 20))
    chosen = counts.filter((F.col("feature") != "") & (F.col("p") >= least)).withColumn("ratio", F.log((p + smooth) / (rest + smooth)))
    chosen = chosen.filter(F.col("ratio") >= LEAST_RATIO).orderBy(F.desc("p"), "feature").limit(MOST_FEATURES).select("feature", "ratio").collect()
    ratio = dict(sorted(tuple(r) for r in chosen))
    number = {f: i for i, f in enumerate(ratio)}

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [sorted(number[f] for f in features(t) if f in number) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(found, pa.list_(pa.int32()))], ["positive", "found"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = sorted((p, tuple(f)) for b in batches for p, f in zip(b.column("positive").to_pylist(), b.column("found").to_pylist()))
        positive = np.array([p for p, _ in texts], bool)
        owner = np.repeat(np.arange(len(texts)), [len(f) for _, f in texts])
        feature = np.array([i for _, f in texts for i in f], np.int64)
        weights = np.mean([train(owner, feature, np.array(list(ratio.values())), positive, prior, seed) for seed in range(CLASSIFIERS)], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([*ratio, ""]), pa.array(weights)], ["feature", "weight"])
        del texts, owner, feature
        release()

    reduced = sample.mapInArrow(reduce, "positive boolean, found array<int>").repartition(1)
    return {f: w for f, w in reduced.mapInArrow(learnt, "feature string, weight double").collect()}


class Scorer:
    """Scores texts by a model's weights; words seen before are looked up."""

    def __init__(self, weights: dict[str, float]):
        self.weights, self.seen = weights, {}
        self.pieces = {f.rstrip("*%") for f in weights}

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        seen, weights, pieces, n = self.seen, self.weights, {}, 0
        for word, times in Counter(WORDS.findall((text or "").lower())).items():
            n += times
            own = seen.get(word)
            if own is None:
                if len(seen) >= CACHE:
                    seen.clear()
                own = seen[word] = tuple(f for f in of_word(word) if f in self.pieces)
            for piece in own:
                pieces[piece] = pieces.get(piece, 0) + times
        g = weights[""] + sum(weights.get(f, 0.0) for f in sorted(marked(pieces, n)))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, g)))))


def scored(docs: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row's whole text.

    Null or empty text: the score of a text without words. No model (nothing toxic to learn from): 0. Null or repeated ids:
    each row is returned. Empty table: no rows. Other columns don't matter.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in sliced(batches):
            scores = np.array([scorer.score(t) for t in batch.column("text").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def without_toxic(docs: DataFrame, weights: dict[str, float], text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score is at least ``threshold``.

    Null or empty text: the score of a text without words, which the model's bias alone gives. No model: all rows stay. Repeated rows go or stay together.
    Empty table: no rows. All columns stay, whatever their names.
    """
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(weights)
        for batch in sliced(batches):
            yield batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    return flat.mapInArrow(run, flat.schema).toDF(*names)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return scored(docs, weights).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
