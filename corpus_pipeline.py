"""A training corpus from raw documents: five stages, each reading what the one before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, jaccard, mixing, suffixes, toxicity
from quire.llm.common import fold, shared_folder, table

#: Words of the shortest passage that the suffix stage cuts out.
REPEATED_WORDS = 51


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifiers reject go; they learn from the labelled rows of ``documents`` outside the held-out fold.

    A document with a null or empty text has the score of one without words, and stays. Without toxic labels nothing goes. Repeated rows go or stay
    together; of null ids none is learnt from. All columns stay; an empty table stays empty.
    """
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 3) != 1)
    return toxicity.without_toxic(docs, weights)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one of the least id: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

    Fingerprints of such texts differ in too many bits for one trie, so tries of fingerprints, one for each shingle of a set's first fifth, find the candidates, which the sets verify. Texts without
    a word, null ones too, are one group. A null id is the last of all; repeated rows count once. All columns stay; an empty table stays empty.
    """
    return jaccard.one_of_each(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that repeat, and strings of op8's length, are cut out of all texts; every document stays, with ``n_chars`` as it is now.

    A null text stays null; a text that repeats as a whole becomes empty. Repeated rows repeat each other's text. An empty table stays empty.
    """
    return suffixes.trimmed(docs, words=REPEATED_WORDS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with at most 8 % of its characters edited (short items: as they are, as whole words).

    Null and empty texts hold none; null items are passed over; repeated rows go or stay together. All columns stay; empty tables change nothing.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each copy taken, with ``copy`` and ``taken`` (its words).

    Documents without a word, null texts too, are never taken; a null source is one of its own; rows of one id and text are one document. An empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", suffix_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
]

#: Trained classifiers, fingerprints and alignments are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
