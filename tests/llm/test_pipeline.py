"""The stages, one after another, against what a slow version keeps of each stage's own input."""

import os
import sys

import corpus_pipeline
from quire.llm.decontaminate import Index

sys.path.insert(0, os.path.dirname(__file__))
from test_jaccard import slow_kept  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = str(tmp_path / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        after = docs.collect()
        assert after
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in after} == slow_kept([(r.doc_id, r.text) for r in before])
        if name == "suffix_array_dedup":
            assert len(after) == len(before)
            seen, runs = {}, {}
            for r in before:
                data, words = r.text.encode(), r.text.encode().split()
                for at in range(len(data) - 399):
                    seen.setdefault(data[at : at + 400], set()).add((r.doc_id, at))
                for at in range(len(words) - 50):
                    runs.setdefault(tuple(words[at : at + 51]), set()).add((r.doc_id, at))
            twice = {i for places in [*seen.values(), *runs.values()] if len(places) > 1 for i, _ in places}
            texts = {r.doc_id: r.text for r in before}
            assert {r.doc_id for r in after if r.text != texts[r.doc_id]} == twice
        if name == "benchmark_decontamination":
            index = Index(bench)
            leaky = {before[f[0]].doc_id for f in index.find([r.text for r in before])}
            assert {r.doc_id for r in before} - {r.doc_id for r in after} == leaky and leaky
        if name == "source_mixing":
            sizes = {r.doc_id: len(r.text.split()) for r in before}
            taken = {}
            for r in after:
                taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
            assert all(t <= 3 * sizes[i] for i, t in taken.items())
            assert abs(sum(taken.values()) - sum(sizes.values())) < 0.03 * sum(sizes.values())
    assert corpus_pipeline.run(spark, DATA).count() == len(after)
