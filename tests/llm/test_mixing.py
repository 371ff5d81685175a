import duckdb
import pytest

from quire.llm import mixing

DATA = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.sql(mixing.OP7_SQL)
    got = mixing.op7_mixing(spark, DATA).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_targets_by_hand(spark):
    sizes = [("a", 1000), ("b", 10), ("c", 400), (None, 0), ("é", 90)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    level, weights = {}, {"a": 1, "b": 2, "c": 3, "é": 1, None: 2}
    open_, left = set(weights), 1500.0
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * dict(sizes)[s]}
        if not full:
            break
        for s in full:
            level[s] = 3.0 * dict(sizes)[s]
            left -= level[s]
        open_ -= full
    level.update(share)
    assert got == pytest.approx(level)


def test_apportion_equals_divisors_one_by_one(spark):
    votes = [37, 0, 1, 250, 12, 12, 999]
    for seats in (0, 1, 6, 50, 1313):
        rows = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "p int, i int, v long, seats long")
        got = {r.i: r.quota for r in mixing.apportion(rows, ["p"], "v", "seats", ["i"]).collect()}
        want = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))
            want[best] += 1
        assert got == dict(enumerate(want)), seats


def test_bounds_shards_and_reruns(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 50), "hot" if i % 3 else f"s{i % 7}") for i in range(600)], "doc_id long, text string, source string")
    first = mixing.mix(docs, shard_tokens=500).collect()
    assert sorted(first) == sorted(mixing.mix(docs.repartition(7), shard_tokens=500).collect())
    assert len({r.shard for r in first if r.source == "hot"}) > 10
    by = {}
    for r in first:
        assert 0 <= r.taken <= 3 * r.size
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    assert all(abs(taken - target) <= max(16, 0.02 * target) for target, taken in by.values()), by
