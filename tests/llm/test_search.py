import duckdb
import numpy as np
import pytest

from quire.llm import search

DATA = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{DATA}/embeddings.parquet'")
    want = con.sql(search.OP1_SQL)
    assert sorted(map(tuple, search.op1_search(spark, DATA).select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("trial", range(24))
def test_retrieval_equals_brute_force(trial):
    rng = np.random.default_rng(trial)
    d, n, kind, k = int(rng.integers(1, 9)), int(rng.integers(1, 300)), trial % 4, int(rng.integers(1, 8))
    v = rng.integers(-30, 30, (n, d)) * (rng.integers(1, 50, (n, 1)) if kind else 1)
    if kind == 2:
        v = rng.integers(-300, 300, (4, d))[rng.integers(0, 4, n)] + rng.integers(-6, 6, (n, d))
    if kind == 3:
        v = v * 10**17 if trial % 8 == 3 else v // 20
    ids = rng.permutation(n * 2)[:n]
    q, q_ids = v[::5], ids[::5]
    got = [tuple(map(int, x)) for x in zip(*search.retrieve(q, q_ids, np.full(len(q), -np.inf), v, ids, k, bucket=16))]
    want = []
    for j in range(len(q)):
        exact = lambda m: max(-(2**63), min(2**63 - 1, sum(int(a) * int(b) for a, b in zip(q[j], v[m]))))  # noqa: B023, E731
        want += [(j, -s, i) for s, i in sorted((-exact(m), int(ids[m])) for m in range(n) if ids[m] != q_ids[j])[:k]]
    assert got == want


def test_stripes_and_groups(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-9, 9, int(rng.integers(0, 6)))]) for i in range(150)] + [(3, [1, 2]), (3, [1, 2])]
    table = spark.createDataFrame(rows, "id long, vector array<long>")
    got = sorted(map(tuple, search.top_k(table, table.filter("id % 7 = 0"), 4, stripe=40, group=9).collect()))
    distinct = sorted({(i, tuple(v)) for i, v in rows})
    want = []
    for qi, qv in distinct:
        if qi % 7 == 0:
            best = sorted((-sum(a * b for a, b in zip(qv, cv)), ci) for ci, cv in distinct if ci != qi)[:4]
            want += [(qi, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    assert got == sorted(want)
