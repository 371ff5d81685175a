"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import durable, pick, spooled, table

TOP = 5
#: Vectors of a stripe and of a bucket within one, queries of a group, longest vectors that give the first thresholds.
STRIPE = 16_384
BUCKET = 2_048
GROUP = 65_536
#: Components of a group's vectors at most, and queries that meet a stripe at a time.
GROUP_NUMBERS = 4_000_000
QUERIES = 4_096
SEEDS = 2_048
#: Local cosine threshold from which on coordinates prune a bucket, and how many of them.
COORDINATE_FROM = 0.75
FOCUS = 3
#: Products are exact in double precision up to here.
EXACT = 2.0**53


def matrix(lists: pa.ChunkedArray | pa.Array, wide: int) -> np.ndarray:
    """Whole numbers of each list as a row, with zeros up to ``wide``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    if len(sizes) and (sizes == wide).all():
        return flat.reshape(-1, wide).astype(np.int64)
    out = np.zeros((len(sizes), wide), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def small(rows: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest type that has them."""
    most = max(abs(int(rows.min(initial=0))), abs(int(rows.max(initial=0))))
    return rows.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)


def products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q and v: by double precision where that is exact, else by Python's integers, held to a long's range."""
    if not q.size or not v.size or float(np.abs(q.astype(float)).max()) * float(np.abs(v.astype(float)).max()) * q.shape[1] < EXACT:
        return q.astype(float) @ v.astype(float).T
    return np.array([[min(2**63 - 1, max(-(2**63), int(x))) for x in row] for row in q.astype(object) @ v.astype(object).T], object)


def keep_best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row: the highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), int)
    row, score, ids = row[order], score[order], ids[order]
    first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, int)
    rank = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    good = rank < k
    return row[good], score[good], ids[good]


def retrieve(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int, bucket: int = BUCKET) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, score, id) of the k best vectors of each query, of those that reach its ``floor``.

    Vectors go by falling length in buckets. For a query with threshold t (the k-th best so far), a bucket whose longest
    vector is l long has the local cosine threshold t / (|q| l). Above one, nothing in it can do. If it is high,
    the query's largest coordinates bound those of a vector that could, and sorted coordinates give the candidates; otherwise
    vectors too short to reach t are cut off. Products verify what is left.
    """
    length = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    v, v_ids, length = v[order], v_ids[order], length[order]
    q_len = np.sqrt((q.astype(float) ** 2).sum(axis=1))
    exact = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(v.astype(float)).max(initial=0)) * q.shape[1] < EXACT
    row, score, ids = np.zeros(0, int), np.zeros(0, float if exact else object), np.zeros(0, v_ids.dtype)
    least = floor.astype(float) if exact else np.full(len(q), -np.inf)  # products held to a long's range allow no bounds
    for at in range(0, len(v), bucket):
        part, part_ids, part_len = v[at : at + bucket], v_ids[at : at + bucket], length[at : at + bucket]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(q_len * part_len[0] > 0, least / (q_len * part_len[0]), np.where(least > 0, np.inf, -np.inf))
        open_ = np.flatnonzero(local <= 1 + 1e-9)
        by_coordinate = open_[local[open_] >= COORDINATE_FROM] if part_len[-1] > 0 else open_[:0]
        by_length = np.setdiff1d(open_, by_coordinate, assume_unique=True)
        found = [(row, score, ids)]
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                short = np.where((least[by_length] > 0) & (q_len[by_length] > 0), least[by_length] / q_len[by_length] * (1 - 1e-9), -np.inf)
            reach = int(np.searchsorted(-part_len, -short.min(), "right"))
            s = products(q[by_length], part[:reach]).astype(score.dtype)
            good = (s >= least[by_length, None]) & (part_ids[None, :reach] != q_ids[by_length, None])
            r, c = np.nonzero(good)
            found.append((by_length[r], s[r, c], part_ids[c]))
        if len(by_coordinate):
            unit = part / part_len[:, None]
            lists = {}
            for i in by_coordinate:
                own = q[i] / q_len[i]
                focus = np.argsort(-np.abs(own))[:FOCUS]
                t = max(0.0, min(1.0, local[i] * (1 - 1e-9)))
                half = np.sqrt(np.maximum(0, (1 - t * t) * (1 - own[focus] ** 2))) + 1e-9
                low, high = own[focus] * t - half, own[focus] * t + half
                low, high = np.where(-own[focus] >= t, -np.inf, low), np.where(own[focus] >= t, np.inf, high)  # the cone holds the axis itself
                spans = []
                for f in focus:
                    if f not in lists:
                        lists[f] = (o := np.argsort(unit[:, f]), unit[o, f])
                for f, lo, hi in zip(focus, low, high):
                    o, values = lists[f]
                    a, b = np.searchsorted(values, lo, "left"), np.searchsorted(values, hi, "right")
                    spans.append((b - a, f, a, b))
                _, f, a, b = min(spans)
                candidates = lists[f][0][a:b]
                for g, lo, hi in zip(focus, low, high):
                    if g != f:
                        candidates = candidates[(unit[candidates, g] >= lo) & (unit[candidates, g] <= hi)]
                candidates = candidates[part_ids[candidates] != q_ids[i]]
                if len(candidates):
                    s = products(q[i : i + 1], part[candidates])[0].astype(score.dtype)
                    good = s >= least[i]
                    found.append((np.full(good.sum(), i), s[good], part_ids[candidates[good]]))
        row, score, ids = keep_best(*(np.concatenate(c) for c in zip(*found)), k)
        if len(row) and exact:
            n = np.bincount(row, minlength=len(q))
            last = np.cumsum(n) - 1
            full = n >= k
            least[full] = np.maximum(least[full], score[last[full]].astype(float))
    return row, score, ids


def quantised(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(id, vector) with floor(scale * x) of every component as a whole number; rows without an id, or with a null or non-finite component, are left out."""
    rows = pick(vectors, id=id_col, vector=vector_col).filter("id IS NOT NULL AND vector IS NOT NULL")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~bad).select("id", F.transform("vector", lambda x: F.floor(x.cast("double") * scale)).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, stripe: int = STRIPE, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k vectors of highest inner product with each query, its own id excepted.

    Both tables have (id, vector) with whole numbers. Vectors are ranged by falling length into stripes of about ``stripe`` rows and
    queries into groups of about ``group``; a group, of bounded size, is broadcast and meets only the stripes long enough for the k-th best product that one
    of its queries has with the longest vectors. A stripe is a task's rows and never moves; what a group finds is at most k rows for a query and stripe.

    Ties go to the smaller id. A repeated row (same id and vector) counts once; rows of one id with other vectors are candidates of their
    own. A shorter vector counts as if zeros followed. Products beyond a long are held to its range. Fewer than k candidates: all.
    Empty tables: no rows.
    """
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    base = vectors.dropDuplicates(["id", "vector"]).withColumn("length", length)
    base = durable(base)
    n, wide = base.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    asked = durable(queries.dropDuplicates(["id", "vector"]))
    n_q, wide_q = asked.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    kind = dict(base.dtypes)["id"]
    if not n or not n_q:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    wide = max(wide, wide_q, 1)
    striped = durable(base.repartitionByRange(-(-n // stripe), F.desc("length"), "id").withColumn("stripe", F.spark_partition_id()))
    reach = [r[0] for r in striped.groupBy("stripe").agg(F.max("length").alias("length")).orderBy("stripe").select("length").collect()]
    number = {s: i for i, s in enumerate(sorted(r[0] for r in striped.select("stripe").distinct().collect()))}
    striped = striped.withColumn("stripe", F.element_at(F.create_map(*[F.lit(x) for p in number.items() for x in p]), F.col("stripe"))) if any(a != b for a, b in number.items()) else striped
    seeds = base.orderBy(F.desc("length"), "id").limit(SEEDS).select("id", "vector").toArrow()
    seed_ids, seed_vectors = seeds.column("id").to_numpy(), matrix(seeds.column("vector"), wide)
    longest = np.array(reach)

    def first_thresholds(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, q = batch.column("id").to_numpy(), matrix(batch.column("vector"), wide)
            s = products(q, seed_vectors).astype(float)
            s[ids[:, None] == seed_ids[None, :]] = -np.inf
            largest = float(np.abs(q.astype(float)).max(initial=0)) * longest[0] * wide
            floor = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] >= k and largest < EXACT else np.full(len(q), -np.inf)
            q_len = np.sqrt((q.astype(float) ** 2).sum(axis=1))
            bound = q_len[:, None] * longest[None, :] * (1 + 1e-9) + 1e-9
            visits = (bound >= floor[:, None]).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(floor), pa.array(visits)], ["id", "vector", "floor", "visits"])

    ready = asked.mapInArrow(first_thresholds, f"id {kind}, vector array<long>, floor double, visits int").filter("visits > 0")
    size = max(1, min(group, GROUP_NUMBERS // wide))
    ready = durable(ready.repartitionByRange(-(-n_q // size), "visits", "id").withColumn("group", F.spark_partition_id()))
    kept = []
    for most, number in sorted((r["most"], r["group"]) for r in ready.groupBy("group").agg(F.max("visits").alias("most")).collect()):
        own = ready.filter(F.col("group") == number).select("id", "vector", "floor").toArrow()
        block = spark.sparkContext.broadcast((own.column("id").to_numpy(), small(matrix(own.column("vector"), wide)), own.column("floor").to_numpy()))
        del own

        def met(batches, block=block):
            held = [b for b in batches if b.num_rows]
            if held:
                q_ids, q, floor = block.value
                stripe_ = pa.Table.from_batches(held)
                v_ids, v = stripe_.column("id").to_numpy(), matrix(stripe_.column("vector"), wide)
                del held, stripe_
                for at in range(0, len(q), QUERIES):
                    row, score, ids = retrieve(q[at : at + QUERIES].astype(np.int64), q_ids[at : at + QUERIES], floor[at : at + QUERIES], v, v_ids, k)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + row]), pa.array(ids), pa.array([int(x) for x in score], pa.int64())], ["query_id", "vec_id", "score"])

        found = striped.filter(F.col("stripe") < most).mapInArrow(met, f"query_id {kind}, vec_id {kind}, score long")
        kept.append(spooled(found))
    if not kept:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")
    found = spark.read.schema(kept[0].schema).parquet(*[f.spool for f in kept])
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.filter("id % 50 = 0"))


OP1_SQL = f"""
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= {TOP}
"""
