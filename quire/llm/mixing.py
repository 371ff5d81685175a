"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import WORD, broadcast_if, durable, pick, table

BLOCK_TOKENS = 16
SHARD_TOKENS = 4_000_000
SHARD_ROWS = 4_000_000
MOST_REPEATS = 3
SEED = "mix-1"
#: Sources of up to this many rows (one row a source) are broadcast; more are joined by shuffling.
BROADCAST_SOURCES = 200_000


def apportion(cells: DataFrame, part: list[str], votes: str, seats: str, order: list[Column]) -> DataFrame:
    """``cells`` with ``quota``: ``seats`` of each part shared by the highest quotients votes/1, votes/3, votes/5...

    The seats themselves are never enumerated. A divisor that surely gives too few
    seats and one that surely gives enough enclose each cell's quota within a few
    quotients, and only those are ranked: about two rows a cell whatever the number
    of seats. Ties go to the first cell in ``order``.
    """
    w = W.partitionBy(*part)
    half = F.col("_n") / 2
    v, m = F.col(votes), F.col(seats)
    bounded = (
        cells.withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_v", F.sum(v).over(w).cast("double"))
        .withColumn("_pos", F.row_number().over(w.orderBy(*order)))
        .withColumn("_low", F.when((v > 0) & (m > half), F.greatest(F.lit(0), F.floor(v * (m - half) / F.col("_v") + 0.5).cast("long") - 1)).otherwise(F.lit(0)).cast("long"))
        .withColumn("_high", F.when((v > 0) & (m > 0), F.floor(v * (m + half) / F.col("_v") + 0.5).cast("long") + 1).otherwise(F.lit(0)).cast("long"))
        .withColumn("_open", m - F.sum("_low").over(w))
    )
    tries = (
        bounded.filter("_high > _low")
        .select(*part, "_pos", "_open", v.alias("_votes"), F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("_a"))
        .withColumn("_q", F.col("_votes") / (2 * F.col("_a") - 1))
        .withColumn("_rank", F.row_number().over(w.orderBy(F.desc("_q"), "_pos", "_a")))
        .filter("_rank <= _open")
        .groupBy(*part, "_pos")
        .agg(F.count(F.lit(1)).alias("_won"))
    )
    left, right = bounded.alias("l"), tries.alias("r")
    same = F.col("l._pos") == F.col("r._pos")
    for c in part:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.join(right, same, "left").select(*[F.col(f"l.{c}") for c in cells.columns], (F.col("l._low") + F.coalesce(F.col("r._won"), F.lit(0))).alias("quota"))


def targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """``sources`` (source, source_size) with ``pos``, ``weight`` and ``target``.

    Weights are 1, 2, 3 repeating, by code point with null last. Targets share the
    sum of all sizes by weight; a target stops at ``most`` times its source's size and the
    excess goes to the others by weight. That fixed point is least(level * weight, most * size)
    for one level, which prefix sums over the sources in order of cap / weight give at once.
    """
    everything = W.partitionBy(F.lit(0))
    cap = F.col("source_size") * most
    up_to = everything.orderBy(F.col("source_size") * most / F.col("weight"), "pos").rowsBetween(W.unboundedPreceding, -1)
    return (
        sources.withColumn("pos", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())).cast("long"))
        .withColumn("weight", (F.col("pos") - 1) % 3 + 1)
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum(cap).over(up_to), F.lit(0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        .withColumn("_stop", F.when(F.col("_level") * F.col("weight") <= cap, F.struct(F.col("source_size") * most / F.col("weight"), "pos", "_level")))
        .withColumn("_stop", F.min("_stop").over(everything)["_level"])
        .withColumn("target", F.least(F.coalesce("_stop", F.lit(0.0)) * F.col("weight"), cap.cast("double")))
        .select("source", "source_size", "pos", "weight", "target")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, shard_rows: int = SHARD_ROWS, most: int = MOST_REPEATS, seed: str = SEED, key: bool = False) -> DataFrame:
    """One row per document: how many of its words a mix of the whole corpus takes.

    Sources get blocks of ``block_tokens`` words by Sainte-Lague; a source is cut into
    as many shards as its size needs (``shard_tokens`` words and ``shard_rows`` documents each, so a hot source is
    many shards) and its blocks are apportioned to its shards in the same way. A shard's
    documents stand in a seeded order, and the shard's quota is the first so many
    blocks of that stream, which begins again when it ends, ``most`` times at most.

    Only (doc_id, source, size) is shuffled, never a text.

    Null text: size 0. Null source: a source of its own, the last. Null or repeated
    doc_id: each row counts for itself. Empty table: no rows. Other columns don't matter.

    Returns doc_id, source, size, source_size, target, taken, shard, quota_blocks (and ``text_key``, if ``key``).
    """
    rows = pick(docs, doc_id=id_col, text=text_col, source=source_col).select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.xxhash64("text").alias("text_key")] * key
    )
    rows = durable(rows)
    sized = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_rows")).withColumnRenamed("source", "_from")
    sized = sized.withColumn("_part", F.lit(0)).withColumn("_blocks", F.ceil(F.sum("source_size").over(W.partitionBy("_part")) / block_tokens).cast("long"))
    sized = apportion(sized, ["_part"], "target", "_blocks", [F.col("pos")]).select("source", "source_size", "target", F.col("quota").alias("source_blocks"))
    sized = sized.join(counts, sized["source"].eqNullSafe(counts["_from"])).drop("_from")
    sized = durable(sized.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens), F.ceil(F.col("_rows") / shard_rows)).cast("long")).drop("_rows"))
    few = broadcast_if(sized, sized.count(), BROADCAST_SOURCES).withColumnRenamed("source", "_source")

    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    placed = (
        rows.join(few, rows["source"].eqNullSafe(few["_source"]))
        .drop("_source")
        .withColumn("_turn", digest)
        .withColumn("shard", F.conv(F.substring("_turn", 1, 8), 16, 10).cast("long") % F.col("shards"))
    )
    cells = placed.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"), F.first("source_blocks").alias("source_blocks"))
    cells = apportion(cells, ["source"], "cell_size", "source_blocks", [F.col("shard")]).select(F.col("source").alias("_source"), F.col("shard").alias("_shard"), "cell_size", F.col("quota").alias("quota_blocks"))
    joined = placed.join(cells, placed["source"].eqNullSafe(cells["_source"]) & (placed["shard"] == cells["_shard"]))

    stream = W.partitionBy("source", "shard").orderBy("_turn", "doc_id", "size", *["text_key"] * key).rowsBetween(W.unboundedPreceding, -1)
    words = F.least(F.col("quota_blocks") * block_tokens, F.col("cell_size") * most)
    return (
        joined.withColumn("_at", F.coalesce(F.sum("size").over(stream), F.lit(0)))
        .withColumn("_turns", F.when(F.col("cell_size") > 0, F.floor(words / F.col("cell_size"))).otherwise(0).cast("long"))
        .withColumn("_rest", words - F.col("_turns") * F.col("cell_size"))
        .withColumn("taken", (F.col("_turns") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("_at") + F.col("size"), F.col("_rest")) - F.col("_at"))).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "shard", "quota_blocks", *["text_key"] * key)
    )


def mixed_documents(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: one row for each copy that the mix takes of a document, with ``copy`` (from 1) and ``taken``, its words.

    A copy is always the whole text: where a shard's quota ends inside a document, that copy is taken if the quota has half of it or more.
    Documents of which nothing is taken are left out, those with a null text or one without words too. The
    columns of ``docs`` stay (the new ones are ``mix_copy`` and ``mix_taken`` if it has such already); rows of one doc_id and one text count
    as one document's copies. Null ids and sources are as good as any. Empty table: no rows.
    """
    names = docs.columns
    copies = F.floor(F.col("taken") / F.col("size") + F.lit(0.5)).cast("int")
    taken = mix(docs, key=True, **params).filter("size > 0").groupBy("doc_id", "text_key", "size").agg(F.sum(copies).alias("_copies")).filter("_copies > 0")
    flat = docs.toDF(*[f"__{i}" for i in range(len(names))])
    by = {n: f"__{names.index(n)}" for n in ("doc_id", "text")}
    flat = flat.withColumn("_key", F.xxhash64(by["text"])).dropDuplicates([by["doc_id"], "_key"])
    rows = flat.join(taken, flat[by["doc_id"]].eqNullSafe(taken["doc_id"]) & (flat["_key"] == taken["text_key"]))
    free = lambda n: n if n not in [c.lower() for c in names] else free(f"mix_{n}")
    copy = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    return rows.select(*[f"__{i}" for i in range(len(names))], copy, F.col("size").alias("_taken")).toDF(*names, free("copy"), free("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard", "quota_blocks")


OP7_SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS turn
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS source_rows FROM rows GROUP BY source),
pos AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos FROM src),
wt AS (SELECT *, (pos - 1) % 3 + 1 AS weight, {MOST_REPEATS} * source_size AS cap, sum(source_size) OVER ()::BIGINT AS total FROM pos),
lev AS (
  SELECT *, cap / weight AS r,
         (total - coalesce(sum(cap) OVER up, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER up, 0))::DOUBLE AS level
  FROM wt WINDOW up AS (ORDER BY cap / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
tgt AS (
  SELECT source, source_size, source_rows, pos,
         least(coalesce((SELECT arg_min(l.level, (l.r, l.pos)) FROM lev l WHERE l.level * l.weight <= l.cap), 0.0) * weight, cap::DOUBLE) AS target,
         ceil(total / {BLOCK_TOKENS}.0)::BIGINT AS m, count(*) OVER () AS n
  FROM lev),
bnd AS (
  SELECT *, sum(target) OVER () AS v,
    CASE WHEN target > 0 AND m > n / 2 THEN greatest(0, floor(target * (m - n / 2) / sum(target) OVER () + 0.5)::BIGINT - 1) ELSE 0 END AS low,
    CASE WHEN target > 0 AND m > 0 THEN floor(target * (m + n / 2) / sum(target) OVER () + 0.5)::BIGINT + 1 ELSE 0 END AS high
  FROM tgt),
opn AS (SELECT *, m - sum(low) OVER () AS open FROM bnd),
tries AS (
  SELECT pos, open, row_number() OVER (ORDER BY target / (2 * a - 1) DESC, pos, a) AS rk
  FROM (SELECT *, unnest(range(low + 1, high + 1)) AS a FROM opn)),
won AS (SELECT pos, count(*) AS won FROM tries WHERE rk <= open GROUP BY pos),
quota AS (
  SELECT o.source, o.source_size, o.target, o.pos, (o.low + coalesce(w.won, 0))::BIGINT AS blocks,
         greatest(1, ceil(o.source_size / {SHARD_TOKENS}.0), ceil(o.source_rows / {SHARD_ROWS}.0))::BIGINT AS shards
  FROM opn o LEFT JOIN won w USING (pos)),
placed AS (
  SELECT r.*, q.source_size, q.target, q.pos, q.blocks, ('0x' || substr(r.turn, 1, 8))::BIGINT % q.shards AS shard
  FROM rows r JOIN quota q ON r.source IS NOT DISTINCT FROM q.source),
cells AS (SELECT pos, shard, sum(size)::BIGINT AS cell_size, any_value(blocks) AS m, count(*) OVER (PARTITION BY pos) AS n FROM placed GROUP BY pos, shard),
cbnd AS (
  SELECT *,
    CASE WHEN cell_size > 0 AND m > n / 2 THEN greatest(0, floor(cell_size * (m - n / 2) / (sum(cell_size) OVER c)::DOUBLE + 0.5)::BIGINT - 1) ELSE 0 END AS low,
    CASE WHEN cell_size > 0 AND m > 0 THEN floor(cell_size * (m + n / 2) / (sum(cell_size) OVER c)::DOUBLE + 0.5)::BIGINT + 1 ELSE 0 END AS high
  FROM cells WINDOW c AS (PARTITION BY pos)),
copn AS (SELECT *, m - sum(low) OVER (PARTITION BY pos) AS open FROM cbnd),
ctries AS (
  SELECT pos, shard, open, row_number() OVER (PARTITION BY pos ORDER BY cell_size / (2 * a - 1) DESC, shard, a) AS rk
  FROM (SELECT *, unnest(range(low + 1, high + 1)) AS a FROM copn)),
cwon AS (SELECT pos, shard, count(*) AS won FROM ctries WHERE rk <= open GROUP BY pos, shard),
cq AS (SELECT o.pos, o.shard, o.cell_size, (o.low + coalesce(w.won, 0))::BIGINT AS quota FROM copn o LEFT JOIN cwon w USING (pos, shard)),
stood AS (
  SELECT p.*, c.cell_size, c.quota, least(c.quota * {BLOCK_TOKENS}, c.cell_size * {MOST_REPEATS})::BIGINT AS words,
         coalesce(sum(p.size) OVER (PARTITION BY p.pos, p.shard ORDER BY p.turn, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed p JOIN cq c USING (pos, shard)),
fin AS (SELECT *, CASE WHEN cell_size > 0 THEN words // cell_size ELSE 0 END AS turns FROM stood)
SELECT doc_id, size, source_size, target,
       (turns * size + greatest(0, least(start + size, words - turns * cell_size) - start))::BIGINT AS taken,
       shard::BIGINT AS shard, quota::BIGINT AS quota_blocks
FROM fin
"""
