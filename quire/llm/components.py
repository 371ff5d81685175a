"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import durable


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v) but the roots; a root is its component's least node.

    Alternates large-star and small-star steps until nothing changes, which takes a
    number of rounds that grows with the logarithm of the largest component. Minima are
    aggregated before they are joined back, so a node with very many links is
    combined on the map side, and its join can be split. Every round is written to the
    checkpoint folder. Loops, repeated links and an empty table are fine.
    """
    at = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        now = at.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before or now[0] == 0:
            return at.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.inline(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
        at = durable(small.filter("u <> v").distinct())
