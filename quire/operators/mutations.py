"""Changes of documents as tables of objects (doc_id, revision_no, obj_no, gen_no, ...) and index entries; a change gives new tables, so what it began with is its rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators import relational


def numbered(objects: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` (doc_id, ...) with ``obj_no``: the next free numbers of each document, in order."""
    top = objects.groupBy("doc_id").agg(F.max("obj_no").alias("_top"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(*order))
    return new.join(top, "doc_id", "left").withColumn("obj_no", F.coalesce("_top", F.lit(0)) + place).drop("_top")


def reserved(objects: DataFrame, wanted: DataFrame, count: str) -> DataFrame:
    """(doc_id, first, last) of the numbers that each document keeps free for ``count`` objects to come."""
    top = objects.groupBy("doc_id").agg(F.max("obj_no").alias("_top"))
    return wanted.join(top, "doc_id", "left").select("doc_id", (F.coalesce("_top", F.lit(0)) + 1).alias("first"), (F.coalesce("_top", F.lit(0)) + F.col(count)).alias("last"))


def added(objects: DataFrame, pool: DataFrame, chosen: DataFrame, links: DataFrame) -> DataFrame:
    """``objects`` with those of ``pool`` that are ``chosen`` (doc_id, node) or that these refer to, over any number of steps (``links``: doc_id, source, target), if their number isn't taken."""
    needed = relational.closure(links, chosen).withColumnRenamed("node", "obj_no")
    return relational.union_first(objects, pool.join(needed, ["doc_id", "obj_no"], "left_semi"), ["doc_id", "obj_no"])


def deleted(objects: DataFrame, entries: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects without those in ``gone`` (doc_id, obj_no), and index entries in which these are free, a generation later."""
    mark = gone.select("doc_id", "obj_no", F.lit(True).alias("_gone")).distinct()
    left = objects.join(mark, ["doc_id", "obj_no"], "left_anti")
    changed = entries.join(mark, ["doc_id", "obj_no"], "left")
    own = {"entry_type": F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("entry_type")), "byte_offset": F.when(~F.coalesce("_gone", F.lit(False)), F.col("byte_offset")), "gen_no": F.col("gen_no") + F.when(F.col("_gone"), 1).otherwise(0)}
    return left, changed.withColumns(own).drop("_gone").select(*entries.columns)


def incremental(objects: DataFrame, changes: DataFrame) -> DataFrame:
    """Earlier revisions as they are, and the changed objects as rows of one further revision of their document; documents without a change get none."""
    last = objects.groupBy("doc_id").agg(F.max("revision_no").alias("_last"))
    new = changes.drop("revision_no").join(last, "doc_id", "left").withColumn("revision_no", F.coalesce(F.col("_last") + 1, F.lit(0))).drop("_last")
    return objects.unionByName(new.select(*objects.columns))


def modified(objects: DataFrame, before: DataFrame, content: str) -> DataFrame:
    """(doc_id, changed): whether any object was added, taken away or has other content than before."""
    a = objects.select("doc_id", "obj_no", F.col(content).alias("_new"))
    b = before.select("doc_id", "obj_no", F.col(content).alias("_old"))
    both = a.join(b, ["doc_id", "obj_no"], "full")
    return both.groupBy("doc_id").agg(F.bool_or(~F.col("_new").eqNullSafe(F.col("_old"))).alias("changed"))


def placed(objects: DataFrame, size: str, order: list[str], header: int = 0) -> DataFrame:
    """Objects with ``byte_offset``, where each begins when its document is written anew: the sizes of those before, after the header."""
    return relational.running_offset(objects, size, order, ["doc_id"]).withColumn("byte_offset", F.col("byte_offset") + header)


def indexed(placed_: DataFrame) -> DataFrame:
    """(doc_id, first, n, lines) of the index sections of written objects: consecutive numbers stand together, each line in the format's form."""
    w = W.partitionBy("doc_id").orderBy("obj_no")
    rows = placed_.withColumn("_run", F.col("obj_no") - F.row_number().over(w))
    line = F.struct("obj_no", relational.xref_line(F.col("byte_offset"), F.col("gen_no"), F.lit(True)).alias("line"))
    return rows.groupBy("doc_id", "_run").agg(F.min("obj_no").alias("first"), F.count(F.lit(1)).alias("n"), F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"])).alias("lines")).drop("_run")


def stale_offsets(entries: DataFrame, placed_: DataFrame) -> DataFrame:
    """Entries whose offset isn't where their object was written: what an update must correct, until there are none."""
    at = placed_.select("doc_id", "obj_no", F.col("byte_offset").alias("_now"))
    return entries.join(at, ["doc_id", "obj_no"]).filter(~F.col("byte_offset").eqNullSafe(F.col("_now")))


def with_version(documents: DataFrame, version: Column) -> DataFrame:
    """``documents`` (doc_id, version, ...) with a version that is never lowered."""
    return documents.withColumn("version", F.greatest("version", version))


def empty_revisions(revisions: DataFrame, objects: DataFrame) -> DataFrame:
    """Revisions that have no object of their own."""
    return revisions.join(objects.select("doc_id", "revision_no").distinct(), ["doc_id", "revision_no"], "left_anti")


def contained(objects: DataFrame, wanted: DataFrame, content: str) -> DataFrame:
    """``wanted`` (doc_id, obj_no, content) with ``contains`` (its number is there) and ``exists`` (an equal content is there, whatever its number)."""
    by_number = objects.select("doc_id", "obj_no").distinct().withColumn("_number", F.lit(True))
    by_content = objects.select("doc_id", F.col(content)).distinct().withColumn("_content", F.lit(True))
    joined = wanted.join(by_number, ["doc_id", "obj_no"], "left").join(by_content, ["doc_id", content], "left")
    return joined.withColumn("contains", F.coalesce("_number", F.lit(False))).withColumn("exists", F.coalesce("_content", F.lit(False))).drop("_number", "_content")


def not_yet_on_page(widgets: DataFrame, annotations: DataFrame) -> DataFrame:
    """Widgets (doc_id, page_obj, obj_no) that their page's annotations don't have."""
    return widgets.join(annotations, ["doc_id", "page_obj", "obj_no"], "left_anti")
