"""Index, version, graph and sequence operators, each as one declarative plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.operators.shared import discard, sums_before, written


def islands(rows: DataFrame, number: str, part: list[str] = ()) -> DataFrame:
    """(part, start, n) of the runs of consecutive different numbers. Without parts, the numbers are ranged into tasks."""
    distinct = rows.select(*part, number).distinct()
    if part:
        placed = distinct.withColumn("_run", F.col(number) - F.row_number().over(W.partitionBy(*part).orderBy(number)))
    else:
        placed = sums_before(distinct, F.lit(1), [number], "_n").withColumn("_run", F.col(number) - F.col("_n"))
    return placed.groupBy(*part, "_run").agg(F.min(number).alias("start"), F.count(F.lit(1)).alias("n")).drop("_run")


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``: newest version, live object, last turn."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def running_offset(rows: DataFrame, size: str, order: list[str], part: list[str] = (), name: str = "byte_offset") -> DataFrame:
    """Where each piece begins when all are written one after another. Without parts, the pieces are ranged into tasks."""
    if not part:
        return sums_before(rows, F.col(size), order, name)
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def union_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``first``, and those rows of ``second`` whose key isn't in it."""
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))


def missing(referenced: DataFrame, registered: DataFrame, keys: list[str]) -> DataFrame:
    return referenced.join(registered, keys, "left_anti")


def live_objects(entries: DataFrame, objects: DataFrame) -> DataFrame:
    """Objects that stand where the index says: equal document, number and offset."""
    return objects.join(entries.filter("entry_type = 1"), ["doc_id", "obj_no", "byte_offset"], "left_semi")


def prev_links(revisions: DataFrame) -> DataFrame:
    """(doc_id, revision_no, prev_no) where exactly one revision's index begins at ``prev``."""
    later, earlier = revisions.alias("l"), revisions.alias("e")
    pairs = later.join(earlier, (F.col("l.doc_id") == F.col("e.doc_id")) & (F.col("l.prev") == F.col("e.xref_offset")) & (F.col("l.prev") != 0))
    pairs = pairs.select(F.col("l.doc_id").alias("doc_id"), F.col("l.revision_no").alias("revision_no"), F.col("e.revision_no").alias("prev_no"))
    return pairs.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("doc_id", "revision_no"))).filter("_n = 1").drop("_n")


def effective_entries(entries: DataFrame) -> DataFrame:
    """For each object the index entry of the newest revision that has one; a free entry hides older ones."""
    return latest(entries, ["doc_id", "obj_no"], [F.desc("revision_no"), F.desc("entry_type")])


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, node) of everything that the roots reach over (doc_id, source, target), the roots too.

    One join a step, over the nodes found last, until a step finds none; so cycles end, and the steps are as many
    as the longest shortest path. The edges and what each step finds are written to the shared folder: a checkpoint would keep its
    few partitions, and all edges would be shuffled into those.
    """
    links = written(edges.select("doc_id", F.col("source").alias("node"), "target").distinct())
    known = fresh = written(roots.select("doc_id", "node").distinct())
    while not fresh.isEmpty():
        found = links.join(fresh, ["doc_id", "node"]).select("doc_id", F.col("target").alias("node")).distinct()
        fresh = written(found.join(known, ["doc_id", "node"], "left_anti"))
        known = known.unionByName(fresh)  # of what each step wrote
    discard(links)
    return known


def tree_paths(nodes: DataFrame) -> DataFrame:
    """Nodes (doc_id, node, parent, name) with depth and dotted path from their root, whose parent is null.

    One join a level, until a level has no node; a cycle has no root and so isn't reached. Children and levels are written to the shared folder (see ``closure``).
    """
    children = written(nodes.filter("parent IS NOT NULL").select("doc_id", F.col("node").alias("_node"), "parent", F.col("name").cast("string").alias("_name")))
    level = written(nodes.filter("parent IS NULL").select("doc_id", "node", F.lit(0).alias("depth"), F.col("name").cast("string").alias("path")))
    found = level
    while not level.isEmpty():
        below = children.join(level.withColumnRenamed("node", "parent"), ["doc_id", "parent"])
        level = written(below.select("doc_id", F.col("_node").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("."), "_name").alias("path")))
        found = found.unionByName(level)
    discard(children)
    return found


def inherited(fields: DataFrame, parents: DataFrame, columns: list[str]) -> DataFrame:
    """Fields with those columns taken from their parent where their own is null (one step)."""
    p = parents.select(F.col("doc_id").alias("_doc"), F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = fields.join(p, (fields["doc_id"] == p["_doc"]) & (fields["parent"] == p["_node"]), "left")
    return joined.select(*[F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if c in columns else fields[c] for c in fields.columns])


def in_ranges(rows: DataFrame, value: str, ranges: DataFrame, low: str, size: str, width: int) -> DataFrame:
    """Rows joined to the range [low, low + size) their value lies in, as an equi join on cells of ``width``."""
    cells = ranges.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor((F.col(low) + F.col(size) - 1) / width))))
    return rows.withColumn("_cell", F.floor(F.col(value) / width)).join(cells, "_cell").filter((F.col(value) >= F.col(low)) & (F.col(value) < F.col(low) + F.col(size))).drop("_cell")


def xref_line(offset: Column, gen: Column, in_use: Column) -> Column:
    return F.concat(F.lpad(offset.cast("string"), 10, "0"), F.lit(" "), F.lpad(gen.cast("string"), 5, "0"), F.when(in_use, F.lit(" n")).otherwise(F.lit(" f")))


def fixed_width(values: list[tuple[Column, int]]) -> Column:
    """Big-endian record of (value, bytes) as upper-case hex digits."""
    return F.concat(*[F.lpad(F.hex(v.cast("long")), 2 * n, "0") for v, n in values])


def simple_calculate(values: Column, operation: str) -> Column:
    """SUM, AVG, PRD, MIN or MAX over a column of numbers, with 0 (1 for PRD) for no rows."""
    operation = operation.upper()
    found = {"SUM": F.sum, "AVG": F.avg, "PRD": F.product, "MIN": F.min, "MAX": F.max}[operation](values)
    return F.coalesce(found, F.lit(1.0 if operation == "PRD" else 0.0))


def tiff_encode(value: Column, part: list[str], order: str, step: int = 1) -> Column:
    return F.pmod(value - F.coalesce(F.lag(value, step).over(W.partitionBy(*part).orderBy(order)), F.lit(0)), F.lit(256))


def tiff_decode(value: Column, part: list[str], order: str) -> Column:
    return F.pmod(F.sum(value).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)), F.lit(256))


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """``rows`` with ``batch`` and ``place``: batches of ``size`` in order, as objects go to object streams."""
    return sums_before(rows, F.lit(1), order, "_n").withColumn("batch", F.floor(F.col("_n") / size)).withColumn("place", F.col("_n") % size).drop("_n")


def joined_by_number(entries: DataFrame, objects: DataFrame, key: str, number: str, inside: Column) -> DataFrame:
    """Entries with the objects of their key, of which a condition on both is true as well."""
    e, o = entries.alias("e"), objects.alias("o")
    return e.join(o, (F.col(f"e.{key}") == F.col(f"o.{number}")) & inside)


def ordered_lookup(order: DataFrame, rows: DataFrame, key: str, other: str, by: list[str]) -> DataFrame:
    """``order`` with its position (from 1) and what ``rows`` has for its key; what isn't there stays, with nulls."""
    placed = sums_before(order, F.lit(1), by, "_n").withColumn("position", (F.col("_n") + 1).cast("int")).drop("_n")
    return placed.join(rows, F.col(key) == F.col(other), "left")


def distinct_content(rows: DataFrame, content: Column, first: str) -> DataFrame:
    """(digest, first): one row for each different content, whatever the number of copies; they are combined before they are shuffled."""
    return rows.groupBy(F.sha2(content, 256).alias("digest")).agg(F.min(first).alias(first))


def union_distinct(tables: list[DataFrame], content: str) -> DataFrame:
    """The different contents of several tables with the first table's number that has each: revocation data of old and new."""
    found = None
    for number, rows in enumerate(tables):
        own = rows.select(F.col(content).alias(content), F.lit(number).alias("origin"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy(content).agg(F.min("origin").alias("origin"))


def found_last(value: Column, order: Column, matches: Column | None = None) -> Column:
    """Aggregate: the value of the last row, of those that match."""
    return F.max_by(value, order) if matches is None else F.max_by(F.when(matches, value), F.when(matches, order))


def found_first(value: Column, order: Column, matches: Column | None = None) -> Column:
    """Aggregate: the value of the first row, of those that match; null if none does."""
    return F.min_by(value, order) if matches is None else F.min_by(F.when(matches, value), F.when(matches, order))


def at_position(value: Column, order: Column, position: int) -> Column:
    """Aggregate: the value at a position; null beyond the end."""
    return F.max(F.when(order == position, value))


def index_size(numbers: Column) -> Column:
    """Aggregate: the size entry of an index, one more than the largest number."""
    return F.coalesce(F.max(numbers), F.lit(-1)) + 1


def field_width(values: Column) -> Column:
    """Aggregate: bytes that the largest value needs, one at least."""
    most = F.coalesce(F.max(values), F.lit(0)).cast("long")
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(most)) / 8)).cast("int")


def sessions(events: DataFrame, keys: list[str], at: str, tie: str, gap: str) -> DataFrame:
    """(keys, session, begin, n): runs of events no further apart than ``gap``, the batch form of the stream's sessions."""
    w = W.partitionBy(*keys).orderBy(at, tie)
    fresh = F.when(F.col(at) - F.lag(at).over(w) <= F.expr(f"INTERVAL {gap}"), 0).otherwise(1)
    return events.withColumn("_fresh", fresh).withColumn("session", F.sum("_fresh").over(w)).groupBy(*keys, "session").agg(F.min(at).alias("begin"), F.count(F.lit(1)).alias("n"))


def resolved(values: DataFrame, objects: DataFrame, most: int = 32) -> DataFrame:
    """``values`` (doc_id, node, ref) with the object that the reference leads to, over references to references; null where it leads nowhere or round in a circle.

    ``objects`` has (doc_id, obj_no, ref): ref is null for an object that is a value itself. One step for what isn't settled yet: the
    objects that its references name are looked up once each. Objects and steps are written to the shared folder (see ``closure``), so
    objects are made once, and their size decides whether they are shuffled or what is looked up goes to where they lie.
    """
    kind = objects.schema["obj_no"].dataType
    steps = written(objects.select("doc_id", F.col("obj_no").alias("_no"), F.col("ref").cast(kind).alias("_next")))
    open_ = written(values.withColumn("_at", F.col("ref").cast(kind)))
    done = None
    for _ in range(most):
        found = steps.join(open_.select("doc_id", F.col("_at").alias("_no")).distinct(), ["doc_id", "_no"], "left_semi")
        there = written(open_.join(found, (open_["doc_id"] == found["doc_id"]) & (open_["_at"] == found["_no"]), "left").drop(found["doc_id"]))
        ended = there.filter("_next IS NULL").select(*values.columns, F.col("_no").alias("target"))
        done = ended if done is None else done.unionByName(ended)
        open_ = there.filter("_next IS NOT NULL").select(*values.columns, F.col("_next").alias("_at"))
        if open_.isEmpty():
            discard(steps)
            return done
    discard(steps)
    return done.unionByName(open_.select(*values.columns, F.lit(None).cast(kind).alias("target")))


def separators(kinds: Column, before: Column) -> Column:
    """Whether white space must stand between a token and the one before: both are made of regular characters."""
    regular = lambda k: k.isin("number", "name", "keyword", "boolean", "null", "ref", "start_object")
    return F.coalesce(regular(before) & (regular(kinds) & (kinds != "name")), F.lit(False))


def pen_positions(glyphs: DataFrame, part: list[str], order: str, width: str, size: float, start: float = 0.0) -> DataFrame:
    """Glyphs with ``pen``, where each begins: the widths (thousandths of an em) of those before it, in a font size."""
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return glyphs.withColumn("pen", F.coalesce(F.sum(width).over(w), F.lit(0)) * size / 1000 + start)


def radio_choice(buttons: DataFrame, group: list[str], order: str, matches: Column) -> DataFrame:
    """Buttons with ``chosen``: in each group the first that matches, or the first of all."""
    w = W.partitionBy(*group).orderBy(F.when(matches, 0).otherwise(1), order)
    return buttons.withColumn("chosen", F.row_number().over(w) == 1)


def written_order(objects: DataFrame, rank: Column, part: list[str], ordinal: str) -> DataFrame:
    """Objects with ``position``: by rank (signatures and index streams last), those of one rank as they stood."""
    return objects.withColumn("position", F.row_number().over(W.partitionBy(*part).orderBy(rank, ordinal)))


def differences(items: DataFrame, part: list[str], order: str, number: str, name: str) -> DataFrame:
    """(part, code, name) of an array of codes and glyph names: a number sets the code of the next name, each name after that has the next code."""
    w = W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    code = F.last(number, True).over(w) + F.col(order) - F.last(F.when(F.col(number).isNotNull(), F.col(order)), True).over(w) - 1
    return items.withColumn("code", code).filter(F.col(name).isNotNull() & F.col("code").isNotNull()).select(*part, F.col("code").cast("int"), name)


def chunked(rows: DataFrame, part: list[str], order: str, size: int = 100) -> DataFrame:
    """Rows with ``chunk``, of ``size`` in order: a character map lists no more than a hundred at a time."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(*part).orderBy(order)) - 1) / size))


def joined_bytes(data: Column, order: Column) -> Column:
    """Aggregate: all pieces one after another, in order."""
    pieces = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.hex(data).alias("d")))), lambda x: x["d"])
    return F.unhex(F.array_join(pieces, ""))


def cut(files: DataFrame, size: int = 1024) -> DataFrame:
    """(doc_id, seq, data, is_last) of files (doc_id, content): pieces of ``size`` bytes, the last what is left; an empty file is one empty piece."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("content") / size)).cast("int")
    rows = files.select("doc_id", "content", n.alias("_n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select("doc_id", "seq", F.substring(F.col("content"), F.col("seq") * size + 1, F.lit(size)).alias("data"), (F.col("seq") == F.col("_n") - 1).alias("is_last"))


def linked(references: DataFrame, part: list[str], offset: str) -> DataFrame:
    """References with ``link``: those of one offset share one, numbered by offset, so that a change reaches all of them."""
    return references.withColumn("link", F.dense_rank().over(W.partitionBy(*part).orderBy(offset)))


def line_positions(lines: DataFrame, part: list[str], order: str, size: float, top: float, leading: float = 1.2) -> DataFrame:
    """Lines with ``line`` (from 0) and ``y``, their base line: the first a size below the top, each other a step below the one before."""
    placed = lines.withColumn("line", F.row_number().over(W.partitionBy(*part).orderBy(order)) - 1)
    return placed.withColumn("y", F.lit(top - size) - F.col("line") * (size * leading))
