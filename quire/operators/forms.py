"""Form data: export, import, validation and calculation, with scripts read as declarations and never run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.functions import formats

CALL = re.compile(r"^\s*(AF\w+)\s*\((.*)\)\s*;?\s*$", re.S)
ARGUMENT = re.compile(r"""\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(true|false)|(-?\d+(?:\.\d+)?)|new\s+Array\(([^)]*)\)|\[([^\]]*)\])\s*(?:,|$)""")


def call(script: str) -> tuple[str, list] | None:
    """(function, arguments) if a script is one call of a known form with plain arguments; otherwise None."""
    m = CALL.match(script or "")
    if not m or m[1] not in KNOWN:
        return None
    found, at, body = [], 0, m[2].strip()
    while at < len(body):
        a = ARGUMENT.match(body, at)
        if not a:
            return None
        if a[5] is not None or a[6] is not None:
            found.append(re.findall(r"""["']([^"']*)["']""", a[5] or a[6]))
        else:
            found.append(a[1] if a[1] is not None else a[2] if a[2] is not None else a[3] == "true" if a[3] else float(a[4]) if "." in a[4] else int(a[4]))
        at = a.end()
    return m[1], found


def formatted(script: str, value: Column) -> Column:
    """A value in the form that a format script declares; ``unsupported script`` is an error at plan time."""
    found = call(script)
    if found is None:
        raise ValueError("unsupported script")
    name, args = found
    if name == "AFNumber_Format":
        places, separators, negative, _, currency, prepend = (args + [0, 0, 0, 0, "", True][len(args) :])[:6]
        return formats.number_format(formats.parse_numeric(value), places, separators, negative, currency, prepend)
    if name == "AFSpecial_Format":
        return formats.special_format(value, args[0])
    if name == "AFDate_FormatEx":
        return formats.printd(args[0], F.try_to_timestamp(value))
    raise ValueError("unsupported script")


def valid(script: str, value: Column) -> Column:
    """Whether a keystroke script would take a value."""
    found = call(script)
    if found is None:
        raise ValueError("unsupported script")
    name, args = found
    if name == "AFNumber_Keystroke":
        return formats.number_valid(value, args[1] if len(args) > 1 else 0)
    if name == "AFSpecial_Keystroke":
        return formats.special_valid(value, args[0])
    if name == "AFDate_KeystrokeEx":
        return formats.scand(args[0], value).isNotNull()
    raise ValueError("unsupported script")


KNOWN = {"AFNumber_Format", "AFNumber_Keystroke", "AFSpecial_Format", "AFSpecial_Keystroke", "AFDate_FormatEx", "AFDate_KeystrokeEx", "AFSimple_Calculate"}


def calculated(fields: DataFrame, orders: DataFrame) -> DataFrame:
    """``fields`` (doc_id, name, value) with the calculations of ``orders`` (doc_id, position, target, operation, sources array) done in order.

    Later calculations see earlier results, so positions go one after another; each is one join and aggregation over all documents.
    """
    levels = [r[0] for r in orders.select("position").distinct().orderBy("position").collect()]
    for level in levels:
        now = orders.filter(F.col("position") == level).select("doc_id", "target", F.upper("operation").alias("operation"), F.posexplode("sources").alias("i", "name"))
        number = formats.parse_numeric(F.coalesce("value", F.lit("")))
        found = now.join(fields, ["doc_id", "name"], "left").groupBy("doc_id", "target", "operation").agg(F.sum(number).alias("SUM"), F.avg(number).alias("AVG"), F.product(number).alias("PRD"), F.min(number).alias("MIN"), F.max(number).alias("MAX"))
        pick = F.coalesce(*[F.when(F.col("operation") == o, F.col(o)) for o in ("SUM", "AVG", "PRD", "MIN", "MAX")])
        plain = F.when(pick == F.floor(pick), pick.cast("long").cast("string")).otherwise(pick.cast("string"))
        done = found.select("doc_id", F.col("target").alias("name"), plain.alias("_value"))
        fields = fields.join(done, ["doc_id", "name"], "left").withColumn("value", F.coalesce("_value", "value")).drop("_value")
    return fields


def exported(fields: DataFrame) -> DataFrame:
    """(doc_id, data): name to value, the last field of a name counting."""
    last = fields.withColumn("_n", F.row_number().over(W.partitionBy("doc_id", "name").orderBy(F.desc("ordinal")))).filter("_n = 1")
    return last.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("data"))


def imported(fields: DataFrame, data: DataFrame) -> DataFrame:
    """``fields`` with the values of ``data`` (doc_id, name, value) where it has their name."""
    new = data.select("doc_id", "name", F.col("value").alias("_value"))
    return fields.join(new, ["doc_id", "name"], "left").withColumn("value", F.coalesce("_value", "value")).drop("_value")


def export_states(states: Column) -> Column:
    """A button's on states."""
    return F.filter(states, lambda s: s != "Off")


#: What a field is by its type; anything else is handled as text.
KINDS = {"Tx": "text", "Btn": "button", "Ch": "choice", "Sig": "signature"}


def field_kind(field_type: Column, flags_: Column) -> Column:
    """text, checkbox, radio, push, combo, list or signature; an unknown type is text."""
    has = lambda bit: flags_.bitwiseAND(F.lit(bit)) != 0
    return (
        F.when(field_type == "Btn", F.when(has(1 << 16), "push").when(has(1 << 15), "radio").otherwise("checkbox"))
        .when(field_type == "Ch", F.when(has(1 << 17), "combo").otherwise("list"))
        .when(field_type == "Sig", "signature")
        .otherwise("text")
    )


def propagated(fields: DataFrame, changes: DataFrame) -> DataFrame:
    """``fields`` (doc_id, obj_no, parent, name, value) in which a changed value reaches every field of the same name in its document: the field, its siblings and its children.

    The last change of a name (``changes``: doc_id, name, value, ordinal) counts. ``dirty`` marks the fields whose appearance must be made anew.
    """
    last = changes.groupBy("doc_id", "name").agg(F.max_by(F.struct("value"), "ordinal").alias("_new"))
    joined = fields.join(last, ["doc_id", "name"], "left")
    dirty = F.col("_new").isNotNull() & ~F.col("_new.value").eqNullSafe(F.col("value"))
    return joined.withColumn("dirty", F.coalesce(dirty, F.lit(False))).withColumn("value", F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("value"))).drop("_new").select(*fields.columns, "dirty")


def pair_options(options: Column) -> Column:
    """(export, shown) of options written as pairs joined by a tab, or as one text that is both."""
    return F.transform(options, lambda o: F.struct(F.split(o, "\t")[0].alias("export"), F.when(F.contains(o, F.lit("\t")), F.split(o, "\t")[1]).otherwise(o).alias("shown")))
