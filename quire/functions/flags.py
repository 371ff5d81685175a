"""Bit flags of fields, annotations and permissions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIELD = {"readOnly": 1, "required": 2, "noExport": 4, "multiline": 4096, "password": 8192, "noToggleToOff": 16384, "radio": 32768, "pushButton": 65536, "combo": 131072, "edit": 262144, "sort": 524288, "multiSelect": 2097152, "doNotSpellCheck": 4194304, "doNotScroll": 8388608, "comb": 16777216, "commitOnSelChange": 67108864}
ANNOTATION = {"invisible": 1, "hidden": 2, "print": 4, "noZoom": 8, "noRotate": 16, "noView": 32, "locked": 128}
PERMISSION = {"print": 4, "modify": 8, "copy": 16, "annotate": 32, "fill": 256, "extract": 512, "assemble": 1024, "printHighQuality": 2048}


def has(flags: Column, bit: int) -> Column:
    return flags.cast("long").bitwiseAND(F.lit(bit).cast("long")) != 0


def with_flag(flags: Column, bit: int, on: bool = True) -> Column:
    flags = flags.cast("long")
    return flags.bitwiseOR(F.lit(bit).cast("long")) if on else flags.bitwiseAND(F.lit(~bit).cast("long"))


def decode(flags: Column, names: dict[str, int]) -> Column:
    return F.struct(*[has(flags, bit).alias(name) for name, bit in names.items()])


def permissions(denied: list[str]) -> int:
    """The permission word that denies those rights and grants the others."""
    word = 0xFFFFFFFC
    for name in denied:
        word &= ~PERMISSION[name]
    return word | 0xFFFFF000
