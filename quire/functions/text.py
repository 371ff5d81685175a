"""Bytes, strings, names, XML and markup as Column expressions; Arrow UDFs only for what expressions can't say."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, StringType, StructField, StructType

#: Characters that the document encoding puts at 0x80 to 0x9E; elsewhere it agrees with Latin-1.
DOC_ENCODING = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
DOC_CODES = "".join(chr(0x80 + i) for i in range(len(DOC_ENCODING)))


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def utf8_text(data: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def hex_upper(data: Column) -> Column:
    return F.hex(data)


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(digits: Column) -> Column:
    """Bytes of hex digits; an odd number of them is an error, a character that is no digit counts as 0."""
    clean = F.regexp_replace(digits, "[^0-9A-Fa-f]", "0")
    return F.when(F.length(digits) % 2 == 0, F.unhex(clean)).otherwise(F.raise_error(F.lit("odd number of hex digits")))


def pad_bytes(data: Column, size: int) -> Column:
    """Zeros on the right up to ``size`` bytes; longer data is an error."""
    zeros = F.unhex(F.lit("00" * size))
    short = F.concat(data, F.substring(zeros, 1, size) if size else F.lit(b""))
    return F.when(F.octet_length(data) <= size, F.substring(short, 1, size)).otherwise(F.raise_error(F.lit("too long to pad")))


def replace_bytes(data: Column, old: bytes, new: bytes, every: bool = False) -> Column:
    """The first (or every) ``old`` in bytes replaced; null if there is none. Works on hex digits, aligned to whole bytes."""
    pattern = "^((?:..)*?)" + old.hex().upper()
    spaced = F.regexp_replace(F.hex(data), "(..)", "$1 ")
    wanted, put = "".join(f"{b:02X} " for b in old), "".join(f"{b:02X} " for b in new)
    many = F.unhex(F.replace(F.replace(spaced, F.lit(wanted), F.lit(put)), F.lit(" "), F.lit("")))
    one = F.unhex(F.regexp_replace(F.hex(data), pattern, "$1" + new.hex().upper()))
    return F.when(F.contains(spaced, F.lit(wanted)), many if every else one)


def escape_string(text: Column) -> Column:
    """A literal string's escapes: backslash, newline, return, tab, backspace, form feed and both parentheses."""
    steps = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), ("(", "\\("), (")", "\\)")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


SIMPLE = {ord(a): b for a, b in zip("nrtbf()\\", (10, 13, 9, 8, 12, 40, 41, 92))}


ESCAPED = re.compile(rb"\\(?:([0-7]{1,3})|([\r\n])|(.))", re.S)


def _one(m: re.Match) -> bytes:
    if m[1]:
        return bytes([int(m[1], 8) & 255])
    if m[2]:
        return b""
    return bytes([SIMPLE.get(m[3][0], m[3][0])])


def unescape_bytes(data: bytes) -> bytes:
    """The bytes a literal string stands for: simple and octal escapes, and line continuations (of CR LF only the CR is taken)."""
    return ESCAPED.sub(_one, data) if b"\\" in data else data


@F.pandas_udf(BinaryType())
def unescape_string(data: pd.Series) -> pd.Series:
    return data.map(lambda b: None if b is None else unescape_bytes(bytes(b)))


#: A character that the document encoding lacks. The short class is asked first, of every character, and the long one only of the few that it leaves.
LACKING = "[^\\x00-\\x7F\\u00A0-\\u00FF](?<![" + DOC_ENCODING + "])"


def only_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def needs_unicode(text: Column) -> Column:
    """Whether a text has a character that the document encoding lacks."""
    return ~only_ascii(text) & text.rlike(LACKING)


def doc_encode(text: Column) -> Column:
    """Document encoding; characters it lacks become ``?``. Only texts that have such characters, or others outside of Latin-1, are gone through character by character."""
    known = F.translate(F.regexp_replace(text, LACKING, "?"), DOC_ENCODING, DOC_CODES)
    plain = only_ascii(text) | ~text.rlike("[^\\x00-\\x7F\\u00A0-\\u00FF]")
    return F.encode(F.when(plain, text).otherwise(known), "ISO-8859-1")


def doc_decode(data: Column) -> Column:
    return F.translate(F.decode(data, "ISO-8859-1"), DOC_CODES + "\x9f", DOC_ENCODING + "�")


def utf16be(text: Column) -> Column:
    return F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))


def utf16be_text(data: Column) -> Column:
    """Text of UTF-16BE bytes; the first two bytes are a byte-order mark, and an odd tail is filled with a zero."""
    even = F.when(F.octet_length(data) % 2 == 1, F.concat(data, F.unhex(F.lit("00")))).otherwise(data)
    return F.decode(F.substring(even, 3, 2**31 - 1), "UTF-16BE")


def string_value(data: Column) -> Column:
    """A literal string's text: UTF-16BE behind a byte-order mark, otherwise document encoding."""
    return F.when(F.hex(F.substring(data, 1, 2)) == "FEFF", utf16be_text(data)).otherwise(doc_decode(data))


def string_bytes(text: Column) -> Column:
    return F.when(needs_unicode(text), utf16be(text)).otherwise(doc_encode(text))


def name_escape(name: Column, utf8_bytes: bool = False) -> Column:
    """``#XX`` for all but letters, digits and ``+ , - . _``; by code point as written (not reversible above U+00FF), or by UTF-8 byte."""
    if utf8_bytes:
        pairs = F.regexp_extract_all(F.hex(utf8(name)), F.lit("(..)"), F.lit(1))
        plain = F.transform(pairs, lambda h: F.decode(F.unhex(h), "ISO-8859-1"))
        return F.array_join(F.zip_with(pairs, plain, lambda h, c: F.when(c.rlike("^[+,A-Za-z0-9\\-_.]$"), c).otherwise(F.concat(F.lit("#"), h))), "")
    chars = F.regexp_extract_all(name, F.lit("(?s)(.)"), F.lit(1))
    escaped = lambda c: F.concat(F.lit("#"), F.regexp_replace(F.hex(F.encode(c, "UTF-16BE")), "^00", ""))
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike("^[+,A-Za-z0-9\\-_.]$"), c).otherwise(escaped(c))), "")


def name_unescape(name: Column) -> Column:
    pieces = F.regexp_extract_all(name, F.lit("(?s)(#[0-9A-Fa-f]{2}|.)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike("^#[0-9A-Fa-f]{2}$"), F.decode(F.unhex(F.substring(p, 2, 2)), "ISO-8859-1")).otherwise(p)), "")


#: A mark opens and closes; the longer ones are tried first.
MARKS = re.compile("|".join(f"{re.escape(mark)}(.+?){re.escape(mark)}" for mark in ("***", "**", "__", "~~", "*", "_")), re.S)
SEGMENT = StructType([StructField("text", StringType()), StructField("bold", BooleanType()), StructField("italic", BooleanType()), StructField("strike", BooleanType())])


def segments_of(text: str) -> list[tuple[str, bool, bool, bool]]:
    found, at = [], 0
    for m in MARKS.finditer(text):
        if m.start() > at:
            found.append((text[at : m.start()], False, False, False))
        kind = m.lastindex
        found.append((m[kind], kind in (1, 2, 3), kind in (1, 5, 6), kind == 4))
        at = m.end()
    if at < len(text) or not found:
        found.append((text[at:], False, False, False))
    return found


@F.pandas_udf(ArrayType(SEGMENT))
def markdown_segments(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [dict(zip(("text", "bold", "italic", "strike"), s)) for s in segments_of(t)])


def markdown_plain(text: Column) -> Column:
    """A text without its ``**``, ``__`` and ``~~`` marks."""
    for mark in ("\\*\\*", "__", "~~"):
        text = F.regexp_replace(text, f"{mark}(.+?){mark}", "$1")
    return text


def xml_escape(text: Column) -> Column:
    steps = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return reduce(lambda c, s: F.replace(c, F.lit(s[0]), F.lit(s[1])), steps, text)


def xml_content(xml: Column, tag: str) -> Column:
    """The content of the first element of that name; null if there is none."""
    found = F.regexp_extract(xml, f"(?s)<{re.escape(tag)}(?:\\s[^>]*)?>(.*?)</{re.escape(tag)}>", 1)
    return F.when(xml_has(xml, tag), found)


def xml_has(xml: Column, tag: str) -> Column:
    return xml.rlike(f"<{re.escape(tag)}(?:\\s[^>]*)?/?>")


def xml_set(xml: Column, tag: str, value: Column) -> Column:
    """The first element's content replaced by an escaped value."""
    shape = f"(?s)^(.*?<{re.escape(tag)}(?:\\s[^>]*)?>)(.*?)(</{re.escape(tag)}>.*)$"
    return F.when(xml.rlike(shape), F.concat(F.regexp_extract(xml, shape, 1), xml_escape(value), F.regexp_extract(xml, shape, 3))).otherwise(xml)


def xml_wrap(content: Column, tags: list[str]) -> Column:
    return F.concat(F.lit("".join(f"<{t}>" for t in tags)), content, F.lit("".join(f"</{t}>" for t in reversed(tags))))


def xml_insert(xml: Column, parent: str, child: Column) -> Column:
    """``child`` put before the end of the first ``parent``."""
    shape = f"(?s)^(.*?)(</{re.escape(parent)}>.*)$"
    return F.when(xml.rlike(shape), F.concat(F.regexp_extract(xml, shape, 1), child, F.regexp_extract(xml, shape, 2))).otherwise(xml)


def default_appearance(da: Column) -> Column:
    """(font, size, color) of an appearance string; the color is ``0 g`` if none is given, and ``rg`` goes before ``g``."""
    number = "[0-9]*\\.?[0-9]+"
    font = F.regexp_extract(da, f"/(\\S+)\\s+({number})\\s+Tf", 1)
    size = F.regexp_extract(da, f"/(\\S+)\\s+({number})\\s+Tf", 2)
    rgb = F.regexp_extract(da, f"({number}\\s+{number}\\s+{number}\\s+rg)", 1)
    gray = F.regexp_extract(da, f"({number}\\s+g)(?:\\s|$)", 1)
    return F.struct(F.nullif(font, F.lit("")).alias("font"), F.nullif(size, F.lit("")).cast("double").alias("size"), F.coalesce(F.nullif(rgb, F.lit("")), F.nullif(gray, F.lit("")), F.lit("0 g")).alias("color"))


def default_appearance_text(font: Column, size: Column, color: Column) -> Column:
    return F.concat(F.lit("/"), font, F.lit(" "), size, F.lit(" Tf "), color)


def base64_text(data: Column) -> Column:
    """Base 64 in one line, with padding."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


def from_base64(text: Column) -> Column:
    """The bytes of base 64; white space doesn't matter, and what isn't base 64 is null."""
    return F.try_to_binary(F.regexp_replace(text, r"\s", ""), F.lit("base64"))
