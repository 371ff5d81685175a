"""Glyph names, font encodings and character maps."""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

ACCENTS = {"grave": 0x300, "acute": 0x301, "circumflex": 0x302, "tilde": 0x303, "macron": 0x304, "breve": 0x306, "dotaccent": 0x307, "dieresis": 0x308, "ring": 0x30A, "hungarumlaut": 0x30B, "caron": 0x30C, "commaaccent": 0x327, "cedilla": 0x327, "ogonek": 0x328, "dotbelow": 0x323, "hookabove": 0x309}
#: Names of the ASCII marks, by code point from 32 on, digits and letters apart.
MARKS = {
    32: "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at",
    91: "bracketleft backslash bracketright asciicircum underscore grave",
    123: "braceleft bar braceright asciitilde",
    161: "exclamdown cent sterling currency yen brokenbar section dieresis copyright ordfeminine guillemotleft logicalnot",
    174: "registered macron degree plusminus twosuperior threesuperior acute mu paragraph periodcentered cedilla onesuperior ordmasculine guillemotright onequarter onehalf threequarters questiondown",
}
OTHERS = {
    "nbspace": 0xA0, "sfthyphen": 0xAD, "AE": 0xC6, "ae": 0xE6, "OE": 0x152, "oe": 0x153, "Eth": 0xD0, "eth": 0xF0, "Thorn": 0xDE, "thorn": 0xFE, "germandbls": 0xDF,
    "Oslash": 0xD8, "oslash": 0xF8, "multiply": 0xD7, "divide": 0xF7, "Lslash": 0x141, "lslash": 0x142, "Dcroat": 0x110, "dcroat": 0x111, "dotlessi": 0x131, "florin": 0x192,
    "circumflex": 0x2C6, "caron": 0x2C7, "breve": 0x2D8, "dotaccent": 0x2D9, "ring": 0x2DA, "ogonek": 0x2DB, "tilde": 0x2DC, "hungarumlaut": 0x2DD, "endash": 0x2013, "emdash": 0x2014,
    "quoteleft": 0x2018, "quoteright": 0x2019, "quotesinglbase": 0x201A, "quotedblleft": 0x201C, "quotedblright": 0x201D, "quotedblbase": 0x201E, "dagger": 0x2020, "daggerdbl": 0x2021,
    "bullet": 0x2022, "ellipsis": 0x2026, "perthousand": 0x2030, "guilsinglleft": 0x2039, "guilsinglright": 0x203A, "fraction": 0x2044, "Euro": 0x20AC, "trademark": 0x2122, "minus": 0x2212,
    "fi": 0xFB01, "fl": 0xFB02, "ff": 0xFB00, "ffi": 0xFB03, "ffl": 0xFB04, "partialdiff": 0x2202, "Delta": 0x2206, "product": 0x220F, "summation": 0x2211, "radical": 0x221A, "infinity": 0x221E,
    "integral": 0x222B, "approxequal": 0x2248, "notequal": 0x2260, "lessequal": 0x2264, "greaterequal": 0x2265, "lozenge": 0x25CA, "Omega": 0x2126, "arrowleft": 0x2190, "arrowup": 0x2191,
    "arrowright": 0x2192, "arrowdown": 0x2193, "checkmark": 0x2713,
}


@cache
def names() -> dict[str, str]:
    """Text by glyph name: the ASCII and Latin ones, letters with every accent that makes one character, and Greek and Cyrillic letters by their names."""
    found = {n: chr(first + i) for first, line in MARKS.items() for i, n in enumerate(line.split())}
    found |= {n: chr(c) for n, c in OTHERS.items()}
    letters = [chr(c) for r in ((65, 91), (97, 123)) for c in range(*r)]
    found |= {c: c for c in letters}
    for c in letters + ["AE", "ae"]:
        for accent, mark in ACCENTS.items():
            made = unicodedata.normalize("NFC", found[c] + chr(mark))
            if len(made) == 1:
                found.setdefault(c + accent, made)
    for script, codes in (("GREEK", range(0x370, 0x400)),):
        for c in map(chr, codes):
            m = re.fullmatch(rf"{script} (CAPITAL|SMALL) LETTER (\w+)", unicodedata.name(c, ""))
            if m:
                own = m[2].capitalize() if m[1] == "CAPITAL" else m[2].lower()
                found.setdefault(own.replace("Lamda", "Lambda").replace("lamda", "lambda"), c)
    return found


def glyph_text(name: str | None) -> str | None:
    """The text of a glyph name: what stands after a dot is dropped, parts between low lines are read one by one, ``uniXXXX`` and ``uXXXXX`` are code points. Null if a part is unknown."""
    if not name or name == ".notdef":
        return None
    parts = []
    for part in name.partition(".")[0].split("_"):
        m = re.fullmatch(r"uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6})", part)
        if part in names():
            parts.append(names()[part])
        elif m and m[1]:
            parts.append("".join(chr(int(m[1][i : i + 4], 16)) for i in range(0, len(m[1]), 4)))
        elif m and int(m[2], 16) < 0x110000:
            parts.append(chr(int(m[2], 16)))
        else:
            return None
    return "".join(parts) or None


@F.pandas_udf(StringType())
def glyph_to_text(name: pd.Series) -> pd.Series:
    return name.map(glyph_text)


def base_encoding(name: str) -> dict[int, str]:
    """Text by code of WinAnsiEncoding, MacRomanEncoding or StandardEncoding."""
    if name in ("WinAnsiEncoding", "MacRomanEncoding"):
        codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
        found = {c: bytes([c]).decode(codec, "ignore") for c in range(32, 256)}
        if name == "WinAnsiEncoding":
            found |= {c: "•" for c in range(127, 161) if not found[c].strip() and c not in (160,)} | {160: " ", 173: "-"}
        return {c: t for c, t in found.items() if t}
    if name != "StandardEncoding":
        raise ValueError(f"unknown encoding {name}")
    found = {c: chr(c) for c in range(32, 127)} | {39: "’", 96: "‘"}
    upper = "exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl . endash dagger daggerdbl periodcentered . paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand . questiondown . grave acute circumflex tilde macron breve dotaccent dieresis . ring cedilla . hungarumlaut ogonek caron emdash".split()
    found |= {161 + i: names()[n] for i, n in enumerate(upper) if n != "."}
    return found | {225: "Æ", 227: "ª", 232: "Ł", 233: "Ø", 234: "Œ", 235: "º", 241: "æ", 245: "ı", 248: "ł", 249: "ø", 250: "œ", 251: "ß"}


def encoding(base: str | None, changes: dict[int, str]) -> dict[int, str]:
    """Text by code: a base encoding with glyph names in place of some codes; names without a text leave the base's."""
    return base_encoding(base or "StandardEncoding") | {c: t for c, n in changes.items() if (t := glyph_text(n)) is not None}


def decoded(data: Column, table: dict[int, str], other: str = "�") -> Column:
    """The text of one-byte codes, without a UDF: bytes as Latin characters, translated by arrays of the table."""
    cells = F.array(*[F.lit(table.get(c, other)) for c in range(256)])
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(data)), lambda i: F.ascii(F.decode(F.substring(data, i, F.lit(1)), "ISO-8859-1")))
    return F.when(F.octet_length(data) == 0, F.lit("")).otherwise(F.array_join(F.transform(codes, lambda c: F.element_at(cells, c.cast("int") + 1)), ""))


def operand(text: Column, table: dict[str, int] | None = None) -> Column:
    """What a content stream shows: a literal of one-byte codes where all characters have one, else hex digits of two-byte codes."""
    codes = table or {t: c for c, t in base_encoding("WinAnsiEncoding").items() if len(t) == 1}

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            if t is None:
                return None
            if all(c in codes for c in t):
                body = "".join(chr(codes[c]) for c in t)
                return "(" + re.sub(r"([\\()])", r"\\\1", body) + ")"
            return "<" + t.encode("utf-16-be").hex().upper() + ">"

        return texts.map(one)

    return run(text)


def to_unicode_map(codes: dict[int, str]) -> str:
    """A character map of two-byte codes to text, in code order, no more than a hundred lines at a time."""
    lines = [f"<{c:04X}> <{t.encode('utf-16-be').hex().upper()}>" for c, t in sorted(codes.items())]
    parts = [f"{len(p)} beginbfchar\n" + "\n".join(p) + "\nendbfchar" for i in range(0, len(lines), 100) if (p := lines[i : i + 100])]
    head = "/CIDInit /ProcSet findresource begin\n12 dict begin\nbegincmap\n/CMapType 2 def\n1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange"
    return "\n".join([head, *parts, "endcmap\nend\nend"])


def read_unicode_map(data: str) -> dict[int, str]:
    """The codes of a character map: single lines, ranges from a first text on, and ranges with a text for each."""
    found: dict[int, str] = {}
    said = lambda h: bytes.fromhex(h).decode("utf-16-be", "replace")
    for body in re.findall(r"beginbfchar(.*?)endbfchar", data, re.S):
        found |= {int(a, 16): said(b) for a, b in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", body)}
    for body in re.findall(r"beginbfrange(.*?)endbfrange", data, re.S):
        for low, high, first, each in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]*)>|\[([^\]]*)\])", body):
            codes = range(int(low, 16), min(int(high, 16), 0xFFFF) + 1)
            if each:
                found |= dict(zip(codes, map(said, re.findall(r"<([0-9A-Fa-f]*)>", each))))
            else:
                found |= {c: said(first[:-4] + f"{(int(first[-4:], 16) + i) & 0xFFFF:04X}") for i, c in enumerate(codes)}
    return found


def width_array(widths: dict[int, int]) -> list:
    """The widths of codes in short form: runs of one width as (first, last, width), runs of different ones as (first, [widths])."""
    out: list = []
    codes = sorted(widths)
    i = 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1 and widths[codes[j + 1]] == widths[codes[i]]:
            j += 1
        if j > i:
            out += [codes[i], codes[j], widths[codes[i]]]
        elif len(out) >= 2 and isinstance(out[-1], list) and out[-2] + len(out[-1]) == codes[i]:
            out[-1].append(widths[codes[i]])
        else:
            out += [codes[i], [widths[codes[i]]]]
        i = j + 1
    return out


def read_width_array(items: list) -> dict[int, int]:
    found: dict[int, int] = {}
    i = 0
    while i < len(items):
        if i + 1 < len(items) and isinstance(items[i + 1], list):
            found |= {items[i] + k: w for k, w in enumerate(items[i + 1])}
            i += 2
        else:
            found |= {c: items[i + 2] for c in range(items[i], items[i + 1] + 1)}
            i += 3
    return found


def cid_to_gid(glyphs: dict[int, int]) -> bytes:
    """Two bytes for each code up to the largest."""
    return b"".join(glyphs.get(c, 0).to_bytes(2, "big") for c in range(max(glyphs, default=-1) + 1))


#: Fonts that every reader has, by family, with the short names that forms use for them.
FAMILIES = {"Helvetica": ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique"), "Times": ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic"), "Courier": ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique"), "Symbol": ("Symbol",) * 4, "ZapfDingbats": ("ZapfDingbats",) * 4}
ALIASES = {"Helv": "Helvetica", "HeBo": "Helvetica-Bold", "HeOb": "Helvetica-Oblique", "HeBO": "Helvetica-BoldOblique", "TiRo": "Times-Roman", "TiBo": "Times-Bold", "TiIt": "Times-Italic", "TiBI": "Times-BoldItalic", "Cour": "Courier", "CoBo": "Courier-Bold", "CoOb": "Courier-Oblique", "CoBO": "Courier-BoldOblique", "Symb": "Symbol", "ZaDb": "ZapfDingbats", "Arial": "Helvetica", "TimesNewRoman": "Times-Roman", "CourierNew": "Courier"}
#: Widths of the ASCII characters from the space on, in thousandths of an em.
ASCII_WIDTHS = {
    "Helvetica": "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584",
    "Times-Roman": "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541",
}


def standard_font(name: str) -> str | None:
    """The standard font that a name means, a subset's prefix aside; null if it means none."""
    plain = re.sub(r"^[A-Z]{6}\+", "", name.removeprefix("/"))
    known = {f for fonts in FAMILIES.values() for f in fonts}
    return plain if plain in known else ALIASES.get(plain)


def family_member(family: str, bold: bool = False, italic: bool = False) -> str:
    return FAMILIES[family][bold + 2 * italic]


def standard_widths(name: str) -> dict[str, float]:
    """Widths of the ASCII characters of a standard font; the slanted fonts have those of the upright, bold ones are not listed and use the plain."""
    font = standard_font(name)
    if font is None or font in ("Symbol", "ZapfDingbats"):
        raise ValueError(f"no widths for {name}")
    if font.startswith("Courier"):
        return {chr(c): 600.0 for c in range(32, 127)}
    own = ASCII_WIDTHS["Times-Roman" if font.startswith("Times") else "Helvetica"]
    return {chr(32 + i): float(w) for i, w in enumerate(own.split())}


def average_width(widths: Column) -> Column:
    """Aggregate: the mean of the widths that aren't zero, rounded; 0 without any."""
    return F.coalesce(F.round(F.avg(F.when(widths > 0, widths))), F.lit(0)).cast("int")
