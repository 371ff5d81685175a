"""Font files as rows: format, tables, metrics, character map and widths."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import glyphs

MOST_BYTES = 64 << 20


def font_format(content: Column) -> Column:
    """``ttf``, ``otf``, ``woff``, ``woff2`` or null, by the first four bytes."""
    first = F.hex(F.substring(content, 1, 4))
    return F.when(first.isin("00010000", "74727565"), "ttf").when(first == "4F54544F", "otf").when(first == "774F4646", "woff").when(first == "774F4632", "woff2")


def tables(data: bytes) -> dict[str, bytes]:
    """The tables of a font by tag; of the compressed form they are inflated."""
    if data[:4] == b"wOFF":
        count = struct.unpack(">H", data[12:14])[0]
        found = {}
        for i in range(count):
            tag, at, packed, plain, _ = struct.unpack(">4sIIII", data[44 + 20 * i : 64 + 20 * i])
            if plain > MOST_BYTES:
                raise ValueError("table is too large")
            body = data[at : at + packed]
            found[tag.decode("latin-1")] = zlib.decompress(body) if packed < plain else body
        return found
    if data[:4] == b"wOF2":
        raise ValueError("this compressed form isn't read")
    if data[:4] not in (b"\0\1\0\0", b"true", b"OTTO"):
        raise ValueError("not a font")
    count = struct.unpack(">H", data[4:6])[0]
    found = {}
    for i in range(count):
        tag, _, at, size = struct.unpack(">4sIII", data[12 + 16 * i : 28 + 16 * i])
        found[tag.decode("latin-1")] = data[at : at + size]
    return found


def character_map(cmap: bytes) -> dict[int, int]:
    """Code point to glyph from the Unicode subtables of formats 4 and 12, the fuller one counting."""
    best: dict[int, int] = {}
    for i in range(struct.unpack(">H", cmap[2:4])[0]):
        platform, encoding, at = struct.unpack(">HHI", cmap[4 + 8 * i : 12 + 8 * i])
        if platform not in (0, 3) or platform == 3 and encoding not in (1, 10):
            continue
        own: dict[int, int] = {}
        kind = struct.unpack(">H", cmap[at : at + 2])[0]
        if kind == 4:
            n = struct.unpack(">H", cmap[at + 6 : at + 8])[0] // 2
            words = lambda skip: struct.unpack(f">{n}H", cmap[at + skip : at + skip + 2 * n])  # noqa: B023, E731
            ends, begins, deltas, ranges = words(14), words(16 + 2 * n), words(16 + 4 * n), words(16 + 6 * n)
            for s in range(n):
                for code in range(begins[s], ends[s] + 1):
                    glyph = code + deltas[s]
                    if ranges[s]:
                        place = at + 16 + 6 * n + 2 * s + ranges[s] + 2 * (code - begins[s])
                        glyph = struct.unpack(">H", cmap[place : place + 2])[0] if place + 2 <= len(cmap) else 0
                        glyph += deltas[s] if glyph else 0
                    if glyph % 65536 and code != 0xFFFF:
                        own[code] = glyph % 65536
        elif kind == 12:
            for g in range(struct.unpack(">I", cmap[at + 12 : at + 16])[0]):
                first, last, glyph = struct.unpack(">III", cmap[at + 16 + 12 * g : at + 28 + 12 * g])
                own.update((c, glyph + c - first) for c in range(first, min(last, 0x10FFFF) + 1))
        if len(own) > len(best):
            best = own
    return best


def metrics(data: bytes) -> dict[str, object]:
    t = tables(data)
    head, hhea = t["head"], t["hhea"]
    units = struct.unpack(">H", head[18:20])[0]
    scale = lambda v: (v * 1000 * 2 + units) // (2 * units)  # half up
    ascent, descent = struct.unpack(">hh", hhea[4:8])
    n = struct.unpack(">H", hhea[34:36])[0]
    advance = struct.unpack(f">{2 * n}H", t["hmtx"][: 4 * n])[::2]
    widths = {code: scale(advance[min(glyph, n - 1)]) for code, glyph in sorted(character_map(t["cmap"]).items())}
    weight = struct.unpack(">H", t["OS/2"][4:6])[0] if len(t.get("OS/2", b"")) > 6 else 400
    return {"units_per_em": units, "ascent": scale(ascent), "descent": scale(descent), "box": [scale(v) for v in struct.unpack(">4h", head[36:44])], "weight": weight, "has_outlines": "glyf" in t, "is_cff": "CFF " in t, "widths": widths}


def checksum(data: bytes) -> int:
    padded = data + b"\0" * (-len(data) % 4)
    return sum(struct.unpack(f">{len(padded) // 4}I", padded)) & 0xFFFFFFFF


def plain_font(found: dict[str, bytes], version: bytes = b"\0\1\0\0") -> bytes:
    """A font file of tables, in order of their tags, each on a multiple of four bytes."""
    tags = sorted(found)
    power = 1 << max(0, len(tags).bit_length() - 1)
    out = version + struct.pack(">4H", len(tags), power * 16, power.bit_length() - 1, 16 * (len(tags) - power))
    at, body = 12 + 16 * len(tags), b""
    for tag in tags:
        data = found[tag]
        out += struct.pack(">4sIII", tag.encode("latin-1"), checksum(data), at + len(body), len(data))
        body += data + b"\0" * (-len(data) % 4)
    return out + body


def compressed_font(data: bytes) -> bytes:
    """The compressed form of a font file: tables by tag, each deflated where that makes it smaller."""
    found = tables(data)
    entries, at, body, plain = b"", 44 + 20 * len(found), b"", 12 + 16 * len(found)
    for tag in sorted(found):
        small = zlib.compress(found[tag], 9)
        small = small if len(small) < len(found[tag]) else found[tag]
        entries += struct.pack(">4sIIII", tag.encode("latin-1"), at + len(body), len(small), len(found[tag]), checksum(found[tag]))
        body += small + b"\0" * (-len(small) % 4)
        plain += len(found[tag]) + (-len(found[tag]) % 4)
    head = struct.pack(">4s4sIHHIHHIIIII", b"wOFF", data[:4] if data[:4] != b"wOFF" else data[4:8], at + len(body), len(found), 0, plain, 1, 0, 0, 0, 0, 0, 0)
    return head + entries + body


def font_names(data: bytes) -> dict[int, str]:
    """The texts of a font's name table by number (1 family, 2 style, 4 full name, 6 PostScript name); of several, the first that reads as Unicode."""
    own = tables(data).get("name", b"")
    if len(own) < 6:
        return {}
    count, start = struct.unpack(">HH", own[2:6])
    found: dict[int, str] = {}
    for i in range(count):
        platform, _, _, number, size, at = struct.unpack(">6H", own[6 + 12 * i : 18 + 12 * i])
        said = own[start + at : start + at + size].decode("utf-16-be" if platform in (0, 3) else "mac_roman", "replace")
        if number not in found or platform in (0, 3):
            found.setdefault(number, said) if platform not in (0, 3) else found.update({number: said})
    return found


def embedded(data: bytes, text: str, name: str, number: int) -> dict[int, object]:
    """The six objects, from ``number`` on, of a font for two-byte codes that shows ``text``: codes are the characters' code points in the basic plane.

    A font with outlines of the other kind, or without a character of the text, is a ValueError.
    """
    m, units = metrics(data), tables(data)
    if m["is_cff"]:
        raise ValueError("outlines of this kind aren't embedded")
    glyph_of = character_map(units["cmap"])
    codes = sorted({ord(c) for c in text})
    lost = [chr(c) for c in codes if c not in glyph_of or c > 0xFFFF]
    if lost:
        raise ValueError(f"the font lacks {lost[:5]}")
    descriptor = {"Type": "/FontDescriptor", "FontName": "/" + name, "Flags": 32, "FontBBox": m["box"], "ItalicAngle": 0, "Ascent": m["ascent"], "Descent": m["descent"], "CapHeight": m["ascent"], "StemV": 50 + m["weight"] // 8, "FontFile2": (number + 3, 0)}
    file = plain_font(units)
    child = {"Type": "/Font", "Subtype": "/CIDFontType2", "BaseFont": "/" + name, "CIDSystemInfo": {"Registry": b"Adobe", "Ordering": b"Identity", "Supplement": 0}, "FontDescriptor": (number + 2, 0), "DW": round(sum(m["widths"].values()) / max(1, len(m["widths"]))), "W": glyphs.width_array({c: m["widths"][c] for c in codes}), "CIDToGIDMap": (number + 5, 0)}
    return {
        number: {"Type": "/Font", "Subtype": "/Type0", "BaseFont": "/" + name, "Encoding": "/Identity-H", "DescendantFonts": [(number + 1, 0)], "ToUnicode": (number + 4, 0)},
        number + 1: child,
        number + 2: descriptor,
        number + 3: ({"Length1": len(file), "Filter": "/FlateDecode"}, zlib.compress(file)),
        number + 4: ({"Filter": "/FlateDecode"}, zlib.compress(glyphs.to_unicode_map({c: chr(c) for c in codes}).encode())),
        number + 5: ({"Filter": "/FlateDecode"}, zlib.compress(glyphs.cid_to_gid({c: glyph_of[c] for c in codes}))),
    }


def fonts(files: DataFrame) -> DataFrame:
    """(doc_id, units_per_em, ascent, descent, box, weight, is_cff, widths by code point, error) of font files (doc_id, content)."""
    kind = dict(files.dtypes)["doc_id"]
    schema = pa.schema([("units_per_em", pa.int32()), ("ascent", pa.int32()), ("descent", pa.int32()), ("box", pa.list_(pa.int32())), ("weight", pa.int32()), ("is_cff", pa.bool_()), ("widths", pa.map_(pa.int32(), pa.int32())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for content in batch.column("content").to_pylist():
                try:
                    m = metrics(content or b"")
                    rows.append({**{k: m.get(k) for k in schema.names}, "widths": list(m["widths"].items())})
                except (ValueError, KeyError, struct.error, zlib.error, ZeroDivisionError) as error:
                    rows.append({"error": f"{type(error).__name__}: {error}"})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r.get(f.name) for r in rows], f.type) for f in schema]], ["doc_id", *schema.names])

    return files.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, units_per_em int, ascent int, descent int, box array<int>, weight int, is_cff boolean, widths map<int,int>, error string")
