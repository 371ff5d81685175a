import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quire.operators import signatures
from quire.functions import glyphs
from quire.sources import documents, fonts, syntax


def font():
    """A font of four glyphs: A, B and U+1F600 are the last three."""
    head = bytearray(54)
    struct.pack_into(">H", head, 18, 2000)
    struct.pack_into(">4h", head, 36, 0, -400, 2000, 1600)
    hhea = bytearray(36)
    struct.pack_into(">hh", hhea, 4, 1500, -500)
    struct.pack_into(">H", hhea, 34, 3)
    hmtx = struct.pack(">6Hh", 1000, 0, 1201, 0, 1301, 0, 0)
    four = struct.pack(">HHHHHHH", 4, 32, 0, 4, 0, 0, 0) + struct.pack(">2H", 66, 0xFFFF) + b"\0\0" + struct.pack(">2H", 65, 0xFFFF) + struct.pack(">2H", (1 - 65) % 65536, 1) + struct.pack(">2H", 0, 0)
    twelve = struct.pack(">HHIII", 12, 0, 40, 0, 2) + struct.pack(">III", 65, 66, 1) + struct.pack(">III", 0x1F600, 0x1F600, 3)
    cmap = struct.pack(">HH", 0, 2) + struct.pack(">HHI", 3, 1, 20) + struct.pack(">HHI", 3, 10, 20 + len(four)) + four + twelve
    own = {"head": bytes(head), "hhea": bytes(hhea), "hmtx": hmtx, "cmap": cmap, "OS/2": struct.pack(">HhHH", 4, 0, 700, 5), "glyf": b"\0"}
    return own


def packed(own):
    out, body, at = struct.pack(">4sHHHH", b"\0\1\0\0", len(own), 0, 0, 0), b"", 12 + 16 * len(own)
    for tag, data in own.items():
        out += struct.pack(">4sIII", tag.encode(), 0, at + len(body), len(data))
        body += data
    return out + body


def woff(own):
    out, body, at = b"wOFF" + b"\0\1\0\0" + b"\0" * 4 + struct.pack(">HH", len(own), 0) + b"\0" * 28, b"", 44 + 20 * len(own)
    for tag, data in own.items():
        small = min(zlib.compress(data), data, key=len)
        out += struct.pack(">4sIIII", tag.encode(), at + len(body), len(small), len(data), 0)
        body += small
    return out + body


def test_fonts(spark):
    rows = spark.createDataFrame([(1, bytearray(packed(font()))), (2, bytearray(woff(font()))), (3, bytearray(b"junk")), (4, bytearray(b"wOF2"))], "doc_id long, content binary")
    assert [r.f for r in rows.orderBy("doc_id").select(fonts.font_format(F.col("content")).alias("f")).collect()] == ["ttf", "woff", None, "woff2"]
    found = {r.doc_id: r for r in fonts.fonts(rows).collect()}
    for i in (1, 2):
        assert found[i].widths == {65: 601, 66: 651, 0x1F600: 651}
        assert (found[i].ascent, found[i].descent, found[i].weight, found[i].box) == (750, -250, 700, [0, -200, 1000, 800])
    assert found[3].error and found[4].error


def test_signatures(spark):
    data = syntax.write({1: {"Type": "/Catalog"}, 2: {"Type": "/Sig", "SubFilter": "/adbe.pkcs7.detached"}}, 1)
    data = data.replace(b"/SubFilter", signatures.placeholder(64) + b" /SubFilter")
    at = data.index(b"<" + b"0" * 64)
    place = b" ".join(str(n).encode().rjust(12) for n in (at, at + 66, len(data) - at - 66))
    signed = data.replace(b" ".join([b"0".rjust(12)] * 3), place)
    assert len(signed) == len(data)
    # the index's offsets still hold: the placeholder is inside the last object, and the index is found by its own
    signed = signed.replace(b"startxref\n", b"startxref\n")
    files = spark.createDataFrame([(1, bytearray(signed)), (2, bytearray(signed + b"more"))], "doc_id long, content binary")
    found = {r.doc_id: r for r in signatures.checked(signatures.signatures(documents.nodes(files)), files).collect()}
    assert found[1].well_formed and found[1].covers_whole_file and not found[2].covers_whole_file
    assert found[1].sha256 == hashlib.sha256(signed[:at] + signed[at + 66 :]).hexdigest()
    row = spark.range(1).select(signatures.byte_range(F.lit(at), F.lit(66), F.lit(len(signed))).alias("r")).first()
    assert row.r == list(found[1].byte_range)


def test_fonts_written_and_embedded():
    plain = packed(font())
    again = fonts.compressed_font(plain)
    assert fonts.tables(again) == fonts.tables(plain) and fonts.tables(fonts.plain_font(fonts.tables(again))) == fonts.tables(plain)
    tags = [again[44 + 20 * i : 48 + 20 * i] for i in range(len(font()))]
    assert tags == sorted(tags)
    objects = fonts.embedded(plain, "ABBA", "Own", 10)
    doc = syntax.read(syntax.write({1: {"Type": "/Catalog"}} | objects, 1)).live()
    assert fonts.tables(syntax.stream_data(doc[13].node)) == fonts.tables(plain)
    assert glyphs.read_unicode_map(syntax.stream_data(doc[14].node).decode()) == {65: "A", 66: "B"}
    assert glyphs.read_width_array(objects[11]["W"]) == {65: 601, 66: 651} and len(syntax.stream_data(doc[15].node)) == 2 * 67
    with pytest.raises(ValueError):
        fonts.embedded(plain, "A日", "Own", 10)
