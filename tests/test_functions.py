import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import codecs, crypto, flags, formats, text


def one(spark, column, **values):
    names = list(values)
    row = spark.createDataFrame([tuple(values[n] for n in names)], names) if names else spark.range(1)
    return row.select(column.alias("x")).first().x


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=600), st.sampled_from(sorted(codecs.FILTERS)))
def test_filters_round_trip(data, name):
    assert codecs.decode_stream(codecs.encode_stream(data, [name, "ASCIIHexDecode"]), [name, "ASCIIHexDecode"]) == data


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=120), st.sampled_from([1, 2, 10, 11, 12, 13, 14, 15]), st.sampled_from([(4, 1), (5, 3)]))
def test_predictors_round_trip(data, predictor, shape):
    data = data[: len(data) // (shape[0] * shape[1]) * shape[0] * shape[1]]
    assert codecs.unpredict(codecs.predict(data, predictor, *shape), predictor, *shape) == data


def test_filter_details():
    assert codecs.hex_decode(b"48 65 6C6c6F2>") == b"Hello "
    assert codecs.ascii85_decode(b"<~87cURD]j7BEbo80~>") == b"Hello world!"
    assert codecs.flate_decode(codecs.flate_encode(b"x" * 99) + b"\r\n") == b"x" * 99 and codecs.flate_decode(b"") == b""
    assert codecs.run_length_decode(codecs.run_length_encode(b"AAABBBCCCC")) == b"AAABBBCCCC"
    with pytest.raises(ValueError, match="unknown filter"):
        codecs.decode_stream(b"", ["Nope"])


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=80))
def test_string_escapes_round_trip(data):
    from quire.sources.syntax import escaped

    assert text.unescape_bytes(escaped(data)) == data


def test_octal_and_continuation():
    assert text.unescape_bytes(rb"a\101\7\
b\(\)\q") == b"aA\x07b()q"


@pytest.mark.parametrize(("name", "want"), [("test#value", "test#23value"), ("value(1)", "value#281#29"), ("50%", "50#25"), ("café", "caf#E9"), ("test™", "test#2122")])
def test_names(spark, name, want):
    assert one(spark, text.name_escape(F.col("n")), n=name) == want
    if "™" not in name:
        assert one(spark, text.name_unescape(F.col("n")), n=want) == name
    assert one(spark, text.name_escape(F.col("n"), utf8_bytes=True), n="é") == "#C3#A9"


def test_encodings(spark):
    assert one(spark, F.hex(text.doc_encode(F.col("t"))), t="•†—–™ﬁﬂŒ ") == "808184859293" + "94" + "96A0"
    assert one(spark, text.doc_decode(text.doc_encode(F.col("t"))), t="Hi • café") == "Hi • café"
    assert one(spark, text.needs_unicode(F.col("t")), t="€") and not one(spark, text.needs_unicode(F.col("t")), t="é•")
    for t in ("plain", "日本", "€uro"):
        assert one(spark, text.string_value(text.string_bytes(F.col("t"))), t=t) == t
    assert one(spark, text.pad_bytes(F.col("b"), 5), b=bytearray(b"ab")) == b"ab\0\0\0"
    assert one(spark, text.from_hex(F.col("h")), h="4a4B") == b"JK"
    assert one(spark, text.replace_bytes(F.col("b"), b"\x12", b"zz"), b=bytearray(b"\x41\x21\x12\x12")) == b"\x41\x21zz\x12"
    assert one(spark, text.replace_bytes(F.col("b"), b"\x12", b"zz", True), b=bytearray(b"\x41\x21\x12\x12")) == b"\x41\x21zzzz"


def test_markup(spark):
    assert [tuple(s) for s in one(spark, text.markdown_segments(F.col("t")), t="a **b** *c* ~~d~~")] == [("a ", False, False, False), ("b", True, False, False), (" ", False, False, False), ("c", False, True, False), (" ", False, False, False), ("d", False, False, True)]
    xml = "<a><name x='1'>v</name><name>w</name></a>"
    assert one(spark, text.xml_content(F.col("x"), "name"), x=xml) == "v"
    assert one(spark, text.xml_set(F.col("x"), "name", F.lit("<&")), x=xml) == "<a><name x='1'>&lt;&amp;</name><name>w</name></a>"
    assert one(spark, text.xml_insert(F.col("x"), "a", F.lit("<b/>")), x=xml).endswith("</name><b/></a>")
    assert tuple(one(spark, text.default_appearance(F.col("d")), d="/Helv 12 Tf 0.5 g 1 0 0 rg")) == ("Helv", 12.0, "1 0 0 rg")
    assert tuple(one(spark, text.default_appearance(F.col("d")), d="/F 9 Tf")) == ("F", 9.0, "0 g")


@pytest.mark.parametrize(("form", "want"), [("mm/dd/yyyy", "01/15/2025"), ("d-mmm-yy", "15-Jan-25"), ("HH:MM:ss", "14:30:05"), ("hh:MM tt", "02:30 PM")])
def test_printd(spark, form, want):
    assert one(spark, formats.printd(form, F.col("t")), t=dt.datetime(2025, 1, 15, 14, 30, 5)) == want


def test_scand(spark):
    assert one(spark, formats.scand("mm/dd/yyyy", F.col("t")), t="01/15/2025") == dt.datetime(2025, 1, 15)
    assert one(spark, formats.scand("dd-mmm-yyyy", F.col("t")), t="15-Jan-2025") == dt.datetime(2025, 1, 15)
    assert one(spark, formats.scand("mm/dd/yyyy", F.col("t")), t="not-a-date") is None
    assert one(spark, formats.scand("mm/dd/yyyy", F.col("t")), t="02/31/2025") == dt.datetime(2025, 3, 3)
    assert one(spark, formats.scand("m/d/yy hh:MM tt", F.col("t")), t="1/5/49 02:30 PM") == dt.datetime(2049, 1, 5, 14, 30)


def test_numbers(spark):
    assert one(spark, formats.printf("%.2f", F.lit(3.1))) == "3.10"
    assert one(spark, formats.printf("%05d", F.lit(42))) == "00042"
    assert one(spark, formats.printf("%d%%", F.lit(100))) == "100%"
    assert one(spark, formats.printf("Hello %s!", F.lit("world"))) == "Hello world!"
    assert one(spark, formats.number_format(F.lit(1234.5), 2, 0, 0, "$", True)) == "$1,234.50"
    assert one(spark, formats.number_format(F.lit(-500.0), 2, 0, 2)) == "(500.00)"
    assert one(spark, formats.number_format(F.lit(1234567.0), 0, 1)) == "1234567"
    assert one(spark, formats.number_format(F.lit(1234.5), 2, 2)) == "1.234,50"
    assert one(spark, formats.parse_numeric(F.lit("$1,234.5 x"))) == 1234.5 and one(spark, formats.parse_numeric(F.lit("Fee 5"))) == 0.0
    assert one(spark, formats.special_format(F.lit("1234567890"), 2)) == "(123) 456-7890"
    assert one(spark, formats.special_format(F.lit("123456789"), 1)) == "123-45-6789"
    assert one(spark, formats.special_format(F.lit("12345"), 0)) == "12345"
    assert one(spark, F.hex(formats.little_endian(F.lit(258)))) == "02010000"


def test_document_dates(spark):
    when = dt.datetime(2024, 5, 6, 7, 8, 9)
    assert one(spark, formats.document_date(F.col("t")), t=when) == "D:20240506070809+00'00'"
    assert one(spark, formats.parse_document_date(F.col("t")), t="D:20240506090809+02'00'") == when
    assert one(spark, formats.parse_document_date(F.col("t")), t="D:2024") is None


def test_flags(spark):
    assert one(spark, flags.has(F.lit(4096), flags.FIELD["multiline"])) and not one(spark, flags.has(F.lit(1), 2))
    assert one(spark, flags.decode(F.lit(5), flags.ANNOTATION))["print"]
    assert flags.permissions([]) == 0xFFFFFFFC and not flags.permissions(["print"]) & 4


def test_ciphers(spark):
    assert crypto.rc4_bytes(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    key, iv = bytearray.fromhex("2b7e151628aed2a6abf7158809cf4f3c"), bytearray(range(16))
    block = bytearray.fromhex("6bc1bee22e409f96e93d7e117393172a")
    assert one(spark, F.hex(crypto.aes_cbc_raw(F.lit(block), F.lit(key), F.lit(iv)))) == "7649ABAC8119B246CEE98E9B12E9197D"
    assert one(spark, crypto.aes_cbc_decrypt(F.lit(bytearray(b"short")), F.lit(key))) == b"short"
    for revision, length in ((2, 5), (3, 16)):
        owner = crypto.owner_value(b"own", b"usr", length, revision)
        master = crypto.master_key(b"usr", owner, -4, b"id", length, revision)
        user = crypto.user_value(master, b"id", revision)
        assert crypto.opens(b"own", owner, user, -4, b"id", length, revision) == crypto.opens(b"usr", owner, user, -4, b"id", length, revision) == master
        assert crypto.opens(b"no", owner, user, -4, b"id", length, revision) is None
