import pytest
from pyspark.sql import functions as F

from quire.functions import codecs, crypto
from quire.operators import forms, layout, relational
from quire.sources import docfile, documents, syntax
from quire.streaming import chunks


def form_file():
    return syntax.write(
        {
            1: {"Type": "/Catalog", "Pages": (2, 0), "AcroForm": {"Fields": [(5, 0), (7, 0)], "DA": b"/Helv 10 Tf"}},
            2: {"Type": "/Pages", "Kids": [(3, 0), (4, 0)], "Count": 2},
            3: {"Type": "/Page", "Parent": (2, 0), "MediaBox": [0, 0, 200, 100], "Rotate": 90, "Annots": [(6, 0)]},
            4: {"Type": "/Page", "Parent": (2, 0)},
            5: {"T": b"group", "FT": "/Tx", "Ff": 4096, "V": b"above", "Kids": [(6, 0)]},
            6: {"T": b"first"},
            7: {"T": b"total", "FT": "/Tx", "V": b"\xfe\xff\x00h\x00i"},
        },
        1,
    )


def test_tokens_join_to_the_input():
    data = form_file() + b"% comment\n<48 65> [1 .5 -2 true null (a\\(b(c))] 7 0 R"
    assert b"".join(t.data for t in syntax.tokens(data)) == data
    kinds = {t.kind for t in syntax.tokens(data)}
    assert {"number", "name", "string", "ref", "start_object", "end_object", "xref_start", "trailer", "startxref", "comment", "hexadecimal", "boolean", "null"} <= kinds


def test_write_read_update():
    first = form_file()
    doc = syntax.read(first)
    assert doc.version == "1.7" and len(doc.objects) == 7 and set(doc.live()) == set(range(1, 8))
    second = syntax.write({7: {"T": b"total", "FT": "/Tx", "V": b"new"}, 9: ({"Filter": "/FlateDecode"}, codecs.flate_encode(b"stream data"))}, 1, before=first)
    assert second.startswith(first)
    doc = syntax.read(second)
    assert len(doc.revisions) == 2 and doc.live()[7].node.get("V").value == b"new"
    assert syntax.stream_data(doc.live()[9].node) == b"stream data"
    assert doc.revisions[1].trailer.number("Prev") == doc.revisions[0].startxref


def test_object_and_index_streams():
    inner = b"(one) <</A 1>>"
    body = codecs.flate_encode(b"11 0 12 6 " + inner)
    data = bytearray(b"%PDF-1.5\n")
    at = {}
    for n, head, raw in ((1, {"Type": "/Catalog"}, None), (5, {"Type": "/ObjStm", "N": 2, "First": 10, "Filter": "/FlateDecode"}, body)):
        at[n] = len(data)
        data += b"%d 0 obj\n" % n + (syntax.dump(head) if raw is None else syntax.dump(head | {"Length": len(raw)}) + b"\nstream\n" + raw + b"\nendstream") + b"\nendobj\n"
    rows = b"".join(bytes([k]) + a.to_bytes(2, "big") + bytes([b]) for k, a, b in ((1, at[1], 0), (1, at[5], 0), (2, 5, 0), (2, 5, 1)))
    predicted = codecs.flate_encode(codecs.predict(rows, 12, 4))
    index = {"Type": "/XRef", "W": [1, 2, 1], "Index": [1, 1, 5, 1, 11, 2], "Size": 13, "Root": (1, 0), "Filter": "/FlateDecode", "DecodeParms": {"Predictor": 12, "Columns": 4}, "Length": len(predicted)}
    place = len(data)
    data += b"20 0 obj\n" + syntax.dump(index) + b"\nstream\n" + predicted + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % place
    doc = syntax.read(bytes(data))
    live = doc.live()
    assert live[11].node.value == b"one" and live[12].node.number("A") == 1 and live[12].index == 1


def test_encrypted_with_rc4():
    ident, owner = b"0123456789abcdef", crypto.owner_value(b"own", b"pw", 16, 3)
    key = crypto.master_key(b"pw", owner, -4, ident, 16, 3)
    import hashlib

    secret = crypto.rc4_bytes(hashlib.md5(key + (3).to_bytes(3, "little") + b"\0\0").digest(), b"hidden")
    plain = syntax.write({1: {"Type": "/Catalog"}, 2: {"Filter": "/Standard", "V": 2, "R": 3, "Length": 128, "P": -4, "O": owner, "U": crypto.user_value(key, ident, 3)}, 3: {"A": secret}}, 1)
    data = plain.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 2 0 R /ID [" + syntax.dump(ident) + b"]")
    assert syntax.read(data, b"pw").live()[3].node.get("A").value == b"hidden"
    with pytest.raises(PermissionError):
        syntax.read(data, b"wrong")


def test_tables(spark):
    rows = spark.createDataFrame([(1, bytearray(form_file())), (2, bytearray(b"junk (")), (3, None)], "doc_id long, content binary")
    assert [r.doc_id for r in documents.errors(rows).collect()] == [2]
    pages = documents.pages(rows).orderBy("page_no").collect()
    assert [(p.width, p.height, p.rotate, p.n_annotations) for p in pages] == [(200, 100, 90, 1), (612, 792, 0, 0)]
    fields = {f.name: f for f in documents.fields(rows).collect()}
    assert fields["group.first"].value == "above" and fields["group.first"].flags == 4096 and fields["group.first"].appearance == "/Helv 10 Tf"
    assert fields["total"].value == "hi"
    nodes = documents.nodes(rows)
    assert nodes.filter("key = 'Kids' AND kind = 'array'").count() == 2 and nodes.filter("ref_obj = 6").count() == 2
    live = relational.live_objects(documents.xref_entries(rows), documents.objects(rows))
    assert live.count() == 7
    token = documents.tokens(rows.limit(1))
    assert documents.serialised(token).join(token, ["doc_id", "pos"]).filter("byte_offset <> offset").count() == 0
    assert documents.revisions(rows).filter("doc_id = 1").first().xref_kind == "table"


def test_relations(spark):
    revisions = spark.createDataFrame([(1, 0, 100, None), (1, 1, 200, 100), (1, 2, 300, 999)], "doc_id int, revision_no int, xref_offset long, prev long")
    assert [tuple(r) for r in relational.prev_links(revisions).collect()] == [(1, 1, 0)]
    entries = spark.createDataFrame([(1, 0, 2, 1, 200), (1, 1, 2, 0, None), (1, 0, 3, 1, 300)], "doc_id int, revision_no int, obj_no int, entry_type int, byte_offset long")
    assert {(r.obj_no, r.entry_type) for r in relational.effective_entries(entries).collect()} == {(2, 0), (3, 1)}
    edges = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 8, 9)], "doc_id int, source int, target int")
    assert {r.node for r in relational.closure(edges, spark.createDataFrame([(1, 1)], "doc_id int, node int")).collect()} == {1, 2, 3}
    fields = spark.createDataFrame([(1, 2, 1, None, "x"), (1, 1, None, "Tx", None)], "doc_id int, node int, parent int, ft string, v string")
    assert {(r.node, r.ft, r.v) for r in relational.inherited(fields, fields, ["ft", "v"]).collect()} == {(2, "Tx", "x"), (1, "Tx", None)}


def test_layout(spark):
    widths = layout.plain_widths()
    assert layout.width_of("A", widths, 12) == 9 and layout.width_of("Hi", widths, 10) == 12.5 and layout.width_of("A A", widths, 10) == 17.5
    assert layout.wrapped("Hello World", 30, widths, 10) == ["Hello", "World"] and len(layout.wrapped("Line1\nLine2", 500, widths, 10)) == 2
    assert all(layout.width_of(x, widths, 10) <= 20 for x in layout.wrapped("unbreakable", 20, widths, 10))
    row = spark.range(1).select(layout.text_width(F.lit("A A"), widths, 10.0).alias("w"), layout.operators(("Td", 1, 2), ("ET",)).alias("s")).first()
    assert row.w == 17.5 and row.s == "1 2 Td\nET"


def test_forms(spark):
    fields = spark.createDataFrame([(1, "a", "10"), (1, "b", "20.5"), (1, "c", ""), (1, "sum", None), (1, "twice", None)], "doc_id int, name string, value string")
    orders = spark.createDataFrame([(1, 0, "sum", "sum", ["a", "b", "c"]), (1, 1, "twice", "AVG", ["sum", "a"])], "doc_id int, position int, target string, operation string, sources array<string>")
    assert {r.name: r.value for r in forms.calculated(fields, orders).collect()} == {"a": "10", "b": "20.5", "c": "", "sum": "30.5", "twice": "20.25"}
    assert forms.call('AFSimple_Calculate("SUM", new Array("a", "b"));') == ("AFSimple_Calculate", ["SUM", ["a", "b"]])
    assert forms.call("app.alert('x')") is None
    with pytest.raises(ValueError, match="unsupported"):
        forms.formatted("event.value = 1", F.lit("x"))
    row = spark.range(1).select(forms.formatted('AFNumber_Format(2, 0, 0, 0, "$", true)', F.lit("1234.5")).alias("n"), forms.valid("AFSpecial_Keystroke(2)", F.lit("555-1234")).alias("v"), forms.formatted('AFDate_FormatEx("mm/dd/yyyy")', F.lit("2025-01-15")).alias("d")).first()
    assert (row.n, row.v, row.d) == ("$1,234.50", True, "01/15/2025")
    data = spark.createDataFrame([(1, "a", "1", 0), (1, "a", "2", 1)], "doc_id int, name string, value string, ordinal int")
    assert forms.exported(data).first().data == {"a": "2"}
    assert forms.imported(fields, spark.createDataFrame([(1, "a", "7")], "doc_id int, name string, value string")).filter("name = 'a'").first().value == "7"


def test_data_source(spark, tmp_path):
    docfile.register(spark)
    rows = documents.write(spark.createDataFrame([(1, "Hello (1)"), (2, "日本")], "doc_id long, text string"))
    target = str(tmp_path / "files")
    rows.select(F.format_string("%d.pdf", "doc_id").alias("path"), F.lit(None).cast("string").alias("version"), F.lit(0).alias("n_revisions"), F.lit(0).alias("n_objects"), F.lit(0).cast("long").alias("length"), "content").write.format("docfile").mode("append").save(target)
    back = spark.read.format("docfile").load(target)
    assert [(r.version, r.n_objects) for r in back.collect()] == [("1.7", 5)] * 2
    assert documents.files(spark, target).count() == 2
    stream = spark.readStream.format("docfile").option("maxFilesPerTrigger", 1).load(target).select("path").writeStream.format("memory").queryName("files_seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        stream.processAllAvailable()
        assert spark.table("files_seen").count() >= 1
    finally:
        stream.stop()


def test_chunked_stream(spark, tmp_path):
    data = form_file()
    cut = [data[:50], data[50:333], data[333:]]
    rows = [(1, i, bytearray(c), i == 2) for i, c in enumerate(cut)]
    schema = "doc_id long, seq int, data binary, is_last boolean"
    for i in (2, 0, 1):  # out of order, a trigger each
        spark.createDataFrame([rows[i]], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = chunks.parsed_stream(source).writeStream.format("memory").queryName("parsed").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        stream.processAllAvailable()
        assert [tuple(r) for r in spark.table("parsed").collect()] == [(1, 7, len(data), None)]
    finally:
        stream.stop()
    feeder, found = chunks.Feeder(), []
    for i in range(0, len(data), 37):
        found += feeder.feed(data[i : i + 37])
    found += feeder.feed(b"", last=True)
    assert [(t.kind, t.at) for t in found] == [(t.kind, t.at) for t in syntax.tokens(data)]
