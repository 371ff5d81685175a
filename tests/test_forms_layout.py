import pytest
from pyspark.sql import functions as F

from quire.functions import glyphs
from quire.operators import layout, mutations, relational
from quire.sources import docfile, documents, syntax, xfa

WIDTHS = layout.plain_widths()


def shown(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_annotations_and_options(spark):
    data = documents.form_file(
        [
            ("a", "Btn", {"Rect": [10, 30, 5, 2], "F": 4, "AS": "/On", "AP": {"N": {"On": (90, 0), "Off": (91, 0)}}}),
            ("b", "Ch", {"Opt": [[b"x", b"The X"], b"y", [b"z"]], "V": b"y"}),
            ("c", "Ch", {"Opt": [b"p", b"q"], "V": [b"p", b"q"]}),
        ],
        pages=2,
    )
    files = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"nothing"))], "doc_id long, content binary")
    found = documents.annotations(files).orderBy("obj_no").collect()
    assert [(r.page_no, r.place, r.is_widget) for r in found] == [(0, 0, True), (1, 0, True), (0, 1, True)]
    assert found[0].rect == [5.0, 2.0, 10.0, 30.0] and found[0].flags == 4 and found[0].states == ["On", "Off"] and found[0].state == "On"
    assert all(r.own_page == r.page_obj for r in found)
    assert [(r.export, r.shown, r.chosen) for r in documents.options(files).orderBy("obj_no", "place").collect()] == [("x", "The X", False), ("y", "y", True), ("p", "p", True), ("q", "q", True)]


def test_lines_are_wrapped_as_words_fit():
    assert layout.wrapped("ab abcdefgh x", 24.0, dict.fromkeys("abcdefghx ", 500.0), 12.0) == ["ab", "abcdefgh", "x"]
    assert layout.wrapped("abcdefgh x", 24.0, dict.fromkeys("abcdefghx ", 500.0), 12.0) == ["abcd", "efgh", "x"]
    assert layout.wrapped("a  b\n\nc", 240.0, WIDTHS, 12.0) == ["a  b", "", "c"]


def test_appearances(spark):
    comb = shown(spark, layout.comb_appearance(F.lit("A("), F.lit(4), F.lit(40.0), 3, "Helv", 10, WIDTHS))
    assert comb.split("\n")[3:6] == ["/Helv 10 Tf", "1 0 0 1 1.25 3 Tm (A) Tj", "1 0 0 1 13 3 Tm (\\() Tj"]
    lines = shown(spark, layout.lines_appearance(F.array(F.lit("a"), F.lit("b")), F.lit("F1"), 10, F.lit("0 g"), F.lit(2.0), F.lit(30.5)))
    assert "2 30.5 Td (a) Tj\n0 -12 Td (b) Tj" in lines
    listed = shown(spark, layout.list_appearance(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(1), F.lit(7)), F.lit(50.0), F.lit(40.0), "Helv", 10))
    assert listed.count(" re f") == 1 and "0 16 50 12 re f" in listed and "(b) Tj" in listed
    assert shown(spark, layout.button_appearance(F.lit(False), F.lit(True), F.lit(10.0), F.lit(10.0))) == ""
    assert shown(spark, layout.button_appearance(F.lit(True), F.lit(True), F.lit(10.0), F.lit(10.0))).count(" c") == 4
    assert "(4) Tj" in shown(spark, layout.button_appearance(F.lit(True), F.lit(False), F.lit(10.0), F.lit(10.0)))
    assert shown(spark, layout.widest(F.lit("aA "), WIDTHS, 10.0)) == 7.5 and shown(spark, layout.widest(F.lit(""), WIDTHS, 10.0)) == 0.0


def test_fonts_and_maps(spark):
    assert glyphs.standard_font("ABCDEF+Helvetica") == glyphs.standard_font("/Helv") == "Helvetica" and glyphs.standard_font("Nothing") is None
    assert glyphs.family_member("Times", True, True) == "Times-BoldItalic"
    assert glyphs.standard_widths("Helv")["A"] == 667 and set(glyphs.standard_widths("Cour").values()) == {600.0}
    table = {i: chr(65 + i) for i in range(230)} | {300: "fi", 301: "😀"}
    said = glyphs.to_unicode_map(table)
    assert glyphs.read_unicode_map(said) == table and said.count("beginbfchar") == 3
    assert glyphs.read_unicode_map("2 beginbfrange\n<0001> <0003> <0041>\n<0005> <0006> [<0061> <00620063>]\nendbfrange") == {1: "A", 2: "B", 3: "C", 5: "a", 6: "bc"}
    widths = {1: 5, 2: 5, 3: 5, 4: 7, 5: 8, 9: 1}
    assert glyphs.width_array(widths) == [1, 3, 5, 4, [7, 8], 9, [1]] and glyphs.read_width_array(glyphs.width_array(widths)) == widths
    assert glyphs.cid_to_gid({0: 1, 2: 258}) == b"\0\1\0\0\1\2"
    rows = spark.createDataFrame([("plain",), ("nö",), ("日本",), ("a(b)\\",), (None,)], "t string").select(glyphs.operand(F.col("t")).alias("o")).collect()
    assert [r.o for r in rows] == ["(plain)", "(nö)", "<65E5672C>", "(a\\(b\\)\\\\)", None]
    assert spark.createDataFrame([(0,), (500,), (251,)], "w int").agg(glyphs.average_width(F.col("w")).alias("a")).first().a == 376


def test_form_data_packets(spark):
    xml = '<x:datasets xmlns:x="u"><x:data><form1><a>1 &amp; 2</a><b/></form1></x:data></x:datasets>'
    assert xfa.value(xml, "form1[0].a[0]") == "1 & 2" and xfa.value(xml, "form1.nothing") is None
    new = xfa.imported(xml, {"form1[0].b[0]": "x<y", "form1.c.d": "made"})
    assert xfa.value(new, "form1.b") == "x<y" and xfa.value(new, "c.d") == "made" and xfa.value(new, "a") == "1 & 2"
    objects = {1: {"Type": "/Catalog", "AcroForm": {"Fields": [], "XFA": [b"template", (3, 0), b"datasets", (4, 0)]}}, 3: ({}, b"<t/>"), 4: ({}, xml.encode())}
    files = spark.createDataFrame([(1, bytearray(syntax.write(objects, 1))), (2, bytearray(syntax.write({1: {"Type": "/Catalog"}}, 1)))], "doc_id long, content binary")
    assert [(r.doc_id, r.name, bytes(r.data)) for r in xfa.packets(files).orderBy("place").collect()] == [(1, "template", b"<t/>"), (1, "datasets", xml.encode())]


def test_changes_of_documents(spark):
    objects = spark.createDataFrame([(1, 0, 1, 0, "a"), (1, 0, 2, 0, "b"), (2, 0, 1, 0, "a")], "doc_id int, revision_no int, obj_no int, gen_no int, value string")
    pool = spark.createDataFrame([(1, 0, 2, 0, "taken"), (1, 0, 5, 0, "e"), (1, 0, 6, 0, "f"), (1, 0, 7, 0, "g")], objects.schema)
    links = spark.createDataFrame([(1, 5, 6), (1, 6, 5), (1, 6, 2)], "doc_id int, source int, target int")
    new = mutations.added(objects, pool, spark.createDataFrame([(1, 5)], "doc_id int, node int"), links)
    assert sorted((r.doc_id, r.obj_no, r.value) for r in new.collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 5, "e"), (1, 6, "f"), (2, 1, "a")]
    assert {r.doc_id: r.changed for r in mutations.modified(new, objects, "value").collect()} == {1: True, 2: False}
    wanted = spark.createDataFrame([(1, 1, "x"), (1, 9, "b"), (2, 1, "a"), (2, 4, "q")], "doc_id int, obj_no int, value string")
    assert {(r.doc_id, r.obj_no): (r.contains, r.exists) for r in mutations.contained(objects, wanted, "value").collect()} == {(1, 1): (True, False), (1, 9): (False, True), (2, 1): (True, True), (2, 4): (False, False)}
    entries = objects.select("doc_id", "obj_no", "gen_no", F.lit(1).alias("entry_type"), F.lit(9).cast("long").alias("byte_offset"))
    at = mutations.placed(objects.withColumn("size", F.lit(10)), "size", ["obj_no"], 9)
    assert [(r.doc_id, r.obj_no) for r in mutations.stale_offsets(entries, at).collect()] == [(1, 2)]
    assert [tuple(r) for r in mutations.reserved(objects, spark.createDataFrame([(1, 3)], "doc_id int, n int"), "n").collect()] == [(1, 3, 5)]
    revisions = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id int, revision_no int")
    assert [tuple(r) for r in mutations.empty_revisions(revisions, objects).collect()] == [(1, 1)]
    assert mutations.with_version(spark.createDataFrame([(1, "1.4")], "doc_id int, version string"), F.lit("1.7")).first().version == "1.7"
    widgets = spark.createDataFrame([(1, 3, 8), (1, 3, 9)], "doc_id int, page_obj int, obj_no int")
    assert [r.obj_no for r in mutations.not_yet_on_page(widgets, widgets.filter("obj_no = 8")).collect()] == [9]


def test_references_in_a_circle_lead_nowhere(spark):
    objects = spark.createDataFrame([(1, 1, 2), (1, 2, 1), (1, 3, 4), (1, 4, None)], "doc_id int, obj_no int, ref int")
    values = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 99), (1, "d", 4)], "doc_id int, node string, ref int")
    assert {r.node: r.target for r in relational.resolved(values, objects, most=6).collect()} == {"a": None, "b": 4, "c": None, "d": 4}


def test_tokens_that_need_white_space(spark):
    rows = spark.createDataFrame([("number", "number", True), ("name", "number", False), ("number", "name", True), ("start_array", "name", False), ("name", None, False)], "kind string, before string, want boolean")
    assert all(r.got == r.want for r in rows.select("want", relational.separators(F.col("kind"), F.col("before")).alias("got")).collect())


def test_files_of_one_name_are_an_error(spark, tmp_path):
    docfile.register(spark)
    data = bytearray(syntax.write({1: {"Type": "/Catalog"}}, 1))
    rows = lambda *names: spark.createDataFrame([(n, None, 0, 0, 0, data) for n in names], docfile.SCHEMA)
    target = str(tmp_path / "out")
    with pytest.raises(Exception, match="files of one name"):
        rows("a/x.pdf", "b/x.pdf").write.format("docfile").mode("append").save(target)
    assert docfile.listed(target) == []
    rows("a/x.pdf", "y.pdf").write.format("docfile").mode("append").save(target)
    with pytest.raises(Exception, match="files of one name"):
        rows("x.pdf").write.format("docfile").mode("append").save(target)
    rows("x.pdf").write.format("docfile").mode("overwrite").save(target)
    assert [p.rpartition("/")[2] for p in docfile.listed(target)] == ["x.pdf", "y.pdf"]
    assert spark.read.format("docfile").load("file://" + target).count() == 2
