"""Tables that the small data don't have: odd texts, and steps whose cost must not follow from how the rows come."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.functions import codecs, crypto, text
from quire.operators import relational
from quire.operators.shared import sliced
from quire.plans import catalogue
from quire.sources import documents as pdf

#: Empty and very short texts (in the four kinds of protected files), and ones whose bytes the syntax escapes.
TEXTS = ["", "", "", "", "a", ".", "A.", "\n", "(", "\\", ")(", " ", "é", "ÿ", "•", "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "x" * 600, "(\\\r\n" * 40]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    rows = {"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": TEXTS, "n_chars": pa.array(map(len, TEXTS), pa.int64())}
    pq.write_table(pa.table(rows), os.path.join(folder, "documents.parquet"))
    return folder


def same_as_sql(spark, folder: str, name: str) -> None:
    con = duckdb.connect()
    for table in os.listdir(folder):
        con.sql(f"CREATE VIEW {table.partition('.')[0]} AS SELECT * FROM '{folder}/{table}'")
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, folder).select(*want.columns).collect()
    assert sorted(repr(tuple(r)) for r in got) == sorted(map(repr, want.fetchall()))


def test_flate_of_empty_texts(spark, odd):
    assert codecs.flate_encode(b"") == bytes.fromhex("789c030000000001") and codecs.flate_decode(codecs.flate_encode(b"")) == b""
    same_as_sql(spark, odd, "q36_flate")


def test_protected_files_of_short_texts(spark, odd):
    same_as_sql(spark, odd, "q60_protected_files")


def test_texts_of_plain_files_are_not_hidden(spark, odd):
    rows = spark.read.parquet(f"{odd}/documents.parquet").select("doc_id", "text")
    plain = pdf.write(rows).join(rows, "doc_id").select(catalogue.is_hidden(F.col("content"), F.col("text")).alias("hidden"))
    assert [r.hidden for r in plain.collect()] == [False] * len(TEXTS)


def test_steps_over_references_make_their_objects_once(spark):
    """A chain of references is looked up step by step, but what it leads through is computed once and not once a step."""
    made = spark.sparkContext.accumulator(0)

    def counted(i: int) -> tuple:
        made.add(1)
        return 0, i, i + 1 if i < 8 else None

    schema = "doc_id int, obj_no int, ref int"
    links = spark.createDataFrame(spark.sparkContext.range(1, 101, numSlices=2).map(counted), schema)
    values = spark.createDataFrame([(0, "a", 1), (0, "b", 9), (0, "c", 200), (0, "d", None)], "doc_id int, node string, ref int")
    assert {r.node: r.target for r in relational.resolved(values, links).collect()} == {"a": 8, "b": 9, "c": None, "d": None} and made.value == 100
    made.value = 0
    edges = links.select("doc_id", F.col("obj_no").alias("source"), F.col("ref").alias("target")).filter("target IS NOT NULL")
    assert {r.node for r in relational.closure(edges, spark.createDataFrame([(0, 3)], "doc_id int, node int")).collect()} == {*range(3, 9)} and made.value == 100
    made.value = 0
    nodes = links.filter("obj_no <= 8").select("doc_id", F.col("obj_no").alias("node"), F.when(F.col("obj_no") > 1, F.col("obj_no") - 1).alias("parent"), F.lit("n").alias("name"))
    assert {r.path: r.depth for r in relational.tree_paths(nodes).collect()} == {".".join("n" * (i + 1)): i for i in range(8)} and made.value <= 200


def test_batches_for_python_are_small(spark):
    """By rows and by bytes, whatever the texts' lengths; and little of a batch is unpacked at a time."""
    rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 20_000).alias("text"))
    pdf.write(rows, "id")  # any step of the document engine, or query, sets them

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "bytes": [batch.nbytes]})

    seen = rows.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in seen) == 3000 and max(r.rows for r in seen) <= 1000 and max(r.bytes for r in seen) < 8 << 20
    batch = pa.RecordBatch.from_pydict({"text": ["y" * 20_000] * 300})
    pieces = [*sliced(iter([batch]))]
    assert sum(p.num_rows for p in pieces) == 300 and max(p.num_rows for p in pieces) <= 60


def test_random_bytes_take_one_key_a_row(spark):
    rows = spark.range(2000).select(crypto.random_bytes(400).alias("a"), crypto.random_bytes(5).alias("b"), crypto.random_bytes(400, 7).alias("c"), crypto.random_bytes(400, 7).alias("d"))
    made = rows.collect()
    assert {(len(r.a), len(r.b), len(r.c)) for r in made} == {(400, 5, 400)} and all(r.c == r.d for r in made)
    assert len({r.a for r in made}) == len({r.c for r in made}) == 2000 and len({r.a[16 * i : 16 * i + 16] for r in made for i in range(25)}) == 50_000
    assert rows.select("a")._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_document_encoding_asks_texts_first(spark):
    """Equal to the encoding character by character; the long class and the translation are only for texts that need them."""
    texts = [None, "", "plain", "é" * 9, "a•€b", "\x80\x9f", "x😀y\n", "“é”", "日本", "ÿ\xa0\x7f"]
    code = {c: 0x80 + i for i, c in enumerate(text.DOC_ENCODING)}
    known = lambda c: code.get(c, ord(c) if ord(c) < 0x80 or 0xA0 <= ord(c) <= 0xFF else None)
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.needs_unicode(F.col("t")).alias("u"), text.doc_encode(F.col("t")).alias("e"))
    for r in rows.collect():
        assert (r.u, r.e) == ((None, None) if r.t is None else (None in [known(c) for c in r.t], bytes(known(c) if known(c) is not None else 63 for c in r.t)))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "octet_length" in plan
