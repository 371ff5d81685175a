import pytest
from pyspark.sql import functions as F

from quire.functions import aes, crypto
from quire.sources import documents, security, syntax

OBJECTS = {1: {"Type": "/Catalog", "Pages": (2, 0), "Title": b"secret (title)"}, 2: {"Type": "/Pages", "Kids": [(3, 0)], "Count": 1}, 3: {"Type": "/Page", "Parent": (2, 0), "Contents": (4, 0)}, 4: ({}, b"BT (Hello) Tj ET"), 5: ({"Type": "/Metadata"}, b"<plain metadata/>")}


def test_aes_standard_vectors():
    key = bytes.fromhex("2b7e151628aed2a6abf7158809cf4f3c")
    plain = bytes.fromhex("6bc1bee22e409f96e93d7e117393172aae2d8a571e03ac9c9eb76fac45af8e51")
    sealed = aes.encrypt_cbc(key, bytes(range(16)), plain)
    assert sealed.hex() == "7649abac8119b246cee98e9b12e9197d5086cb9b507219ee95db113a917678b2"
    assert aes.decrypt_cbc(key, bytes(range(16)), sealed) == plain
    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert aes.encrypt_block(bytes(range(size)), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == want
    for n in (0, 1, 15, 16, 17, 100):
        assert aes.unseal(key, aes.seal(key, bytes(16), b"x" * n)) == b"x" * n
    assert aes.unseal(key, b"short") == b"short"


def test_aes_equals_the_engines(spark):
    data, key, iv = b"some bytes to be sealed, of no special size", b"k" * 32, b"i" * 16
    row = spark.range(1).select(crypto.aes_cbc_encrypt(F.lit(bytearray(data)), F.lit(bytearray(key)), F.lit(bytearray(iv))).alias("x")).first()
    assert bytes(row.x) == aes.seal(key, iv, data)


@pytest.mark.parametrize("version", [1, 2, 4, 5])
@pytest.mark.parametrize("compressed", [False, True])
def test_every_version(version, compressed):
    data = syntax.write(OBJECTS, 1, protect={"version": version, "user": b"user", "owner": b"owner", "permission": -44, "revision": 6 if not compressed else 5}, compressed=compressed)
    assert b"secret" not in data and b"Hello" not in data
    for password in (b"user", b"owner"):
        doc = syntax.read(data, password)
        assert doc.security.permission == -44
        live = doc.live()
        assert live[1].node.get("Title").value == b"secret (title)" and live[4].node.raw == b"BT (Hello) Tj ET"
    with pytest.raises(PermissionError):
        syntax.read(data, b"other")


def test_metadata_may_stay_plain():
    data = syntax.write(OBJECTS, 1, protect={"version": 4, "user": b"u", "metadata": False})
    assert b"<plain metadata/>" in data and syntax.read(data, b"u").live()[5].node.raw == b"<plain metadata/>"
    hidden = syntax.write(OBJECTS, 1, protect={"version": 4, "user": b"u"})
    assert b"<plain metadata/>" not in hidden and syntax.read(hidden, b"u").live()[5].node.raw == b"<plain metadata/>"


def test_filters_by_name():
    assert security.filter_method({"StdCF": "AESV2"}, "StdCF") == security.AES128
    assert security.filter_method({}, None) == security.filter_method({"A": "None"}, "A") == security.filter_method({}, "Identity") == security.IDENTITY
    with pytest.raises(ValueError):
        security.filter_method({"A": "Other"}, "A")
    with pytest.raises(ValueError):
        security.opened({"V": 3}, b"", b"")


def test_the_wrong_password_is_an_error_row(spark):
    files = documents.write(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string"), version=4, password="p")
    assert documents.errors(files).count() == 2 and documents.errors(files, "p").count() == 0
    assert documents.pages(files).count() == 0 and documents.pages(files, "p").count() == 2
    own = files.withColumn("password", F.when(F.col("doc_id") == 1, "p"))
    assert [r.doc_id for r in documents.pages(own).collect()] == [1]
