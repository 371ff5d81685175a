import hashlib
import random

import pytest

from quire.functions import der
from quire.operators import signatures
from quire.sources import documents


def prime(bits, rng):
    while True:
        n = rng.getrandbits(bits) | 1 << bits - 1 | 1 << bits - 2 | 1
        if all(n % p for p in (3, 5, 7, 11, 13, 17, 19, 23, 29, 31)) and all(pow(a, n - 1, n) == 1 for a in (2, 3, 5, 7)):
            return n


@pytest.fixture(scope="module")
def key():
    rng = random.Random(9)
    p, q = prime(512, rng), prime(512, rng)
    return p * q, 65537, pow(65537, -1, (p - 1) * (q - 1))


OBJECTS = {1: {"Type": "/Catalog", "Pages": (2, 0)}, 2: {"Type": "/Pages", "Kids": [], "Count": 0}}


def test_encoding():
    for n in (0, 1, 127, 128, 255, 256, 2**64, -1):
        assert der.read(der.integer(n)).number() == n
    assert der.read(der.oid("1.2.840.113549.1.7.2")).oid() == "1.2.840.113549.1.7.2"
    assert der.integer(128) == bytes.fromhex("02020080") and der.oid("2.5.4.3") == bytes.fromhex("0603550403")
    with pytest.raises(ValueError):
        der.read(b"\x30\x05\x00")


def test_every_kind(spark, key):
    n, e, d = key
    own = der.self_signed("someone", n, e, d)
    assert der.public_key(own) == (n, e)
    seals = {
        "adbe.pkcs7.detached": lambda x: der.signed_message(hashlib.sha256(x).digest(), own, n, d),
        "ETSI.CAdES.detached": lambda x: der.signed_message(hashlib.sha512(x).digest(), own, n, d, "sha512"),
        "adbe.pkcs7.sha1": lambda x: der.signed_message(b"", own, n, d, content=hashlib.sha1(x).digest()),
        "adbe.x509.rsa_sha1": lambda x: der.item(der.OCTETS, der.rsa_sign(hashlib.sha1(x).digest(), "sha1", n, d)),
        "ETSI.RFC3161": lambda x: der.signed_message(b"", own, n, d, content=der.timestamp_info(hashlib.sha512(x).digest(), "sha512"), content_type=der.TIMESTAMP_INFO),
    }
    rows, certificates = [], bytearray(own)
    for i, (kind, seal) in enumerate(seals.items()):
        data = signatures.signed_file(OBJECTS, 1, seal, kind)
        rows.append((2 * i, kind, True, bytearray(data)))
        rows.append((2 * i + 1, kind, False, bytearray(data.replace(b"/Count 0", b"/Count 9"))))
    files = spark.createDataFrame(rows, "doc_id int, kind string, want boolean, content binary")
    found = signatures.signatures(documents.nodes(files))
    found = found.join(spark.createDataFrame([(i, [certificates]) for i in range(10)], "doc_id int, certificates array<binary>"), "doc_id")
    got = {r.doc_id: r for r in signatures.verified(found, files).collect()}
    assert len(got) == 10
    for doc_id, kind, want, _ in rows:
        assert got[doc_id].valid == want and got[doc_id].sub_filter == kind and got[doc_id].covers_whole_file, got[doc_id]
        assert want or got[doc_id].reason


def test_another_key_is_found_out(key):
    n, e, d = key
    rng = random.Random(10)
    p, q = prime(512, rng), prime(512, rng)
    other = der.self_signed("someone", p * q, e, pow(e, -1, (p - 1) * (q - 1)))
    assert der.failure(der.signed_message(hashlib.sha256(b"x").digest(), other, n, d), b"x") == "the signature is wrong"
    assert signatures.failure_of("adbe.other", b"", b"", []) == "unknown kind adbe.other"
