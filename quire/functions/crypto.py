"""Hashes, ciphers and key derivation; built-in functions where they exist, Arrow-batched UDFs where not."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quire.functions.formats import little_endian

#: The padding of short passwords in the public document format.
PADDING = bytes.fromhex("28BF4E5E4E758A4164004E56FFFA01082E2E00B6D0683E802F0CA9FE6453697A")


def digest(data: Column, algorithm: str) -> Column:
    """md5, sha1, sha256, sha384 or sha512 as bytes."""
    if algorithm == "md5":
        return F.unhex(F.md5(data))
    if algorithm == "sha1":
        return F.unhex(F.sha1(data))
    return F.unhex(F.sha2(data, int(algorithm.removeprefix("sha"))))


def rc4_bytes(key: bytes, data: bytes) -> bytes:
    box, j = list(range(256)), 0
    for i in range(256):
        j = (j + box[i] + key[i % len(key)]) & 255
        box[i], box[j] = box[j], box[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + box[i]) & 255
        box[i], box[j] = box[j], box[i]
        out[n] = byte ^ box[(box[i] + box[j]) & 255]
    return bytes(out)


@F.pandas_udf(BinaryType())
def rc4(data: pd.Series, key: pd.Series) -> pd.Series:
    return pd.Series([None if d is None or k is None else rc4_bytes(bytes(k), bytes(d)) for d, k in zip(data, key)])


def aes_cbc_encrypt(data: Column, key: Column, iv: Column | None = None) -> Column:
    """CBC with PKCS padding; the initial vector comes first."""
    return F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv) if iv is not None else F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"))


def aes_cbc_decrypt(data: Column, key: Column) -> Column:
    """The plain bytes; what is shorter than a block or can't be decrypted comes back as it is."""
    return F.when(F.octet_length(data) < 16, data).otherwise(F.coalesce(F.try_aes_decrypt(data, key, F.lit("CBC"), F.lit("PKCS")), data))


def aes_ecb_block(block: Column, key: Column) -> Column:
    """One block of sixteen bytes, without padding."""
    return F.substring(F.aes_encrypt(block, key, F.lit("ECB"), F.lit("PKCS")), 1, 16)


def aes_cbc_raw(data: Column, key: Column, iv: Column) -> Column:
    """CBC without padding or initial vector in the result; ``data`` is whole blocks."""
    sealed = F.aes_encrypt(data, key, F.lit("CBC"), F.lit("PKCS"), iv)
    return F.substring(sealed, F.lit(17), F.octet_length(data))


def pad_password(password: bytes) -> bytes:
    return (password + PADDING)[:32]


def master_key(password: bytes, owner: bytes, permission: int, file_id: bytes, length: int = 5, revision: int = 2, encrypt_metadata: bool = True) -> bytes:
    seed = pad_password(password) + owner + (permission & 0xFFFFFFFF).to_bytes(4, "little") + file_id
    if revision >= 4 and not encrypt_metadata:
        seed += b"\xff" * 4
    key = hashlib.md5(seed).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key[:length]).digest()
    return key[:length]


def object_key(key: Column, obj_no: Column, gen_no: Column, aes: bool = False) -> Column:
    """The key of one object: md5 over the file key, three bytes of its number, two of its generation (and a constant for AES)."""
    seed = F.concat(key, F.substring(little_endian(obj_no), 1, 3), F.substring(little_endian(gen_no), 1, 2))
    if aes:
        seed = F.concat(seed, F.lit(bytearray(b"sAlT")))
    return F.substring(F.unhex(F.md5(seed)), F.lit(1), F.least(F.octet_length(key) + 5, F.lit(16)))


def owner_value(owner: bytes, user: bytes, length: int = 5, revision: int = 2) -> bytes:
    key = hashlib.md5(pad_password(owner)).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    key = key[:length]
    out = rc4_bytes(key, pad_password(user))
    for i in range(1, 20 if revision >= 3 else 1):
        out = rc4_bytes(bytes(b ^ i for b in key), out)
    return out


def user_value(key: bytes, file_id: bytes, revision: int = 2) -> bytes:
    if revision < 3:
        return rc4_bytes(key, PADDING)
    out = rc4_bytes(key, hashlib.md5(PADDING + file_id).digest())
    for i in range(1, 20):
        out = rc4_bytes(bytes(b ^ i for b in key), out)
    return out + b"\0" * 16


def user_password(owner: bytes, value: bytes, length: int = 5, revision: int = 2) -> bytes:
    """The padded user password that an owner password opens."""
    key = hashlib.md5(pad_password(owner)).digest()
    for _ in range(50 if revision >= 3 else 0):
        key = hashlib.md5(key).digest()
    key = key[:length]
    for i in range(19 if revision >= 3 else 0, -1, -1):
        value = rc4_bytes(bytes(b ^ i for b in key), value)
    return value


def unpad(password: bytes) -> bytes:
    for n in range(32, -1, -1):
        if password[32 - n :] == PADDING[:n]:
            return password[: 32 - n]
    return password


def opens(password: bytes, owner: bytes, user: bytes, permission: int, file_id: bytes, length: int = 5, revision: int = 2) -> bytes | None:
    """The file key if the password is the user's or the owner's, else None."""
    for candidate in (password, unpad(user_password(password, owner, length, revision))):
        key = master_key(candidate, owner, permission, file_id, length, revision)
        if user_value(key, file_id, revision)[:16] == user[:16]:
            return key
    return None


def random_bytes(n: int, seed: int | None = None) -> Column:
    """``n`` bytes that differ from row to row; not a secret's source. One random key a row, and zeros sealed with it in one go."""
    chance = F.expr("uuid()") if seed is None else F.concat(F.rand(seed).cast("string"), F.lit(":"), F.rand(seed + 1).cast("string"))
    zeros = F.unhex(F.lit("00" * max(16, n)))
    return F.substring(aes_cbc_encrypt(zeros, F.unhex(F.md5(chance)), F.unhex(F.lit("00" * 16))), 17, n)
