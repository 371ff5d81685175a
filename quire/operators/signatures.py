"""Signatures: where they are, what they cover, the digest of what they cover, and whether the signature is right for it (RSA); trust in certificates is another's to judge."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import der
from quire.sources import syntax


def is_signature(kind: Column, sub_filter: Column) -> Column:
    return F.coalesce(kind == "Sig", F.lit(False)) | F.coalesce(sub_filter.rlike(r"^(adbe|ETSI)\."), F.lit(False))


def signatures(nodes: DataFrame) -> DataFrame:
    """(doc_id, obj_no, sub_filter, byte_range, contents) of the signature dictionaries among nodes."""
    top = nodes.filter("parent_path = ''")
    by = top.groupBy("doc_id", "obj_no").agg(
        F.max(F.when(F.col("key") == "Type", F.col("text"))).alias("type"),
        F.max(F.when(F.col("key") == "SubFilter", F.col("text"))).alias("sub_filter"),
        F.max(F.when(F.col("key") == "Contents", F.col("bytes"))).alias("contents"),
    )
    ranges = nodes.filter("parent_path = '/ByteRange'").groupBy("doc_id", "obj_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.col("num").cast("long").alias("n")))), lambda x: x["n"]).alias("byte_range"))
    return by.filter(is_signature(F.col("type"), F.col("sub_filter"))).join(ranges, ["doc_id", "obj_no"], "left").select("doc_id", "obj_no", "sub_filter", "byte_range", "contents")


def covered(content: Column, byte_range: Column) -> Column:
    """The bytes that a range [from, size, from, size] covers."""
    part = lambda i: F.substring(content, (byte_range[i] + 1).cast("int"), byte_range[i + 1].cast("int"))
    return F.concat(part(0), part(2))


def checked(signed: DataFrame, files: DataFrame) -> DataFrame:
    """``signatures`` with well_formed, covers_whole_file, sha1 and sha256 of the bytes covered.

    The whole file is covered if the two parts leave out only the contents' hex digits. None of this says that the signature is valid.
    """
    joined = signed.join(files.select("doc_id", "content"), "doc_id")
    r, size = F.col("byte_range"), F.octet_length("content")
    form = F.coalesce((F.size(r) == 4) & (r[0] == 0) & (r[1] <= r[2]) & (r[2] + r[3] <= size), F.lit(False))
    gap = F.substring("content", (r[1] + 1).cast("int"), (r[2] - r[1]).cast("int"))
    whole = form & (r[2] + r[3] == size) & F.decode(gap, "ISO-8859-1").rlike("^<[0-9A-Fa-f]*>$")
    data = F.when(form, covered(F.col("content"), r))
    return joined.select("doc_id", "obj_no", "sub_filter", "byte_range", form.alias("well_formed"), F.coalesce(whole, F.lit(False)).alias("covers_whole_file"), F.sha1(data).alias("sha1"), F.sha2(data, 256).alias("sha256"))


def placeholder(digits: int = 32_768) -> bytes:
    """The entries of a signature dictionary before it is signed, of a fixed size."""
    return b"/ByteRange [0 " + b" ".join([b"0".rjust(12)] * 3) + b"] /Contents <" + b"0" * digits + b">"


def byte_range(contents_at: Column, contents_size: Column, file_size: Column) -> Column:
    """The range that leaves out ``contents_size`` bytes at ``contents_at``."""
    after = contents_at + contents_size
    return F.array(F.lit(0).cast("long"), contents_at.cast("long"), after.cast("long"), (file_size - after).cast("long"))


def all_valid(valid: Column) -> Column:
    return F.coalesce(F.bool_and(valid), F.lit(True))


def failure_of(kind: str, contents: bytes, covered_: bytes, certificates: list[bytes]) -> str | None:
    """What is wrong with a signature of that sub-filter over those bytes; nothing, if it is right. Trust in its certificate is not looked at."""
    if kind == "adbe.x509.rsa_sha1":
        signature = der.read(contents).body
        for c in certificates:
            if der.rsa_valid(signature, hashlib.sha1(covered_).digest(), "sha1", *der.public_key(c)):
                return None
        return "no certificate's key made the signature"
    if kind in ("adbe.pkcs7.detached", "ETSI.CAdES.detached", "adbe.pkcs7.sha1", "ETSI.RFC3161"):
        found = der.read_signed(contents)
        if kind.endswith("detached") and found.content is not None:
            return "a detached message has no content of its own"
        if kind == "adbe.pkcs7.sha1" and (found.content is None or found.content_type != der.PLAIN_DATA):
            return "the message lacks the SHA-1 it should hold"
        if kind == "ETSI.RFC3161" and found.content_type != der.TIMESTAMP_INFO:
            return "not a timestamp"
        return der.failure(contents, covered_)
    return f"unknown kind {kind}"


def verified(signed: DataFrame, files: DataFrame) -> DataFrame:
    """``signatures`` with ``covers_whole_file``, ``valid`` and the reason if not: digest and RSA signature, of all sub-filters of the format.

    Certificates beside the message (``certificates``, an array of bytes) are those of ``adbe.x509.rsa_sha1``. A file that can't be checked has a reason.
    """
    if "certificates" not in signed.columns:
        signed = signed.withColumn("certificates", F.lit(None).cast("array<binary>"))
    shape = checked(signed, files).select("doc_id", "obj_no", "well_formed", "covers_whole_file")
    rows = signed.join(shape, ["doc_id", "obj_no"]).join(files.select("doc_id", "content"), "doc_id")
    data = F.when(F.col("well_formed"), covered(F.col("content"), F.col("byte_range")))
    rows = rows.select("doc_id", "obj_no", "sub_filter", "covers_whole_file", "contents", "certificates", data.alias("data"))

    @F.pandas_udf("string")
    def reason(kind: pd.Series, contents: pd.Series, data: pd.Series, certificates: pd.Series) -> pd.Series:
        def one(k, c, d, own):
            if d is None:
                return "the byte range is broken"
            try:
                return failure_of(k, bytes(c or b"").rstrip(b"\0") or b"\0", bytes(d), [bytes(x) for x in (own if own is not None else ())])
            except (ValueError, IndexError, StopIteration, KeyError, OverflowError) as error:
                return f"unreadable: {error}"

        return pd.Series([one(*x) for x in zip(kind, contents, data, certificates)])

    made = rows.withColumn("reason", reason("sub_filter", "contents", "data", "certificates"))
    return made.select("doc_id", "obj_no", "sub_filter", "covers_whole_file", F.col("reason").isNull().alias("valid"), "reason")


def signed_file(objects: dict[int, object], root: int, seal, kind: str = "adbe.pkcs7.detached", digits: int = 8192, number: int | None = None) -> bytes:
    """A file with one signature over all of it but the signature's own digits; ``seal(covered bytes)`` gives the signature."""
    number = number or max(objects) + 1
    begin = b"%d 0 obj\n<</Type /Sig /Filter /Adobe.PPKLite /SubFilter /%s " % (number, kind.encode())
    filler = b"@@signature@@"
    data = bytearray(syntax.write(objects | {number: filler}, root))
    spot = data.index(syntax.dump(filler))
    head = data.rindex(b"%d 0 obj" % number, 0, spot)
    tail = bytes(data[spot + len(syntax.dump(filler)) :])
    body = begin + placeholder(digits) + b">>"
    grown = len(body) - (spot + len(syntax.dump(filler)) - head)
    table = tail.index(b"xref\n")
    at = int(re.search(rb"startxref\n(\d+)", tail)[1])
    tail = tail[:table] + re.sub(rb"startxref\n\d+", b"startxref\n%d" % (at + grown), tail[table:])
    out = bytearray(data[:head] + body + tail)
    first = out.index(b"/Contents <") + len(b"/Contents ")
    after = first + digits + 2
    place = out.index(b"/ByteRange [0 ") + len(b"/ByteRange [0 ")
    for i, n in enumerate((first, after, len(out) - after)):
        out[place + 13 * i : place + 13 * i + 12] = b"%12d" % n
    sealed = seal(bytes(out[:first] + out[after:])).hex().encode()
    if len(sealed) > digits:
        raise ValueError("the signature is too long for its place")
    out[first + 1 : first + 1 + len(sealed)] = sealed
    return bytes(out)
