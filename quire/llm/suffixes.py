"""Removal of long repeated strings by sorting suffixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import discard, pick, release, sliced, spooled, table, width

LENGTH = 400
#: Bytes of a word's code, where repeats are counted in words.
CODE = 4
SEPARATED = re.compile(rb"[^\x20\x09-\x0D]+")
#: Starts that are cut at a time in a very long text.
PIECE = 1 << 20
#: Bytes of contexts that are sorted at a time, and different contexts of one anchor from which on they are dealt to many tasks.
SORT_BYTES = 2 << 20
HOT = 20_000
#: Bits of the bitmap of row keys that go to a join, for each key and at most.
BITS_A_KEY = 32
MOST_BITS = 1 << 27
U = np.uint64


def rolling(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit fingerprint of the ``k`` bytes from every position, by joining halves of doubled size."""
    with np.errstate(over="ignore"):
        power, size, made, length, place = U(0x9E3779B97F4A7C15), 1, None, 0, data.astype(U) + U(1)
        while True:
            if k & size:
                n = len(data) - length - size + 1
                made = place[:n].copy() if made is None else made[:n] * power_of(size) + place[length : length + n]
                length += size
            if size * 2 > k:
                break
            place = place[:-size] * power + place[size:]
            power = power * power
            size *= 2
        made ^= made >> U(29)
        made *= U(0xBF58476D1CE4E5B9)
        made ^= made >> U(32)
    return made


def power_of(n: int) -> np.uint64:
    return U(pow(0x9E3779B97F4A7C15, n, 1 << 64))


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if size < n else x


def gram_of(length: int) -> int:
    """Bytes of an anchor: the largest power of two within a third of ``length``."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def segments(text: bytes, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(first start, last start, anchor) of the runs of starts whose ``length`` bytes have the same anchor.

    The anchor of a string is its gram with the least fingerprint, the leftmost of several, so equal
    strings have equal anchors at the same place in them, and only starts of
    equal anchors need be compared.
    """
    gram = gram_of(length)
    low = U((1 << 24) - 1)
    for at in range(0, len(text) - length + 1, PIECE):
        hashes = rolling(np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - at), at), gram)
        place = (sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=U), length - gram + 1) & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        yield first + at, np.append(first[1:], len(place)) - 1 + at, hashes[place[first]].view(np.int64)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position as one number."""
    wide = data.astype(U)
    for size in (1, 2, 4):
        wide = (wide[:-size] << U(8 * size)) | wide[size:]
    return wide


def repeated(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Which suffixes of ``data`` at ``starts`` share their first ``length`` bytes with another of their group.

    Multikey quicksort for all groups at once: suffixes are sorted by one token of an eighth of
    ``length``, and those with an equal go on, among their equals, to the next token. Tokens are compared by fingerprints; what is left together in the end is
    compared byte by byte.
    """
    token = max(1, length // 8)
    hashes = rolling(data, token)
    alive = np.arange(len(starts))
    for offset in [*range(0, length - token, token), length - token]:
        alive, group = sifted(alive, group, hashes[starts[alive] + offset])
    return np.isin(np.arange(len(starts)), exact(data, starts, alive, group, length), assume_unique=True)


def sifted(alive: np.ndarray, group: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those that share group and key with another, sorted, and their new groups."""
    order = np.lexsort((key, group))
    key, group, alive = key[order], group[order], alive[order]
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1]))) if len(key) else np.zeros(0, bool)
    ids = np.cumsum(new) - 1
    keep = np.bincount(ids)[ids] > 1 if len(ids) else new
    return alive[keep], ids[keep]


def exact(data: np.ndarray, starts: np.ndarray, alive: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Of the suffixes with equal fingerprints, those that have an equal in their bytes: all are held against their group's first, and groups with one that differs are sorted by bytes."""
    if not len(alive):
        return alive
    step = 8 if length >= 8 else 1
    words = eights(data) if step == 8 else data
    new = np.concatenate(([True], group[1:] != group[:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    differs = np.zeros(len(alive), bool)
    offsets = [*range(0, length - step, step), length - step]
    for offset in offsets:
        own = words[starts[alive] + offset]
        differs |= own != own[first]
    if not differs.any():
        return alive
    doubtful = np.isin(group, group[differs])
    again, ids = alive[doubtful], group[doubtful]
    for offset in offsets:
        again, ids = sifted(again, ids, words[starts[again] + offset])
    return np.concatenate((alive[~doubtful], again))


def runs(flags: np.ndarray, owner: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, first place, last place) of the runs of flagged neighbours with one owner."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at, at
    cut = np.flatnonzero((np.diff(at) != 1) | (np.diff(owner[at]) != 0))
    first, last = at[np.append(0, cut + 1)], at[np.append(cut, len(at) - 1)]
    return owner[first], place[first], place[last]


def contexts_of(batch: pa.RecordBatch | pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts' bytes joined; of every start in them its place there, its context and its place in the context."""
    texts = batch.column("context").to_pylist()
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    n = sizes - length + 1
    owner = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join(texts), np.uint8), base[owner] + place, owner, place


def repeats(rows: DataFrame, length: int, hot: int = HOT) -> DataFrame:
    """(_key, ranges) of the rows (key, text as binary) that hold starts of repeated strings; ranges: (first start, last start)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            parts = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                for first, last, anchor in segments(text, length):
                    digest = xxhash.xxh3_64_intdigest
                    own = np.array([digest(text[s:e]) for s, e in zip(first.tolist(), (last + length).tolist())], U).view(np.int64)
                    parts.append((np.full(len(first), key), first, last, anchor, own))
            if parts:
                key, first, last, anchor, own = (np.concatenate(c) for c in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(anchor), pa.array(own)], ["key", "first", "last", "anchor", "own"])

    places = spooled(rows.filter(F.octet_length("text") >= length).mapInArrow(cut, "key long, first int, last int, anchor long, own long"))
    every = spooled(places.groupBy("anchor", "own").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "first", "last")).alias("rep")))
    # counted first, so that an anchor with very many different runs is never one task's: the join that tells them so is split where it is skewed
    several = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").withColumnRenamed("anchor", "_anchor")
    kinds = every.join(several, F.col("anchor") == F.col("_anchor"), "left").filter("n > 1 OR kinds > 1")
    kinds = spooled(kinds.select("anchor", "own", "n", F.coalesce("kinds", F.lit(1)).alias("kinds"), "rep.*"))
    discard(every)
    known = kinds.filter("n > 1").select("anchor", "own", F.lit(0).alias("lo"), (F.col("last") - F.col("first")).alias("hi"))
    open_, widest = kinds.filter("kinds > 1").agg(F.count(F.lit(1)), F.max("kinds")).first()
    asked = kinds.filter("kinds > 1").select(F.col("key").alias("_key"), "first", "last", "anchor", "own", "n", "kinds")
    held = rows.filter(likely(asked, open_, "_key")(F.col("key")))
    context = F.expr(f"substring(text, first + 1, last - first + {length})")
    contexts = held.join(asked, F.col("key") == F.col("_key")).select("anchor", "own", (F.col("n") > 1).alias("known"), "kinds", context.alias("context"))

    def compare(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(held)
        anchor, own = both.column("anchor").to_numpy(), both.column("own").to_numpy()
        once = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (own[1:] != own[:-1])))
        both = both.filter(pa.array(once))
        anchor, own, known = anchor[once], own[once], np.asarray(both.column("known"))
        group = np.cumsum(np.concatenate(([0], anchor[1:] != anchor[:-1])))
        data, starts, owner, place = contexts_of(both, length)
        flags = repeated(data, starts, group[owner], length) & ~known[owner]
        who, lo, hi = runs(flags, owner, place)
        return pa.RecordBatch.from_arrays([pa.array(anchor[who]), pa.array(own[who]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], ["anchor", "own", "lo", "hi"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                anchor = part.column("anchor").to_numpy()
                if size >= SORT_BYTES and anchor[0] != held[-1].column("anchor")[-1].as_py():
                    yield compare(held)
                    held, size = [], 0
                other = np.flatnonzero(anchor != anchor[-1])
                if size >= SORT_BYTES and len(other):  # a bucket ends at an anchor's end, so no equal suffixes are parted
                    end = int(other[-1]) + 1
                    yield compare([*held, part.slice(0, end)])
                    held, size, part = [], 0, part.slice(end)
                held.append(part)
                size += pc.sum(pc.binary_length(part.column("context"))).as_py() or 0
        if held:
            yield compare(held)
        release()

    found = "anchor long, own long, lo int, hi int"
    narrow = contexts.filter(F.col("kinds") <= hot).drop("kinds")
    ordered = narrow.repartitionByRange(width(rows.sparkSession), "anchor").sortWithinPartitions("anchor", "own")
    hits = known.unionByName(ordered.mapInArrow(sort, found))

    if (widest or 0) > hot:

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    data, starts, owner, place = contexts_of(part, length)
                    print_ = rolling(data, length)[starts].view(np.int64)
                    take = pa.array(owner)
                    yield pa.RecordBatch.from_arrays([part.column("anchor").take(take), part.column("own").take(take), part.column("known").take(take), pa.array(place.astype(np.int32)), pa.array(print_)], ["anchor", "own", "known", "place", "print"])

        each = contexts.filter(F.col("kinds") > hot).dropDuplicates(["anchor", "own"]).drop("kinds").mapInArrow(spread, "anchor long, own long, known boolean, place int, print long")
        twice = each.groupBy("anchor", "print").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
        hits = hits.unionByName(each.filter("NOT known").join(twice, ["anchor", "print"], "left_semi").select("anchor", "own", F.col("place").alias("lo"), F.col("place").alias("hi")))

    ranges = places.join(hits, ["anchor", "own"]).select(F.col("key").alias("_key"), (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))
    found = spooled(ranges.groupBy("_key").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")))
    discard(places)
    discard(kinds)
    return found


def likely(keys: DataFrame, n: int, key: str) -> Callable[[Column], Column]:
    """A test of row keys that says yes to all of ``keys`` and to few others, by one bit of a bitmap of bounded size; it keeps most texts out of a shuffle."""
    bits = min(MOST_BITS, 1 << max(10, (BITS_A_KEY * max(1, n) - 1).bit_length()))
    at = F.pmod(F.col(key), F.lit(bits))
    words = keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int")).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    shared = keys.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def test(key: pa.Array) -> pa.Array:
        place = np.mod(key.to_numpy(), bits)
        return pa.array((shared.value[place >> 6] >> (place & 63)) & 1 == 1)

    return test


def with_ranges(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the ``ranges`` of ``found`` (_key, ranges), null where there are none. Only rows that are likely to have some are shuffled."""
    test = likely(found, found.count(), "_key")
    other = rows.filter(~test(F.col("key"))).withColumn("ranges", F.lit(None).cast(found.schema["ranges"].dataType))
    return rows.filter(test(F.col("key"))).join(found, F.col("key") == F.col("_key"), "left").drop("_key").unionByName(other)


def spans(ranges: list[dict], length: int, size: int) -> list[tuple[int, int]]:
    """The maximal removed runs [from, to) of a text of ``size`` bytes."""
    merged: list[tuple[int, int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in ranges):
        end = min(hi + length, size)
        if merged and lo <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], end))
        elif lo < end:
            merged.append((lo, end))
    return merged


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, hot: int = HOT, digest_only: bool = False) -> DataFrame:
    """Every row's text without the bytes that a repeated string of ``length`` bytes covers.

    A string is repeated if it starts anywhere else in the table, in the same text too; all that is
    judged on the input. Texts are UTF-8 bytes and strings never cross texts.

    Anchors cut a text's starts into runs that can only repeat where their anchor does. Runs that are
    equal as a whole are counted, first on the map side; of each different run of
    a repeated anchor one context is kept, ranged by sampled splitters of the anchors, which are the leading tokens
    of the suffixes that begin there, and each bucket's suffixes are sorted by multikey quicksort. Buckets end where an
    anchor ends. An anchor with more than ``hot`` different contexts is dealt to many tasks by whole strings instead.

    Null text: empty. Texts shorter than ``length``: kept. Null or repeated ids: each row is returned; a repeated row repeats
    the other's text. Empty table: no rows. Other columns don't matter.

    Returns doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of from, to), and, but for ``digest_only``, text: the
    bytes kept, where a cut character's bytes are left out.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    found = repeats(rows.select("key", "text"), length, hot)
    joined = with_ranges(rows, found).select("doc_id", "key", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made: list[tuple] = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist()):
                gone = spans(ranges or [], length, len(text))
                kept, at = [], 0
                for lo, hi in gone:
                    kept.append(text[at:lo])
                    at = hi
                kept = b"".join([*kept, text[at:]])
                made.append((len(text), sum(hi - lo for lo, hi in gone), len(gone), hashlib.sha256(kept).hexdigest(), [{"from": lo, "to": hi} for lo, hi in gone], None if digest_only else kept.decode("utf-8", "ignore")))
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text"]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *[pa.array([m[i] for m in made], t) for i, t in enumerate(types)]], ["doc_id", "key", *names])

    out = joined.mapInArrow(run, f"doc_id {kind}, key long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<from: bigint, to: bigint>>, text string")
    return out.drop("text") if digest_only else out


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` (key, text as binary) with a code of ``CODE`` bytes, a hash, in place of each word, so that runs of words are strings of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh32_digest
        for batch in sliced(batches):
            codes = [b"".join(map(digest, text.split())) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(codes, pa.binary())], ["key", "text"])

    return rows.mapInArrow(run, "key long, text binary")


def word_spans(text: bytes, ranges: list[dict], words: int) -> list[tuple[int, int]]:
    """The runs of bytes from the first to the last word of the repeats that start at ``ranges`` of the text's codes; between codes none starts."""
    own = [(lo, hi) for lo, hi in ((-(-r["lo"] // CODE), r["hi"] // CODE) for r in ranges) if lo <= hi]
    places = [m.span() for m in SEPARATED.finditer(text)] if own else []
    return [(places[lo][0], places[hi + words - 1][1]) for lo, hi in own]


def trimmed(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", chars_col: str = "n_chars", length: int = LENGTH, words: int | None = None) -> DataFrame:
    """``docs`` with the repeated strings of ``length`` bytes, and the repeated runs of ``words`` words, cut out of their texts; see ``without_repeats``.

    Runs of words repeat whatever white space is between the words, and equal hashes of words count as equal words.
    All rows and columns stay; ``chars_col``, if there is one, is set to the new number of characters. A null text stays null.
    """
    names = docs.columns
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    at, own = names.index(text_col), f"_{names.index(text_col)}"
    flat = flat.withColumn("key", F.xxhash64(f"_{names.index(id_col)}", own))
    rows = flat.filter(F.col(own).isNotNull()).select("key", F.col(own).cast("binary").alias("text"))
    tagged = lambda found, by_words: found.select("_key", F.transform("ranges", lambda r: F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), F.lit(by_words).alias("words"))).alias("ranges"))
    found = tagged(repeats(rows, length), False)
    if words:
        codes = spooled(coded(rows))
        found = found.unionByName(tagged(repeats(codes, CODE * words), True))
        discard(codes)
        found = found.groupBy("_key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    found = spooled(found)
    joined = with_ranges(flat, found).drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            for i, ranges in enumerate(batch.column("ranges").to_pylist()):
                if ranges:
                    text, kept, last = texts[i].encode(), [], 0
                    gone = spans([r for r in ranges if not r["words"]], length, len(text))
                    for lo, hi in sorted(gone + word_spans(text, [r for r in ranges if r["words"]], words)):
                        kept.append(text[last:lo])
                        last = max(last, hi)
                    texts[i] = b"".join([*kept, text[last:]]).decode("utf-8", "ignore")
            yield batch.set_column(at, own, pa.array(texts, batch.column(at).type)).select(names_in)

    names_in = [f"_{i}" for i in range(len(names))]
    made = joined.mapInArrow(run, flat.drop("key").schema)
    if chars_col in names:
        chars = names.index(chars_col)
        made = made.withColumn(f"_{chars}", F.length(own).cast(docs.dtypes[chars][1]))
    return made.toDF(*names)


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), digest_only=True).drop("key", "spans")
