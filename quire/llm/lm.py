"""Language-model scoring by a hierarchical Pitman-Yor process."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import discard, fold, pick, release, spooled, table

#: Bytes of text of a bucket of documents, and of a shard of the vocabulary and of the contexts.
BUCKET_BYTES = 16 << 20
SHARD_BYTES = 32 << 20
#: A context that holds this part of a shard's tokens is dealt to all shards, by the word that follows; one text in so many tells which.
HOT_PART = 0.25
HOT_SAMPLE = 64
#: Strength of every restaurant, discount of those of letters, Gibbs sweeps and how many of the last are averaged.
STRENGTH = 1.0
LETTER_DISCOUNT = 0.6
SWEEPS = 6
AVERAGED = 4
#: A letter is a byte; this one is a word's border.
BORDER = 256
LETTERS = 257
#: Customers of a dish that are seated one by one; later ones come in groups of this part of those that are there.
STEPS_ONE_BY_ONE = 64
GROUP_PART = 16
#: Bits of a word's hash that stand for it in the contexts' tables.
WORD_BITS = 48


def seat(customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables that each dish's customers come to occupy, all of them seated anew by the Chinese restaurant process.

    The first opens a table; with n seated at t tables, the next opens one with probability
    weight / (weight + n - discount * t), where ``weight`` is (strength + discount * all tables) times the dish's probability in the parent.
    The first ones are seated one by one, later ones in groups of a sixteenth of those that are there.
    """
    tables = (customers > 0).astype(np.int64)
    open_ = np.flatnonzero(customers > 1)
    n = 1
    while len(open_):
        size = 1 if n < STEPS_ONE_BY_ONE else n // GROUP_PART
        some = np.minimum(size, customers[open_] - n)
        w = weight[open_]
        chance = w / (w + n + (some - 1) / 2 - discount * tables[open_])
        tables[open_] += rng.binomial(some, np.clip(chance, 0.0, 1.0))
        n += size
        open_ = open_[customers[open_] > n]
    return tables


class Letters:
    """Averaged predictive probabilities of letters after the two before: cells for what was seen, and a share of the shorter context for the rest."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)
        d, s = LETTER_DISCOUNT, STRENGTH
        order = np.argsort(keys)
        self.keys, counts = keys[order].astype(np.int64), counts[order].astype(np.int64)
        context, letter = self.keys // LETTERS, self.keys % LETTERS
        short = context % LETTERS * LETTERS + letter
        self.contexts, at = np.unique(context, return_inverse=True)
        total = np.bincount(at, counts, len(self.contexts))
        uniform = 1.0 / LETTERS
        one, zero = np.full(LETTERS * LETTERS, uniform), np.full(LETTERS, uniform)
        cell, share, mean_one = np.zeros(len(self.keys)), np.zeros(len(self.contexts)), np.zeros(LETTERS * LETTERS)
        tables = (counts > 0).astype(np.int64)
        t_one = np.zeros(LETTERS * LETTERS, np.int64)
        t_zero = np.zeros(LETTERS, np.int64)
        for sweep in range(SWEEPS):
            # the longest contexts' customers are seated anew, given the shorter contexts' probabilities, and so on upwards:
            # a table of a restaurant is a customer of its parent
            strength = s + d * np.bincount(at, tables, len(self.contexts))
            tables = seat(counts, strength[at] * one[short], d, rng)
            c_one = np.bincount(short, tables, LETTERS * LETTERS).astype(np.int64)
            strength = s + d * t_one.reshape(LETTERS, LETTERS).sum(axis=1)
            t_one = seat(c_one, np.repeat(strength, LETTERS) * np.tile(zero, LETTERS), d, rng)
            c_zero = t_one.reshape(LETTERS, LETTERS).sum(axis=0)
            t_zero = seat(c_zero, np.full(LETTERS, (s + d * t_zero.sum()) * uniform), d, rng)
            zero = (c_zero - d * t_zero + (s + d * t_zero.sum()) * uniform) / (s + c_zero.sum())
            all_one, tables_one = c_one.reshape(LETTERS, LETTERS).sum(axis=1), t_one.reshape(LETTERS, LETTERS).sum(axis=1)
            one = (c_one - d * t_one + np.repeat(s + d * tables_one, LETTERS) * np.tile(zero, LETTERS)) / np.repeat(s + all_one, LETTERS)
            if sweep >= SWEEPS - AVERAGED:
                cell += (counts - d * tables) / (s + total[at]) / AVERAGED
                share += (s + d * np.bincount(at, tables, len(self.contexts))) / (s + total) / AVERAGED
                mean_one += one / AVERAGED
        self.cell, self.share, self.one = cell, share, mean_one

    @classmethod
    def of(cls, state: dict) -> Letters:
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """log10 of each word's probability, its end included."""
        key, context, end = spelled(words)
        slot = np.searchsorted(self.keys, key)
        hit = slot < len(self.keys)
        hit[hit] = self.keys[slot[hit]] == key[hit]
        p = np.zeros(len(key))
        p[hit] = self.cell[slot[hit]]
        slot = np.searchsorted(self.contexts, context)
        known = slot < len(self.contexts)
        known[known] = self.contexts[slot[known]] == context[known]
        share = np.ones(len(key))
        share[known] = self.share[slot[known]]
        p += share * self.one[context % LETTERS * LETTERS + key % LETTERS]
        return np.add.reduceat(np.log10(p), np.concatenate(([0], end[:-1] + 1))) if len(end) else np.zeros(0)


def spelled(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all letters of the words, borders included: (context and letter as a key, context, places of the ends)."""
    if not words:
        return (np.zeros(0, np.int64),) * 3
    x = np.frombuffer(b" ".join(words) + b" ", np.uint8).astype(np.int64)
    x[x == 32] = BORDER
    before = np.concatenate(([BORDER], x[:-1]))
    earlier = np.where(before == BORDER, BORDER, np.concatenate(([BORDER], before[:-1])))
    context = earlier * LETTERS + before
    return context * LETTERS + x, context, np.flatnonzero(x == BORDER)


def tokens(text: str | None) -> list[bytes]:
    """Lower-case (A-Z) words; the end of the text, which is one more token, is the empty word and not in this list."""
    return (text or "").encode().lower().split()


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(values.tobytes(), 1)


def unpacked(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def words_in(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b" ")


def planes(values: np.ndarray) -> bytes:
    """Whole numbers, their first bytes together, then their second and so on: small ones compress to what they need. The first byte says how many there are of each."""
    size = 4 if not len(values) or int(values.max()) < 1 << 32 else 8
    return bytes([size]) + zstandard.compress(np.ascontiguousarray(values.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T).tobytes(), 1)


def from_planes(blob: bytes) -> np.ndarray:
    size = blob[0]
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(size, -1).T).reshape(-1).view(f"<u{size}").astype(np.int64)


def ids_of(words: list[bytes]) -> np.ndarray:
    digest, most = xxhash.xxh3_64_intdigest, (1 << WORD_BITS) - 1
    return np.array([digest(w) & most for w in words], np.int64)


def spread(ids: np.ndarray, salt: int, shards: int) -> np.ndarray:
    """A shard for each id."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
        return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(33)).astype(np.int64) % shards


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, kind 0, a, b, c, d): documents packed by bucket and compressed, so that texts are shuffled small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            order = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[order])) + 1
            own = [p for p in np.split(order, cut) if len(p)]
            blobs = []
            for part in own:
                sink = pa.BufferOutputStream()
                piece = batch.select(["doc_id", "learn", "text"]).take(pa.array(part))
                with pa.ipc.new_stream(sink, piece.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(piece)
                blobs.append(sink.getvalue().to_pybytes())
            none = pa.nulls(len(own), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([int(bucket[p[0]]) for p in own], pa.int32()), pa.array([TEXTS] * len(own), pa.int32()), pa.array([0] * len(own), pa.int32()), pa.array(blobs, pa.binary()), none, none, none], REPLY)

    # without an own shuffle first, a map task's many texts are packed together
    keyed = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))
    return keyed.mapInArrow(run, REPLY_SCHEMA)


#: What comes together for a bucket: its texts, what the contexts' shards answer and what the words' shards answer, in this order.
TEXTS, OF_CONTEXTS, OF_WORDS = 0, 1, 2
REPLY = ["bucket", "kind", "shard", "a", "b", "c", "d"]
REPLY_SCHEMA = "bucket int, kind int, shard int, a binary, b binary, c binary, d binary"
#: What goes to shards: questions about words and about pairs of words, and tables that words have in contexts.
WORDS, PAIRS, TABLES = 1, 2, 3
ASK = ["shard", "kind", "bucket", "a", "b", "c"]
ASK_SCHEMA = "shard int, kind int, bucket int, a binary, b binary, c binary"


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n in "abcd" else pa.int32()) for n, c in zip(names, cols)], names)


def opened(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


#: Bytes of text whose words are found at a time, and the longest words that two numbers of eight bytes have whole.
PIECE = 2 << 20
WHOLE = 16
SPACES = np.isin(np.arange(256), [32, *range(9, 14)])


def word_places(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(begin, end, first eight bytes, last eight bytes) of the words of a text, a piece at a time; what a short word lacks is zero."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not SPACES[text[end]]:
            end += 1
        own = np.frombuffer(text, np.uint8, min(end, len(text)) - at, at)
        space = np.concatenate(([True], SPACES[own], [True]))
        begin, stop = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        # the eight bytes from any place on, as one number
        wide = np.ndarray(len(own) + 1, ">u8", np.concatenate((own, np.zeros(8, np.uint8))), strides=(1,))
        n = np.minimum(stop - begin, 8).astype(np.uint64)
        shift = (np.uint64(8) - n) * np.uint64(8)
        first, last = wide[begin].astype(np.uint64), wide[np.maximum(stop - 8, begin)].astype(np.uint64)
        yield begin + at, stop + at, (first >> shift) << shift, last * (n == 8)
        at = end


def mixed(first: np.ndarray, last: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (first ^ (first >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + (last ^ (last >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93) + size.astype(np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def numbered(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(different words, number of each word of the text, where it begins); the order of words depends on nothing but which there are.

    Words are sorted by a hash of their first and last eight bytes and their length, or of all bytes of long ones, and all words of one hash are compared with one of them;
    if ever two words had one hash, the text would be numbered by a dictionary.
    """
    begin, stop, first, last = ([np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2) if not text.strip() else [np.concatenate(c) for c in zip(*word_places(text))]
    hashes = mixed(first, last, stop - begin)
    long = np.flatnonzero(stop - begin > WHOLE)
    kept = [text[b:e] for b, e in zip(begin[long].tolist(), stop[long].tolist())]
    hashes[long] = np.array([xxhash.xxh3_64_intdigest(w) for w in kept], np.uint64)
    different, number = np.unique(hashes, return_inverse=True)
    one = np.zeros(len(different), np.int64)
    one[number] = np.arange(len(number))
    same = one[number]
    clash = ((first != first[same]) | (last != last[same]) | (stop - begin != (stop - begin)[same])).any()
    seen: dict[int, bytes] = {}
    if clash or any(seen.setdefault(n, w) != w for n, w in zip(number[long].tolist(), kept)):
        every = [text[b:e] for b, e in zip(begin.tolist(), stop.tolist())]
        words = sorted(set(every))
        place = {w: i for i, w in enumerate(words)}
        return words, np.array([place[w] for w in every], np.int64), begin
    return [text[b:e] for b, e in zip(begin[one].tolist(), stop[one].tolist())], number, begin


class Bucket:
    """The words of a bucket's texts and their pairs, in an order that depends on what the bucket holds and on nothing else."""

    def __init__(self, blobs: list[bytes], shards: int, hot: np.ndarray):
        held = [opened(b) for b in blobs]
        self.docs = [h.column("doc_id") for h in held]
        texts = [t or b"" for h in held for t in h.column("text").cast(pa.large_binary()).to_pylist()]
        learn = np.array([x for h in held for x in h.column("learn").to_pylist()], bool)
        del held
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        words, number, begin = numbered(b" ".join(texts).lower())
        n_docs, end = len(texts), len(words)
        del texts
        self.words = [*words, b""]
        doc = np.searchsorted(starts, begin, "right") - 1
        self.sizes = np.bincount(doc, minlength=n_docs)[:n_docs] + 1
        # every text ends with the empty word, which is also what stands before the first word of one
        self.tokens = np.full(len(number) + n_docs, end, np.int32)
        self.tokens[np.arange(len(number)) + doc] = number
        del number, begin, doc
        wide = len(self.words)
        learn = np.repeat(learn, self.sizes)
        self.counts = np.bincount(self.tokens[learn], minlength=wide)
        before = np.concatenate(([end], self.tokens[:-1].astype(np.int64)))
        pairs, pair_of = np.unique(before * wide + self.tokens, return_inverse=True)
        self.pair_of = pair_of.astype(np.int32)
        del before, pair_of
        self.before, self.after = pairs // wide, pairs % wide
        self.pair_counts = np.bincount(self.pair_of[learn], minlength=len(pairs))
        self.ids = ids_of(self.words)
        self.word_shard = spread(self.ids, 0, shards)
        self.shard = spread(self.ids, 1, shards)[self.before]
        dealt = np.isin(self.ids, hot)[self.before]
        self.shard[dealt] = spread(self.ids[self.before[dealt]] ^ self.ids[self.after[dealt]] >> 1, 2, shards)
        self.shards = shards

    def by_shard(self, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for i in range(self.shards):
            if cut[i + 1] > cut[i]:
                yield i, order[cut[i] : cut[i + 1]]


def requests(rows: DataFrame, buckets: int, shards: int, hot: np.ndarray) -> DataFrame:
    """What each bucket asks: by word shard its different words with their training tokens, by context shard its different pairs of neighbours with theirs."""

    def flush(number: int, blobs: list[bytes]) -> pa.RecordBatch:
        own, made = Bucket(blobs, shards, hot), []
        for shard, at in own.by_shard(own.word_shard):
            made.append((shard, WORDS, number, zstandard.compress(b" ".join([own.words[i] for i in at.tolist()]), 1), packed(own.counts[at].astype(np.uint32)), None))
        for shard, at in own.by_shard(own.shard):
            ids, place = np.unique(own.ids[np.concatenate((own.before[at], own.after[at]))], return_inverse=True)
            place = place.reshape(2, -1)
            # neighbours of one word stand together, so differences of their numbers are mostly zero
            made.append((shard, PAIRS, number, planes(np.diff(ids, prepend=0)), planes(np.concatenate((np.diff(place[0], prepend=0) + len(ids), place[1]))), planes(own.pair_counts[at])))
        return batch_of(made, ASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs = None, []
        for batch in batches:
            for own, blob in zip(batch.column("bucket").to_pylist(), batch.column("a").to_pylist()):
                if own != bucket and bucket is not None:
                    yield flush(bucket, blobs)
                    blobs = []
                bucket = own
                blobs.append(blob)
        if bucket is not None:
            yield flush(bucket, blobs)
        del blobs
        release()

    ordered = bucketed(rows, buckets).repartitionById(buckets, "bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(run, ASK_SCHEMA)


def hot_contexts(rows: DataFrame, shards: int) -> np.ndarray:
    """Ids of words before which so much of the text stands that one shard shouldn't have it alone. They only settle where work is done."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column("text").to_pylist():
                found.update(tokens(text))
                found[b""] += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(list(found)), pa.int64()), pa.array(list(found.values()), pa.int64())], ["id", "n"])

    counts = rows.filter(F.pmod(F.xxhash64(F.lit(7), "doc_id", "text"), F.lit(HOT_SAMPLE)) == 0).select("text").mapInArrow(run, "id long, n long")
    counts = counts.groupBy("id").agg(F.sum("n").alias("n"))
    all_ = counts.agg(F.sum("n")).first()[0] or 0
    hot = counts.filter(F.col("n") >= max(64.0, HOT_PART * all_ / shards)).select("id").toArrow()  # no more than shards / HOT_PART
    return np.sort(hot.column("id").to_numpy())


def by_shard(asked: DataFrame, shards: int, work, schema: str) -> DataFrame:
    """``work(shard, parts)`` for each shard's messages, parts being (kind, bucket, a, b, c), compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts = None, []
        for batch in batches:
            for own, *part in zip(*[batch.column(c).to_pylist() for c in ASK]):
                if own != shard and shard is not None:
                    yield from work(shard, parts)
                    parts = []
                shard = own
                parts.append(part)
        if shard is not None:
            yield from work(shard, parts)
        del parts
        release()

    return asked.select(*ASK).repartitionById(shards, "shard").sortWithinPartitions("shard", "kind", "bucket").mapInArrow(run, schema)


def discount_of(customers: np.ndarray) -> float:
    once, twice = int((customers == 1).sum()), int((customers == 2).sum())
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def seated(asked: DataFrame, shards: int, hot: np.ndarray) -> DataFrame:
    """The contexts' restaurants: replies to buckets (to, a: pairs' customers less discounted tables, b: contexts' customers, c: strength and discounted tables), and tables for the words' shards.

    A shard has whole contexts, so their restaurants and, over those, a restaurant of words that all its contexts share as their parent
    are seated together, sweep by sweep. A context that is dealt to all shards has a part of its dishes in each; there, its tables
    elsewhere are taken to be as many as here, and what the parts have in all is added up by the reader (kind TABLES, bucket -1).
    """

    def work(shard: int, parts: list) -> Iterator[pa.RecordBatch]:
        ids, befores, afters, counts = [], [], [], []
        for _, _, a, b, c in parts:
            own = np.cumsum(from_planes(a))
            place = from_planes(b).reshape(2, -1)
            place[0] = np.cumsum(place[0] - len(own))
            ids.append(own)
            befores.append(place[0].astype(np.int32))
            afters.append(place[1].astype(np.int32))
            counts.append(from_planes(c).astype(np.int32))
        every, at = np.unique(np.concatenate(ids), return_inverse=True)
        at = np.split(at.astype(np.int32), np.cumsum([len(i) for i in ids])[:-1])
        key = np.concatenate([w[u].astype(np.int64) << 32 | w[v] for w, u, v in zip(at, befores, afters)])
        del afters
        pairs, place = np.unique(key, return_inverse=True)
        del key
        place = place.astype(np.int32)
        customers = np.bincount(place, np.concatenate(counts), len(pairs)).astype(np.int64)
        u, w = (pairs >> 32).astype(np.int32), (pairs & 0xFFFFFFFF).astype(np.int32)
        del pairs
        live = np.flatnonzero(customers)
        c, lu, lw, n = customers[live], u[live], w[live], len(every)
        total = np.bincount(u, customers, n)
        times = np.where(np.isin(every, hot), shards, 1)
        d, rng = discount_of(c), np.random.default_rng(shard)
        tables, many = np.ones(len(c), np.int64), np.flatnonzero(c > 1)  # one customer has one table
        kept, made = np.zeros(len(c)), np.zeros(n)
        words = np.bincount(lw, tables, n).astype(np.int64)
        d_word, base = discount_of(words), 1.0 / max(1, (words > 0).sum())
        own = (words > 0).astype(np.int64)
        for sweep in range(SWEEPS):
            own = seat(words, np.full(n, (STRENGTH + d_word * own.sum()) * base), d_word, rng)
            share = (words - d_word * own + (STRENGTH + d_word * own.sum()) * base) / (STRENGTH + words.sum())
            at_u = np.bincount(lu, tables, n) * times
            tables[many] = seat(c[many], (STRENGTH + d * at_u)[lu[many]] * share[lw[many]], d, rng)
            words = np.bincount(lw, tables, n).astype(np.int64)
            if sweep >= SWEEPS - AVERAGED:
                kept += (c - d * tables) / AVERAGED
                made += d * np.bincount(lu, tables, n) / AVERAGED
        share = np.zeros(len(u), np.float32)
        share[live] = kept
        dealt = np.flatnonzero((times > 1) & (total > 0))
        yield batch_of([(0, TABLES, -1, 0, np.stack([every[dealt], total[dealt], made[dealt]]).astype(float).tobytes(), None, None, None)], ["to", "kind", "bucket", "shard", "a", "b", "c", "d"])
        which = np.flatnonzero(words)
        to = spread(every[which], 0, shards)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(shards + 1))
        for i in np.flatnonzero(np.diff(cut)).tolist():
            mine = which[order[cut[i] : cut[i + 1]]]
            yield batch_of([(i, TABLES, shard, shard, planes(np.diff(every[mine], prepend=0)), planes(words[mine]), None, None)], ["to", "kind", "bucket", "shard", "a", "b", "c", "d"])
        ends = np.cumsum([len(b) for b in befores])
        for (_, bucket, *_), local, before, end in zip(parts, at, befores, ends.tolist()):
            mine = local[before[np.append(True, before[1:] != before[:-1])]]  # each context of the message once
            reply = (bucket, OF_CONTEXTS, bucket, shard, packed(share[place[end - len(before) : end]]), packed(total[mine].astype(np.uint64)), packed((STRENGTH + made[mine]).astype(np.float32)), None)
            yield batch_of([reply], ["to", "kind", "bucket", "shard", "a", "b", "c", "d"])

    return by_shard(asked, shards, work, "to int, kind int, bucket int, shard int, a binary, b binary, c binary, d binary")


def counted(parts: list) -> tuple[list[bytes], dict[bytes, int], np.ndarray, np.ndarray]:
    """(words, their places, training tokens, customers) of a word shard. A word's customers are its tables in all contexts."""
    total: dict[bytes, int] = {}
    for kind, _, a, b, _ in parts:
        if kind == WORDS:
            for word, n in zip(words_in(a), unpacked(b, np.uint32).tolist()):
                total[word] = total.get(word, 0) + n
    words = list(total)
    ids = ids_of(words)
    order = np.argsort(ids)
    customers = np.zeros(len(words), np.int64)
    for kind, _, a, b, _ in parts:
        if kind == TABLES:
            at = np.searchsorted(ids[order], np.cumsum(from_planes(a)))
            np.add.at(customers, order[at], from_planes(b))
    n = np.fromiter(total.values(), np.int64, len(words))
    return words, {w: i for i, w in enumerate(words)}, n, np.where(n > 0, np.maximum(customers, 1), 0)


def statistics(asked: DataFrame, shards: int) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """Numbers of training tokens (-1), of different words (-2), of those with one table in contexts (-3) and with two (-4), of all tables (-5); and the counts of letters in the words, by key.

    At most 257 to the power of 3 keys, however much text there is.
    """

    def work(shard: int, parts: list) -> Iterator[pa.RecordBatch]:
        words, _, n, customers = counted(parts)
        key = spelled([w for w, c in zip(words, n.tolist()) if c])[0]
        keys, counts = np.unique(key, return_counts=True)
        keys = np.concatenate((keys, [-1, -2, -3, -4, -5]))
        counts = np.concatenate((counts, [n.sum(), (n > 0).sum(), (customers == 1).sum(), (customers == 2).sum(), customers.sum()]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], ["key", "n"])

    sums = by_shard(asked, shards, work, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, counts = sums.column("key").to_numpy(), sums.column("n").to_numpy()
    return {int(k): int(c) for k, c in zip(keys, counts) if k < 0}, keys[keys >= 0], counts[keys >= 0]


def answers(asked: DataFrame, shards: int, letters: Letters, discount: float, types: int) -> DataFrame:
    """Replies to buckets (a training tokens, b customers less discounted tables, c log10 letters, in the order asked), and once a shard (bucket -1) its mean number of tables and its known words' sum of spelling probabilities.

    Words' customers are seated by Gibbs sweeps, each dish's all anew given the number of tables; the spelling probability is the parent's.
    """
    state = asked.sparkSession.sparkContext.broadcast(vars(letters))

    def work(shard: int, parts: list) -> Iterator[pa.RecordBatch]:
        words, place, n, customers = counted(parts)
        logs = np.concatenate([np.zeros(0), *[Letters.of(state.value).log_words(words[i : i + 100_000]) for i in range(0, len(words), 100_000)]])
        rng = np.random.default_rng(shard)
        mine, mean, all_tables = max(1, int((n > 0).sum())), np.zeros(len(n)), float(types)
        for sweep in range(SWEEPS):
            tables = seat(customers, (STRENGTH + discount * all_tables) * 10.0**logs, discount, rng)
            all_tables = types * tables.sum() / mine
            if sweep >= SWEEPS - AVERAGED:
                mean += tables / AVERAGED
        yield batch_of([(-1, OF_WORDS, shard, np.array([mean.sum(), (10.0 ** logs[n > 0]).sum()]).tobytes(), None, None, None)], REPLY)
        left = customers - discount * mean
        for kind, bucket, a, _, _ in parts:
            if kind == WORDS:
                at = np.array([place[w] for w in words_in(a)])
                yield batch_of([(bucket, OF_WORDS, shard, packed(n[at].astype(np.uint64)), packed(left[at]), packed(logs[at].astype(np.float32)), None)], REPLY)

    return by_shard(asked, shards, work, REPLY_SCHEMA)


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, spelled_score) of every row's whole text.

    The model is a hierarchy of Pitman-Yor restaurants: one for each word that stands before another (and for a text's beginning), which share the
    restaurant of words as their parent; its parent spells words by letters: restaurants for the two letters before, which share those
    for one letter before as parents, which share the one for none, over equal chances. A restaurant's tables are its parent's customers.
    Seats are sampled by Gibbs sweeps from below upwards, and what several sweeps give is averaged.
    While the contexts are seated, a shard's own restaurant of words stands for that of all shards; the predictive probabilities then use the one over all tables.

    ``score`` is the log10 of the predictive probabilities of the text's tokens, its end among them, each given the one before, where any word not seen in training is the one outcome
    that the base has for it too (V + 1 outcomes, whose probabilities add up to one in every context). ``spelled_score`` also spells those words out, and so
    adds up to one over all words there could be.

    All training texts are counted. Documents go to buckets, words and contexts to shards, by hash: a bucket asks each shard once for its
    different words and its different pairs, so either costs the same however frequent it is, and nobody holds the whole vocabulary. A word that stands
    before much of the text is dealt to all shards by what follows. The letters' tables are bounded by the number of letters and are broadcast. In the contexts a
    word is its 48-bit hash.

    ``learn`` is the condition, on ``doc_id``, of rows to learn from. Null or empty text: only the end. Nothing to learn
    from: equal chances of letters. Null or repeated ids: each row is returned. Empty table: no rows. Other columns don't matter.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]
    id_type = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    rows = rows.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), learn.alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets, shards = int(size // bucket_bytes + 1), int(size // shard_bytes + 1)
    hot = hot_contexts(rows, shards)
    asked = spooled(requests(rows, buckets, shards, hot), by="kind")
    found = spooled(seated(asked.filter(F.col("kind") == PAIRS), shards, hot), by="kind")
    discard(asked, f"kind={PAIRS}")
    parts: dict[int, list[float]] = {}
    for row in found.filter((F.col("kind") == TABLES) & (F.col("bucket") == -1)).select("a").collect():  # a row for each shard, as long as ``hot`` at most
        for own, *more in np.frombuffer(row["a"]).reshape(3, -1).T.tolist():
            parts[int(own)] = [x + y for x, y in zip(parts.get(int(own), [0.0, STRENGTH]), more)]
    tables = found.filter((F.col("kind") == TABLES) & (F.col("bucket") >= 0)).select(F.col("to").alias("shard"), "kind", "bucket", "a", "b", "c")
    words = asked.filter(F.col("kind") == WORDS).select(*ASK).unionByName(tables)
    known, keys, counts = statistics(words, shards)
    n, types, all_customers = known.get(-1, 0), known.get(-2, 0), known.get(-5, 0)
    once, twice = known.get(-3, 0), known.get(-4, 0)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    replies = spooled(answers(words, shards, Letters(keys, counts), discount, types))
    discard(asked)
    sums = np.sum([np.frombuffer(r["a"]) for r in replies.filter("bucket = -1").select("a").collect()], axis=0) if n else np.zeros(2)  # two numbers a shard
    base_all = float(np.log10(n + 0.1 * (types + 1)))
    fresh, customers = STRENGTH + discount * float(sums[0]), STRENGTH + all_customers
    unseen = fresh * max(1e-12, 1.0 - float(sums[1])) / customers

    def scored(blobs: list[bytes], said: dict[int, dict[int, list[bytes]]]) -> pa.RecordBatch:
        own = Bucket(blobs, shards, hot)
        c, left, spelt = np.zeros(len(own.words)), np.zeros(len(own.words)), np.zeros(len(own.words))
        for shard, at in own.by_shard(own.word_shard):
            a, b, d = said[OF_WORDS][shard]
            c[at], left[at], spelt[at] = unpacked(a, np.uint64), unpacked(b, np.float64), unpacked(d, np.float32)
        spelled_p = (left + fresh * 10.0**spelt) / customers
        p = np.where(c > 0, spelled_p, unseen)
        kept, total, more = np.zeros(len(own.before)), np.zeros(len(own.words)), np.zeros(len(own.words))
        for shard, at in own.by_shard(own.shard):
            a, b, d = said[OF_CONTEXTS][shard]
            kept[at] = unpacked(a, np.float32)
            first = own.before[at]
            first = first[np.append(True, first[1:] != first[:-1])]
            total[first], more[first] = unpacked(b, np.uint64), unpacked(d, np.float32)
        for i in np.flatnonzero(np.isin(own.ids, hot)).tolist():
            total[i], more[i] = parts.get(int(own.ids[i]), [0.0, STRENGTH])
        scale = np.log10(STRENGTH + total)[own.before]
        logs, spelled_logs = (np.log10(kept + more[own.before] * x[own.after]) - scale for x in (p, spelled_p))
        starts = np.cumsum(own.sizes) - own.sizes
        sums = [np.add.reduceat(x, starts) for x in ((c > 0)[own.tokens].astype(np.int64), (np.log10(c + 0.1) - base_all)[own.tokens], logs[own.pair_of], spelled_logs[own.pair_of])]
        ids = pa.chunked_array([chunk for d in own.docs for chunk in d.chunks], own.docs[0].type).combine_chunks().cast(id_type)
        return pa.RecordBatch.from_arrays([ids, pa.array(own.sizes), pa.array(sums[0]), pa.array(np.full(len(ids), n, np.int64)), *map(pa.array, sums[1:])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, blobs, said = None, [], {OF_CONTEXTS: {}, OF_WORDS: {}}
        for batch in batches:
            for own, what, shard, *rest in zip(*[batch.column(c).to_pylist() for c in REPLY]):
                if own != bucket:
                    if blobs:
                        yield scored(blobs, said)
                    bucket, blobs, said = own, [], {OF_CONTEXTS: {}, OF_WORDS: {}}
                if what == TEXTS:
                    blobs.append(rest[0])
                else:
                    said[what][shard] = rest[:3]
        if blobs:
            yield scored(blobs, said)
        del blobs, said
        release()

    both = bucketed(rows, buckets).unionByName(found.filter(F.col("kind") == OF_CONTEXTS).select(*REPLY)).unionByName(replies.filter("bucket >= 0"))
    ordered = both.repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "kind")
    return ordered.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, spelled_score double")


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 10) != 0)
    return found.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "spelled_score")
