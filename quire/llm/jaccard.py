"""Near-duplicates by the similarity of their shingle sets: tries of fingerprints joined with themselves, then exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import discard, pick, release, sliced, spooled
from quire.llm.components import components
from quire.llm.simhash import forest, traverse
from quire.llm.suffixes import likely

WORDS = 5
LEAST = 0.8
#: Differing bits up to which two fingerprints are looked at: of the 64 that tries have, and of 128 and 256 beyond those. Sets that are similar enough differ in
#: each bit with a chance of about 0.15, and of 0.19 at the most where they are small (``FEW``), so more bits than these differ in fewer than one of a million such pairs.
BUDGET = 28
WIDER = {2: 42, 4: 70}
WIDER_FEW = {2: 47, 4: 82}
FEW = 20
#: Entries of prefixes that a task joins at once, shingles of a task's texts, pairs that are looked at together.
HELD_ROWS = 1 << 17
CELL = 4_000_000
AT_ONCE = 4096
MIXERS = (1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)
#: One text in so many tells which shingles are frequent; that often there, and so many of them at most.
SAMPLE = 32
OFTEN = 3
MOST_FREQUENT = 100_000


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the different runs of ``words`` lower-case words, or of all of a shorter text; none of a text without words."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64))


def fingerprint(hashes: np.ndarray, parts: int = 1) -> np.ndarray:
    """64 bits for each part: one is set if more than half of the different shingles' hashes have it. Parts after the first are of the hashes mixed anew."""
    made = np.zeros(parts, np.uint64)
    with np.errstate(over="ignore"):
        for part in range(parts):
            ones = np.zeros(64, np.int64)
            for at in range(0, len(hashes), 1 << 16):
                own = hashes[at : at + (1 << 16)]
                if part:
                    own = (own ^ (own >> np.uint64(29))) * np.uint64(MIXERS[part])
                    own ^= own >> np.uint64(32)
                ones += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            made[part] = int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")
    return made


def near(fps: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows of ``fps`` are near enough in all parts."""
    parts = fps.shape[1]
    bits = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)
    return bits <= np.where(np.minimum(sizes[i], sizes[j]) < FEW, WIDER_FEW[parts], WIDER[parts])


def prefix(hashes: np.ndarray, frequent: np.ndarray, least: float) -> np.ndarray:
    """The first of the hashes in one order of all, the frequent last: two sets whose similarity is ``least`` or more share one of theirs."""
    n = len(hashes)
    take = n - int(np.ceil(least * n - 1e-9)) + 1 if n else 0
    slot = np.searchsorted(frequent, hashes)
    often = slot < len(frequent)
    often[often] = frequent[slot[often]] == hashes[often]
    return np.concatenate((hashes[~often], hashes[often]))[:take]


def frequent_shingles(rows: DataFrame, words: int, sample: int = SAMPLE) -> np.ndarray:
    """Sorted hashes of shingles that a sample of the texts has often. They only order prefixes, so what they miss costs time and no pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [shingles(t or b"", words) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(made).view(np.int64))], ["hash"])

    some = rows.filter(F.pmod("text_key", F.lit(sample)) == 0).select("text").mapInArrow(run, "hash long")
    counts = some.groupBy("hash").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "hash").limit(MOST_FREQUENT)
    return np.sort(counts.select("hash").toArrow().column("hash").to_numpy().view(np.uint64))


def candidates(nodes: DataFrame) -> DataFrame:
    """(u, v) links between text keys of ``nodes`` (text_key, fp, prefix) that connect all that share a shingle of their prefixes and have fingerprints within ``BUDGET``.

    The texts of one shingle are a binary trie by their fingerprints, which is joined with itself; a task gives the links of a spanning forest of
    all its shingles' pairs, at most one a text, never all pairs.
    """
    each = nodes.select("text_key", F.least("size", F.lit(FEW)).cast("byte").alias("size"), "fp", "fp2", F.explode("prefix").alias("hash")).repartition("hash").sortWithinPartitions("hash", F.expr("fp ^ shiftleft(1L, 63)"))

    def made(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(parts)
        key, hashes, size = (both.column(c).to_numpy() for c in ("text_key", "hash", "size"))
        fps = np.stack([both.column(c).to_numpy().view(np.uint64) for c in ("fp", "fp2")], 1)
        first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
        end = np.append(first[1:], len(hashes))
        many = end - first > 1
        first, end = first[many], end[many]
        texts, own = np.unique(key, return_inverse=True)
        pairs = np.stack([first, end, first, end, np.zeros_like(first)], 1)
        found = ((i[good], j[good]) for i, j in traverse(fps[:, 0].copy(), pairs, 0, BUDGET) if (good := near(fps, size, i, j)).any())
        root = forest(len(texts), ((own[i], own[j]) for i, j in found))
        linked = np.flatnonzero(root != np.arange(len(texts)))
        return pa.RecordBatch.from_arrays([pa.array(texts[linked]), pa.array(texts[root[linked]])], ["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            hashes = batch.column("hash").to_numpy()
            last = int(np.searchsorted(hashes, hashes[-1]))  # a shingle stays in one piece
            if rows >= HELD_ROWS and (last or held[-1].column("hash")[-1].as_py() != hashes[0]):
                yield made([*held, batch.slice(0, last)])
                held, rows, batch = [], 0, batch.slice(last)
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield made(held)
        release()

    return each.mapInArrow(join, "u long, v long").distinct()


def verified(texts: list[bytes], words: int, least: float) -> np.ndarray:
    """The least index that each text is linked with over pairs that are similar enough; pairs that other pairs have linked already are not looked at."""
    sets = [shingles(t, words) for t in texts]
    sizes = np.array([len(s) for s in sets])
    fps = np.array([fingerprint(s, 4) for s in sets])
    order = np.argsort(fps[:, 0], kind="stable")
    root = np.arange(len(texts))
    n = len(texts)
    for i, j in traverse(fps[order, 0], np.array([[0, n, 0, n, 0]]), 0, BUDGET):
        i, j = order[i], order[j]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        good = near(fps, sizes, i, j) & (least * np.maximum(sizes[i], sizes[j]) - 1e-9 <= np.minimum(sizes[i], sizes[j]))
        i, j = i[good], j[good]
        for at in range(0, len(i), AT_ONCE):
            a, b = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
            apart = root[a] != root[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                if root[x] != root[y]:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if both >= least * (len(sets[x]) + len(sets[y]) - both) - 1e-9:
                        low, high = sorted((root[x], root[y]))
                        root[root == high] = low
    return root


def similar(rows: DataFrame, nodes: DataFrame, words: int, least: float, cell: int = CELL) -> DataFrame:
    """(u, v) links between text keys of ``nodes`` whose texts, in ``rows``, are similar enough; they connect all such.

    Each text that has a candidate goes, once, to the task of all that candidates connect it with. Where those have more than ``cell`` shingles, they
    are cut into blocks, and a task has two blocks.
    """
    asked = spooled(components(candidates(nodes)))
    asked = asked.unionByName(asked.select(F.col("root").alias("node"), "root").distinct())
    asked = nodes.select("text_key", "size").join(asked, F.col("text_key") == F.col("node")).select(F.col("text_key").alias("_key"), "size", "root")
    blocks = asked.groupBy("root").agg(F.ceil(F.sum("size") / cell).cast("int").alias("blocks")).filter("blocks > 1").withColumnRenamed("root", "_root")
    asked = asked.join(blocks, F.col("root") == F.col("_root"), "left").select("_key", "root", F.coalesce("blocks", F.lit(1)).alias("blocks"))
    asked = spooled(asked)
    test = likely(asked, asked.count(), "_key")
    texts = rows.filter(test(F.col("text_key"))).join(asked, F.col("text_key") == F.col("_key")).dropDuplicates(["text_key"])
    own = F.pmod("text_key", "blocks").cast("int")
    texts = texts.select("text_key", "text", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    texts = texts.select("text_key", "text", "root", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, texts = None, [], []

        def made() -> pa.RecordBatch:
            root = verified(texts, words, least)
            at = np.flatnonzero(root != np.arange(len(root)))
            own = np.array(keys, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(own[root[at]])], ["u", "v"])

        for batch in sliced(batches):
            for root, low, high, key, text in zip(*(batch.column(c).to_pylist() for c in ("root", "low", "high", "text_key")), batch.column("text").cast(pa.large_binary()).to_pylist()):
                if (root, low, high) != held:
                    if len(keys) > 1:
                        yield made()
                    held, keys, texts = (root, low, high), [], []
                keys.append(key)
                texts.append(text or b"")
        if len(keys) > 1:
            yield made()
        release()

    return texts.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high", "text_key").mapInArrow(verify, "u long, v long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the least id's (nulls last), repeated rows counting once.

    Rows are linked if the Jaccard similarity of their sets of ``words``-word shingles is ``least`` or more, and groups are what links
    connect. Fingerprints of such pairs differ in up to some 20 of 64 bits, too many for tries of all fingerprints; so there is a
    trie for each shingle, of the texts that have it among the first of their set, which no similar pair fails to share. What is left of the
    tries' self-joins is verified on the sets. Equal sets are one node, so copies, however many, are never expanded into pairs.

    Null, empty or blank text: no shingles, one group. Empty table: no rows. All columns stay.
    """
    rows = pick(docs, doc_id=id_col, text=text_col).withColumn("text_key", F.xxhash64("text"))
    kind = dict(rows.dtypes)["doc_id"]
    frequent = rows.sparkSession.sparkContext.broadcast(frequent_shingles(rows, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sets = [shingles(t or b"", words) for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            fp = np.array([fingerprint(s, 2) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
            size = pa.array([len(s) for s in sets], pa.int32())
            first = pa.array([(prefix(s, frequent.value, least) >> np.uint64(32)).astype(np.uint32).view(np.int32) for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(node), size, pa.array(fp[:, 0].copy()), pa.array(fp[:, 1].copy()), first], ["doc_id", "text_key", "node", "size", "fp", "fp2", "prefix"])

    prints = rows.select("doc_id", "text_key", "text").mapInArrow(run, f"doc_id {kind}, text_key long, node long, size int, fp long, fp2 long, prefix array<int>")
    nodes = prints.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("kept"), *[F.first(c).alias(c) for c in ("size", "fp", "fp2", "prefix")])
    nodes = spooled(nodes.select(F.col("kept.text_key").alias("text_key"), "kept", "size", "fp", "fp2", "prefix"))
    roots = components(similar(rows.select("text_key", "text"), nodes, words, least, cell))
    rooted = nodes.select("text_key", "kept").join(roots, F.col("text_key") == F.col("node"), "left")
    kept = rooted.groupBy(F.coalesce("root", "text_key")).agg(F.min("kept").alias("_kept"))
    kept = spooled(kept.select(F.xxhash64("_kept.doc_id", "_kept.text_key").alias("_key")))
    discard(nodes)
    names = docs.columns
    flat = docs.toDF(*[f"__{i}" for i in range(len(names))])
    own = F.xxhash64(f"__{names.index(id_col)}", F.xxhash64(f"__{names.index(text_col)}"))
    return flat.withColumn("_key", own).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key").toDF(*names)
