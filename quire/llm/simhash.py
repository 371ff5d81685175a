"""SimHash near-duplicates by a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import durable, pick, sliced, table
from quire.llm.components import components

SHINGLE_WORDS = 3
BUDGET = 3
#: Fingerprints of one trie that a task joins at once; a fuller trie is cut into pairs of its nodes.
NODE_ROWS = 1_000_000
#: Node pairs of at most this many fingerprint pairs are compared one by one.
LEAF_PAIRS = 64
PAIRS_AT_ONCE = 1 << 20


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text: a bit is set if more than half of its shingles' hashes have it."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = b"".join([digest(joined[s:e], 42) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, text_key, fp) of every row; a null text is an empty one, with fingerprint zero."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = batch.column("text").cast(pa.large_binary()).to_pylist()
            fps = np.array([fingerprint(t or b"", words) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"])

    return rows.withColumn("text_key", F.xxhash64("text")).mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def expand(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs of the range pairs [a0, a1) x [b0, b1), a bounded number at a time."""
    per = (a1 - a0) * (b1 - b0)
    cut = np.flatnonzero(np.diff(np.cumsum(per) // PAIRS_AT_ONCE, prepend=0)) if len(per) else []
    for part in np.split(np.arange(len(per)), cut):
        if not len(part):
            continue
        n, wide = per[part], (b1 - b0)[part]
        each = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(wide, n)
        yield np.repeat(a0[part], n) + each // wide, np.repeat(b0[part], n) + each % wide


def traverse(keys: np.ndarray, pairs: np.ndarray, depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of ``keys`` that differ in at most ``budget`` bits.

    ``pairs`` are trie node pairs, a row (a0, a1, b0, b1, differing bits) each; a node is a range of
    the sorted keys that share their first ``depth`` bits. The walk goes down both nodes of
    a pair together, one bit at a time: equal branches keep the count of differing bits, unequal
    ones add one, and pairs beyond the budget are dropped. Levels are walked for all pairs at
    once, in pieces of bounded size.
    """
    stack = [(pairs, depth)]
    while stack:
        at, depth = stack.pop()
        same = at[:, 0] == at[:, 2]
        size = (at[:, 1] - at[:, 0]) * (at[:, 3] - at[:, 2])
        leaf = (size <= LEAF_PAIRS) | (depth >= 64)
        for i, j in expand(*at[leaf, :4].T):
            near = (np.bitwise_count(keys[i] ^ keys[j]) <= budget) & (i < j)
            if near.any():
                yield i[near], j[near]
        at, same = at[~leaf], same[~leaf]
        if not len(at):
            continue
        if len(at) > PAIRS_AT_ONCE // 8:
            half = len(at) // 2
            stack += [(at[:half], depth), (at[half:], depth)]
            continue
        bit = np.uint64(63 - depth)
        lo, hi = int(at[:, 0].min()), int(at[:, [1, 3]].max())
        ones = np.concatenate(([0], np.cumsum((keys[lo:hi] >> bit) & np.uint64(1)).astype(np.int64)))
        a0, a1, b0, b1, d = at.T
        am, bm = a1 - (ones[a1 - lo] - ones[a0 - lo]), b1 - (ones[b1 - lo] - ones[b0 - lo])
        crossed = ~same
        down = [
            np.stack([a0, am, b0, bm, d], 1),
            np.stack([am, a1, bm, b1, d], 1),
            np.stack([a0, am, bm, b1, d + 1], 1),
            np.stack([am, a1, b0, bm, d + 1], 1)[crossed],
        ]
        down = np.concatenate(down)
        stack.append((down[(down[:, 1] > down[:, 0]) & (down[:, 3] > down[:, 2]) & (down[:, 4] <= budget)], depth + 1))


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The least index that each of ``n`` nodes is linked with, over any number of steps."""
    root = np.arange(n)
    for i, j in links:
        while True:
            i, j = root[i], root[j]
            open_ = i != j
            if not open_.any():
                break
            i, j = i[open_], j[open_]
            np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
            while (up := root[root])[i].tolist() != root[i].tolist() or (up != root).any():
                root = up
    return root


def links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(u, v) links that connect all fingerprints ``fp`` within ``budget`` bits of each other.

    Two such fingerprints agree in one of ``budget + 1`` blocks of bits. For each block there is a trie
    of the fingerprints rotated to begin with it, and the tries' nodes at that depth are
    dealt to tasks; a task walks its nodes against themselves. A node with more than
    ``node_rows`` fingerprints is cut further: its descendants go to tasks in pairs, those
    pairs alone whose differing bits are within the budget. A task gives, for each batch of
    nodes, the links of a spanning forest, at most one a fingerprint, never all pairs.
    """
    blocks = budget + 1
    width = 64 // blocks
    rotate = [(F.lit(b), F.col("fp").bitwiseOR(F.lit(0)) if not b else F.shiftleft("fp", b * width).bitwiseOR(F.shiftrightunsigned("fp", 64 - b * width))) for b in range(blocks)]
    tries = distinct.select(F.inline(F.array(*[F.struct(b.alias("trie"), key.alias("key")) for b, key in rotate]))).withColumn("node", F.shiftrightunsigned("key", 64 - width))
    full = tries.groupBy("trie", "node").count().filter(F.col("count") > node_rows)
    full = full.select("trie", "node", F.ceil(F.log2(F.col("count") / node_rows)).cast("int").alias("deeper"))
    own = F.expr(f"shiftrightunsigned(shiftleft(key, {width}), 64 - deeper)")
    partner = F.expr(f"transform(filter(sequence(0L, shiftleft(1L, deeper) - 1), m -> bit_count(m) <= {budget}), m -> struct(least(own, own ^ m) AS low, greatest(own, own ^ m) AS high))")
    cut = tries.join(full, ["trie", "node"], "left").withColumn("deeper", F.coalesce("deeper", F.lit(0)))
    whole = cut.filter("deeper = 0").select("trie", "node", "deeper", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "key")
    pieces = cut.filter("deeper > 0").withColumn("own", own).select("trie", "node", "deeper", "key", F.inline(partner)).select("trie", "node", "deeper", "low", "high", "key")
    cells = whole.unionByName(pieces)
    cells = cells.repartition("trie", "node", "low", "high").sortWithinPartitions("trie", "node", "deeper", "low", "high", F.expr("key ^ shiftleft(1L, 63)"))

    def joined(batch: pa.Table) -> pa.RecordBatch:
        trie, node, deeper, low, high, key = (batch.column(c).to_numpy() for c in ("trie", "node", "deeper", "low", "high", "key"))
        keys, n = key.view(np.uint64), len(key)
        new = np.flatnonzero(np.concatenate(([True], (trie[1:] != trie[:-1]) | (node[1:] != node[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
        end = np.append(new[1:], n)
        found = np.arange(n)
        for extra in np.unique(deeper):
            mine = deeper[new] == extra
            s, e = new[mine], end[mine]
            apart = low[s] != high[s]
            bits = np.bitwise_count(low[s] ^ high[s]).astype(np.int64)
            split = s.copy()
            if apart.any():  # of two nodes, the lower one's keys come first
                lower = ((keys << np.uint64(width)) >> np.uint64(64 - int(extra))) if extra else np.zeros(n, np.uint64)
                upper = np.concatenate(([0], np.cumsum(lower.astype(np.int64) != np.repeat(low[new], end - new))))
                split = e - (upper[e] - upper[s])
            pairs = np.stack([s, np.where(apart, split, e), np.where(apart, split, s), e, bits], 1)
            root = forest(n, traverse(keys, pairs[(pairs[:, 1] > pairs[:, 0]) & (pairs[:, 3] > pairs[:, 2])], width + int(extra), budget))
            found = np.where(root < found, root, found)
        linked = np.flatnonzero(found != np.arange(n))
        back = lambda i: ((keys[i] >> (w := (trie[i] * width).astype(np.uint64))) | np.where(w > 0, keys[i] << ((np.uint64(64) - w) % np.uint64(64)), np.uint64(0))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(back(linked)), pa.array(back(found[linked]))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in ("trie", "node", "low", "high")]
            last = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
            cut = int(last[-1]) + 1 if len(last) else 0
            first = held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in ("trie", "node", "low", "high"))
            if rows >= 1 << 17 and (cut or first):
                yield joined(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, rows = [batch.slice(cut)], batch.num_rows - cut
            else:
                held.append(batch)
                rows += batch.num_rows
        if rows:
            yield joined(pa.Table.from_batches(held))

    return cells.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, text_key, fp, component_id) of every row; rows are linked if their fingerprints differ in at most ``budget`` bits.

    ``component_id`` is the least doc_id that is reachable by links. Equal fingerprints are one node
    of the graph, so copies, however many, are never expanded into pairs.

    Null or empty text: fingerprint zero, linked like any other. Null doc_id: the row is
    linked but never gives a component its id (null, if all are null). Repeated rows are all
    returned. Empty table: no rows. Other columns don't matter.
    """
    prints = durable(fingerprints(docs, id_col, text_col, words))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("fp"), budget, node_rows))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(rooted.select("fp", "root").join(ids, "root").drop("root"), "fp")


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the least doc_id's (nulls last), repeated rows counting once."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_kept")
    groups = near_duplicates(docs, **params)
    # a group without any id has no component_id of its own: its fingerprints stand for it
    kept = groups.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("_fp")).agg(first)
    kept = kept.select(F.xxhash64("_kept.doc_id", "_kept.text_key").alias("_key"))
    names = docs.columns
    flat = docs.toDF(*[f"__{i}" for i in range(len(names))])
    own = F.xxhash64(f"__{names.index('doc_id')}", F.xxhash64(f"__{names.index('text')}"))
    return flat.withColumn("_key", own).join(kept, "_key", "left_semi").dropDuplicates(["_key"]).drop("_key").toDF(*names)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
