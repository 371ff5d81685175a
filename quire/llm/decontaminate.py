"""Benchmark decontamination by the q-gram lemma and banded alignment."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import pick, sliced, table
from quire.llm.suffixes import rolling

#: Edits allowed, as a share of an item's characters, and the longest gram.
EDITS = 0.08
GRAM = 10
#: Items shorter than this, after normalising, must be there without an edit and as whole words.
LEAST_CHARS = 20
#: Characters of benchmark text in one index (about 30 bytes a character), which is broadcast; a longer benchmark is taken in several passes.
INDEX_CHARS = 2_000_000
#: Characters of documents and alignment cells handled at a time.
CHUNK = 1 << 20
CELLS = 1 << 20
END = "\U0010ffff"
U = np.uint64


def fold_table() -> np.ndarray:
    """Lower case of each code point of the basic plane, where that is one code point; a space for all white space."""
    chars = [chr(i) for i in range(0x10000)]
    return np.array([32 if c.isspace() else ord(low) if len(low := c.lower()) == 1 else i for i, c in enumerate(chars)], np.uint32)


def fold(text: str, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, their places in ``text``) in lower case, with one space for each run of white space."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.where(codes < 0x10000, lower[np.minimum(codes, 0xFFFF)], codes)
    space = codes == 32
    keep = np.flatnonzero(~(space & np.concatenate(([False], space[:-1]))))
    return codes[keep], keep


def stripped(codes: np.ndarray) -> np.ndarray:
    lo, hi = int(len(codes) > 0 and codes[0] == 32), len(codes)
    return codes[lo : hi - int(hi > lo and codes[-1] == 32)]


def gram_for(chars: int, edits: int, most: int) -> int:
    """The longest gram of which a match with ``edits`` edits must share at least one (the q-gram lemma)."""
    return max(1, min(most, chars // (edits + 1)))


def word_table() -> np.ndarray:
    """Whether each code point of the basic plane is a letter or digit."""
    return np.array([chr(i).isalnum() for i in range(0x10000)], bool)


class Index:
    """The grams of benchmark items, by gram length: sorted fingerprints with item and place, and a bit table to look up first."""

    def __init__(self, items: list[tuple[object, str]], edits: float = EDITS, gram: int = GRAM, least_chars: int = LEAST_CHARS):
        lower = fold_table()
        self.lower, self.ids, self.codes, self.edits, self.grams = lower, [], [], [], {}
        self.wordy, self.short = word_table(), {}
        by, short = defaultdict(list), defaultdict(list)
        for item, text in items:
            codes = stripped(fold(text or "", lower)[0])
            if len(codes) < least_chars:
                if self.in_word(codes).any():
                    short[len(codes)].append(len(self.ids))
                    self.ids.append(item)
                    self.codes.append(codes)
                    self.edits.append(0)
                continue
            k = int(edits * len(codes))
            by[gram_for(len(codes), k, gram)].append(len(self.ids))
            self.ids.append(item)
            self.codes.append(codes)
            self.edits.append(k)
        for size, own in short.items():
            hashes = np.array([rolling(self.codes[i], size)[0] for i in own], U)
            order = np.argsort(hashes, kind="stable")
            self.short[size] = (hashes[order], np.array(own)[order])
        for q, own in by.items():
            hashes = [rolling(self.codes[i], q) for i in own]
            item, place = np.repeat(own, [len(h) for h in hashes]), np.concatenate([np.arange(len(h)) for h in hashes])
            hashes = np.concatenate(hashes)
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            seen = np.zeros(1 << 20, bool)
            seen[(hashes >> U(44)).astype(np.int64)] = True
            first = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1])))
            self.grams[q] = (seen, hashes[first], first, np.append(first[1:], len(hashes)), item[order], place[order])

    def in_word(self, codes: np.ndarray) -> np.ndarray:
        return self.wordy[np.minimum(codes, 0xFFFF)] & (codes < 0x10000)

    def whole_words(self, codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, begin, end) of the places of short items: where they stand as they are, and no word goes on beyond either end."""
        word = self.in_word(codes) if self.short else codes
        for size, (hashes, items) in self.short.items():
            if len(codes) < size:
                continue
            own = rolling(codes, size)
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            at = np.flatnonzero(hi > lo)
            open_ = ~((at > 0) & word[at] & word[at - 1]) & ~((at + size < len(codes)) & word[at + size - 1] & word[np.minimum(at + size, len(codes) - 1)])
            for begin in at[open_].tolist():
                for i in items[lo[begin] : hi[begin]].tolist():
                    if (codes[begin : begin + size] == self.codes[i]).all():
                        yield i, begin, begin + size

    @classmethod
    def of(cls, state: dict) -> Index:
        index = cls.__new__(cls)
        index.__dict__.update(state)
        return index

    def find(self, texts: list[str | None]) -> list[tuple[int, object, int, int, int]]:
        """(text, item, begin, end, edits) of each item that a text holds with at most its number of edits: the best place, the first of several."""
        found: list[tuple[int, object, int, int, int]] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end] or "") <= CHUNK):
                size += len(texts[end] or "") + 1
                end += 1
            found += [(at + t, *rest) for t, *rest in self._chunk([t or "" for t in texts[at:end]])]
            at = end
        return found

    def _chunk(self, texts: list[str]) -> Iterator[tuple[int, object, int, int, int]]:
        codes, places = fold(END.join(texts), self.lower)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i, begin, end in self.whole_words(codes):
            begin, end = int(places[begin]), int(places[end - 1]) + 1
            text = int(np.searchsorted(starts, begin, "right")) - 1
            best.setdefault((text, i), (0, begin - int(starts[text]), end - int(starts[text])))
        for q, (seen, hashes, first, last, item, place) in self.grams.items():
            if len(codes) < q:
                continue
            own = rolling(codes, q)
            hit = np.flatnonzero(seen[(own >> U(44)).astype(np.int64)])
            slot = np.searchsorted(hashes, own[hit])
            slot[slot == len(hashes)] = 0
            good = hashes[slot] == own[hit]
            hit, slot = hit[good], slot[good]
            if not len(hit):
                continue
            n = last[slot] - first[slot]
            entry = np.repeat(first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            items, diagonal = item[entry], np.repeat(hit, n) - place[entry]
            edits = np.array(self.edits)[items]
            # bands of 2(k+1) diagonals that overlap by half: all grams of a match with k edits are in one of them
            band = diagonal // (edits + 1)
            items, band = np.concatenate((items, items)), np.concatenate((band, band - 1))
            low = int(band.min())
            pair, count = np.unique(items.astype(np.int64) << 40 | (band - low), return_counts=True)
            items, band = pair >> 40, (pair & ((1 << 40) - 1)) + low
            sizes = np.array([len(c) for c in self.codes])[items]
            k = np.array(self.edits)[items]
            enough = count >= sizes + 1 - q * (k + 1)
            for i in np.unique(items[enough]):
                bands = band[enough & (items == i)]
                wide = 2 * (self.edits[i] + 1)
                step = max(1, CELLS // wide)
                for part in range(0, len(bands), step):
                    for begin, end, cost in align(codes, self.codes[i], bands[part : part + step] * (self.edits[i] + 1), self.edits[i]):
                        begin, end = int(places[begin]), int(places[end - 1]) + 1
                        text = int(np.searchsorted(starts, begin, "right")) - 1
                        key, value = (text, int(i)), (cost, begin - int(starts[text]), end - int(starts[text]))
                        if key not in best or value < best[key]:
                            best[key] = value
        for (text, i), (cost, begin, end) in sorted(best.items()):
            yield text, self.ids[i], begin, end, cost


def align(codes: np.ndarray, item: np.ndarray, first: np.ndarray, edits: int) -> Iterator[tuple[int, int, int]]:
    """(begin, end, edits) in ``codes`` of the best alignment of the whole item in each band, if within ``edits``.

    A band begins at diagonal ``first`` and is 2(edits + 1) wide. A cell holds its cost and, below that, the
    diagonal where its path began, so that one minimum settles both.
    """
    wide, unit = 2 * (edits + 1), 1 << 20
    lane = np.arange(wide)
    over = unit * (edits + 2)
    slope = lane * unit
    at = first[:, None] + np.arange(wide + len(item))
    window = codes[np.clip(at, 0, len(codes) - 1)]
    beyond = (at < 0) | (at >= len(codes)) if at[:, 0].min() < 0 or at[:, -1].max() >= len(codes) else None
    cost = np.broadcast_to(lane, (len(first), wide)).astype(np.int64)
    if beyond is not None:
        cost[(at[:, :wide] < 0) | (at[:, :wide] > len(codes))] = over
    for j, char in enumerate(item.tolist()):
        step = cost + unit * (window[:, j : j + wide] != char)
        if beyond is not None:
            step[beyond[:, j : j + wide]] = over
        np.minimum(step[:, :-1], cost[:, 1:] + unit, out=step[:, :-1])
        step -= slope
        np.minimum.accumulate(step, axis=1, out=step)
        step += slope
        cost = np.minimum(step, over, out=step)
    end = cost.argmin(axis=1)
    value = cost[np.arange(len(first)), end]
    for r in np.flatnonzero(value < unit * (edits + 1)):
        begin, stop = int(first[r] + value[r] % unit), int(first[r] + end[r] + len(item))
        if begin < stop:
            yield begin, stop, int(value[r] // unit)


def indexes(benchmark: DataFrame, id_col: str, text_col: str, index_chars: int, **params) -> Iterator[object]:
    """Broadcast indexes that together hold the benchmark, each of about ``index_chars`` characters at most."""
    items = pick(benchmark, id=id_col, text=text_col).filter("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = -(-total // index_chars)
    for shard in range(shards):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == shard) if shards > 1 else items
        yield items.sparkSession.sparkContext.broadcast(vars(Index([tuple(r) for r in part.collect()], **params)))


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index_chars: int = INDEX_CHARS, **params) -> DataFrame:
    """(doc_id, item_id, edits, begin, end) of each benchmark item in each document: characters [begin, end) hold it.

    Texts are compared in lower case, with one space for each run of white space. An item of m
    characters may have k = floor(edits * m) edits. A match shares at least m + 1 - q(k + 1) q-grams with the item, in a band
    of diagonals; bands with as many are verified by banded alignment of the whole item. No match is lost, as
    q is chosen by item so that this number is positive.

    Documents are read where they lie and never shuffled. The benchmark is broadcast in pieces of bounded size,
    one pass over the documents for each.

    Null or empty text: no match. Items shorter than ``least_chars`` match where they stand without an edit and as whole words; null ones and
    short ones without a letter or digit never do. Null or
    repeated ids: each row is reported for itself. Empty tables: no rows. Other columns don't matter.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    kind, item_kind = dict(rows.dtypes)["doc_id"], dict(benchmark.dtypes)[item_id]
    item_type = pick(benchmark, item_id=item_id).limit(0).toArrow().schema.field(0).type
    passes = []
    for index in indexes(benchmark, item_id, item_text, index_chars, **params):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index.of(index.value)
            for batch in sliced(batches):
                found = own.find(batch.column("text").to_pylist())
                cols = list(zip(*found)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), pa.array(cols[4], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())], ["doc_id", "item_id", "edits", "begin", "end"])

        passes.append(rows.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, edits int, begin long, end long"))
    if not passes:
        return rows.sparkSession.createDataFrame([], f"doc_id {kind}, item_id {item_kind}, edits int, begin long, end long")
    out = passes[0]
    for other in passes[1:]:
        out = out.unionByName(other)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", index_chars: int = INDEX_CHARS, **params) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; see ``leaks``. Rows with a null or empty text stay; all columns stay. Empty tables: ``docs`` as it is."""
    names = docs.columns
    at = names.index(text_col)
    for index in indexes(benchmark, item_id, item_text, index_chars, **params):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            own = Index.of(index.value)
            for batch in sliced(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[f[0] for f in own.find(batch.column(at).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
        docs = flat.mapInArrow(run, flat.schema).toDF(*names)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
