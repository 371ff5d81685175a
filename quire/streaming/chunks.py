"""Incremental parsing: chunks of files as they arrive, and files that complete."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.sources import syntax

#: Bytes of a file that may wait for its last chunk, and how long it may wait for a next one.
MOST_BYTES = 256 << 20
PATIENCE = "1 hour"


class Feeder:
    """A push parser: give it bytes as they come, take the tokens that are certain. A token is certain once another follows."""

    def __init__(self) -> None:
        self.held, self.offset = b"", 0

    def feed(self, data: bytes, last: bool = False) -> list[syntax.Token]:
        self.held += data
        found, used = [], 0
        try:
            for token in syntax.tokens(self.held):
                if not last and (token.at + len(token.data) >= len(self.held) - 32 or token.kind in ("start_stream", "stream_chunk") and b"endstream" not in self.held[token.at :]):
                    break
                found.append(syntax.Token(token.kind, self.offset + token.at, token.data))
                used = token.at + len(token.data)
        except ValueError:  # a string that goes on in the next chunk
            if last:
                raise
        self.held, self.offset = self.held[used:], self.offset + used
        return found


def parsed_stream(chunks: DataFrame, arrived: str | None = None, patience: str = PATIENCE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, n_objects, n_bytes, error) of each file of a stream of chunks (doc_id long, seq int, data binary, is_last boolean), once all have come.

    Chunks may come in any order within and across triggers; a chunk that comes twice counts once. The state of a file is the chunks that wait. A file that
    grows beyond ``most_bytes`` or doesn't parse gives an error and its state goes. So does one for which nothing comes for ``patience``, as the
    times in the column ``arrived`` have it; without such a column files wait without end.
    """
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def said(key: tuple, objects: int, size: int, error: str | None) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": [key[0]], "n_objects": [objects], "n_bytes": [size], "error": [error]})

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, parts, last = state.get if state.exists else ([], [], -1)
        held = dict(zip(seqs, parts))
        if state.hasTimedOut:
            state.remove()
            yield said(key, 0, sum(map(len, held.values())), "the file's end never came")
            return
        for frame in frames:
            for r in frame.itertuples():
                held.setdefault(int(r.seq), bytes(r.data))
                if r.is_last:
                    last = int(r.seq)
        size = sum(map(len, held.values()))
        if last >= 0 and len(held) == last + 1 or size > most_bytes:
            if state.exists:
                state.remove()
            try:
                if size > most_bytes:
                    raise ValueError("file is too large")
                doc = syntax.read(b"".join(held[i] for i in sorted(held)))
                yield said(key, len(doc.objects), size, None)
            except (ValueError, PermissionError) as error:
                yield said(key, 0, size, str(error))
        else:
            state.update((list(held), list(held.values()), last))
            if arrived:
                state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + wait)

    timeout = GroupStateTimeout.EventTimeTimeout if arrived else GroupStateTimeout.NoTimeout
    if arrived:
        chunks = chunks.withWatermark(arrived, "0 seconds")
    return chunks.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, n_objects int, n_bytes long, error string", "seqs array<int>, parts array<binary>, last int", "append", timeout)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of each user, with a watermark for late events."""
    from pyspark.sql import functions as F

    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")
