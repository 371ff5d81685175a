"""Chat formatting in windows of a token budget."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.common import broadcast_if, pick, release, spooled, table, width

BUDGET = 2048
HISTORY = 256
#: Tokens that a turn's marks count for.
MARKS = 4
#: Tokens of a segment of a conversation that has more; a window never crosses into the next, so a huge conversation is many tasks' work.
SEGMENT = 4_000_000
#: Conversations of more than a segment that are broadcast, one number each; of more, they are joined by shuffling.
BROADCAST_LONG = 200_000
START, END = "<|im_start|>", "<|im_end|>"
CONTROL = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPE = re.compile(r"([<\[])(\\*)" + CONTROL)
UNESCAPE = re.compile(r"([<\[])\\(\\*)" + CONTROL)


def escape(text: str) -> str:
    r"""``text`` with one more backslash after the first character of every control string, and of every one that has some: ``</s>`` becomes ``<\/s>``."""
    return ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turns_of(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted window."""
    found, at = [], 0
    while at < len(text):
        line = text.index("\n", at)
        end = text.index(END + "\n", line)
        found.append((role_in(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return found


def word_tokens(text: Column) -> Column:
    """A token count that needs no vocabulary: words and single marks of punctuation."""
    return F.regexp_count(text, F.lit(r"\w+|[^\w\s]"))


Turn = tuple[str, str, int]


def window(system: Turn | None, history: list[Turn], fresh: list[Turn]) -> tuple[str, int, int, int, list[dict]]:
    """(text, tokens, repeated turns, new turns, loss spans): the spans hold the new assistant turns' texts, as places in the window's text."""
    context = ([system] if system else []) + history
    parts: list[str] = []
    spans, at = [], 0
    for i, (role, text, _) in enumerate([*context, *fresh]):
        head, body = f"{START}{role_out(role)}\n", escape(text)
        if role == "assistant" and i >= len(context):
            spans.append({"from": at + len(head), "to": at + len(head) + len(body)})
        parts.append(f"{head}{body}{END}\n")
        at += len(parts[-1])
    return "".join(parts), sum(t[2] for t in [*context, *fresh]), len(context), len(fresh), spans


def windows_of(turns: Iterator[Turn], budget: int, history: int, system: Turn | None = None, past: list[Turn] = ()) -> Iterator[tuple[str, int, int, int, list[dict]]]:
    """The windows of turns, by running sums of their tokens; no more than one window's turns are held. ``system`` and ``past`` were said before.

    A window has the first system turn, if that was said before the window, the last turns before it that fit into ``history`` tokens, and as many
    new turns as fit into ``budget`` with those; at least one, so a turn too large for a window has one to itself, whole.
    """
    held: list[Turn] = []
    before: list[Turn] = []
    repeat, total = None, 0
    for turn in turns:
        if held and total + turn[2] > budget:
            yield window(repeat, before, held)
            past, held = held, []
        if not held:
            repeat, before = system, []
            base = system[2] if system else 0
            room = min(history, max(0, budget - base - turn[2]))
            for t in reversed(past):
                if t[2] > room or system and t[:2] == system[:2]:
                    break
                before.insert(0, t)
                room -= t[2]
            total = base + sum(t[2] for t in before)
        held.append(turn)
        total += turn[2]
        if turn[0] == "system" and system is None:
            system = turn
    if held:
        yield window(repeat, before, held)


#: Turns said before a segment: the system turn and the last turns; and the segment's own.
SAID, LAST, NEW = 0, 1, 2


def segmented(rows: DataFrame, long: DataFrame, segment: int, history: int) -> DataFrame:
    """The turns of the conversations ``long``, by segment of the running sum of tokens, with ``kind``; a segment also gets what was said before it.

    Turns are ranged in their order, so one conversation is many tasks' work; running sums are those of a task's rows, moved by the sums of the tasks before.
    """
    order = ["turn", "role", "text"]
    ranged = rows.join(long, rows["conv_id"].eqNullSafe(long["_conv"])).select("conv_id", *order, "tokens")
    ranged = spooled(ranged.repartitionByRange(max(2, width(rows.sparkSession)), "conv_id", *order).withColumn("task", F.spark_partition_id()))
    sums = ranged.groupBy("conv_id", "task").agg(F.sum("tokens").alias("all"))  # a row for each task that has a part of the conversation
    sums = sums.select(F.col("conv_id").alias("_conv"), F.col("task").alias("_task"), (F.sum("all").over(W.partitionBy("conv_id").orderBy("task")) - F.col("all")).alias("before"))
    own = W.partitionBy("conv_id", "task").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    placed = ranged.withColumn("start", F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    placed = placed.join(sums, placed["conv_id"].eqNullSafe(sums["_conv"]) & (placed["task"] == sums["_task"])).withColumn("start", F.col("start") + F.col("before"))
    placed = placed.select("conv_id", *order, "tokens", "start", F.floor(F.col("start") / segment).alias("segment"))
    new = placed.select("conv_id", "segment", F.lit(NEW).alias("kind"), "start", "role", "text", "tokens")
    last = placed.filter((F.col("segment") + 1) * segment - F.col("start") <= history).select("conv_id", F.col("segment") + 1, F.lit(LAST), "start", "role", "text", "tokens")
    ends = placed.groupBy("conv_id").agg(F.max("segment").alias("_end")).withColumnRenamed("conv_id", "_conv")
    first = placed.filter("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("start", "segment", "text", "tokens")).alias("s"))
    first = first.join(ends, first["conv_id"].eqNullSafe(ends["_conv"])).filter("_end > s.segment")
    said = first.select("conv_id", F.explode(F.sequence(F.col("s.segment") + 1, "_end")), F.lit(SAID), "s.start", F.lit("system"), "s.text", "s.tokens")
    return new.union(last).union(said)


def windows(conversations: DataFrame, budget: int, history: int, conv_col: str, turn_col: str, role_col: str, text_col: str, tokens: Callable[[Column], Column], segment: int) -> tuple[DataFrame, DataFrame]:
    """The windows of conversations within one segment, each conversation in one task, and those of longer ones, a segment in one task."""
    rows = pick(conversations, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    kind = dict(rows.dtypes)["conv_id"]
    conv_type = rows.select("conv_id").limit(0).toArrow().schema.field(0).type
    rows = rows.withColumn("role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tokens", (tokens(F.col("text")) + MARKS).cast("long"))
    long = spooled(rows.groupBy("conv_id").agg(F.sum("tokens").alias("n")).filter(F.col("n") > segment).select(F.col("conv_id").alias("_conv")))
    n_long = long.count()
    long = broadcast_if(long, n_long, BROADCAST_LONG)
    short = rows.join(long, rows["conv_id"].eqNullSafe(long["_conv"]), "left_anti") if n_long else rows
    short = short.select("conv_id", F.lit(0).cast("long").alias("segment"), F.lit(NEW).alias("kind"), "turn", "role", "text", "tokens")
    parts = segmented(rows, long, segment, history) if n_long else short.filter("false").withColumnRenamed("turn", "start")
    spans = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
    fields = [("conv_id", conv_type), ("segment", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("n_tokens", pa.int64()), ("n_repeated", pa.int64()), ("n_new", pa.int64()), ("loss_spans", spans)]

    def batch_of(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*made), fields)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    part = batch.slice(at, 1000)
                    yield from zip(*[part.column(c).to_pylist() for c in ("conv_id", "segment", "kind", "role", "text", "tokens")])

        source = rows_of()
        waiting = next(source, None)
        made: list[tuple] = []
        size = 0
        while waiting is not None:
            key, system, past = waiting[:2], None, []

            def turns() -> Iterator[Turn]:
                nonlocal waiting
                while waiting is not None and waiting[:2] == key:  # noqa: B023
                    turn, waiting = waiting[3:], next(source, None)
                    yield turn

            while waiting is not None and waiting[:2] == key and waiting[2] != NEW:
                if waiting[2] == SAID:
                    system = waiting[3:]
                else:
                    past.append(waiting[3:])
                waiting = next(source, None)
            for number, found in enumerate(windows_of(turns(), budget, history, system, past)):
                made.append((*key, number, *found))
                size += len(found[0])
                if size > 1 << 21:
                    yield batch_of(made)
                    made, size = [], 0
        if made:
            yield batch_of(made)
        release()

    schema = f"conv_id {kind}, segment long, window long, text string, n_tokens long, n_repeated long, n_new long, loss_spans array<struct<from: bigint, to: bigint>>"
    short = short.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    parts = parts.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "kind", "start")
    return short.mapInArrow(run, schema), parts.mapInArrow(run, schema)


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", tokens: Callable[[Column], Column] = word_tokens, segment: int = SEGMENT) -> DataFrame:
    """One row per window: conv_id, segment, window, text, n_tokens, n_repeated, n_new, loss_spans (places of the text that is learnt).

    Turns go in order of turn, then role and text; a window's turns are whole. Every turn is new in
    exactly one window. Windows after the one with the first system turn repeat it. Control strings inside roles and texts are escaped, so the marks that are left are the template's.
    A conversation of more than ``segment`` tokens is cut, by running sums, into segments of about as many, whose windows are built apart, each with the system turn and the history before it.

    Null text or role: empty. Null turn: before all others. Null conv_id: one conversation. Repeated rows: each is a
    turn. An empty table: no windows. Other columns don't matter.
    """
    short, parts = windows(conversations, budget, history, conv_col, turn_col, role_col, text_col, tokens, segment)
    return short.unionByName(parts)


def digests(windows: DataFrame, placed: bool = False) -> DataFrame:
    """What the windows of each conversation hold, read back from them: every turn once, and all text under the loss mask.

    ``placed``: each conversation's windows stand in one task already, in order.
    """
    kind = dict(windows.dtypes)["conv_id"]
    conv_type = windows.select("conv_id").limit(0).toArrow().schema.field(0).type
    ordered = windows if placed else windows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
    types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, made = None, None, []
        for batch in batches:
            for conv, text, repeated, spans in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "text", "n_repeated", "loss_spans")]):
                if state is None or conv != key:
                    if state is not None:
                        made.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in turns_of(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for span in spans:
                    learnt = unescape(text[span["from"] : span["to"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
                state[5] += 1
            if len(made) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)
                made = []
        if state is not None:
            made.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    short, parts = windows(rows.unionByName(extra), BUDGET, HISTORY, "conv_id", "turn", "role", "text", word_tokens, SEGMENT)
    return digests(short, placed=True).unionByName(digests(parts))
