import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import chat

PIECES = ["</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "\\", "<", "[", "a b", "\n", "|im_end|>", "é", "s>", ""]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(mark in out for mark in PIECES[:8])
    assert chat.role_in(chat.role_out(text)) == text


def test_every_turn_once(spark):
    rng = random.Random(2)
    rows = []
    for conv in (None, 1, 2, 3):
        for t in range(rng.choice([1, 7, 30])):
            said = rng.choice([None] + ["".join(rng.choices(PIECES, k=rng.randrange(12))) for _ in range(9)])
            rows.append((conv, rng.choice([None, t, t, t * 3000]), rng.choice(["user", "assistant", "system", "tool", None, "a\nb\\n", "<s>"]), said))
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        learnt = "".join(x for _, _, r, x in own if r == "assistant")
        want[conv] = (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    for budget, history, segment in ((30, 10, 10**6), (8, 3, 10**6), (2000, 100, 10**6), (30, 10, 40), (8, 3, 25)):
        windows = chat.format_windows(talk, budget=budget, history=history, segment=segment)
        assert {r.conv_id: tuple(r)[1:5] for r in chat.digests(windows).collect()} == want
        for r in windows.collect():
            assert r.n_tokens <= budget or r.n_new == 1
            assert len(chat.turns_of(r.text)) == r.n_repeated + r.n_new


def test_system_turn_and_history_are_repeated_and_masked(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn number {i} says a few words") for i in range(1, 9)]
    windows = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=40, history=12).orderBy("window").collect()
    assert len(windows) > 2
    for w in windows[1:]:
        turns = chat.turns_of(w.text)
        assert turns[0] == ("system", "be kind") and w.n_repeated == 2
    learnt = [w.text[s["from"] : s["to"]] for w in windows for s in w.loss_spans]
    assert learnt == [r[3] for r in rows if r[2] == "assistant"]


def test_numbers_of_turns_do_not_cut_windows(spark):
    for numbers in (range(12), range(4090, 4102), range(1_700_000_000_000, 1_700_000_012_000, 1000)):
        rows = [(1, n, "user" if i % 2 else "assistant", f"turn {i}") for i, n in enumerate(list(numbers)[:12])]
        assert chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 1


def test_a_late_system_turn_is_repeated_only_once_it_was_said(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn number {i} says a few words") for i in range(9)]
    rows[3] = (1, 3, "system", "be kind")
    rows[6] = (1, 6, "system", "another")
    found = chat.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), budget=36, history=12).orderBy("window").collect()
    said = set()
    for w in found:
        turns = chat.turns_of(w.text)
        assert (turns[0] == ("system", "be kind")) == (("system", "be kind") in said)
        assert turns.count(("system", "be kind")) <= 1
        said.update(turns)
    assert len(found) > 3 and ("system", "another") in said


def test_segments_go_on_with_what_was_said(spark):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", f"turn number {i} says a few words") for i in range(1, 60)]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = chat.format_windows(talk, budget=40, history=12, segment=150).orderBy("segment", "window").collect()
    assert found[-1].segment >= 3
    for w in found[1:]:
        assert chat.turns_of(w.text)[0] == ("system", "be kind") and w.n_repeated == 2
    fresh = [t for w in found for t in chat.turns_of(w.text)[w.n_repeated :]]
    assert fresh == [r[2:] for r in rows]
