import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lattica.llm import chat

TEXT = st.lists(st.sampled_from([*chat.CONTROL, "\\", "-", "n", "\n", "<", "s>", "/s>", "[", "INST]", "a", "\0", "é"])).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), TEXT, TEXT), max_size=5))
def test_reversible_and_without_control_strings(turns):
    text, _, spans = chat.assembled(turns)
    assert chat.parsed(text) == [(r, t) for _, r, t in turns]
    for _, _, t in turns:
        assert not any(c in chat.escaped(t) for c in chat.CONTROL)
    assert [chat.unescaped(text[s["start"] : s["end"]]) for s in spans] == [t for new, r, t in turns if new and r == "assistant"]


def tokens(role, text):
    return -(-(len(role) + len(text)) // 4) + 4


@pytest.mark.parametrize(("budget", "history", "system", "turn"), [(1024, 256, 656, (230, 255)), (1024, 256, 0, (5, 400)), (1024, 256, 1100, (5, 60)), (200, 150, 120, (5, 90)), (64, 16, 20, (5, 80))])
def test_no_window_exceeds_the_budget_beside_one_new_turn(spark, budget, history, system, turn):
    rnd = random.Random(budget + system)
    rows = []
    for c in range(8):
        if system:
            rows.append((c, 0, "system", "s" * (4 * system - 22)))
        for t in range(1, 120):
            rows.append((c, t, "user", "u" * (4 * rnd.randint(*turn) - 20)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows, seen, filled, alone = chat.formatted(df, budget, history).collect(), {}, 0, 0
    for w in sorted(windows, key=lambda w: (w.conv_id, w.window)):
        turns, new = chat.parsed(w.formatted), chat.parsed(w.formatted[w.new_from :])
        assert w.n_tokens == sum(tokens(*t) for t in turns)
        assert not system or turns[0][0] == "system"
        if w.n_tokens > budget:
            assert len(new) == 1 and len(turns) <= 2
            alone += 1
        filled += w.n_tokens
        seen.setdefault(w.conv_id, []).extend(new)
    assert all(seen[c] == [(r, t) for k, _, r, t in rows if k == c] for c in range(8))
    if not alone:
        assert filled >= 0.55 * budget * len(windows)


def test_windows_keep_budget_and_every_turn_once(spark):
    rnd = random.Random(9)
    rows = []
    for c in [*range(12), None]:
        for t in range(rnd.choice([1, 3, 40, 700])):
            role = "system" if t == 0 and rnd.random() < 0.6 else "user" if t % 2 else "assistant"
            rows.append((c, t, role, "x</s>" * rnd.randint(0, 60)))
    rows += [(50, None, None, None), (50, 1, "assistant", "ok"), (50, 1, "assistant", "ok"), (51, 0, "user", "y" * 9000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.formatted(df, 1024, 256)
    for w in windows.collect():
        turns = chat.parsed(w.formatted)
        assert w.n_tokens == sum(tokens(*t) for t in turns)
        if w.n_tokens > 1024:
            assert len(chat.parsed(w.formatted[w.new_from :])) == 1 and len(turns) <= 2
        if w.window > 0 and any(r[0] == w.conv_id and r[1] == 0 and r[2] == "system" for r in rows):
            assert turns[0][0] == "system"
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    by: dict = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0
