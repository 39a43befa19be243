import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import queries
from tessera.llm.chat import CONTROLS, escape, format_conversations, read_conversations, read_turns, token_counts, unescape, written_turn
from tessera.llm.tokens import tokenizer_path

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "s>", "[", "TEXT]", " ", "\n", "x", "é😀"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escape_is_reversible(text):
    assert unescape(escape(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=4))
def test_turns_are_read_back(turns):
    made = "".join(f"<s>[ROLE] {escape(r)} [TEXT] {escape(t)} </s>" for r, t in turns)
    assert [(r, t) for r, t, _, _ in read_turns(made)] == turns
    assert [unescape(made[a:b]) for _, _, a, b in read_turns(made)] == [t for _, t in turns]


def digest(turns):
    return hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns).encode()).hexdigest()


def conversations():
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"w{i} " * (i * 7 % 40)) for i in range(60)]
    rows += [(2, 0, None, None), (2, 1, "assistant", "a\\"), (2, 1, "assistant", "b"), (2, None, "tool", "[TEXT] </s>"), (None, 0, "user", "x"), (3, 0, "assistant", "long " * 5000), (3, 0, "assistant", "long " * 5000)]
    return rows


@pytest.mark.parametrize(("budget", "history"), [(50, 2), (50, 0), (10_000, 3), (1, 1)])
def test_windows(spark, budget, history):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(tokenizer_path())
    rows = conversations()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS window").repartition(3)
    windows = format_conversations(df, budget=budget, history=history)
    for w in windows.collect():
        turns = read_turns(w.formatted)
        new = turns[w.repeated :]
        assert w.n_tokens == len(tool.encode(w.formatted, add_special_tokens=False).ids)
        assert new and (w.n_tokens <= budget or len(new) == 1 or w.over_budget)
        assert w.repeated <= history + 1
        if w.conv_id == 1:
            assert turns[0][0] == "system"
        said = [t for r, t, _, _ in new if r == "assistant"]
        assert [unescape(w.formatted[a:b]) for a, b in zip(w.loss_start, w.loss_end)] == said
    got = {r.conv_id: r for r in read_conversations(windows).collect()}
    by = {}
    for c, n, r, t in sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or "")):
        by.setdefault(c, []).append((r, t))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_budget_is_kept_by_turns_that_fit(spark):
    df = spark.createDataFrame([(1, i, "user", "one two three") for i in range(20)], SCHEMA)
    windows = format_conversations(df, budget=30, history=2).collect()
    assert not any(w.over_budget for w in windows) and all(w.n_tokens <= 30 for w in windows) and len(windows) > 3
    assert format_conversations(df.limit(0)).collect() == [] and read_conversations(format_conversations(df.limit(0))).collect() == []


def test_spans_are_the_longest_that_fit(spark):
    """Each window but the last ends where one more turn would be over the budget, the repeated system turn counted."""
    rows = [(1, 0, "system", "be kind")] + [(1, i, ("user", "assistant")[i % 2], "word " * (i * 5 % 17)) for i in range(1, 40)]
    windows = sorted(format_conversations(spark.createDataFrame(rows, SCHEMA), budget=100, history=0).collect(), key=lambda w: w.window)
    tokens = token_counts(["".join(written_turn(r, t)) + " </s>\n" for _, _, r, t in rows], tokenizer_path())
    at = 0
    for w in windows:
        n = len(w.loss_start) + sum(r != "assistant" for r, *_ in read_turns(w.formatted)[w.repeated :])
        room = 100 - (tokens[0] if w.window else 0)
        assert w.first_turn == at and sum(tokens[at : at + n]) <= room < sum(tokens[at : at + n + 1]) + room * (at + n == len(rows))
        at += n
    assert at == len(rows) and len(windows) > 3


def test_query(spark, sf_dir):
    by = {-1: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text))
    got = {r.conv_id: r for r in queries.op6_chat_windows(spark, sf_dir).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (len(turns), digest(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c].formatted_chars > sum(len(t) for _, t in turns)
