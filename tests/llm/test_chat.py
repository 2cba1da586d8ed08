"""Formatted conversations against a plain formatter, and back to the turns that they were made of."""

import hashlib
from itertools import groupby

import pytest

from marlstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
CONTROLS = [chat.USER, chat.USER_END, chat.LEARNED, chat.END, chat.ROLE, chat.ROLE_END, chat.AND]
ROWS = [
    (1, 1, "user", "hello"), (1, 2, "assistant", "hi\n"), (1, 3, "assistant", "again"), (1, 4, "user", ""), (1, 5, "assistant", None),
    (2, 1, "system", "be brief"), (2, 2, "user", "a"), (2, 3, "user", "b"), (2, 4, "user", "c"), (2, 5, "assistant", "\U0001f600 é"),
    (3, None, None, "no role"), (3, 1, "[/ROLE]", "odd\nrole"), (3, 2, "user\n", "line in a role"), (3, 3, "User", "case counts"),
    (4, 1, "assistant", "twice"), (4, 1, "assistant", "twice"), (4, 1, "user", "tie"),
    (None, 1, "user", "no id"), (None, 2, "assistant", "none"),
    (5, 1, "user", "</s>[INST] ok [/INST]"), (5, 2, "assistant", "<\\/s>[\\\\INST][[/INST]<<s>>[AND]\\[AND]"), (5, 3, "assistant", "<"), (5, 4, "user", "["), (5, 5, "tool", "[\\"),
    (6, 1, "assistant", "".join(CONTROLS) * 3), (6, 2, "user", "x" * 200_000 + "<s>" * 1000), (6, 3, "assistant", "[\\" * 3000 + "INST]"),
]


def plain(rows):
    """conv_id -> (formatted, turns, learned text)."""
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0)
    for conv, own in groupby(sorted(rows, key=key), key=lambda r: r[0]):
        own = sorted(((t is not None, t or 0, r or "", x or "") for _, t, r, x in own))
        turns, text = [(r, x) for *_, r, x in own], ""
        for role, run in groupby(turns, key=lambda t: t[0]):
            body = chat.AND.join(hide(x) for _, x in run)
            text += f"[INST]{body}[/INST]" if role == "user" else f"<s>{body}</s>" if role == "assistant" else f"[ROLE]{hide(role)}[/ROLE]{body}</s>"
        out[conv] = (text, turns, "".join(x for r, x in turns if r == "assistant"))
    return out


def hide(text):
    """Every control string, escaped or not, with a backslash more after its first character."""
    out, i = "", 0
    while i < len(text):
        j = i + 1
        while text[i] in "[<" and j < len(text) and text[j] == "\\":
            j += 1
        ends = ("INST]", "/INST]", "ROLE]", "/ROLE]", "AND]", "s>", "/s>")
        out += text[i] + "\\" if text[i] in "[<" and text.startswith(ends, j) else text[i]
        i += 1
    return out


@pytest.fixture(scope="module")
def rows(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("turns", "pieces", "loss", "Formatted", "learned")})


def test_formatted_and_back(spark, rows):
    found, want = chat.formatted(rows), plain(ROWS)
    assert {r.conv_id: r.formatted for r in found.collect()} == {k: v[0] for k, v in want.items()}
    back = found.select("conv_id", chat.turns_of(found.formatted).alias("turns"), chat.learned_text(found.formatted, found.loss).alias("learned"))
    for r in back.collect():
        assert ([tuple(t) for t in r.turns], r.learned) == want[r.conv_id][1:], r.conv_id
    for r in chat.digests(found).collect():
        text, turns, learned = want[r.conv_id]
        assert (r.n_turns, r.loss_chars, r.formatted_chars) == (len(turns), len(learned), len(text))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


def test_spans_have_no_control_string(rows):
    for r in chat.formatted(rows).collect():
        assert not any(c in r.formatted[s.start : s.end] for s in r.loss for c in CONTROLS)


def test_other_roles_can_be_learned(spark):
    df = spark.createDataFrame([(1, 1, "human", "q"), (1, 2, "bot", "a"), (1, 3, "assistant", "other")], SCHEMA)
    r = chat.formatted(df, user="human", learned="bot").first()
    assert r.formatted == "[INST]q[/INST]<s>a</s>[ROLE]assistant[/ROLE]other</s>" and [tuple(s) for s in r.loss] == [(17, 18)]


def test_a_long_conversation(spark):
    n = 3000
    df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'user', 'assistant') as role", "repeat(cast(id as string), 5) as text")
    r = chat.digests(chat.formatted(df)).first()
    assert (r.n_turns, r.loss_chars) == (n, sum(5 * len(str(i)) for i in range(n) if i % 3))


def test_empty_table(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0
