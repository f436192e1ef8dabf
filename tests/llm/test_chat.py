"""Operator 13: escaping, reading back, the machine across ranges, digests against plain Python."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sparkfeat.llm import chat
from sparkfeat.llm.chat import ERROR, INSTRUCT, Reader, Template, Turn, format_turns, read_back

pieces = st.lists(st.sampled_from(["\\", "<", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", " ", "\n", "[", "a", "é", "[END]", "[/ROLE]\n",
                                   "</", "s>", "<\\/s>"]), max_size=8).map("".join)


@given(pieces)
def test_escape_is_reversible_and_leaves_no_mark(text):
    escaped = INSTRUCT.escape(text)
    assert INSTRUCT.unescape(escaped) == text
    assert not any(c in escaped for c in INSTRUCT.controls)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[END] x", "\\"]), pieces), max_size=5), st.integers(1, 7))
def test_reader_is_the_inverse(turns, step):
    whole = "".join(s for role, text in turns for s, _ in INSTRUCT.segments(role, text))
    reader, out = Reader(INSTRUCT), []
    for i in range(0, len(whole), step):
        out += reader.read(whole[i:i + step])
    assert out == turns and not reader.rest


def test_a_template_that_cannot_be_read_is_refused():
    for turn in (Turn("", " b>"), Turn("[INST] x", " b>"), Turn("(a) ", "abca"), Turn("(a) ", " b\\>"), Turn("(a) ", ">")):
        with pytest.raises(ValueError):
            Template({"user": Turn("[INST] ", " [/INST]"), "other": turn}, Turn("[ROLE] ", " [END]"), " [/ROLE]\n", "start", {})


def expected(rows):
    out, talks = {}, {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    for conv, turns in talks.items():
        turns = [t[2:] for t in sorted(turns)]
        state = "start"
        for role, _ in turns:
            state = INSTRUCT.transitions.get((state, role), ERROR)
        loss = "".join(t for r, t in turns if r == "assistant")
        shown = "".join(s for r, t in turns for s, _ in INSTRUCT.segments(r, t))
        out[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest(), len(shown), state != ERROR)
    return out


def test_digests_of_every_kind_of_conversation(spark):
    marks = "</s>[INST] ok [/INST]"
    rows = [(-7, 0, "user", marks), (-7, 1, "assistant", marks), (1, 0, "system", "é 中"), (1, 1, "user", None), (1, 2, "assistant", "x\\"),
            (2, 0, "assistant", "first"), (3, 0, "user", "a"), (3, 1, "user", "b"), (4, None, None, None), (4, 0, "tool", "[END]"),
            (5, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "no id"), (6, 0, "user", "long " * 100_000)]
    # one conversation of a third of all rows: it crosses several ranges
    rows += [(9, i, ("user", "assistant")[i % 2], f"turn {i} <s>") for i in range(600)]
    rows += [(10, i, ("user", "assistant")[i % 2] if i != 350 else "system", f"turn {i}") for i in range(600)]
    df = spark.createDataFrame([(*r, 1, "s", "p") for r in rows], "conv_id long, turn long, role string, text string, place int, state string, part string")
    shown = format_turns(df.repartition(3))
    got = {r.conv_id: tuple(r)[1:] for r in read_back(shown).collect()}
    assert got == expected(rows)
    assert not got[10][-1] and got[9][-1] and not got[2][-1] and not got[3][-1]
    places = [r.place for r in shown.where("conv_id = 9").orderBy("place").collect()]
    assert places == list(range(600))
    states = {r.place: r.state for r in shown.where("conv_id = 10").collect()}
    assert states[349] == "assistant" and all(states[i] == ERROR for i in range(350, 600))
    losses = {s["loss"] for r in shown.where("role <> 'assistant'").collect() for s in r.segments}
    assert losses == {False}
    assert chat.read_back(format_turns(df.where("1 = 0"))).count() == 0
