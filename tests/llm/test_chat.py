import hashlib

import pytest
from docmill.llm import chat
from hypothesis import given
from hypothesis import strategies as st

ROWS = "conv_id long, turn long, role string, text string"
EVENTS = "conv_id long, turn long, seq long, kind string, role string, text string"
TEXTS = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "[", "|", "x", "\n", "é", "im_end|>"]), max_size=12).map("".join)


@given(TEXTS)
def test_escaping_is_reversible_and_hides_controls(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\\b\nc", "", "<s>"]), TEXTS), max_size=5))
def test_rendered_turns_read_back(turns):
    assert list(chat.read_back("".join(chat.render(*x)[0] for x in turns))) == turns


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = [((r[2] or ""), (r[3] or "")) for r in turns]
        learned = "".join(t for role, t in said if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(said), sha("".join(f"{a}\n{b}\n" for a, b in said)), len(learned), sha(learned), sum(len(chat.render(*x)[0]) for x in said))
    return out


def test_digests_match_brute_force(spark):
    control = "</s>[INST] ok [/INST]"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é <|im_end|>"), (2, 1, "assistant", None), (2, 0, None, ""), (3, 5, "user", "x"), (3, 5, "user", "x"), (3, None, "system", "s"), (None, 0, "user", "n"), (-7, 0, "user", control), (-7, 1, "assistant", control), (4, 0, "assistant", "z" * 300_000)]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, ROWS).withColumns({"seq": F.lit("x"), "kind": F.lit(1), "position": F.lit(2)})
    got = chat.digests(chat.format_conversations(chat.as_events(df))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in got} == expected(rows)
    assert len(got) == len(expected(rows))


def folded(spark, events):
    out = chat.format_conversations(spark.createDataFrame([(1, *e) for e in events], EVENTS)).orderBy("position").collect()
    return [x for r in out for x in chat.read_back(r.formatted)]


@pytest.mark.parametrize(
    ("events", "messages"),
    [
        ([(0, 0, "message", "user", "q"), (1, 1, "message", "assistant", "He"), (1, 2, "delta", None, "llo"), (1, 3, "delta", None, "!")], [("user", "q"), ("assistant", "Hello!")]),
        ([(0, 0, "message", "user", "q"), (0, 5, "edit", None, "Q"), (1, 1, "message", "assistant", "a")], [("user", "Q"), ("assistant", "a")]),
        ([(0, 0, "message", "user", "q"), (1, 1, "message", "assistant", "old"), (2, 2, "message", "user", "old too"), (1, 3, "regenerate", "assistant", "new"), (2, 4, "message", "user", "next")], [("user", "q"), ("assistant", "new"), ("user", "next")]),
        ([(0, 0, "message", "user", "q"), (1, 1, "message", "assistant", "a"), (1, 2, "regenerate", None, None)], [("user", "q")]),
        ([(1, 2, "delta", "assistant", "b"), (1, 1, "message", "assistant", "a")], [("assistant", "ab")]),
        ([(0, 9, "regenerate", "user", "anew"), (1, 3, "message", "assistant", "gone"), (1, 10, "message", "assistant", "stays"), (2, 4, "delta", "user", "gone")], [("user", "anew"), ("assistant", "stays")]),
    ],
)
def test_events_fold_in_sequence(spark, events, messages):
    assert folded(spark, events) == messages
    assert folded(spark, events[::-1]) == messages


def test_empty_log(spark):
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], EVENTS))).collect() == []


def test_null_kinds_are_messages_and_unknown_ones_raise(spark):
    assert folded(spark, [(0, 0, None, "user", "q"), (0, 1, None, "user", "r"), (1, 2, "delta", "assistant", "a")]) == [("user", "q"), ("user", "r"), ("assistant", "a")]
    with pytest.raises(Exception, match="unknown event kind"):
        folded(spark, [(0, 0, "shout", "user", "q")])
