import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from threadloom.llm import chat

TURNS = f"conv_id long, turn long, role string, parts {chat.PARTS}"


def part(text=None, kind="text", ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def formatted(spark, rows):
    df = chat.format_chats(spark.createDataFrame(rows, TURNS))
    return df.withColumn("turns", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss_spans")))


def test_parts_become_ordered_placeholders(spark):
    rows = [
        (1, 1, "assistant", [part("ok"), part(kind="audio", ref="a.wav", seconds=1.5)]),
        (1, 0, "user", [part("see "), part(kind="image", ref="i.png", width=57, height=28), part(" and <|image 1.2|> "), part(kind="document", ref="d.pdf", pages=3)]),
    ]
    r = formatted(spark, rows).first()
    assert [tuple(a) for a in r.attachments] == [
        ("<|image 1.2|>", "image", "i.png", 3), ("<|document 1.4|>", "document", "d.pdf", 1800), ("<|audio 2.2|>", "audio", "a.wav", 38),
    ]
    assert r.formatted == "<|turn|>user\nsee <|image 1.2|> and <\\|image 1.2|> <|document 1.4|><|end|>\n<|turn|>assistant\nok<|audio 2.2|><|end|>\n"
    assert r.learned == "ok<|audio 2.2|>" and r.n_turns == 2


TRICKY = st.lists(st.sampled_from(["<|", "|>", "</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "|turn|>", "\n", "é", "a", "<|end|>\n", "[", "s>"]), max_size=12)


@settings(deadline=None, max_examples=5)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "", "<|turn|>"]), TRICKY), min_size=40, max_size=60))
def test_round_trip(spark, turns):
    rows = [(1, i, role, [part("".join(t))]) for i, (role, t) in enumerate(turns)]
    r = formatted(spark, rows).first()
    assert [(t.role, t.text) for t in r.turns] == [(role, "".join(t)) for role, t in turns]
    assert r.learned == "".join("".join(t) for role, t in turns if role == "assistant")
    inside = r.formatted.replace(chat.TURN, "").replace(chat.END, "")
    assert not any(c in inside for c in chat.CONTROL)


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", [part("x")]), (2, None, None, None), (2, 1, "assistant", [part(None)]), (2, 1, "assistant", [part(None)]),
        (3, 0, "assistant", [part("y" * 200_000)]), (4, 0, "user", [part("t", kind="video"), part("u", kind=None), part(kind="image")]), (5, 0, "user", []),
    ]
    got = {r.conv_id: r for r in formatted(spark, rows).collect()}
    assert got[2].n_turns == 3 and got[2].learned == "" and [t.text for t in got[2].turns] == ["", "", ""]
    assert got[3].learned == "y" * 200_000 and got[4].turns[0].text == "tu<|image 1.3|>" and got[None].n_turns == 1 and got[5].turns[0].text == ""
    assert chat.format_chats(spark.createDataFrame([], TURNS)).count() == 0
    more = spark.createDataFrame(rows, TURNS).withColumn("formatted", F.lit("x")).withColumn("n_turns", F.lit(9))
    assert chat.format_chats(more).count() == len(got)


@pytest.mark.parametrize("text", ["", "\\", "<\\|", "\\<|", "<<||", "[\\INST]", "</s></s>"])
def test_escape(one, text):
    assert one([text], chat.unescape(chat.escape(F.col("v")))) == [text]
