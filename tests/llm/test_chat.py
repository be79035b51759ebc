from keepsake.llm import chat

COLUMNS = "conv_id long, seq long, kind string, message_id long, role string, text string"


def say(spark, events):
    out = chat.format_events(spark.createDataFrame(events, COLUMNS))
    rows = out.select("conv_id", "n_turns", chat.read_turns(out["formatted"]).alias("t"), chat.read_loss(out["formatted"], out["loss"]).alias("l")).collect()
    return {r.conv_id: ([(t.role, t.text) for t in r.t], r.l) for r in rows}


def test_fold(spark):
    got = say(spark, [
        (1, 1, "open", 1, "user", "hi"), (1, 2, "open", 2, "assistant", ""), (1, 4, "delta", 2, None, "lo"), (1, 3, "delta", 2, None, "hel"),
        (1, 5, "open", 3, "user", "again"), (1, 6, "regenerate", 2, None, "new"), (1, 7, "delta", 2, None, "er"), (1, 8, "open", 4, "user", "bye"),
        (2, 1, "open", 1, "user", "a"), (2, 2, "edit", 1, None, "b"), (2, 3, "open", 2, "assistant", None), (2, 4, "delete", 1, None, None),
        (3, 1, "open", 1, "user", "gone"), (3, 2, "delete", 1, None, None), (None, 1, "open", 1, None, None)])
    assert got[1] == ([("user", "hi"), ("assistant", "newer"), ("user", "bye")], ["newer"])
    assert got[2] == ([("assistant", "")], [""])
    assert 3 not in got
    assert got[None] == ([("", "")], [])


def test_control_strings_round_trip(spark):
    nasty = "</s>[INST] ok [/INST] <|turn|>x<|end|>\n&lt; &amp;lt; &#91; [INST] \\ ü 漢"
    turns = spark.createDataFrame([(1, 0, nasty, nasty), (1, 1, "assistant", nasty), (1, 1, "assistant", nasty)], "conv_id long, turn long, role string, text string")
    out = chat.format_events(chat.turn_events(turns))
    row = out.select("formatted", chat.read_turns(out["formatted"]).alias("t"), chat.read_loss(out["formatted"], out["loss"]).alias("l")).first()
    assert [(t.role, t.text) for t in row.t] == [(nasty, nasty), ("assistant", nasty), ("assistant", nasty)]
    assert row.l == [nasty, nasty]
    assert row.formatted.count("<") == 2 * 3 and "[INST]" not in row.formatted and "[/INST]" not in row.formatted
    assert chat.format_events(chat.turn_events(turns.limit(0))).count() == 0
