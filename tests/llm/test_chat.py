from pyspark.sql import functions as F

from loglantern.llm import chat


def test_turns_come_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>", "\\", "<\\", "[[\\\\<<", "<|text|>x<|end|>", "", None, "|>", "🙂<", "a\nb"]
    rows = [(1, i, ["user", "assistant", "assistant", "<|turn|>", None, "system"][i % 6], t) for i, t in enumerate(nasty)]
    rows += [(2, 5, "user", "b"), (2, 5, "user", "b"), (2, None, "assistant", "first"), (None, 0, "user", "x")]
    frame = spark.createDataFrame([(*r, "TURN", 1) for r in rows], "conv_id long, turn long, role string, text string, TURN string, pieces long")
    made = chat.format_chat(frame)
    read = {r.conv_id: r for r in chat.read_chat(made).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(r[2] or "", r[3] or "") for r in rows[: len(nasty)]]
    assert read[1].loss_texts == [r[3] for r in rows[: len(nasty)] if r[2] == "assistant" and r[3]]
    assert [(t.role, t.text) for t in read[2].turns] == [("assistant", "first"), ("user", "b"), ("user", "b")]
    assert len(read) == 3
    body = made.where("conv_id = 1").first().formatted
    for marker in ("</s>", "[INST]", "[/INST]"):
        assert marker not in body
    one = made.where("conv_id = 2").first().formatted
    assert one == "<|turn|>assistant<|text|>first<|end|><|turn|>user<|text|>b<|next|>b<|end|>"
    assert chat.read_chat(chat.format_chat(frame.where("false"))).count() == 0


def test_broken_mask_fails(spark):
    frame = spark.createDataFrame([(1, 0, "assistant", "hello")], "conv_id long, turn long, role string, text string")
    made = chat.format_chat(frame).withColumn("formatted", F.replace("formatted", F.lit("hello"), F.lit("hell")))
    try:
        chat.read_chat(made).select("loss_texts").collect()
    except Exception as error:
        assert "loss mask" in str(error)
    else:
        raise AssertionError("a mask that does not fit was taken")
