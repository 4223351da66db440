from pyspark.sql import functions as F

from corpuscope.llm import chat

ODD = ["", "\\", "<s>", "</s>x", "a\\<s>[NEXT]", "[INST] hi [/INST]", "<\\s>", "[", "<", "[ROLE]\n\n", "é🙂"]


def test_texts_come_back(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", t) for i, t in enumerate(ODD)]
    rows += [(2, 0, "user", "a"), (2, 1, "user", "b"), (2, 1, "user", "b"), (2, None, "system", None), (2, 2, "assistant", "c"), (2, 3, "assistant", "d"),
             (3, 0, None, None), (None, 0, "[ROLE]\n", "x"), (4, 0, "assistant", "[INST] y")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit("x"))
    done = chat.format_chats(table)
    found = {r["conv_id"]: r for r in done.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("loss")).collect()}
    for conv, r in found.items():
        own = sorted((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv)
        assert [(t["role"], t["text"]) for t in r["t"]] == [(x[2], x[3]) for x in own]
        assert r["loss"] == "".join(x[3] for x in own if x[2] == "assistant")
    assert found[2]["formatted"] == ("<s>system[ROLE][INST]  [/INST]</s><s>user[ROLE][INST] a[NEXT]b[NEXT]b [/INST]</s>"
                                     "<s>assistant[ROLE]c[NEXT]d</s>")
    assert chat.format_chats(table.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf):
    from corpuscope.llm.chat_queries import op9_chat_format

    plan = op9_chat_format(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") <= 2
