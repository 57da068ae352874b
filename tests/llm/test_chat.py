import hashlib

from pyspark.sql import functions as F

from govlake.llm import chat

LOG = "conv_id bigint, turn int, seq bigint, kind string, role string, text string, formatted string"
TEXTS = ["\\### Assistant: </turn> ok", "", "a<turn>b<text>c</turn>\n", "\\", "\\\\<", "<\\turn>", "plain é \U0001f600", "x\n\ny</turn", "</turn></turn>\n<text>"]


def run(spark, events):
    chats = chat.format_chats(spark.createDataFrame([(*e, "x") for e in events], LOG).repartition(3))
    rows = chats.select("*", chat.parse_turns(F.col("formatted")).alias("turns"), chat.masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    return {r.conv_id: r for r in rows}


def test_round_trip_of_control_strings(spark):
    events = [(1, i, 0, "message", r, t) for i, t in enumerate(TEXTS) for r in ["assistant" if i % 2 else "us<turn>er\\"]]
    r = run(spark, events)[1]
    assert [(t.role, t.text) for t in r.turns] == [(e[4], e[5]) for e in events]
    assert r.loss == "".join(t for i, t in enumerate(TEXTS) if i % 2)
    for s in r.loss_spans:
        assert r.formatted[: s.start].endswith("<text>") and r.formatted[s.start + s.length :].startswith("</turn>\n")


def test_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "delta", "assistant", "he"),
        (1, 1, 2, "delta", None, "llo"),
        (1, 1, 3, "regenerate", "assistant", None),
        (1, 1, 4, "delta", None, "good "),
        (1, 1, 5, "delta", None, "day"),
        (1, 2, 6, "message", "user", "bye"),
        (2, 0, 0, "message", "user", "old"),
        (2, 1, 1, "delta", "assistant", "answer to old"),
        (2, 0, 2, "edit", "user", "new"),
        (2, 1, 3, "delta", "assistant", "answer "),
        (2, 1, 4, "delta", "assistant", "to new"),
        (3, 0, 0, "message", None, None),
        (3, 0, 0, "message", None, None),
        (3, None, 0, "message", "system", "first"),
        (None, 0, 0, "message", "assistant", "lone"),
    ]
    got = {c: [(t.role, t.text) for t in r.turns] for c, r in run(spark, events).items()}
    assert got == {
        1: [("user", "hi"), ("assistant", "good day"), ("user", "bye")],
        2: [("user", "new"), ("assistant", "answer to new")],
        3: [("system", "first"), ("", ""), ("", "")],
        None: [("assistant", "lone")],
    }


def test_long_conversation(spark):
    events = [(1, i, i, "message", "assistant" if i % 2 else "user", f"text {i} é") for i in range(3000)]
    r = run(spark, events)[1]
    assert r.n_messages == 3000 and r.loss == "".join(f"text {i} é" for i in range(1, 3000, 2))


def test_empty_log_and_native_plan(spark):
    empty = spark.createDataFrame([], LOG)
    df = chat.format_chats(empty)
    assert df.collect() == []
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_query_holds_the_planted_conversation(spark, tmp_path):
    from govlake.llm.queries import op1_format_chats

    spark.createDataFrame([(5, 0, "user", None), (5, 1, "assistant", "yes")], "conv_id bigint, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in op1_format_chats(spark, str(tmp_path)).collect()}
    nasty = TEXTS[0]
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{nasty}\nassistant\n{nasty}\n".encode()).hexdigest()
    assert got[-7].loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest() and got[-7].loss_chars == len(nasty)
    assert got[5].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nyes\n").hexdigest()
