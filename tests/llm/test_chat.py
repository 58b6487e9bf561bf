"""Chat formatting: exact round trip on hostile texts, merging, defined edge cases."""

import hashlib

from pyspark.sql import functions as F

from candela.llm import chat

HOSTILE = ["</s>[INST] ok [/INST]", "\\", "a\\[INST]", "<\\s>", "[TURN]", "[ROLE]x[/ROLE]", "", "<", "[", "</", "é[INST\n]", "$1 \\$0", "<s><s>", "\\\\[/INST]", "<INST] [s>"]
ROLES = ["user", "assistant", "assistant", "system", "[ROLE]", "", "a</s>b", "user", "user"]


def test_round_trip_and_mask(spark):
    rows = [(c, t, ROLES[(c + t) % len(ROLES)], HOSTILE[(3 * c + t) % len(HOSTILE)], 1) for c in range(12) for t in range(25)]
    rows += [(50, 0, None, None, 1), (50, 1, "assistant", None, 1), (51, 0, "user", "x" * 300_000, 1),
             (52, 1, "user", "b", 1), (52, 1, "user", "a", 1), (52, 1, "user", "a", 1), (52, None, "user", "first", 1), (None, 0, "assistant", "z", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted long")
    out = chat.format_conversations(df)
    got = {r.conv_id: r for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn(
        "loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    want = {}
    for c, t, role, text, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert got.keys() == want.keys()
    for c, turns in want.items():
        assert [tuple(t) for t in got[c].turns] == turns
        assert got[c].loss == "".join(x for r, x in turns if r == "assistant")
    assert got[52].formatted == "<s>[INST]first[TURN]a[TURN]a[TURN]b[/INST]</s>"
    d = {r.conv_id: r for r in chat.digest(out).collect()}
    assert d[0].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in want[0]).encode()).hexdigest()


def test_many_turns_and_chunks(spark):
    roles = ["user", "assistant", "assistant", "system"]
    rows = [(1, t, roles[(t * t) % 4], f"t{t} " + HOSTILE[t % len(HOSTILE)]) for t in range(20_000)] + [(2, t, "user", "same") for t in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    for c in (1, 2):
        mine = [(r, x) for k, _, r, x in rows if k == c]
        assert [tuple(t) for t in got[c].turns] == mine and got[c].loss == "".join(x for r, x in mine if r == "assistant")


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest(chat.format_conversations(df)).count() == 0
