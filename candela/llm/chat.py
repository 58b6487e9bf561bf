"""Chat formatting: conversations rendered with a reversible turn template.

Template (one conversation = its blocks, joined)::

    user       <s>[INST]body[/INST]</s>
    assistant  <s>body</s>
    any other  <s>[ROLE]role[/ROLE]body</s>

A block holds adjacent turns of one role; their texts are joined by ``[TURN]``.
Inside texts and roles a backslash goes before every backslash and before the
second character of every control string, so no control string occurs in them
and dropping the backslashes restores them.

Defined cases: rows are ordered by (turn, role, text), so ties and repeated rows
stay and the result is the same at each run; null role, turn or text: empty role,
first place, empty text; null conv_id: a conversation of its own; an empty
table gives no rows; a very long text is escaped whole, and a conversation of very many turns is one
task's work (its places in about linear time, reading masked text back in more: 32,000 turns 33 s); columns besides conv_id, turn, role, text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from candela.llm.common import table

OPEN, CLOSE, USER, USER_END, ROLE, ROLE_END, TURN = "<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[TURN]"
#: pieces whose places one fold computes
CHUNK = 256
#: every control string starts with < or [ and holds no other < or [, nor a backslash
CONTROL = r"<(?=/?s>)|\[(?=/?(?:INST|ROLE)\]|TURN\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


def format_conversations(df: DataFrame) -> DataFrame:
    """Rows ``conv_id, formatted, loss_spans``: the text, and the code-point ranges
    (start, end) of the assistant texts, escaped, in order."""
    turns = df.select(
        "conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"),
                            F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    # adjacent turns of one role are a block (role, texts): blocks start where the role changes
    role = lambda i: F.get("t", i)["role"]
    one = one.withColumn("n", F.size("t")).withColumn("from", F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (i == 0) | (role(i) != role(i - 1))))

    def block(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get("from", k + 1), F.col("n"))
        return F.struct(role(at).alias("role"), F.transform(F.slice("t", at + 1, end - at), lambda x: x["text"]).alias("texts"))

    one = one.select("conv_id", F.transform("from", block).alias("b"))

    def head(b: Column) -> Column:
        return (F.when(b["role"] == "user", F.lit(OPEN + USER)).when(b["role"] == "assistant", F.lit(OPEN))
                .otherwise(F.concat(F.lit(OPEN + ROLE), escape(b["role"]), F.lit(ROLE_END))))

    # pieces in order, each with whether the loss covers it; concatenated they are the text
    def pieces(b: Column) -> Column:
        loss = b["role"] == "assistant"
        def piece(text, on):
            return F.struct(text.alias("s"), on.alias("on"))
        body = F.flatten(F.transform(b["texts"], lambda x, i: F.array(
            piece(F.when(i > 0, F.lit(TURN)).otherwise(""), F.lit(False)), piece(escape(x), loss))))
        tail = F.when(b["role"] == "user", F.lit(USER_END + CLOSE)).otherwise(F.lit(CLOSE))
        return F.concat(F.array(piece(head(b), F.lit(False))), body, F.array(piece(tail, F.lit(False))))

    one = one.select("conv_id", F.flatten(F.transform("b", pieces)).alias("p"))
    # places in chunks of pieces, then the chunks' places: arrays that grow in a fold stay short
    chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("p") - 1) / CHUNK), F.lit(0)).cast("int")), lambda c: F.slice("p", c * CHUNK + 1, F.lit(CHUNK)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def locate(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["s"])
        return F.struct(end.alias("at"), F.when(p["on"], F.concat(acc["spans"], F.array(
            F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"))

    one = one.select("conv_id", F.array_join(F.transform("p", lambda p: p["s"]), "").alias("formatted"),
                     F.transform(chunks, lambda c: F.aggregate(c, start, locate)).alias("c"))
    zero = F.array(F.lit(0).cast("long"))
    one = one.withColumn("o", F.aggregate("c", zero, lambda o, c: F.concat(o, F.array(F.element_at(o, -1) + c["at"]))))
    moved = lambda c, i: F.transform(c["spans"], lambda s: F.struct((s["start"] + F.get("o", i)).alias("start"), (s["end"] + F.get("o", i)).alias("end")))
    return one.select("conv_id", "formatted", F.flatten(F.transform("c", moved)).alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` read back from a formatted text."""
    blocks = F.transform(F.filter(F.split(formatted, CLOSE), lambda x: x != ""), lambda x: F.substr(x, F.lit(len(OPEN) + 1)))

    def turns(b: Column) -> Column:
        user, named = F.startswith(b, F.lit(USER)), F.startswith(b, F.lit(ROLE))
        # the role ends at its first end mark: escaped roles hold none
        cut = F.instr(b, ROLE_END)
        role = (F.when(user, F.lit("user")).when(named, unescape(F.substr(b, F.lit(len(ROLE) + 1), cut - 1 - len(ROLE))))
                .otherwise(F.lit("assistant")))
        body = (F.when(user, F.substr(b, F.lit(len(USER) + 1), F.length(b) - len(USER) - len(USER_END)))
                .when(named, F.substr(b, cut + len(ROLE_END))).otherwise(b))
        return F.transform(F.split(body, r"\[TURN\]"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return unescape(F.array_join(F.transform(spans, lambda s: F.substr(
        formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def digest(out: DataFrame) -> DataFrame:
    """The contract's columns, read back from the operator's output."""
    turns = F.col("turns")
    return (out.withColumn("turns", read_turns(F.col("formatted")))
            .withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
            .select("conv_id", F.size(turns).cast("long").alias("n_turns"),
                    F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars")))


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixed = spark.sql("SELECT -1L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text "
                      "FROM VALUES (0L, 'user'), (1L, 'assistant') AS v(turn, role)")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(fixed)
    return digest(format_conversations(chats))


def _sql_escape(c: str) -> str:
    x = f"replace({c}, '\\', '\\\\')"
    for s in (OPEN, CLOSE, USER, USER_END, ROLE, ROLE_END, TURN):
        x = f"replace({x}, '{s}', '{s[0]}\\{s[1:]}')"
    return x


OP1_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM r),
b AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i) = role, false) AS same FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length({_sql_escape('text')}) + CASE WHEN same THEN {len(TURN)}
      ELSE {len(OPEN + CLOSE)} + CASE role WHEN 'user' THEN {len(USER + USER_END)} WHEN 'assistant' THEN 0
           ELSE {len(ROLE + ROLE_END)} + length({_sql_escape('role')}) END END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id"""
