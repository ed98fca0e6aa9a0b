"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as
context, the reply as the only trainable span.  Turns after the last reply (or a
conversation without one) make one more example with an empty span, so the whole
conversation can be read back from the output.

A turn is TURN, its role, a line feed, its text, END and a line feed.  Inside
roles and texts a backslash follows each ``<``, ``[`` and backslash, so no control
string of this or another bracketed template can occur there; a line feed in a
role is written ``[n``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = "<|turn|>"
END = "<|end|>\n"
TRAINED_ROLE = "assistant"


def escape(text):
    for c in ("\\", "<", "["):
        text = F.replace(text, F.lit(c), F.lit(c + "\\"))
    return text


def unescape(text):
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def format_examples(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row per example: conv_id, lone (numbers the rows without conv_id, else
    null), target (number of its last turn in the conversation, from 1), whole (it ends with the last turn), trained (its last
    turn is the reply), formatted, loss_start and loss_end (code points of the
    trainable span, end exclusive).

    turns: conv_id, turn, role, text.  Null texts and roles are empty.  Turns go
    by (turn, role, text), nulls first, so ties have a fixed order and repeated
    rows are turns of their own.  A row without conv_id can't be put with others
    and is a conversation of its own.  Long texts are kept whole, other columns
    aren't read, and no rows give no examples.  Examples hold whole prefixes: their size grows with the square of a
    conversation's length, which is the operation asked for.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), F.replace(escape(role), F.lit("\n"), F.lit("[n")), F.lit("\n"))
    conv = F.col("conv_id").cast("long")
    one = turns.select(conv.alias("conv_id"), F.when(conv.isNull(), F.monotonically_increasing_id()).alias("lone"), F.struct("turn", role.alias("role"), text.alias("text"), head.alias("head"), escape(text).alias("body")).alias("t"))
    convs = one.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    convs = convs.withColumn("ts", F.expr("concat(filter(ts, t -> t.turn is null), filter(ts, t -> t.turn is not null))"))
    each = convs.select("conv_id", "lone", "ts", F.posexplode("ts").alias("k", "last"))
    whole = F.col("k") == F.size("ts") - 1
    trained = F.col("last.role") == trained_role
    prefix = F.expr(f"array_join(transform(slice(ts, 1, k), t -> concat(t.head, t.body, '{END[:-1]}\\n')), '')")
    ends = each.filter(whole | trained).select("conv_id", "lone", (F.col("k") + 1).alias("target"), whole.alias("whole"), trained.alias("trained"), prefix.alias("prefix"), "last")
    start = (F.char_length("prefix") + F.char_length("last.head")).cast("long")
    return ends.select(
        "conv_id",
        "lone",
        "target",
        "whole",
        "trained",
        F.concat("prefix", "last.head", "last.body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        F.when(F.col("trained"), start + F.char_length("last.body")).otherwise(start).cast("long").alias("loss_end"),
    )


def read_turns(formatted) -> object:
    """The turns (role, text) of a formatted conversation, as an array."""
    parts = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")

    def turn(p):
        body = F.substr(p, F.lit(len(TURN) + 1))
        cut = F.instr(body, "\n")
        role = unescape(F.replace(F.substr(body, F.lit(1), cut - 1), F.lit("[n"), F.lit("\n")))
        return F.struct(role.alias("role"), unescape(F.substr(body, cut + 1)).alias("text"))

    return F.transform(parts, turn)


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars (over all examples)."""
    back = F.when(F.col("whole"), read_turns(F.col("formatted")))
    loss = F.when(F.col("trained"), F.struct("target", unescape(F.expr("substr(formatted, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))")).alias("text")))
    rows = examples.select("conv_id", "lone", back.alias("ts"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("chars"))
    rows = rows.select(
        "conv_id",
        "lone",
        F.size("ts").cast("long").alias("n"),
        F.when(F.col("ts").isNotNull(), F.sha2(F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)).alias("sha"),
        "loss",
        "chars",
    )
    convs = rows.groupBy("conv_id", "lone").agg(F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.array_sort(F.collect_list("loss")).alias("losses"), F.sum("chars").alias("formatted_chars"))
    loss_text = F.array_join(F.transform("losses", lambda x: x["text"]), "")
    out = convs.select("conv_id", "n_turns", "turns_sha256", loss_text.alias("_loss"), "formatted_chars")
    return out.select("conv_id", "n_turns", "turns_sha256", F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")


#: DuckDB SQL for the digests of ``conversations`` and conversation -1.
DIGEST_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
c AS (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone FROM t),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, lone ORDER BY turn NULLS FIRST, role, text) AS k, count(*) OVER (PARTITION BY conv_id, lone) AS n,
      length(replace(replace(replace(role, '\\', '\\\\'), '<', '<\\'), '[', '[\\')) + (length(role) - length(replace(role, chr(10), '')))
      + length(replace(replace(replace(text, '\\', '\\\\'), '<', '<\\'), '[', '[\\')) + {len(TURN) + 1 + len(END)} AS chars FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id, lone ORDER BY k) AS upto FROM s)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = '{TRAINED_ROLE}'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = '{TRAINED_ROLE}'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = '{TRAINED_ROLE}' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id, lone
"""
