"""Chat formatting as relational expressions: one formatted string a conversation.

Turn structs are collected, sorted and merged by array functions only (no
Python on the executors). The template:

    <|turn|>ROLE<|text|>TEXT[<|text|>TEXT ...]<|end|>   for each block

where a block holds adjacent turns of one role. Inside roles and texts every
character that could begin a control string is followed by a backslash, so no
control string survives in them; unescape() takes the backslashes out again.

Defined results: null texts and roles count as empty; null conv_id is a
conversation of its own; null turns come first; equal turn numbers are ordered
by role and text; repeated rows are turns of their own; extra columns are
ignored; an empty table gives an empty result. A conversation is one row of the
result, so its turns meet in one task by nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import need

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Also escaped: the control strings of common chat templates, <s> </s> [INST] [/INST] <<SYS>> <</SYS>>.
_OPENS = r"\\|<(?=[|/<\\]|s>)|\[(?=/?INST\]|\\)"
_CLOSES = r"([\\<\[])\\"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_OPENS), F.lit(r"$0\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(_CLOSES), F.lit("$1"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments, loss_role of each conversation of turns (conv_id, turn, role, text).

    segments: array of (text, loss), which concatenated are ``formatted``; loss
    marks the (escaped) texts of ``loss_role``, the spans that a trainer learns.
    """
    need(turns, "conv_id", "turn", "role", "text")
    row = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", row.alias("row")).groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("turns"))

    def pieces(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(F.col("turns"), i - 1)["role"])
        head = F.when(before == x["role"], F.lit(TEXT)).otherwise(
            F.concat(F.when(i > 0, F.lit(END)).otherwise(F.lit("")), F.lit(TURN), escape(x["role"]), F.lit(TEXT))
        )
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(head, F.lit(False)), part(escape(x["text"]), x["role"] == loss_role))

    tail = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    out = sorted_turns.select("conv_id", F.concat(F.flatten(F.transform("turns", pieces)), tail).alias("segments"))
    return out.select("conv_id", F.concat_ws("", F.col("segments")["text"]).alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted string again: array of (role, text), escapes undone."""
    blocks = F.filter(F.split(formatted, r"<\|turn\|>"), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        parts = F.split(F.regexp_replace(block, F.lit(r"<\|end\|>\z"), F.lit("")), r"<\|text\|>")
        return F.transform(F.slice(parts, 2, F.size(parts)), lambda t: F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns_of))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from format_conversations(): counts and SHA-256 digests."""
    turn_text = F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])))
    return (
        formatted.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("read"), loss.alias("loss"))
        .select(
            "conv_id",
            F.size("read").cast("long").alias("n_turns"),
            F.sha2(turn_text, 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
    )


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    len(role || text)
    + len(role || text) - len(replace(role || text, chr(92), ''))
    + (len(text) - len(replace(text, '<|', ''))) // 2 + (len(text) - len(replace(text, '</', ''))) // 2
    + (len(text) - len(replace(text, '<' || chr(92), ''))) // 2 + (len(text) - len(replace(text, '<s>', ''))) // 3
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '<+'), lambda x: len(x) - 1)), 0)
    + (len(text) - len(replace(text, '[INST]', ''))) // 6 + (len(text) - len(replace(text, '[/INST]', ''))) // 7
    + (len(text) - len(replace(text, '[' || chr(92), ''))) // 2 AS chars
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  (sum(CASE WHEN before = role THEN chars - len(role) + 8 ELSE chars + 16 + 7 END))::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
