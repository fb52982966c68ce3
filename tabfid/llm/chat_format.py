"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it are the
context, and only that reply is trainable.  Turns after the last reply (or of a conversation
without a reply) come as one more example without a trainable part, so no turn is lost and the
last example of a conversation holds all its turns.

Template of a turn: ``<|im_start|>`` role, newline, text, ``<|im_end|>`` newline.  Inside roles and
texts ``\\`` is doubled and every control string gets a ``\\`` after its first character, so none
occurs there; a newline in a role gets a ``\\`` before it.  Taking each ``\\`` out, with the
character after it as it is, gives the text back.

An example holds its whole conversation up to the reply; the rows are made one at a time from the
conversation's turns, so a long conversation costs the memory of one example, not of all.

Edge cases: null roles and texts count as empty; turns are ordered by ``turn`` (nulls first), ties
by role, then text; repeated rows are turns of their own; a null conv_id is one conversation; an
empty table gives no examples; other columns of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings that texts must not hold.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
CONTROLS = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
REPLY = "assistant"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda c, s: F.replace(c, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROLS, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted_turn(role: Column, text: Column) -> Column:
    name = F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))
    return F.concat(F.lit(OPEN), name, F.lit("\n"), escaped(text), F.lit(CLOSE + "\n"))


def examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(conv_id, example, text, loss_start, loss_end, is_last): code points, end exclusive; equal
    bounds where nothing is trainable.  ``example`` counts from 0 within a conversation."""
    t = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
                     F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    conv = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    conv = conv.select(
        "conv_id", F.transform("turns", lambda x: formatted_turn(x["role"], x["text"])).alias("parts"),
        F.filter(F.transform("turns", lambda x, i: F.when(
            (x["role"] == REPLY) | (i == F.size("turns") - 1),
            F.struct(i.alias("at"), F.when(x["role"] == REPLY, F.length(escaped(x["text"]))).alias("n")))),
            lambda x: x.isNotNull()).alias("targets"))
    one = conv.select("conv_id", "parts", F.size("targets").alias("of"), F.posexplode_outer("targets").alias("example", "target"))
    body = F.array_join(F.slice("parts", F.lit(1), F.col("target.at") + 1), "")
    one = one.select("conv_id", "example", body.alias("text"), "target.n", (F.col("example") == F.col("of") - 1).alias("is_last"))
    end = F.length("text") - len(CLOSE) - 1
    return one.select("conv_id", "example", "text", (end - F.coalesce("n", F.lit(0))).alias("loss_start"),
                      end.alias("loss_end"), "is_last")


def parsed_turns(text: Column) -> Column:
    """array<struct<role, text>>: the turns of an example's text."""
    parts = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda p: p != "")
    head = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*+)\n(.*)$"
    return F.transform(parts, lambda p: F.struct(unescaped(F.regexp_extract(p, head, 1)).alias("role"),
                                                 unescaped(F.regexp_extract(p, head, 2)).alias("text")))


def loss_text(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example, unescaped."""
    return unescaped(F.substring(text, start + 1, end - start))
