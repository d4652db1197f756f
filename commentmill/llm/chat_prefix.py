"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, and only its
text under the loss mask. A turn is written ``<s>[INST]role[/INST]text</s>``. Control strings
inside roles and texts get a backslash after their first character, backslashes are doubled, and
``unescape`` undoes both. Turns after the last reply (or of a conversation without any) are kept as
one more example with an empty mask, so the output holds the whole conversation.

Defined cases: a null role or text is empty; rows of one turn number are ordered by role, then
text, and all kept; null conversation ids form one conversation; an empty table gives no example.
Other columns of the input are not read. A conversation is one training text, so it must fit in a
task; its examples are cut from it one row at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentmill.llm.common import empty_if_null

# The control strings of the template.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
START, END, OPEN, CLOSE = CONTROL


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    """A doubled backslash is one, a single one goes."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def format_examples(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                    role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per example: conv_id, example (from 1), text, loss_start, loss_end (code points,
    end exclusive; equal if nothing is trained), last (it holds the whole conversation)."""
    turns = df.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), empty_if_null(F.col(role_col)).alias("role"),
                 empty_if_null(F.col(text_col)).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    written = whole.select("conv_id", F.transform("ts", lambda t: F.struct(
        F.concat(F.lit(START + OPEN), escape(t["role"]), F.lit(CLOSE)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("reply"))).alias("ts"))
    piece = F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END)))
    # running ends of the turns, by one fold over their lengths
    ends = F.aggregate(
        "ts", F.array().cast("array<int>"),
        lambda acc, t: F.concat(acc, F.array(
            F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(t["head"])
            + F.length(t["body"]) + len(END))))
    placed = (written.withColumn("ends", ends).withColumn("all", F.array_join(piece, ""))
              .withColumn("n", F.size("ts"))
              .withColumn("ts", F.transform("ts", lambda t: F.struct(
                  F.length(t["body"]).alias("len"), t["reply"].alias("reply")))))
    chosen = placed.select("conv_id", "ends", "all", "n", "ts", F.explode(F.filter(
        F.sequence(F.lit(1), F.col("n")),
        lambda i: F.element_at("ts", i)["reply"] | (i == F.col("n")))).alias("i"))
    end = F.element_at("ends", F.col("i"))
    turn = F.element_at("ts", F.col("i"))
    stop = end - len(END)
    return chosen.select(
        "conv_id", F.col("i").alias("turn_no"), F.substring(F.col("all"), F.lit(1), end).alias("text"),
        F.when(turn["reply"], stop - turn["len"]).otherwise(end).alias("loss_start"),
        F.when(turn["reply"], stop).otherwise(end).alias("loss_end"),
        (F.col("i") == F.col("n")).alias("last"))


def read_turns(text: Column) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    parts = F.filter(F.split(text, END), lambda p: p != "")
    body = F.transform(parts, lambda p: F.substring(p, len(START + OPEN) + 1, F.length(p)))
    return F.transform(body, lambda p: F.struct(
        unescape(F.substring_index(p, CLOSE, 1)).alias("role"),
        unescape(F.substring(p, F.locate(CLOSE, p) + len(CLOSE), F.length(p))).alias("text")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts and masks alone: n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars (of all examples together)."""
    trained = unescape(F.substring(F.col("text"), F.col("loss_start") + 1,
                                   F.col("loss_end") - F.col("loss_start")))
    seen = examples.select(
        "conv_id", F.struct(F.col("turn_no"), trained.alias("loss")).alias("l"),
        F.length("text").cast("bigint").alias("chars"),
        F.when(F.col("last"), read_turns(F.col("text"))).alias("turns"))
    conv = seen.groupBy("conv_id").agg(
        F.sort_array(F.collect_list("l")).alias("l"), F.sum("chars").alias("formatted_chars"),
        F.first("turns", ignorenulls=True).alias("turns"))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(
        t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("l.loss"), "")
    return conv.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars")
