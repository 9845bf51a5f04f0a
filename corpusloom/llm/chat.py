"""Chat turns as training examples: one per assistant turn, all earlier turns its context, only that reply trainable.

Template: each turn is ``<|role|>\\n`` + text + ``<|end|>\\n``. In texts a backslash is doubled and one is put between
``<`` and ``|``; in roles, before ``|``. So control strings, all of which begin with ``<|``, occur in no escaped text.
Escaping is undone by dropping each backslash and keeping what follows it.

The turns of a conversation are ordered by turn, then role, then text. A null text or role is empty; a null turn comes first;
rows with a null conv_id are one conversation. Turns after the last assistant turn belong to no reply: they are kept in one
more example, with nothing trainable, so that formatting loses no turn. Conversations without rows don't exist.

An example holds what precedes it, so a conversation of n turns takes the square of n in output. Rows are one
example each, and only the turns of one conversation are gathered, at most once per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def escape(text: Column) -> Column:
    """A text without control strings."""
    return F.replace(F.replace(F.coalesce(text.cast("string"), F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """A role without control strings or bars, which end it."""
    return F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def prefix_targets(turns: DataFrame) -> DataFrame:
    """``(conv_id, example, formatted, loss_start, loss_end)`` of ``turns(conv_id, turn, role, text)``.

    example counts from 0 within a conversation. Characters [loss_start, loss_end) of ``formatted``, in code points, are
    the reply; both are 0 in the example of trailing turns.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    head = F.concat(F.lit("<|"), escape_role(role), F.lit("|>\n"))
    each = turns.select("conv_id", "turn", role.alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), head.alias("head"), escape(F.col("text")).alias("body"))
    item = F.struct("turn", "role", "text", "head", "body")
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("turns"))
    whole = whole.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["head"].alias("head"), t["body"].alias("body"))).alias("turns"))
    # Where examples end: at each assistant turn, and at the last turn.
    ends = F.expr("filter(sequence(0, size(turns) - 1), i -> turns[i].role = 'assistant' or i = size(turns) - 1)")
    cut = whole.select("conv_id", "turns", F.posexplode(ends).alias("example", "last"))
    reply = F.expr("turns[last].role = 'assistant'")
    context = F.expr("concat_ws('', transform(slice(turns, 1, last), t -> concat(t.head, t.body, '<|end|>\n')))")
    cut = cut.select("conv_id", "example", F.concat(context, F.expr("turns[last].head")).alias("before"), F.expr("turns[last].body").alias("body"), reply.alias("reply"))
    start = F.when(F.col("reply"), F.char_length("before")).otherwise(0)
    return cut.select(
        "conv_id", "example", F.concat("before", "body", F.lit(END)).alias("formatted"), start.cast("int").alias("loss_start"),
        F.when(F.col("reply"), start + F.char_length("body")).otherwise(0).cast("int").alias("loss_end"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted example: an array of (role, text)."""
    pieces = F.slice(F.split(formatted, r"<\|end\|>\n"), 1, F.size(F.split(formatted, r"<\|end\|>\n")) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^<\|((?:\\.|[^\\|])*)\|>\n", 1)).alias("role"), unescape(F.regexp_replace(p, r"(?s)^<\|(?:\\.|[^\\|])*\|>\n", "")).alias("text"),
    ))


def read_back(examples: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` from the formatted examples alone."""
    reply = F.when(F.col("loss_end") > 0, unescape(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))).otherwise("")
    one = examples.select("conv_id", "example", "formatted", reply.alias("reply"))
    whole = one.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("example", "reply"))), lambda x: x["reply"])).alias("loss"),
        F.sum(F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    whole = whole.withColumn("turns", parse(F.col("longest")))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return whole.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
