"""Chat formatting from an event log, with built-in functions only.

The log is partitioned by conversation and sorted by sequence; deltas, edits and
regenerations are folded into final messages, which are then rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, TAIL = "### ", " </turn>\n"
_CODES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column) -> Column:
    """Reversible: afterwards there is no '#' and no '<', so no control string, in the text."""
    for plain, coded in _CODES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(_CODES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of a log with conv_id, seq, message, kind, role, text.

    kind: `message` starts a message, `delta` appends to it, `edit` and `regenerate`
    replace all before them. A null or other kind counts as `delta`. The role is that
    of the first event that has one; null text is empty. Ties of seq go by role and
    text. Returns conv_id, message, seq (of the first event), role, text. A null
    conv_id is a conversation of its own.
    """
    by_message = Window.partitionBy("conv_id", "message")
    fresh = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("seq"))).over(by_message)
    rows = events.select("conv_id", "message", "seq", "kind", F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), fresh.alias("__fresh"))
    part = F.when(F.col("__fresh").isNull() | (F.col("seq") >= F.col("__fresh")), F.struct("seq", "role", "text"))
    folded = rows.groupBy("conv_id", "message").agg(
        F.min("seq").alias("seq"), F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("__role"), F.array_sort(F.collect_list(part)).alias("__parts")
    )
    return folded.select("conv_id", "message", "seq", F.coalesce("__role.role", F.lit("")).alias("role"), F.array_join("__parts.text", "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation of messages (conv_id, seq, role, text): conv_id, formatted, loss_spans.

    Messages come by seq, then role and text. Null role and text are empty.
    loss_spans: start and end (code points) of the assistant texts in formatted.
    """
    turn = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("__turns"))
    coded = turns.select(
        "conv_id",
        F.transform(
            "__turns",
            lambda t: F.struct(
                F.concat(F.lit(HEAD), escape(t["role"]), F.lit(":\n")).alias("head"), escape(t["text"]).alias("body"), (F.lower(t["role"]) == "assistant").alias("loss")
            ),
        ).alias("__coded"),
    )
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))

    def step(acc: Column, t: Column) -> Column:
        first = acc["at"] + F.char_length(t["head"])
        last = first + F.char_length(t["body"])
        return F.struct((last + len(TAIL)).alias("at"), F.when(t["loss"], F.concat(acc["out"], F.array(F.struct(first.alias("start"), last.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return coded.select(
        "conv_id",
        F.array_join(F.transform("__coded", lambda t: F.concat(t["head"], t["body"], F.lit(TAIL))), "").alias("formatted"),
        F.aggregate("__coded", start, step, lambda acc: acc["out"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text), loss_text (array), formatted: parsed from formatted and loss_spans alone."""
    blocks = F.filter(F.split("formatted", "\\Q" + TAIL + "\\E", -1), lambda b: b != "")

    role = lambda b: F.regexp_extract(b, "(?s)^### (.*?):\n", 1)
    turns = F.transform(blocks, lambda b: F.struct(unescape(role(b)).alias("role"), unescape(F.regexp_extract(b, "(?s)^### .*?:\n(.*)$", 1)).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def digest(parsed: DataFrame) -> DataFrame:
    """Counts and digests of what read_back found."""
    loss = F.array_join("loss_text", "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def conversations_as_events(rows: DataFrame) -> DataFrame:
    """Each row (conv_id, turn, role, text) as a message of its own; repeated rows stay apart."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("seq"), "role", "text").select("conv_id", "seq", F.col("seq").alias("message"), F.lit("message").alias("kind"), "role", "text")
