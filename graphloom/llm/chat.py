"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context,
its text alone is trainable. Turns are written with the control strings below; inside
texts each ``[``, ``<`` and ``\\`` gets a ``\\`` after it, so that no control string can
occur there and plain substring search finds the turn limits. Decoding drops those
backslashes again, whatever the text holds.

Edge cases: null text or role counts as empty; equal turn numbers are ordered by role,
then text; repeated rows are repeated turns; a null ``conv_id`` is a conversation of its
own; turns after the last assistant turn (or a conversation without one) give a closing
row whose ``target_turn`` is null and which trains nothing, so that the output holds
every turn; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[TEXT]", "[/ROLE]")
_TURN_START = r"(?=\[INST\]|<s>|\[ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<\\])\\", r"$1")


def _write_turn(t: Column) -> Column:
    text = escape(t["text"])
    return (
        F.when(t["role"] == "user", F.concat(F.lit("[INST]"), text, F.lit("[/INST]")))
        .when(t["role"] == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(t["role"]), F.lit("[TEXT]"), text, F.lit("[/ROLE]")))
    )


def _read_turn(s: Column) -> Column:
    """A struct (role, text) from one written turn."""
    inner = lambda a, b: F.substring(s, F.lit(a + 1), F.length(s) - (a + b))
    return F.struct(
        F.when(s.startswith("[INST]"), F.lit("user"))
        .when(s.startswith("<s>"), F.lit("assistant"))
        .otherwise(unescape(F.split_part(inner(6, 7), F.lit("[TEXT]"), F.lit(1))))
        .alias("role"),
        F.when(s.startswith("[INST]"), unescape(inner(6, 7)))
        .when(s.startswith("<s>"), unescape(inner(3, 4)))
        .otherwise(unescape(F.split_part(inner(6, 7), F.lit("[TEXT]"), F.lit(2))))
        .alias("text"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) structs that a formatted string holds."""
    parts = F.filter(F.split(formatted, _TURN_START), lambda s: s != "")
    return F.transform(parts, _read_turn)


def expand(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, example, target_turn, is_last, formatted, loss_start, loss_length).

    ``loss_start`` and ``loss_length`` are in code points of ``formatted`` and mark the
    trainable reply; both are 0 in a closing row. One shuffle, on ``conv_id``.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            "turn",
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    written = grouped.select(
        "conv_id",
        F.transform("turns", _write_turn).alias("parts"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("reply"),
    )
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("reply", i) | (i == n))
    rows = written.select("conv_id", "parts", "reply", n.alias("n"), F.posexplode(ends).alias("example", "end"))
    trains = F.element_at("reply", F.col("end"))
    last = F.element_at("parts", F.col("end"))
    formatted = F.array_join(F.slice("parts", F.lit(1), F.col("end")), "")
    return rows.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.when(trains, F.col("end") - 1).cast("long").alias("target_turn"),
        (F.col("end") == F.col("n")).alias("is_last"),
        formatted.alias("formatted"),
        F.when(trains, F.length(formatted) - F.length(last) + 3).otherwise(0).cast("long").alias("loss_start"),
        F.when(trains, F.length(last) - 7).otherwise(0).cast("long").alias("loss_length"),
    )


def digest(examples: DataFrame) -> DataFrame:
    """Per conversation, what its formatted examples hold when they are read back.

    The last example has every turn; the trainable texts are gathered from all of them.
    """
    turns = read_turns(F.col("formatted"))
    loss = F.when(
        F.col("target_turn").isNotNull(),
        unescape(F.expr("substring(formatted, cast(loss_start + 1 as int), cast(loss_length as int))")),
    )
    spelled = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("is_last"), F.struct(F.size(turns).cast("long").alias("n"), F.sha2(spelled, 256).alias("sha"))).alias("all"),
        loss.alias("loss"),
    )
    per = read.groupBy("conv_id").agg(
        F.max("all").alias("all"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("loss").isNotNull(), F.struct("example", "loss")))),
                lambda x: x["loss"],
            ),
            "",
        ).alias("loss"),
    )
    return per.select(
        "conv_id",
        F.col("all.n").alias("n_turns"),
        F.col("all.sha").alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
