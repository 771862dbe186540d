"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it as context, and only its
reply under the loss mask.  A turn is written ``<s>role\\ntext\\n</s>``.  A control string inside a
text gets one backslash before it, and reading back takes one away; as a line feed stands before
every real end mark, no text can forge or swallow a mark.  If turns follow the last assistant turn,
or there is none, one more row holds the whole conversation with nothing to train on, so that the
output loses no turn.

An example is one row by definition, so a conversation must fit into one; it is gathered once, and
its examples are cut from it one at a time.  Nothing but the turns themselves is shuffled.

Defined results: null texts and roles are empty; turns are ordered by turn, then role, then text
(nulls first), so ties and repeated rows have one order and all are kept; a row without conversation
id is a conversation by itself; other columns are not part of an example; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: control strings that are escaped, and the marks of a turn.
CONTROL = r"(</?s>|\[/?INST\]|<</?SYS>>)"
START, END = "<s>", "\n</s>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\" + CONTROL, "$1")


def _escape_role(role: Column) -> Column:
    """Roles stand before the first line feed, so theirs are written as backslash and n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def expand(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, target, text, loss_start, loss_chars, whole) of conversations.

    ``target`` counts turns from 1; ``loss_start`` is the code point (from 1) where the trainable
    text begins and is null where there is none; ``whole`` marks the row with all turns.
    """
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    role, text = F.coalesce("role", F.lit("")), escape(F.coalesce("text", F.lit("")))
    turn = F.struct(
        F.col("turn"),
        role.alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.concat(F.lit(START), _escape_role(role), F.lit("\n"), text, F.lit(END)).alias("written"),
        F.char_length(text).alias("chars"),
    )
    gathered = (
        turns.select("conv_id", lone, turn.alias("t"))
        .groupBy("conv_id", "lone")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .withColumn("n", F.size("turns"))
    )
    trained = lambda k: F.element_at("turns", k)["role"] == TRAINED
    targets = F.filter(F.sequence(F.lit(1), F.col("n")), lambda k: trained(k) | (k == F.col("n")))
    example = gathered.select(
        "conv_id",
        "lone",
        F.explode(targets).alias("target"),
        "n",
        F.transform("turns", lambda t: t["written"]).alias("written"),
        F.transform("turns", lambda t: F.when(t["role"] == TRAINED, t["chars"])).alias("chars"),
    )
    loss_chars = F.element_at("chars", F.col("target"))
    cut = F.array_join(F.slice("written", F.lit(1), F.col("target")), "")
    return example.select("conv_id", "lone", "target", cut.alias("text"), loss_chars.alias("loss_chars"), (F.col("target") == F.col("n")).alias("whole")).select(
        "conv_id",
        "lone",
        "target",
        "text",
        (F.char_length("text") - len(END) - F.col("loss_chars") + 1).alias("loss_start"),
        "loss_chars",
        "whole",
    )


def read_turns(text: Column) -> Column:
    """The (role, text) pairs of a formatted text."""
    written = F.split(text, END)
    parts = F.transform(F.slice(written, F.lit(1), F.size(written) - 1), lambda t: F.substring(t, len(START) + 1, 2**31 - 1))
    return F.transform(
        parts,
        lambda t: F.struct(
            _unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
            unescape(F.substr(t, F.char_length(F.substring_index(t, "\n", 1)) + 2)).alias("text"),
        ),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples hold: all turns, the trained texts in order, and the size."""
    row = examples.select(
        "conv_id",
        "lone",
        F.when(F.col("whole"), read_turns(F.col("text"))).alias("turns"),
        F.struct("target", unescape(F.substr("text", "loss_start", "loss_chars")).alias("text")).alias("loss"),
        F.char_length("text").cast("long").alias("chars"),
    )
    done = row.groupBy("conv_id", "lone").agg(
        F.first("turns", ignorenulls=True).alias("turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list("loss")), lambda x: x["text"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
    )
    return done.drop("lone")
