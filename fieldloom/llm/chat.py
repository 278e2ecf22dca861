"""Chat formatting with prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns up to it, formatted, with only that reply trainable.
Turns after the last reply make a context-only example, so no turn is lost. A turn reads

    [INST]role[/INST]text</s>

and control strings inside roles and texts get a backslash before their closing bracket (one more where there are some),
which unescape() takes away again; so a formatted conversation can be read back exactly.

An example holds its whole context, so a conversation of n turns takes n^2/2 turns of output; examples are made one
after the other, and a task holds one conversation and one example at a time: some four times its text, so 400 MB for a
conversation of 100 MB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the template writes between roles and texts.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"

_CONTROL = r"(</?s|\[/?INST)(\\*)([>\]])"
_ESCAPED = r"(</?s|\[/?INST)(\\*)\\([>\]])"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, _CONTROL, r"$1$2\\$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, _ESCAPED, "$1$2$3")


def chat_examples(turns: DataFrame, conv: str = "conv_id", order: str = "turn", trainable: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (from 0), n_context, formatted, loss_start, loss_chars, complete.

    loss_start and loss_chars give the trainable span of formatted in code points (escaped text); loss_chars is null in
    a context-only example. complete marks the example that holds the whole conversation. Turns go by `order`, then
    role, then text; a null role or text is empty, a null conv_id a conversation of its own; repeated rows are turns of
    their own; an empty table gives no examples; turns of any length are kept whole. Other columns, whatever their
    names, are ignored.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv_id"), F.struct(F.col(order).alias("o"), role.alias("role"), text.alias("text")).alias("t"))
    talk = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    head = F.transform("t", lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE)))
    body = F.transform("t", lambda x: escape(x["text"]))
    talk = talk.select("conv_id", head.alias("head"), body.alias("body"), F.transform("t", lambda x: x["role"] == F.lit(trainable)).alias("mine"))
    talk = talk.select("*", F.zip_with("head", "body", lambda h, b: F.concat(h, b, F.lit(END))).alias("piece"), F.size("mine").alias("n"))
    at = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("mine", i) | (i == F.col("n") - 1))
    one = talk.select("*", F.posexplode(at).alias("example", "i")).select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("i").cast("long").alias("n_context"),
        F.array_join(F.slice("piece", F.lit(1), F.col("i")), "").alias("context"),
        F.get("piece", F.col("i")).alias("last"),
        F.get("head", F.col("i")).alias("h"),
        F.when(F.get("mine", F.col("i")), F.length(F.get("body", F.col("i")))).cast("long").alias("loss_chars"),
        (F.col("i") == F.col("n") - 1).alias("complete"),
    )
    return one.select(
        "conv_id",
        "example",
        "n_context",
        F.concat("context", "last").alias("formatted"),
        (F.length("context") + F.length("h")).cast("long").alias("loss_start"),
        "loss_chars",
        "complete",
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        two = F.split(p, r"\[/INST\]", 2)
        return F.struct(unescape(F.substr(two[0], F.lit(len(OPEN) + 1))).alias("role"), unescape(two[1]).alias("text"))

    return F.transform(pieces, turn)


def trained_text(formatted: Column, start: Column, chars: Column) -> Column:
    """The unescaped text under the loss mask of one example."""
    return unescape(F.substr(formatted, start.cast("int") + 1, chars.cast("int")))


def chat_digest(examples: DataFrame) -> DataFrame:
    """What each conversation's examples say, read back from them alone."""
    turns = F.when(F.col("complete"), read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = examples.select(
        "conv_id",
        turns.alias("turns"),
        F.struct("example", F.coalesce(trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")), F.lit("")).alias("text")).alias("loss"),
        F.length("formatted").cast("long").alias("chars"),
    )
    rows = rows.select("conv_id", F.size("turns").cast("long").alias("n"), F.sha2(said, 256).alias("sha"), "loss", "chars")
    out = rows.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), F.sort_array(F.collect_list("loss")).alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples")
    )
    out = out.withColumn("loss", F.array_join(F.transform("loss", lambda x: x["text"]), ""))
    return out.select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples"
    )
