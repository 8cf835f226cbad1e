"""Chat formatting: every participant's view of a dialogue.

For each participant the dialogue is rendered once, with that speaker's turns as
the assistant's, everybody else's as those of named users and system turns as
they are.  The masks tell which characters a model should learn from: the text
and the end mark of the assistant's turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of a turn (fixed values of the common chat markup).
START, END = "<|im_start|>", "<|im_end|>\n"
SYSTEM = "system"


def _guarded(text: Column) -> Column:
    """Marks inside a text are broken up, so that no speaker can forge a turn."""
    return F.replace(text, F.lit("<|im_"), F.lit("<|im-"))


def _head(name: Column) -> Column:
    return F.concat(F.lit(START), name, F.lit("\n"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", system: str = SYSTEM) -> DataFrame:
    """One row per conversation and participant.

    Columns: ``conv_id``, ``participant``, ``n_turns``, ``n_own`` (turns of the
    participant), ``rendered``, ``spans`` (array of start and length, in
    characters of ``rendered``, that count for the loss) and ``n_masked_in``
    (their characters).

    Participants are the roles of a conversation other than the system's; rows
    with a null role are one participant, null, who is a user without a name.
    Turns stand by turn number, then role and text, null first; repeated turns
    stay.  Null texts are empty.  Marks are broken up and line breaks become
    spaces in names, as marks are in texts.  Rows without a conversation id form
    one conversation.  A conversation of system turns alone gives no row; an empty
    table gives none.  Other columns are not read.  A rendering is one row, so a
    conversation must fit into one.
    """
    order = ["turn", "role", "text"]
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), _guarded(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    shown = F.translate(_guarded(F.col("role")), "\r\n", "  ")
    name = F.when(F.col("role") == system, F.lit(system)).when(F.col("role").isNull(), "user").otherwise(F.concat(F.lit("user name="), shown))
    rows = rows.withColumn("head", _head(name)).withColumn("body", F.concat("text", F.lit(END)))
    # Where a turn begins if it is anybody else's; its speaker's view is shifted by their own heads up to there.
    before = Window.partitionBy("conv").orderBy(*[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.char_length("head") + F.char_length("body")).over(before), F.lit(0)).cast("long"))
    talks = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("at", "role", "head", "body"))).alias("turns"))
    speakers = F.array_sort(F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: ~r.eqNullSafe(F.lit(system)))))
    views = talks.select("conv", "turns", F.explode(speakers).alias("participant"))

    mine, own_head = (lambda t: t["role"].eqNullSafe(F.col("participant"))), _head(F.lit("assistant"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(F.when(mine(t), own_head).otherwise(t["head"]), t["body"])), "")

    def span(t: Column, k: Column) -> Column:
        start = t["at"] + (k + 1) * F.char_length(own_head) - k * F.char_length(t["head"])
        return F.struct(start.cast("long").alias("start"), F.char_length(t["body"]).cast("long").alias("length"))

    views = views.select("conv", "participant", F.size("turns").cast("long").alias("n_turns"), text.alias("rendered"), F.transform(F.filter("turns", mine), span).alias("spans"))
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["length"])
    return views.select(F.col("conv").alias("conv_id"), "participant", "n_turns", F.size("spans").cast("long").alias("n_own"), "rendered", "spans", total.alias("n_masked_in"))
