"""Preference formatting of conversations.

The longest common turn prefix of a chosen and a rejected conversation is rendered
once as the prompt; what follows in each is rendered as a completion, with a mask
that tells which of its characters are trained on (assistant turns and their end
marks).  DataFrame functions only.

A conversation is one record of the result, so its turns meet in one row; that row is
as large as the conversation and no larger.  Pairs are keyed by id, so no text, role
or first turn, however common, makes a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks around a turn.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>\n"


def adjacent_pairs(conversations: DataFrame) -> DataFrame:
    """Pairing of the query: conversations 2n (chosen) and 2n + 1 (rejected)."""
    side = F.pmod(F.col("conv_id"), F.lit(2))
    return conversations.select("conv_id").distinct().select("conv_id", F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), F.when(side == 0, "chosen").otherwise("rejected").alias("side"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(TURN_START), t["role"], F.lit("\n"), t["text"], F.lit(TURN_END))), "")


def _mask(turns: Column) -> Column:
    """Spans [start, end) of trained characters, in code points of the rendering."""
    head = lambda t: F.length(F.concat(F.lit(TURN_START), t["role"], F.lit("\n")))
    size = lambda t: head(t) + F.length(t["text"]) + len(TURN_END)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        span = F.array(F.struct((acc["at"] + head(t)).alias("start"), (acc["at"] + size(t)).alias("end")))
        return F.struct((acc["at"] + size(t)).alias("at"), F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_examples(conversations: DataFrame, pairs: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` and ``pairs(pair_id, conv_id, side)``
    to one row per pair that has both sides.

    Columns: pair_id, n_prompt_turns, n_chosen_turns, n_rejected_turns (turns after
    the prompt), prompt, chosen, rejected, chosen_mask and rejected_mask (spans of
    trained code points of the completion).

    Turns are ordered by turn, then role and text.  If one conversation is a prefix of
    the other, the prompt is that prefix and its own completion is empty.

    Edge cases: null roles and texts count as empty; null turns come first; rows
    without conv_id and pairs with one side are left out, as they have no counterpart;
    exactly repeated turns count once; an empty table gives an empty result; further
    columns are ignored.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sided = conversations.where("conv_id is not null").select("conv_id", turn.alias("t")).join(pairs.select("pair_id", "conv_id", "side"), "conv_id")
    ordered = lambda side: F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("side") == side, F.col("t")))))
    both = sided.groupBy("pair_id").agg(ordered("chosen").alias("c"), ordered("rejected").alias("r")).where("size(c) > 0 and size(r) > 0")
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    # The first place that differs; zip_with pads the shorter side, so one is found unless all turns agree.
    n = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size("c"))
    cut = both.withColumn("n", n.cast("int"))
    after = lambda name: F.expr(f"slice({name}, n + 1, size({name}))")
    cut = cut.select("pair_id", "n", F.expr("slice(c, 1, n)").alias("p"), after("c").alias("c"), after("r").alias("r"))
    return cut.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        F.size("c").cast("long").alias("n_chosen_turns"),
        F.size("r").cast("long").alias("n_rejected_turns"),
        _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"),
        _render(F.col("r")).alias("rejected"),
        _mask(F.col("c")).alias("chosen_mask"),
        _mask(F.col("r")).alias("rejected_mask"),
    )


def preference_digest(conversations: DataFrame) -> DataFrame:
    """Examples of adjacent conversations, masks as text ``start:end`` comma-joined.

    Edge cases: as in ``preference_examples``; a conversation whose neighbour is missing
    gives no row; an empty mask is the empty text.
    """
    spans = lambda c: F.array_join(F.transform(F.col(c), lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    made = preference_examples(conversations, adjacent_pairs(conversations.where("conv_id is not null")))
    return made.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))
