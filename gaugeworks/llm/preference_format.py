"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

Turns are matched by position; the longest common prefix ends before the first position where role or text
differ, or where one side has ended. The prefix is rendered once as the prompt. The rest of each conversation
is its completion, and the loss mask covers the assistant turns of it alone, as character spans.

Both sides lie in one table with a column that names the side. It is shuffled once, by pair; positions, matches and
span offsets are windows of that partitioning, and the strings one aggregation of it. A pair is one row of the
result, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gaugeworks.llm.common import pick


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>\n"))


def format_sides(
    turns: DataFrame, side_col: str = "side", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """format_preferences() over one table of both sides, where side_col is 'chosen' or 'rejected'; rows of any
    other side are left out."""
    rows = pick(turns, pair_id=conv_col, side=side_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')")
    rows = rows.withColumn("role", F.coalesce("role", F.lit("user"))).withColumn("text", F.coalesce("text", F.lit("")))
    per = W.partitionBy("pair_id")
    own = W.partitionBy("pair_id", "side")
    rows = rows.withColumn("at", (F.row_number().over(own.orderBy("turn", "role", "text")) - 1).cast("long"))
    # a position has at most one turn of each side, so they are neighbours in this order
    beside = per.orderBy("at", "side")
    turn = F.struct("at", "role", "text")
    is_shared = F.coalesce(F.lag(turn).over(beside) == turn, F.lit(False)) | F.coalesce(F.lead(turn).over(beside) == turn, F.lit(False))
    rows = rows.withColumn("differs", F.when(~is_shared, F.col("at")))
    rows = rows.withColumn("n_prompt_turns", F.coalesce(F.min("differs").over(per), F.max("at").over(per) + 1))
    rest = F.col("at") >= F.col("n_prompt_turns")
    rows = rows.withColumn("shown", render(F.col("role"), F.col("text")))
    before = own.orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("begins", F.coalesce(F.sum(F.when(rest, F.length("shown"))).over(before), F.lit(0)))
    head = F.length("role") + 5  # the role line isn't learned; the end mark is
    span = F.concat(F.col("begins") + head, F.lit(":"), F.col("begins") + F.length("shown") - 1)
    is_chosen = F.col("side") == "chosen"

    def joined(value: str, which: Column, by: str = "") -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(which, F.struct("at", F.col(value).alias("v")))))["v"], by)

    return (
        rows.withColumn("span", F.when(rest & (F.col("role") == "assistant"), span))
        .groupBy("pair_id")
        .agg(
            F.first("n_prompt_turns").alias("n_prompt_turns"),
            joined("shown", is_chosen & ~rest).alias("prompt"),
            joined("shown", is_chosen & rest).alias("chosen"),
            joined("span", is_chosen & F.col("span").isNotNull(), ",").alias("chosen_spans"),
            joined("shown", ~is_chosen & rest).alias("rejected"),
            joined("span", ~is_chosen & F.col("span").isNotNull(), ",").alias("rejected_spans"),
        )
    )


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans), a row per pair.

    A spans string lists from:to pairs of character positions in the completion, joined by commas; it is empty
    where the completion has no assistant turn. A pair that only one side has gets an empty prompt and an empty
    completion for the other. Equal conversations are all prompt. Null roles count as user, null texts as
    empty; turns that share a number follow role and text; a null conv_id is left out. Empty tables give no rows.
    """
    columns = {"conv_id": conv_col, "turn": turn_col, "role": role_col, "text": text_col}
    sides = [pick(x, **columns).withColumn("side", F.lit(n)) for x, n in ((chosen, "chosen"), (rejected, "rejected"))]
    return format_sides(sides[0].unionByName(sides[1]))


def repeated_answer(conversations: DataFrame) -> DataFrame:
    """Both sides of conversations that come alone, as (conv_id, turn, role, text, side): the chosen one as it is; in
    the rejected one the last assistant turn repeats the answer before it, or is empty if there was none.
    Conversations without an assistant turn are equal on both sides."""
    rows = pick(conversations, conv_id="conv_id", turn="turn", role="role", text="text")
    per = W.partitionBy("conv_id")
    order = per.orderBy("turn", "role", "text")
    said = F.when(F.col("role") == "assistant", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("n", F.row_number().over(order))
    rows = rows.withColumn("last_n", F.max(F.when(F.col("role") == "assistant", F.col("n"))).over(per))
    rows = rows.withColumn("before", F.last(said, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    worse = F.when(F.col("n") == F.col("last_n"), F.coalesce("before", F.lit(""))).otherwise(F.col("text"))
    side = lambda name, text: F.struct(F.lit(name).alias("side"), text.alias("text"))
    both = F.explode(F.array(side("chosen", F.col("text")), side("rejected", worse))).alias("of")
    return rows.select("conv_id", "turn", "role", both).select("conv_id", "turn", "role", "of.text", "of.side")
