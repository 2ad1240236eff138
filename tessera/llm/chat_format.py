"""Preference formatting, in DataFrame operations only.

Chosen and rejected conversations of a pair share their first turns; the longest
common prefix of equal (role, text) turns is rendered once as the prompt, the
rest of each becomes its completion.  Masks are the spans of a completion that
carry loss: the texts of the trained role and their end marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def header(role: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(header(t["role"]), t["text"], F.lit(END))), "")


def spans(turns: Column, role: str) -> Column:
    """[start, end) character spans of the trained role's texts in render(turns)."""
    kind = "struct<at:bigint,spans:array<struct<start:bigint,end:bigint>>>"

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(header(t["role"]))
        end = start + F.length(t["text"]) + len(END)
        mine = F.array(F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == role, F.concat(state["spans"], mine)).otherwise(state["spans"]).alias("spans")).cast(kind)

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")).cast(kind)
    return F.aggregate(turns, first, step, lambda s: s["spans"])


def collect_turns(turns: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name): a conversation's turns in order of turn number, then role and
    text; null numbers come first, null roles and texts count as empty."""
    cells = F.struct(turns["turn"].cast("long").alias("turn"), F.coalesce(turns["role"], F.lit("")).alias("role"), F.coalesce(turns["text"], F.lit("")).alias("text"))
    return turns.groupBy(turns[key].alias(key)).agg(F.array_sort(F.collect_list(cells)).alias(name))


def common_turns(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by role and text."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    return F.when(differs > 0, differs.cast("int") - 1).otherwise(n)


def format_pairs(pairs: DataFrame, key: str, trained_role: str = "assistant") -> DataFrame:
    """pairs: (key, chosen, rejected) with arrays of turns, null meaning none."""
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    sides = pairs.select(key, F.coalesce("chosen", none).alias("c"), F.coalesce("rejected", none).alias("r"))
    sides = sides.withColumn("n", common_turns(F.col("c"), F.col("r")))
    rest = lambda side: F.slice(F.col(side), F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    cut = sides.select(key, "n", F.slice("c", F.lit(1), F.col("n")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return cut.select(
        key,
        F.col("n").alias("prompt_turns"),
        render(F.col("p")).alias("prompt"),
        render(F.col("c")).alias("chosen"),
        render(F.col("r")).alias("rejected"),
        spans(F.col("c"), trained_role).alias("chosen_mask"),
        spans(F.col("r"), trained_role).alias("rejected_mask"),
    )


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", trained_role: str = "assistant") -> DataFrame:
    """One row per pair that occurs on either side: key, prompt_turns, prompt,
    chosen, rejected, chosen_mask, rejected_mask.

    Both inputs hold turns (key, turn, role, text).  A side without turns has an
    empty completion; equal sides have the whole conversation as prompt and two
    empty completions.  Null roles and texts count as empty; turns that tie are
    ordered by role and text, repeated rows are repeated turns.  Rows with a null
    key form one pair a side and don't meet the other side's.  A conversation is
    one array, so it has to fit a row (2 GB).  Empty tables give
    an empty result; other columns are ignored.
    """
    sides = collect_turns(chosen, key, "chosen").join(collect_turns(rejected, key, "rejected"), key, "full")
    return format_pairs(sides, key, trained_role)


def parroted(turns: Column, role: str = "assistant") -> Column:
    """The turns with the role's last text replaced by the text before it (empty
    if it is the first): a rejected answer that only repeats what was said."""
    places = F.transform(turns, lambda t, i: F.when(t["role"] == role, i + 1).otherwise(0))
    last = F.coalesce(F.array_max(places), F.lit(0))
    before = F.coalesce(F.get(turns, last - 2)["text"], F.lit(""))
    return F.transform(turns, lambda t, i: F.when(i + 1 == last, F.struct(t["turn"].alias("turn"), t["role"].alias("role"), before.alias("text"))).otherwise(t))
