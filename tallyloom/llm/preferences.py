"""Preference formatting: a shared prompt and two masked completions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a turn is rendered.
BEFORE, BETWEEN, AFTER = "<|", "|>\n", "<|end|>\n"


def _render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(BEFORE), F.coalesce(t["role"], F.lit("")), F.lit(BETWEEN), F.coalesce(t["text"], F.lit("")), F.lit(AFTER))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column, trained: str) -> Column:
    """Spans [start, end) of the rendered turns that are learned: texts and end marks of the trained role."""
    role = lambda t: F.coalesce(t["role"], F.lit(""))
    head = lambda t: F.length(role(t)) + (len(BEFORE) + len(BETWEEN))
    body = lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + len(AFTER)
    kind = "struct<at:int,spans:array<struct<start:int,end:int>>>"

    def step(acc: Column, t: Column) -> Column:
        a = acc["at"] + head(t)
        b = a + body(t)
        span = F.array(F.struct(a.alias("start"), b.alias("end")))
        return F.struct(b.alias("at"), F.when(role(t) == trained, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans")).cast(kind)

    start = F.struct(F.lit(0).alias("at"), F.array().alias("spans")).cast(kind)
    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def _ordered(turn: Column, role: Column, text: Column) -> Column:
    """What turns are sorted by: turn, role and text, nulls last."""
    last = lambda c, name: (c.isNull().alias(f"no_{name}"), c.alias(name))
    return F.struct(*last(turn.cast("long"), "turn"), *last(role.cast("string"), "role"), *last(text.cast("string"), "text"))


def preference_pairs(chosen: DataFrame, rejected: DataFrame, trained: str = "assistant") -> DataFrame:
    """pair_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask for each pair_id of either input.

    Both inputs have rows (pair_id, turn, role, text). The turns of a side are taken by turn, then role and text, nulls last. The
    longest common prefix of turns, equal in role and text, is rendered once as prompt; the remaining
    turns of each side are its completion. The masks list the character spans [start, end) of a completion that are learned, those
    of the trained role's texts with their end mark; the prompt is not learned.

    Edge cases: a null role or text is rendered as empty, but is equal only to another null; a pair that one side lacks has that side
    empty; equal sides have two empty completions; repeated rows are repeated turns; rows without pair_id are left out;
    a null turn comes last; other columns are ignored; empty inputs give an empty result.
    """
    part = lambda df, k: df.filter("pair_id is not null").select("pair_id", F.lit(k).alias("k"), _ordered(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    rows = part(chosen, 0).unionByName(part(rejected, 1))
    side = lambda k: F.transform(F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("t")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    both = rows.groupBy("pair_id").agg(side(0).alias("c"), side(1).alias("r"))
    least = F.least(F.size("c"), F.size("r"))
    places = F.when(least > 0, F.sequence(F.lit(1), least)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(places, lambda i: ~F.element_at("c", i).eqNullSafe(F.element_at("r", i)))
    both = both.withColumn("n_prefix", F.coalesce(F.get(differ, F.lit(0)) - 1, least))
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.size(c))
    return both.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        _render(F.slice("c", F.lit(1), F.col("n_prefix"))).alias("prompt"),
        _render(rest("c")).alias("chosen"),
        _render(rest("r")).alias("rejected"),
        _mask(rest("c"), trained).alias("chosen_mask"),
        _mask(rest("r"), trained).alias("rejected_mask"),
    )


def stale_answers(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """Conversations with the last turn of the trained role answered by that role's turn before (or by nothing), as rejected sides."""
    turn = _ordered(F.col("turn"), F.col("role"), F.col("text"))
    own = F.when(F.col("role") == trained, turn)
    last = conversations.groupBy("conv_id").agg(F.max(own).alias("last"), F.slice(F.reverse(F.array_sort(F.collect_list(own))), 2, 1).alias("two"))
    both = conversations.join(last, "conv_id", "left")
    stale = F.coalesce(F.get("two", F.lit(0))["text"], F.lit(""))
    return both.select("conv_id", "turn", "role", F.when(turn.eqNullSafe(F.col("last")), stale).otherwise(F.col("text")).alias("text"))
