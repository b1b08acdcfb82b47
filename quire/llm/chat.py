"""Preference formatting: the turns that a chosen and a rejected conversation share are rendered once, the rest twice.

Turns are compared by role and text from the first on; the longest common prefix becomes the prompt. It never takes the
last turn of both sides unless the conversations are the same. Each completion is rendered with character spans of the
turns that count for the loss (those of ``learn_role``); everything else is masked.

Defined cases: a null conversation is an empty one; null roles and texts count as empty strings and equal each other;
turns are ordered by number, null ones first, those with equal numbers by role and text; turns without conversation id
are one conversation; equal conversations have empty completions; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import table

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "\n"
TURNS = "array<struct<turn: int, role: string, text: string>>"


def conversations(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, turns): one row per conversation; turns in order."""
    one = F.struct(F.col("turn").cast("int").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).cast(TURNS).alias("turns"))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column, learn_role: str) -> Column:
    """(start, length) of the learned texts, with their close mark, in the rendering of ``turns``."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("spans"))

    def step(state, turn):
        start = state["at"] + F.length(turn["role"]) + len(OPEN) + len(MIDDLE)
        size = F.length(turn["text"]) + len(CLOSE)
        own = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size).alias("at"), F.when(turn["role"] == learn_role, F.concat(state["spans"], own)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, zero, step)["spans"]


def format_pairs(pairs: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """pairs (pair_id, chosen, rejected: arrays of turns) to prompt, completions and their learned spans, and the number of shared turns."""
    empty = F.expr(f"cast(array() as {TURNS})")
    df = pairs.select("pair_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    same = F.expr("transform(slice(chosen, 1, least(size(chosen), size(rejected))), (x, i) -> x.role = rejected[i].role and x.text = rejected[i].text)")
    first_other = F.array_position(same, F.lit(False))
    df = df.withColumn("n_prompt", F.when(first_other > 0, first_other - 1).otherwise(shorter).cast("int"))
    rest = "slice({0}, n_prompt + 1, size({0}))"
    df = df.select("pair_id", "n_prompt", F.expr("slice(chosen, 1, n_prompt)").alias("shared"), F.expr(rest.format("chosen")).alias("good"), F.expr(rest.format("rejected")).alias("bad"))
    return df.select(
        "pair_id",
        "n_prompt",
        _render(F.col("shared")).alias("prompt"),
        _render(F.col("good")).alias("chosen"),
        _render(F.col("bad")).alias("rejected"),
        _spans(F.col("good"), learn_role).alias("chosen_spans"),
        _spans(F.col("bad"), learn_role).alias("rejected_spans"),
    )


def crossed(convs: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): each conversation, and one that takes the first half of its turns (rounded down) and then the turns at the later places of the conversation with the next id, if there is one."""
    other = convs.where("conv_id is not null").select((F.col("conv_id") - 1).alias("conv_id"), F.col("turns").alias("next"))
    joined = convs.join(other, "conv_id", "left")
    half = "cast(size(turns) div 2 as int)"
    rejected = F.expr(f"concat(slice(turns, 1, {half}), coalesce(slice(next, {half} + 1, greatest(size(next) - {half}, 0)), cast(array() as {TURNS})))")
    return joined.select(F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.cast(TURNS).alias("rejected"))


def op8_preferences(spark, sf_dir: str) -> DataFrame:
    """One pair per conversation of the table (``crossed``), those without id as one; the prefix that the sides share is found by comparing turns."""
    found = format_pairs(crossed(conversations(table(spark, sf_dir, "conversations"))))

    def spans(c: str) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat(s["start"], F.lit("+"), s["length"])), ",")

    return found.select("pair_id", F.col("n_prompt").cast("long").alias("n_prompt"), "prompt", "chosen", "rejected", spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


OP8_SQL = r"""
with turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as k, count(*) over (partition by conv_id) as n
  from conversations),
sizes as (select conv_id, any_value(n) // 2 as half from turns group by 1),
rejected as (select s.conv_id, t.k, t.role, t.text from sizes s join turns t on t.conv_id is not distinct from s.conv_id and t.k <= s.half
  union all select s.conv_id, t.k, t.role, t.text from sizes s join turns t on t.conv_id = s.conv_id + 1 and t.k > s.half),
places as (select conv_id, k, t.role as role, t.text as text, r.role as other_role, r.text as other,
    t.k is not null as here, r.k is not null as there, t.k is not null and r.k is not null and t.role = r.role and t.text = r.text as same
  from (select coalesce(t.conv_id, r.conv_id) as conv_id, coalesce(t.k, r.k) as k, t, r
    from turns t full join rejected r on t.conv_id is not distinct from r.conv_id and t.k = r.k)),
shared as (select conv_id, coalesce(min(k) filter (not same) - 1, max(k)) as n_prompt from places group by 1),
pieces as (select p.conv_id, p.k, p.k <= h.n_prompt as is_prompt, h.n_prompt, here, there, role = 'assistant' as learned, other_role = 'assistant' as other_learned,
    '<|' || role || '|>' || chr(10) || text || chr(10) as good, '<|' || other_role || '|>' || chr(10) || other || chr(10) as bad,
    length(role) + 5 as head, length(other_role) + 5 as other_head, length(text) + 1 as good_size, length(other) + 1 as bad_size
  from places p join shared h on h.conv_id is not distinct from p.conv_id),
placed as (select *, coalesce(sum(head + good_size) over w, 0) as good_at, coalesce(sum(other_head + bad_size) over w, 0) as bad_at from pieces
  window w as (partition by conv_id, is_prompt order by k rows between unbounded preceding and 1 preceding))
select conv_id as pair_id, any_value(n_prompt)::bigint as n_prompt,
  coalesce(string_agg(good, '' order by k) filter (is_prompt), '') as prompt,
  coalesce(string_agg(good, '' order by k) filter (not is_prompt and here), '') as chosen,
  coalesce(string_agg(bad, '' order by k) filter (not is_prompt and there), '') as rejected,
  coalesce(string_agg((good_at + head)::bigint || '+' || good_size, ',' order by k) filter (not is_prompt and learned), '') as chosen_spans,
  coalesce(string_agg((bad_at + other_head)::bigint || '+' || bad_size, ',' order by k) filter (not is_prompt and other_learned), '') as rejected_spans
from placed group by conv_id
"""
