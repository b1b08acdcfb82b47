"""Queries over requests to the model: what each batch carries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import packing, prompts
from quire.operators.revisions import open_segment
from quire.plans.registry import query
from quire.plans.text_queries import AROUND, BUDGET, packing_sql
from quire.sources.adapters import DIALOGUE, GLOSSARY, dialogue, glossary

RECENT_CHARS = 2000

PROMPTS = packing_sql(
    f"{DIALOGUE}, {GLOSSARY}, items as (select * from dialogue)",
    "book, chapter",
    "ordinal",
    "length(source)",
    BUDGET,
    rf""", own as (select source, arg_min(target, lang) as target, arg_min(aliases, lang) as aliases, arg_min(policy, lang) as policy from glossary group by 1),
needles as (select source, lower(source) as needle, false as is_alias from own union all select source, lower(unnest(aliases)), true from own),
near as (select *, coalesce(right(lag(source) over w, {AROUND}), '') as before, coalesce(left(lead(source) over w, {AROUND}), '') as after,
  row_number() over b as p, sum((v is null)::int) over b as g, sum(coalesce(length(v), 0)) over b as cs
  from (select *, case when status = 'translated' then target end as v from packed) window w as (partition by book, chapter order by ordinal), b as (partition by book order by chapter, ordinal)),
batches as (select book, chapter, batch, arg_min(before, ordinal) as before, arg_max(after, ordinal) as after, min(ordinal) as head, string_agg(source, chr(10) order by ordinal) as body
  from near where target is null and draft is null group by all),
tokens as (select distinct book, chapter, batch, unnest(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}]+')) as needle from batches),
found as (select t.*, n.source, count(*) over (partition by book, chapter, batch, needle, is_alias) as hits, is_alias from tokens t join needles n using (needle)),
known as (select f.book, f.chapter, f.batch, list({{'source': o.source, 'target': o.target}} order by o.source) as terms
  from (select distinct book, chapter, batch, source from found where not is_alias or hits = 1) f join own o on o.source = f.source and o.policy in ('automatic', 'fixed') group by all),
back as (select b.book, b.chapter, b.ordinal, list({{'segment_id': a.id, 'target': right(a.v, ({RECENT_CHARS} - (b.cs - coalesce(length(b.v), 0) - a.cs))::bigint)}} order by a.p) as told
  from near b join near a on a.book = b.book and a.v is not null and a.g = b.g - (b.v is null)::int and a.p < b.p and b.cs - coalesce(length(b.v), 0) - a.cs < {RECENT_CHARS} group by all)
select x.book::bigint as book, x.chapter, x.batch::int as batch, '{{"style":["plain"],"terms":' || coalesce(to_json(terms)::varchar, '[]') || ',"recent_targets":' || coalesce(to_json(told)::varchar, '[]')
  || case when before <> '' or after <> '' then ',"surrounding_source":' || to_json({{'before': before, 'after': after}})::varchar else '' end || '}}' as context
from batches x left join known k on k.book = x.book and k.chapter = x.chapter and k.batch = x.batch left join back r on r.book = x.book and r.chapter = x.chapter and r.ordinal = x.head""",
)


@query(PROMPTS)
def prompt_plan(spark, sf_dir):
    """The context of every batch of dialogue that is open, with one glossary of all languages; of terms that two languages share, the first language's counts."""
    rows = dialogue(spark, sf_dir)
    items = rows.withColumn("size", F.length("source")).withColumn("open", open_segment())
    packed = packing.pack(items, ["book", "chapter"], "ordinal", "size", BUDGET)
    segments = packed.withColumn("batch", F.when(F.col("open"), F.col("batch")))
    own = glossary(spark, sf_dir).groupBy("source").agg(F.min_by(F.struct("target", "aliases", "policy"), "lang").alias("x")).select("source", "x.*")
    return prompts.contexts(segments, ["book"], ["chapter"], "ordinal", own, around=AROUND, budget=RECENT_CHARS, stable=True, style=F.array(F.lit("plain")))
