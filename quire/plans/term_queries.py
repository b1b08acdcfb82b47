"""Queries over the glossary and the term base: matching, impact, conflicts, decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.matching import borders_match, matches_folded, signed
from quire.operators import conflicts, context, terms
from quire.plans.registry import query
from quire.sources.adapters import EVIDENCE, GLOSSARY, evidence, glossary, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "doc_id", "text")


NEEDLES = """needles as (select lang, source, lower(source) as needle, false as is_alias from glossary
  union all select lang, source, lower(unnest(aliases)), true from glossary)"""
# Glossary words are letters only, so a needle matches where it is a whole run of letters and numbers.
MATCHES = rf"""{GLOSSARY}, {NEEDLES},
tokens as (select distinct lang, doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as needle from documents),
matches as (select t.lang, t.doc_id, n.source, n.needle, n.is_alias from tokens t join needles n using (lang, needle))"""


@query(f"with {MATCHES} select lang, doc_id, source, needle, is_alias from matches")
def term_match(spark, sf_dir):
    return terms.matches(_docs(spark, sf_dir), ["lang"], "doc_id", "text", glossary(spark, sf_dir), stable=True)


RELEVANT = """relevant as (select distinct m.lang, doc_id, m.source from (select *, count(*) over (partition by lang, doc_id, needle, is_alias) as hits from matches) m
  join glossary g on g.lang = m.lang and g.source = m.source and g.policy in ('automatic', 'fixed') where not is_alias or hits = 1)"""


@query(f"with {MATCHES}, {RELEVANT} select * from relevant")
def relevant_terms(spark, sf_dir):
    return terms.relevant(_docs(spark, sf_dir), ["lang"], "doc_id", "text", glossary(spark, sf_dir), stable=True)


@query(
    f"""with {GLOSSARY}, {NEEDLES}, own as (select distinct lang, needle as alias_key, source from needles where is_alias)
select a.lang, a.alias_key, a.source as first_source, b.source as second_source from own a join own b on a.lang = b.lang and a.alias_key = b.alias_key and a.source < b.source"""
)
def alias_conflicts(spark, sf_dir):
    return terms.alias_conflicts(glossary(spark, sf_dir), ["lang"])


IMPACT = rf"""{GLOSSARY}, heads as (select lang, 'title:' || doc_id as id, doc_id::varchar as chapter_id, 'title' as kind, trim(string_split(text, chr(10))[1]) as text, case when doc_id % 4 <> 0 then 'T ' || doc_id end as target from documents),
body as (select lang, doc_id || '-' || pos as id, doc_id::varchar as chapter_id, case when pos = 0 then 'heading' else 'paragraph' end as kind, line as text, case when (doc_id + pos) % 3 <> 0 then 'S' || pos end as target
  from (select lang, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, text from documents where text <> '')
  where not (ends_with(text, chr(10)) and line = '' and pos = len(string_split(text, chr(10))) - 1)),
contents as (select * from heads union all select * from body),
tokens as (select distinct lang, id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) as source from contents),
hits as (select t.lang, t.id, g.source from tokens t join glossary g using (lang, source)),
title_hits as (select h.lang, h.source, c.chapter_id, c.text from hits h join heads c using (lang, id)),
impact as (select h.lang, h.source, c.id, c.chapter_id, c.kind, c.text, c.target from hits h join contents c using (lang, id)
  where c.target is not null and not (c.kind = 'heading' and exists (select 1 from title_hits t where t.lang = h.lang and t.source = h.source and t.chapter_id = c.chapter_id and t.text = trim(c.text))))"""


def _impact(spark, sf_dir):
    from quire.operators import segment

    docs = _docs(spark, sf_dir)
    first = F.trim(F.split("text", "\n")[0])
    key = F.col("doc_id").cast("string")
    heads = docs.select("lang", key.alias("chapter_id"), first.alias("title"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("T "), "doc_id")).alias("target_title"))
    rows = segment.lines(docs)
    target = F.when((F.col("doc_id") + F.col("pos")) % 3 != 0, F.concat(F.lit("S"), "pos"))
    body = rows.select("lang", F.concat_ws("-", key, F.col("pos").cast("string")).alias("id"), key.alias("chapter_id"), F.when(F.col("pos") == 0, "heading").otherwise("paragraph").alias("kind"), F.col("line").alias("source"), target.alias("target"))
    own = glossary(spark, sf_dir)
    return terms.impact(heads, body, ["lang"], own, stable=True), own


@query(f"with {IMPACT} select lang, source, id, chapter_id, kind, target, sha256(text) as digest from impact")
def term_impact(spark, sf_dir):
    found, _ = _impact(spark, sf_dir)
    return found.select("lang", "source", "id", "chapter_id", "kind", "target", F.sha2("text", 256).alias("digest"))


@query(f"with {IMPACT} select distinct i.lang, i.id, i.kind, i.target from impact i join glossary g using (lang, source) where g.policy = 'fixed'")
def fixed_impact(spark, sf_dir):
    found, own = _impact(spark, sf_dir)
    return terms.impact_of_fixed(found, own, ["lang"]).select("lang", "id", "kind", "target")


@query(
    rf"""with {MATCHES}, hits as (select distinct lang, doc_id, source from matches where not is_alias),
rows as (select h.*, string_split(d.text, chr(10)) as own from hits h join documents d using (lang, doc_id))
select lang, doc_id, source, left(coalesce(list_filter(own, lambda x: list_contains(regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+'), source))[1], own[1]), 240) as excerpt from rows"""
)
def evidence_excerpt(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    found = terms.matches(docs, ["lang"], "doc_id", "text", glossary(spark, sf_dir), stable=True).where("not is_alias").select("lang", "doc_id", "source").distinct()
    rows = found.join(docs, ["lang", "doc_id"])
    own = context.excerpt(F.col("text"), lambda line: borders_match(F.lower(line), F.col("source")))
    return rows.select("lang", "doc_id", "source", own.alias("excerpt"))


# Terms of the evidence base: the target is the first wording seen, conflicts are the other wordings, every third of them resolved.
BASE = f"""{EVIDENCE}, terms as (select source, arg_min(target, id) as target, min_by(chapter, id) as first_chapter from evidence group by 1),
conflicts as (select distinct e.source, e.target, e.target = 't2' as resolved from evidence e join terms t using (source) where e.target <> t.target)"""


def _base(spark, sf_dir):
    shown = evidence(spark, sf_dir)
    own = shown.groupBy("source").agg(F.min_by("target", "id").alias("target"), F.min_by("chapter", "id").alias("first_chapter"))
    events = conflicts.evidence_against(own, shown).select("source", "target", (F.col("target") == "t2").alias("resolved")).distinct()
    return own, events, shown


@query(
    f"""with {EVIDENCE}, chapters as (select source, target, chapter, count(*) as n, min(id) as first from evidence group by all),
found as (select source, target, sum(n)::bigint as occurrences, min(first) as first, string_agg(chapter::varchar, ',' order by first) as chapters from chapters group by 1, 2)
select source, target, occurrences, (row_number() over (partition by source order by first) - 1)::int as candidate, chapters from found"""
)
def conflict_candidates(spark, sf_dir):
    return conflicts.conflict_candidates(evidence(spark, sf_dir)).withColumn("chapters", F.array_join(F.col("chapters").cast("array<string>"), ","))


@query(
    f"""with {BASE}, counts as (select source, count(*) filter (not resolved) as unresolved, count(*) filter (resolved) as resolved from conflicts group by 1),
seen as (select source, count(distinct target) as n_candidates from evidence group by 1)
select t.source, t.target, c.unresolved, c.resolved, n_candidates::int as n_candidates from terms t join counts c using (source) join seen using (source)"""
)
def conflict_details(spark, sf_dir):
    found = conflicts.conflict_details(*_base(spark, sf_dir), include_resolved=True)
    return found.select("source", "target", "unresolved", "resolved", F.size("candidates").alias("n_candidates"))


@query(f"with {BASE} select count(*) filter (not resolved) as unresolved from conflicts")
def pending_conflicts(spark, sf_dir):
    _, events, _ = _base(spark, sf_dir)
    return conflicts.conflict_counts(events).agg(F.sum("unresolved").alias("unresolved"))


@query(f"with {BASE} select e.id, e.source, e.target, e.chapter from evidence e join terms t using (source) where e.target <> t.target")
def evidence_against(spark, sf_dir):
    own, _, shown = _base(spark, sf_dir)
    return conflicts.evidence_against(own, shown).select("id", "source", "target", "chapter")


@query(f"with {EVIDENCE} select source, target, id, (row_number() over (partition by source, target order by id))::int as place, source_excerpt from evidence qualify place <= 3")
def top_evidence(spark, sf_dir):
    return conflicts.top_evidence(evidence(spark, sf_dir)).select("source", "target", "id", "place", "source_excerpt")


@query(f"with {BASE}, open as (select source from conflicts where not resolved) select distinct e.source, e.target, e.chapter from evidence e where e.source in (select source from open)")
def open_candidates(spark, sf_dir):
    own, events, shown = _base(spark, sf_dir)
    status = own.join(events.where("not resolved").select("source").distinct().withColumn("o", F.lit(True)), "source", "left").withColumn("status", F.when(F.col("o"), "conflict").otherwise("ok"))
    return conflicts.open_candidates(status, shown.select("source", "target", "chapter").distinct())


@query(
    f"""with {EVIDENCE}, entries as (select source, id, target, chapter as first_chapter, case when id % 4 = 0 then 'r' || (id % 11) end as reading, case when id % 6 = 5 then ['a' || (id % 3), 'b'] else ['c' || (id % 2)] end as aliases from evidence),
spread as (select source, id, unnest(aliases) as a, generate_subscripts(aliases, 1) as k from entries),
firsts as (select source, a, min((id, k)) as place from spread group by 1, 2),
joined as (select source, string_agg(a, ',' order by place) as aliases from firsts group by 1)
select e.source, arg_min(target, id) as target, arg_min(reading, id) filter (reading is not null) as reading, min(first_chapter) as first_chapter, any_value(j.aliases) as aliases from entries e join joined j using (source) group by e.source"""
)
def merge_term_metadata(spark, sf_dir):
    n = F.col("id")
    aliases = F.when(n % 6 == 5, F.array(F.concat(F.lit("a"), n % 3), F.lit("b"))).otherwise(F.array(F.concat(F.lit("c"), n % 2)))
    none = F.lit(None).cast("string")
    rows = evidence(spark, sf_dir).select("source", "id", "target", F.col("chapter").alias("first_chapter"), F.when(n % 4 == 0, F.concat(F.lit("r"), n % 11)).alias("reading"), none.alias("gender"), none.alias("note"), aliases.alias("aliases"))
    return terms.merged_metadata(rows, [], "id").select("source", "target", "reading", "first_chapter", F.array_join("aliases", ",").alias("aliases"))


@query(
    r"""with words as (select lang, unnest(list_filter(regexp_split_to_array(text, '[ \n]+'), lambda x: x <> '')) as w from documents)
select lang, signature, count(*) as n, count(distinct w) as n_forms from (select lang, w, lower(regexp_replace(w, '[!-/:-@\[-`{-~…—–“”‘’·]', '', 'g')) as signature from words) group by 1, 2"""
)
def signature_groups(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_remove(F.split("text", "[ \n]+"), "")).alias("w"))
    forms = words.groupBy("lang", "w").agg(F.count("*").alias("n"))  # fold each distinct form once
    return forms.withColumn("signature", signed("w")).groupBy("lang", "signature").agg(F.sum("n").alias("n"), F.count("*").alias("n_forms"))


@query()
def term_upsert_fold(spark, sf_dir):
    """The evidence as inserts, with a decision now and then, folded per term."""
    rows = evidence(spark, sf_dir)
    n = F.col("id") % 23
    action = F.when(n == 7, "resolve").when(n == 11, "undo").when(n == 13, "set_policy").when((n == 17) & (F.col("id") % 5 == 0), "delete").otherwise("insert")
    events = rows.select("source", F.col("id").alias("seq"), action.alias("action"), "target", "chapter", F.when(n == 13, "non_fixed").alias("policy"))
    state = conflicts.fold_terms(events)
    return state.select("source", "target", "status", "policy", "manual_target", "first_chapter", "deleted", F.size("evidence").alias("n_evidence"), F.size("candidates").alias("n_candidates"), F.size("conflicts").alias("n_conflicts"), F.size("audit").alias("n_audit"), F.size("errors").alias("n_errors"))


MIGRATE = f"""{BASE}, old as (select t.source, t.target, t.first_chapter, case when c.n is null then 'ok' when t.first_chapter % 2 = 0 then 'resolved' else 'conflict' end as status
  from terms t left join (select source, count(*) as n from conflicts group by 1) c using (source)),
cands as (select distinct source, target, chapter from evidence where id % 3 = 0), shown as (select source, target, chapter from evidence where id % 9 = 1),
rules2 as (select source, 'fixed' as policy, target as manual_target from old where status = 'resolved'),
shown2 as (select * from shown union all select source, target, first_chapter from old o where not exists (select 1 from shown s where s.source = o.source)),
shown3 as (select * from shown2 union all select * from cands c where not exists (select 1 from shown2 s where s.source = c.source and s.target = c.target and s.chapter = c.chapter)),
events2 as (select distinct c.source, c.target, o.status = 'resolved' as resolved from cands c join old o using (source) where c.target <> o.target and o.status <> 'ok'),
settled as (select source, case when status = 'conflict' and not exists (select 1 from events2 e where e.source = o.source and not resolved) then 'ok' else status end as status from old o)"""


@query(
    f"""with {MIGRATE} select 'terms' as part, status as label, count(*) as n from settled group by all union all select 'rules', policy, count(*) from rules2 group by all
  union all select 'evidence', target, count(*) from shown3 group by all union all select 'conflicts', resolved::varchar, count(*) from events2 group by all"""
)
def migrate_terms(spark, sf_dir):
    own, events, shown = _base(spark, sf_dir)
    hit = events.select("source").distinct().withColumn("o", F.lit(True))
    old = own.join(hit, "source", "left").withColumn("status", F.when(F.col("o").isNull(), "ok").when(F.col("first_chapter") % 2 == 0, "resolved").otherwise("conflict")).drop("o")
    cands = shown.where("id % 3 = 0").select("source", "target", "chapter").distinct()
    held = shown.where("id % 9 = 1")
    rules = spark.createDataFrame([], "source string, policy string, manual_target string")
    none = spark.createDataFrame([], "source string, target string, resolved boolean")
    out = conflicts.migrated(old, cands, held, rules, none)
    labels = {"terms": "status", "rules": "policy", "evidence": "target", "conflicts": "resolved"}
    parts = [out[p].groupBy(F.col(c).cast("string").alias("label")).agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "label", "n") for p, c in labels.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(
    f"""with {BASE}, gone as (select source from terms where first_chapter % 4 = 0)
select 'conflicts' as part, count(*) as n from conflicts where source not in (select source from gone) union all select 'evidence', count(*) from evidence where source not in (select source from gone)
union all select 'audit', count(*) from evidence"""
)
def delete_cascade(spark, sf_dir):
    own, events, shown = _base(spark, sf_dir)
    left = conflicts.without_terms({"conflicts": events, "evidence": shown, "audit": shown}, own.where("first_chapter % 4 = 0"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(p).alias("part"), "n") for p, df in left.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    """with e as (select *, json_extract_string(props, '$.k')::int as k from events), last as (select *, row_number() over (partition by user_id, k order by event_id desc) as n from e)
select user_id, k, event_id from last where n = 1 and event_type <> 'purchase'"""
)
def extraction_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id", F.when(F.col("event_type") == "purchase", "done").otherwise("put").alias("action"))
    return conflicts.queue(rows, ["user_id", "k"], "event_id").select("user_id", "k", "event_id")


@query(
    rf"""with {GLOSSARY}, entries as (select d.doc_id, d.lang, g.source, g.target, d.text, g.rank from documents d join glossary g using (lang) where g.rank < 4)
select doc_id, source from entries where list_contains(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), source)"""
)
def usable_extractions(spark, sf_dir):
    """Each language's first four terms as if they were extracted from every document with a translation that repeats them; only those that occur are usable."""
    docs = _docs(spark, sf_dir)
    own = glossary(spark, sf_dir).where("rank < 4").select("lang", "source", F.col("source").alias("target"))
    rows = docs.join(own, "lang").withColumn("translation", F.concat(F.lit("x "), "source", F.lit(" y")))
    return terms.usable_extractions(rows, "text", "translation").select("doc_id", "source")


@query("select * from (values ('今日は安達さんに会った', false), ('『今日の 安 あ 達 だち さん』', true), ('Alice met Bob', false)) as t(text, hit)")
def reading_match(spark, sf_dir):
    rows = spark.createDataFrame([("『今日の 安 あ 達 だち さん』",), ("今日は安達さんに会った",), ("Alice met Bob",)], "text string")
    return rows.select("text", matches_folded("text", F.lit("今日の安達さん")).alias("hit"))
