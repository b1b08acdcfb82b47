"""Queries over progress, usage, logs, revisions and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.hashing import percent
from quire.operators import conflicts, logs, progress, review, revisions
from quire.plans.registry import query
from quire.plans.term_queries import GLOSSARY
from quire.sources.adapters import DIALOGUE, USAGE, dialogue, glossary, table, usage

DONE = "coalesce(status = 'translated' and target is not null, false)"


@query(f"with {DIALOGUE} select chapter, count(*) filter ({DONE}) as translated, count(*) as total, floor(count(*) filter ({DONE}) * 100.0 / greatest(count(*), 1) + 0.5)::bigint as percent from dialogue group by 1")
def progress_by_chapter(spark, sf_dir):
    found = progress.by_chapter(dialogue(spark, sf_dir), ["chapter"])
    return found.withColumn("percent", percent(F.col("translated"), F.col("total")))


@query(
    f"""with {DIALOGUE}, heads as (select distinct book, chapter, chapter % 2 = 0 as titled from dialogue union all select distinct book, -1 - book, true from dialogue),
done as (select chapter, bool_and({DONE} or chapter % 3 = 0 or book % 2 = 0) as d from dialogue group by 1),
joined as (select h.book, coalesce(d.d, true) as is_complete, titled from heads h left join done d using (chapter))
select book::bigint as book, count(*) filter (is_complete) as chapters_completed, count(*) as chapters_total, case when count(*) = count(*) filter (is_complete) and bool_and(titled) then 'translated' else 'translating' end as status from joined group by 1"""
)
def project_progress(spark, sf_dir):
    """Every third chapter and every second book counts as translated; each book has one more chapter without segments, which is complete."""
    rows = dialogue(spark, sf_dir)
    whole = (F.col("chapter") % 3 == 0) | (F.col("book") % 2 == 0)
    rows = rows.withColumns({"target": F.when(whole, F.col("source")).otherwise(F.col("target")), "status": F.when(whole, "translated").otherwise(F.col("status"))})
    heads = rows.select("book", "chapter", F.when(F.col("chapter") % 2 == 0, "t").alias("target_title")).distinct()
    heads = heads.unionByName(rows.select("book").distinct().select("book", (-1 - F.col("book")).alias("chapter"), F.lit("t").alias("target_title")))
    return progress.project_progress(progress.chapter_status(heads, rows, ["book", "chapter"]), ["book"])


@query("select user_id, count(*) filter (event_type in ('view', 'click')) as pending, count(*) filter (event_type = 'purchase') as succeeded, count(*) filter (event_type = 'error') as failed, count(*) as total from events group by 1")
def polish_summary(spark, sf_dir):
    status = F.create_map(*[F.lit(x) for p in (("view", "pending"), ("click", "running"), ("purchase", "succeeded"), ("error", "failed")) for x in p])
    return progress.polish_summary(table(spark, sf_dir, "events").select("user_id", F.try_element_at(status, "event_type").alias("status")), ["user_id"])


SUMS = ", ".join(f"coalesce(sum({m}), 0)::bigint as {m}" for m in progress.USAGE)


@query(f"with {USAGE} select stage, model, {SUMS} from usage group by 1, 2")
def usage_by_stage(spark, sf_dir):
    return progress.usage_totals(usage(spark, sf_dir), ["stage", "model"])


@query(f"with {USAGE} select stage, model, {SUMS} from usage group by rollup (stage, model)")
def usage_totals(spark, sf_dir):
    return progress.usage_rollup(usage(spark, sf_dir), ["stage", "model"])


@query(
    """select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as timestamp, event_type as event, case when event_id % 7 = 0 then null else props end as details
from events where event_id % 11 <> 0 order by event_id desc limit 100"""
)
def log_tail(spark, sf_dir):
    """Events written as log lines, some without details and some with details that are no JSON."""
    details = F.when(F.col("event_id") % 7 == 0, F.lit("{broken")).otherwise(F.col("props"))
    line = F.when(F.col("event_id") % 11 == 0, F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type")).otherwise(F.concat_ws("\t", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", details))
    rows = logs.parsed(table(spark, sf_dir, "events").select("event_id", line.alias("value")))
    return logs.newest(rows, ["event_id"]).select("event_id", "timestamp", "event", "details")


@query(
    """with f as (select user_id, event_id, event_type in ('error', 'view', 'click') as bad from events),
runs as (select *, sum((not bad)::int) over (partition by user_id order by event_id) as run from f),
streaks as (select *, case when bad then count(*) filter (bad) over (partition by user_id, run order by event_id) else 0 end as streak from runs)
select user_id, min(event_id) filter (streak = 5) as first_break from streaks group by 1"""
)
def failure_breaker(spark, sf_dir):
    return progress.failure_streak(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type").isin("error", "view", "click"))


@query("select user_id, event_id, (count(*) filter (event_type <> 'error') over w)::bigint as done, (count(*) filter (event_type = 'error') over w)::bigint as failed from events window w as (partition by user_id order by event_id)")
def retranslation_progress(spark, sf_dir):
    return progress.running_counts(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") != "error").select("user_id", "event_id", "done", "failed")


@query("select user_id, event_id, event_type, value from (select *, row_number() over (partition by user_id order by ts desc) as n from events) where n = 1")
def latest_by_key(spark, sf_dir):
    return conflicts.latest(table(spark, sf_dir, "events"), ["user_id"], "ts").select("user_id", "event_id", "event_type", "value")


@query("select distinct e.user_id from events e where exists (select 1 from events x where x.user_id = e.user_id and x.event_type = 'signup' and x.value > 60)")
def initialized_projects(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    rows = events.where("value > 60").select("user_id", F.col("event_type").alias("event"))
    return logs.projects_with_event(events.select("user_id").distinct(), rows, "user_id", "signup")


OLD = """old as (select event_id, case when event_id % 3 = 0 then event_type end as previous, case when event_id % 4 <> 1 then lag_type else ' ' end as draft, event_type as current
  from (select *, coalesce(lag(event_type) over (partition by user_id order by event_id), event_type) as lag_type from events))"""


def _old(spark, sf_dir):
    from pyspark.sql import Window

    before = F.coalesce(F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")), F.col("event_type"))
    n = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", F.when(n % 3 == 0, F.col("event_type")).alias("previous"), F.when(n % 4 != 1, before).otherwise(" ").alias("draft"), F.col("event_type").alias("current"))


@query(
    f"""with {OLD}, kept as (select event_id, list_filter([case when previous <> current then previous end, case when draft <> current and trim(draft) <> '' and draft is distinct from case when previous <> current then previous end then draft end, current], lambda x: x is not null) as h from old)
select event_id, array_to_string(h, '|') as history, len(h)::int as current_id from kept"""
)
def revision_history(spark, sf_dir):
    rows = _old(spark, sf_dir).withColumn("h", revisions.legacy_history(F.col("previous"), F.col("draft"), F.col("current")))
    return rows.select("event_id", F.array_join(F.transform("h", lambda x: x["target"]), "|").alias("history"), revisions.current_id(F.col("h")).alias("current_id"))


@query("select user_id, max(event_id) as id, arg_max(event_type, event_id) as target from events group by 1")
def current_revision(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("target"))
    return revisions.current_revisions(rows, ["user_id"])


@query("with last as (select user_id, max(event_id) as id, arg_max(event_type, event_id) as target from events group by 1) select e.event_id, e.user_id from events e join last l on l.user_id = e.user_id and l.id = e.event_id and l.target = 'view'")
def accepted_edits(spark, sf_dir):
    """Every event is an edit that expects itself to be the current revision and its text to be "view"."""
    rows = table(spark, sf_dir, "events")
    now = revisions.current_revisions(rows.select("user_id", F.col("event_id").alias("id"), F.col("event_type").alias("target")), ["user_id"])
    edits = rows.select("user_id", "event_id", F.col("event_id").alias("expected_revision"), F.lit("view").alias("expected_target"))
    return revisions.accepted_edits(edits, now, ["user_id"]).select("event_id", "user_id")


@query()
def revision_fold(spark, sf_dir):
    kinds = F.create_map(*[F.lit(x) for p in (("view", "translation"), ("click", "polish"), ("purchase", "manual"), ("error", "restore_previous"), ("signup", "retranslation")) for x in p])
    rows = table(spark, sf_dir, "events")
    writes = rows.select(F.concat(F.lit("s"), "user_id").alias("segment_id"), F.col("event_id").alias("seq"), F.concat(F.lit("t"), F.col("event_id") % 5).alias("target"), F.try_element_at(kinds, "event_type").alias("kind"), F.lit(None).cast("string").alias("model"))
    state = revisions.fold_writes(writes)
    return state.select("segment_id", "target", "previous_target", "protected", F.size("revisions").alias("n_revisions"), F.size("errors").alias("n_errors"))


@query(
    f"""with {DIALOGUE}, n as (select id, case when not protected and trim(coalesce(draft, '')) <> '' and chapter % 2 = 0 then null else target end as target, protected, draft, status, case when ordinal % 4 = 2 then 'failed' end as polish_status from dialogue)
select id, case when not protected and trim(coalesce(draft, '')) <> '' and target is null then draft else target end as target, case when not protected and trim(coalesce(draft, '')) <> '' and target is null then 'translated' else status end as status,
  case when not protected and trim(coalesce(draft, '')) <> '' and polish_status is null then case when target is null then 'pending' else 'succeeded' end else polish_status end as polish_status from n"""
)
def polish_normalize(spark, sf_dir):
    rows = dialogue(spark, sf_dir)
    touched = ~F.col("protected") & F.col("draft").isNotNull() & (F.col("chapter") % 2 == 0)
    rows = rows.withColumn("target", F.when(~F.coalesce(touched, F.lit(False)), F.col("target"))).withColumn("polish_status", F.when(F.col("ordinal") % 4 == 2, "failed"))
    state = revisions.normalized_polish(F.col("protected"), F.col("target"), F.col("draft"), F.col("status"), F.col("polish_status"))
    return rows.select("id", state.alias("s")).select("id", "s.*")


@query(
    f"""with {DIALOGUE}, r as (select *, case when ordinal % 2 = 0 then true else false end as ok from dialogue where ordinal > 0)
select d.id, case when not d.protected and r.ok then 'new' else d.target end as target, case when not d.protected and r.ok then 'succeeded' when not d.protected and not r.ok then 'failed' end as polish_status from dialogue d left join r using (id)"""
)
def polish_apply(spark, sf_dir):
    rows = dialogue(spark, sf_dir).select(F.col("id").alias("segment_id"), "target", "protected", "ordinal", F.lit(None).cast("string").alias("polish_status"))
    results = rows.where("ordinal > 0").select("segment_id", (F.col("ordinal") % 2 == 0).alias("ok"), F.lit("new").alias("text"))
    return revisions.applied_batches(rows, results).select(F.col("segment_id").alias("id"), "target", "polish_status")


@query(f"with {DIALOGUE} select id, 'T ' || chapter as target from dialogue where ordinal = 0 and status = 'pending'")
def heading_sync(spark, sf_dir):
    rows = dialogue(spark, sf_dir)
    titles = rows.where("ordinal = 0 and status = 'pending'").select("chapter", F.concat(F.lit(" "), "source").alias("title"), F.concat(F.lit("T "), "chapter").alias("target_title"))
    heads = rows.where("ordinal = 0").withColumn("kind", F.lit("heading")).select("chapter", "id", "kind", "source")
    return revisions.synced_headings(heads, titles, ["chapter"]).select("id", "target")


@query(
    f"""with {DIALOGUE}, t as (select *, case when ordinal % 5 = 3 then source else coalesce(target, '') end as t from dialogue)
select chapter, id as segment_id, severity, lower(chapter_id || ':' || id || ':untranslated') as issue from (select *, 'critical' as severity from t where trim(t) = '' union all select *, 'major' from t where t = source and source <> '')"""
)
def review_untranslated(spark, sf_dir):
    from quire.functions.text import issue_id

    rows = dialogue(spark, sf_dir).withColumn("target", F.when(F.col("ordinal") % 5 == 3, F.col("source")).otherwise(F.col("target")))
    found = review.untranslated(rows, ["chapter"])
    return found.select("chapter", "segment_id", "severity", issue_id(F.col("chapter_id"), F.col("segment_id"), F.col("issue_type")).alias("issue"))


WANTED = "wanted as (select distinct source, target from glossary)"


@query(f"with {DIALOGUE}, {GLOSSARY}, {WANTED} select d.id as segment_id, w.target as wanted from dialogue d join wanted w on contains(d.source, w.source) and not contains(coalesce(d.target, ''), w.target)")
def review_terminology(spark, sf_dir):
    """All terms of all languages against all dialogue."""
    own = glossary(spark, sf_dir).select("source", "target").distinct()
    found = review.terminology(dialogue(spark, sf_dir).drop("book"), own, [])
    return found.select("segment_id", F.substring("summary", 7, 1000).alias("wanted"))


@query(
    f"""with {DIALOGUE}, {GLOSSARY}, {WANTED},
issues as (select book, lower(chapter_id || ':' || id || ':untranslated') as id from dialogue where trim(coalesce(target, '')) = ''
  union all select d.book, lower(d.chapter_id || ':' || d.id || ':terminology') from dialogue d join wanted w on contains(d.source, w.source) and not contains(coalesce(d.target, ''), w.target)),
found as (select book, count(distinct id) as issues from issues group by 1),
chapters as (select book, chapter, count(*) as n, count(*) filter (trim(coalesce(target, '')) = '') as blank from dialogue group by 1, 2),
totals as (select book, count(*) as chapters, sum(n)::bigint as segments, count(*) filter (blank > 0) as incomplete_chapters from chapters group by 1)
select book::bigint as book, chapters, segments, incomplete_chapters, coalesce(issues, 0) as issues, greatest(segments - incomplete_chapters, 0)::bigint as reviewed from totals left join found using (book)"""
)
def review_summary(spark, sf_dir):
    rows = dialogue(spark, sf_dir)
    own = glossary(spark, sf_dir).select("source", "target").distinct()
    by_book = rows.select("chapter_id", "id", "book").withColumnRenamed("id", "segment_id")
    unused = review.terminology(rows.drop("book"), own, []).join(by_book, ["chapter_id", "segment_id"])
    found = review.untranslated(rows, ["book"]).unionByName(unused)
    return review.summary(rows, review.report(found, ["book"]), ["book"])
