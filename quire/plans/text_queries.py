"""Queries over documents, pages and dialogue as text: segmentation, packing, context, rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import hashing, text
from quire.functions.punctuation import normalized
from quire.functions.structured import difference, parsed_json, translations_of
from quire.model import mock_polish, mock_terms, mock_title, mock_translation
from quire.operators import context, export, logs, packing, progress, segment
from quire.operators.revisions import open_segment, polish_eligible
from quire.plans.registry import query
from quire.sources.adapters import DIALOGUE, dialogue, table

#: Chunk length of queries that have an oracle, whose regular expressions are slow beyond it; batch budget; neighbours.
CHUNK, BUDGET, AROUND = 200, 1800, 1000

LINES = r"""lines as (select * from (select doc_id, lang, source, unnest(string_split(text, chr(10))) as line,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, text from documents where length(text) > 0)
  where not (ends_with(text, chr(10)) and line = '' and pos = len(string_split(text, chr(10))) - 1))"""
STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
HEAD = r"""((starts_with(t, '第') and (contains(t, '章') or contains(t, '节'))) or starts_with(lower(t), 'chapter ')
  or (length(t) <= 80 and regexp_matches(t, '\p{Lu}') and not regexp_matches(t, '[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]') and not regexp_matches(t, '[.,;。，；]')))"""
CHUNKS = rf"""list_filter(list_transform(regexp_extract_all({{0}}, '(?s).{{{{1,{CHUNK}}}}}\z|.{{{{0,{CHUNK - 1}}}}}[.!?。！？\n]|.{{{{1,{CHUNK}}}}}'), lambda x: {STRIP.format("x").replace("{", "{{").replace("}", "}}")}), lambda x: x <> '')"""
CHUNKED = f"""pieces as (select doc_id, source as book, {CHUNKS.format("text")} as own from documents),
chunks as (select doc_id, book, unnest(own) as chunk, generate_subscripts(own, 1) - 1 as k from pieces)"""


def _lines(spark, sf_dir):
    return segment.lines(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))


@query(
    rf"""with {LINES}, stripped as (select *, {STRIP.format("line")} as t from lines),
heads as (select *, t <> '' and {HEAD} as head from stripped),
opened as (select *, sum(head::int) over w as g, last_value(case when head then t end ignore nulls) over w as title from heads window w as (partition by doc_id order by pos)),
body as (select *, dense_rank() over (partition by doc_id order by g) - 1 as chapter from opened where not head),
runs as (select *, sum((t = '')::int) over (partition by doc_id, chapter order by pos) as run from body),
paras as (select doc_id, chapter, run, coalesce(any_value(title), 'Untitled') as chapter_title, string_agg(t, ' ' order by pos) as para from runs where t <> '' group by 1, 2, 3)
select doc_id, chapter::int as chapter, chapter_title, (row_number() over (partition by doc_id, chapter order by run) - 1)::int as paragraph, sha256(para) as source_hash, length(para)::int as n_chars from paras"""
)
def segment_lines(spark, sf_dir):
    rows = segment.chapters(_lines(spark, sf_dir), ["doc_id"], F.lit("Untitled"))
    found = segment.paragraphs(rows, ["doc_id"])
    return found.select("doc_id", "chapter", "chapter_title", "paragraph", F.sha2("source", 256).alias("source_hash"), F.length("source").alias("n_chars"))


@query(f"with {CHUNKED} select doc_id, k::int as chunk_no, chunk from chunks")
def chunk_long_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segment.chunks(docs, "text", CHUNK, "chunk_no").withColumnRenamed("text", "chunk")


@query(
    rf"""with {CHUNKED}, normal as (select *, trim(regexp_replace(chunk, '[\s\p{{Z}}]+', ' ', 'g')) as n, 'chapter-' || (doc_id + 1) || '-' || sha256(book) as chapter_id from chunks),
based as (select *, 'seg-' || sha256(chapter_id || 'Paragraph' || n) as base from normal where n <> ''),
numbered as (select *, row_number() over (partition by doc_id order by k) - 1 as ordinal, row_number() over (partition by doc_id, base order by k) as again from based)
select doc_id, chapter_id, ordinal::int as ordinal, case when again = 1 then base else base || '-' || again end as id, sha256(chunk) as source_hash from numbered"""
)
def segment_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chapter"), F.col("source").alias("chapter_title"), F.lit("paragraph").alias("kind"), F.col("text").alias("source"), F.lit(0).alias("place"))
    return segment.segments(docs, ["doc_id"], ["place"], CHUNK).select("doc_id", "chapter_id", "ordinal", "id", "source_hash")


@query(rf"with {LINES}, stripped as (select *, {STRIP.format('line')} as t from lines) select doc_id, pos::int as pos, t as heading from stripped where t <> '' and {HEAD}")
def chapter_headings(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", text.strip("line").alias("heading")).where(text.is_heading("heading") & (F.col("heading") != ""))


def packing_sql(rows: str, keys: str, order: str, size: str, budget: int, final: str) -> str:
    """Greedy packing as a recursion over places, all chapters at once."""
    joined = " and ".join(f"p.{k} = n.{k}" for k in keys.split(", "))
    return f"""with recursive {rows},
numbered as (select *, {size} as size, row_number() over (partition by {keys} order by {order}) as place from items),
packed as (select *, 0 as batch, size::bigint as chars from numbered where place = 1
  union all select n.*, case when p.chars + n.size > {budget} or p.chars >= {budget} then p.batch + 1 else p.batch end,
    case when p.chars + n.size > {budget} or p.chars >= {budget} then n.size else p.chars + n.size end
  from packed p join numbered n on {joined} and n.place = p.place + 1)
{final}"""


PACKED_LINES = packing_sql(
    f"{LINES}, items as (select doc_id, pos, line from lines)",
    "doc_id",
    "pos",
    "length(line)",
    BUDGET,
    "select doc_id, batch::int as batch, min(pos)::int as first_item, max(pos)::int as last_item, count(*) as n_items, sum(size)::bigint as chars from packed group by doc_id, batch",
)


@query(PACKED_LINES)
def pack_batches(spark, sf_dir):
    items = _lines(spark, sf_dir).select("doc_id", "pos", F.length("line").alias("size"))
    return packing.batches(packing.batch_rows(items, ["doc_id"], "pos", "size", BUDGET), ["doc_id"], "pos", "size")


@query(
    packing_sql(
        f"{DIALOGUE}, items as (select * from dialogue)",
        "chapter",
        "ordinal",
        "length(source)",
        BUDGET,
        "select chapter, batch::int as batch, min(ordinal) as first_item, max(ordinal) as last_item, count(*) as n_items, sum(size)::bigint as chars from packed where target is null and draft is null group by chapter, batch",
    )
)
def plan_untranslated(spark, sf_dir):
    items = dialogue(spark, sf_dir).select("chapter", "ordinal", "target", "draft", F.length("source").alias("size"))
    return packing.plan_open(items, ["chapter"], "ordinal", "size", open_segment(), BUDGET)


@query(
    packing_sql(
        f"{DIALOGUE}, items as (select * from dialogue where not protected and trim(coalesce(draft, '')) <> '')",
        "book, chapter",
        "ordinal",
        "length(source)",
        BUDGET,
        """, grouped as (select book, chapter, batch, min(ordinal) as first_item, max(ordinal) as last_item, count(*) as n_items, sum(size)::bigint as chars from packed group by all)
select book::bigint as book, chapter, batch::int as batch, first_item, last_item, n_items, chars,
  'round-b' || lpad((row_number() over (partition by book order by chapter, batch) - 1)::varchar, 3, '0') as id from grouped""".replace(", grouped", "select * from (with grouped", 1) + ")",
    )
)
def polish_plan(spark, sf_dir):
    items = dialogue(spark, sf_dir).withColumn("size", F.length("source"))
    eligible = polish_eligible(F.col("protected"), F.lit(None).cast("string"), F.col("draft"))
    return packing.plan_eligible(items.select("book", "chapter", "ordinal", "protected", "draft", "size"), ["book"], "chapter", "ordinal", "size", eligible, BUDGET, "round")


PENDING = f"""with recursive {DIALOGUE},
numbered as (select chapter, length(source) as size, target is null as pending, row_number() over (partition by chapter order by ordinal) as place, count(*) over (partition by chapter) as n from dialogue),
steps as (select chapter, place, n, case when size >= {BUDGET} then pending::int else 0 end as closed, case when size >= {BUDGET} then 0 else size end as chars, case when size >= {BUDGET} then false else pending end as open
    from numbered where place = 1
  union all select chapter, place, n, closed + (cut and was_open)::int + (full_now and now_open)::int, case when full_now then 0 else now_chars end, case when full_now then false else now_open end
  from (select s.chapter, m.place, s.n, s.closed, s.chars > 0 and s.chars + m.size > {BUDGET} as cut, s.open as was_open,
      case when s.chars > 0 and s.chars + m.size > {BUDGET} then m.size else s.chars + m.size end as now_chars,
      case when s.chars > 0 and s.chars + m.size > {BUDGET} then m.pending else s.open or m.pending end as now_open,
      case when s.chars > 0 and s.chars + m.size > {BUDGET} then m.size else s.chars + m.size end >= {BUDGET} as full_now
    from steps s join numbered m on m.chapter = s.chapter and m.place = s.place + 1))
select chapter, (closed + open::int)::bigint as requests from steps where place = n"""


@query(PENDING)
def pack_pending_count(spark, sf_dir):
    items = dialogue(spark, sf_dir).select("chapter", "ordinal", "target", F.length("source").alias("size"))
    return packing.request_estimate(items, ["chapter"], "ordinal", "size", F.col("target").isNull(), BUDGET)


TITLES = """titles as (select book, chapter, chapter_id as title, bool_and(status = 'translated' and target is not null) as done, chapter % 3 = 0 as titled from dialogue group by all)"""


@query(
    packing_sql(
        f"{DIALOGUE}, {TITLES.replace('chapter % 3 = 0 as titled from dialogue group by all', 'chapter % 3 = 0 as titled from dialogue group by book, chapter, chapter_id')}, items as (select * from titles)",
        "book",
        "chapter",
        "length(title)",
        60,
        "select book::bigint as book, batch::int as batch, min(chapter) as first_item, max(chapter) as last_item, count(*) as n_items, sum(size)::bigint as chars from packed where not titled and not done group by book, batch",
    )
)
def title_plan(spark, sf_dir):
    """Titles are packed whole, then those that are open are kept; a chapter is taken here while its body is not done, as dialogue never is."""
    done = F.bool_and(F.coalesce((F.col("status") == "translated") & F.col("target").isNotNull(), F.lit(False)))
    titles = dialogue(spark, sf_dir).groupBy("book", "chapter", "chapter_id").agg(done.alias("done")).withColumn("size", F.length("chapter_id"))
    return packing.plan_open(titles, ["book"], "chapter", "size", (F.col("chapter") % 3 != 0) & ~F.col("done"), 60)


@query(f"with {DIALOGUE}, n as (select *, row_number() over (partition by book order by chapter, ordinal) - 1 as p from dialogue) select book::bigint as book, id, (p // 20)::int as batch, first_value(id) over (partition by book, p // 20 order by p) as first_id from n")
def review_batches(spark, sf_dir):
    items = dialogue(spark, sf_dir).withColumn("place", F.struct("chapter", "ordinal"))
    return packing.fixed_batches(items, ["book"], "place", 20).select("book", "id", "batch", "first_id")


@query(
    f"""with {DIALOGUE} select chapter, ordinal, coalesce(right(lag(source) over w, {AROUND}), '') as before, coalesce(left(lead(source) over w, {AROUND}), '') as after
from dialogue window w as (partition by chapter order by ordinal)"""
)
def surrounding_source(spark, sf_dir):
    return context.neighbours(dialogue(spark, sf_dir), ["chapter"], "ordinal", "source", AROUND).select("chapter", "ordinal", "before", "after")


RECENT = """runs as (select *, row_number() over w as p, (v is null)::int as gap, sum((v is null)::int) over w as g, sum(coalesce(length(v), 0)) over w as cs from valued window w as (partition by book order by chapter, ordinal))
select b.book::bigint as book, b.chapter, b.ordinal, b.p::int as p, a.p::int as recent_p, right(a.v, ({0} - (b.cs - coalesce(length(b.v), 0) - a.cs))::bigint) as recent
from runs b join runs a on a.book = b.book and a.gap = 0 and a.g = b.g - b.gap and a.p < b.p and b.cs - coalesce(length(b.v), 0) - a.cs < {0}"""


@query(f"with {DIALOGUE}, valued as (select *, case when status = 'translated' then target end as v from dialogue), {RECENT.format(2000)}")
def recent_targets(spark, sf_dir):
    return context.recent(dialogue(spark, sf_dir), ["book"], ["chapter", "ordinal"], F.col("target"), F.col("status") == "translated", 2000)


@query(f"with {DIALOGUE}, valued as (select *, case when status <> 'failed' then coalesce(draft, target, source) end as v from dialogue), {RECENT.format(500)}")
def recent_drafts(spark, sf_dir):
    value = F.coalesce("draft", "target", "source")
    return context.recent(dialogue(spark, sf_dir), ["book"], ["chapter", "ordinal"], value, F.col("status") != "failed", 500)


@query(
    """with cut as (select doc_id, case when length(text) <= 300 then [text] else [left(text, 300), substr(text, (length(text) - 300) // 2 + 1, 300), right(text, 300)] end as s from documents),
kept as (select doc_id, list_filter(s, lambda x, i: i = 1 or x <> s[i - 1]) as s from cut)
select doc_id, unnest(s) as sample, (generate_subscripts(s, 1) - 1)::int as sample_no from kept"""
)
def sample_positions(spark, sf_dir):
    return context.sampled(table(spark, sf_dir, "documents"), "text", 300, 3).select("doc_id", "sample_no", "sample")


@query(
    """with cut as (select doc_id, text, [left(text, 400), substr(text, (length(text) - 400) // 2 + 1, 400), right(text, 400)] as s from documents),
kept as (select doc_id, text, list_filter(s, lambda x, i: i = 1 or x <> s[i - 1]) as s from cut)
select doc_id, sha256(case when length(text) <= 1200 then text else array_to_string(s, chr(10) || '…' || chr(10)) end) as digest from kept"""
)
def chapter_sample(spark, sf_dir):
    return context.digest_text(table(spark, sf_dir, "documents"), "text", 1200).select("doc_id", F.sha2("sampled", 256).alias("digest"))


VOTE = "case when regexp_matches({0}, '[぀-ヿ]') then 'ja' when regexp_matches({0}, '[一-鿿]') then 'zh' else 'en' end"


@query(
    f"""with cut as (select doc_id, unnest([left(text, 1000), substr(text, greatest((length(text) - 1000) // 2, 0) + 1, 1000), right(text, 1000)]) as s from documents),
votes as (select doc_id, {VOTE.format("s")} as v from cut) select doc_id, case when min(v) = max(v) then min(v) end as choice from votes group by 1"""
)
def language_vote(spark, sf_dir):
    votes = context.sampled(table(spark, sf_dir, "documents"), "text", 1000, 3).select("doc_id", text.guessed_language("sample").alias("vote"))
    return context.unanimous(votes, ["doc_id"], "vote")


@query("select doc_id, '[mock zh-CN] ' || text as translated, '[mock polished zh-CN] ' || text as polished, '[mock title zh-CN] ' || source as title, case when contains(text, 'Alice') then 1 else 0 end::int as n_terms from documents")
def mock_translate(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", mock_translation(F.col("text")).alias("translated"), mock_polish(F.col("text")).alias("polished"), mock_title(F.col("source")).alias("title"), F.size(mock_terms(F.col("text"))).alias("n_terms"))


@query(
    """with marked as (select doc_id, regexp_replace(text, '[\\s]*\\.\\.\\.+', '……', 'g') as t from documents)
select doc_id, sha256(translate(regexp_replace(regexp_replace(t, '[\\s]*--', '——', 'g'), '\\s*([,;:!?])', '\\1', 'g'), ',;:!?', '，；：！？')) as digest from marked""".replace("\\\\", "\\")
)
def punctuation_normalize(spark, sf_dir):
    """The oracle states the rule for texts without code and URLs, which is what these documents are."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalized("text"), 256).alias("digest"))


PAGE_LINES = rf"""texts as (select page_id, replace(regexp_replace(html, '<[^>]*(?:>|\z)', '', 'g'), '>', '') as text from pages),
rows as (select page_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from texts where text <> ''),
stripped as (select *, {STRIP.format("line")} as t from rows),
runs as (select *, sum((t = '')::int) over (partition by page_id order by pos) as run from stripped),
paras as (select page_id, run, string_agg(t, ' ' order by pos) as source from runs where t <> '' group by 1, 2)"""


@query(f"with {PAGE_LINES} select page_id, (row_number() over (partition by page_id order by run) - 1)::int as ordinal, source from paras")
def xhtml_fallback_blocks(spark, sf_dir):
    return segment.fallback_blocks(table(spark, sf_dir, "pages"), ["page_id"])


@query(
    """with docs as (select page_id // 40 as book, page_id as pos, url as path, case when page_id % 7 = 0 then 0 else 1 end as n_blocks from pages),
named as (select *, case when pos % 5 = 2 then path end as title from docs),
opened as (select *, last_value(title ignore nulls) over w as chapter_title, count(title) over w as g from named window w as (partition by book order by pos)),
sized as (select *, sum(n_blocks) over (partition by book, g) as size from opened where g > 0)
select book::bigint as book, pos, path, chapter_title, (dense_rank() over (partition by book order by g) - 1)::int as chapter from sized where size > 0"""
)
def spine_grouping(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    docs = pages.select(F.floor(F.col("page_id") / 40).alias("book"), F.col("page_id").alias("pos"), F.col("url").alias("path"), F.when(F.col("page_id") % 7 == 0, 0).otherwise(1).alias("n_blocks"))
    starts = docs.where("pos % 5 = 2").select("book", "path", F.col("path").alias("title")).dropDuplicates(["book", "path"])
    return segment.grouped_by_start(docs, starts, "book").select("book", "pos", "path", "chapter_title", "chapter")


@query(
    f"""with {CHUNKED}, kept as (select *, row_number() over (partition by doc_id order by k) - 1 as place from chunks),
saved as (select *, row_number() over (partition by doc_id order by k) - 1 as place2 from kept where doc_id % 10 <> 3 or place <> 1)
select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.place, b.place2)::int as place,
  coalesce(trim(regexp_replace(a.chunk, '[\\s\\p{{Z}}]+', ' ', 'g')) = trim(regexp_replace(b.chunk, '[\\s\\p{{Z}}]+', ' ', 'g')), false) as ok
from kept a full join saved b on a.doc_id = b.doc_id and a.place = b.place2""".replace("\\\\", "\\")
)
def align_zip(spark, sf_dir):
    """Saved segments of every tenth document lack their second chunk, so that its tail does not align."""
    docs = table(spark, sf_dir, "documents")
    originals = docs.select("doc_id", F.lit(0).alias("paragraph"), F.col("text").alias("source"))
    saved = segment.chunks(docs.select("doc_id", F.col("text").alias("source")), "source", CHUNK, "ordinal").where("doc_id % 10 <> 3 or ordinal <> 1")
    return export.aligned(originals, saved, ["doc_id"], CHUNK).select("doc_id", "place", "ok")


TITLE = "'[mock title zh-CN] ' || chapter_id"


@query(
    f"""with {DIALOGUE}, done as (select *, coalesce(target, '[mock zh-CN] ' || source) as t from dialogue),
chapters as (select book, chapter, {TITLE} || chr(10) || chr(10) || string_agg(case when source = t then t else t || chr(10) || source end, chr(10) || chr(10) order by ordinal) as one from done group by book, chapter, chapter_id)
select book::bigint as book, sha256(string_agg(one, chr(10) || chr(10) || chr(10) order by chapter) || chr(10)) as digest, sum(length(one))::bigint as n_chars from chapters group by 1"""
)
def export_txt(spark, sf_dir):
    rows = dialogue(spark, sf_dir).select("book", "chapter", mock_title(F.col("chapter_id")).alias("title"), "ordinal", "kind", "source", F.coalesce("target", mock_translation(F.col("source"))).alias("target"))
    whole = export.plain_text(rows, ["book"], bilingual=True)
    one = export.plain_text(rows.withColumn("book", F.struct("book", "chapter")), ["book"], bilingual=True)
    sizes = one.groupBy("book.book").agg(F.sum(F.length("text") - 1).alias("n_chars"))
    return whole.select("book", F.sha2("text", 256).alias("digest")).join(sizes, "book")


@query(f"with {DIALOGUE} select id, case when trim(source) <> '' and source is distinct from target then array_to_string([source, target], chr(10)) else target end as shown from dialogue where target is not null")
def bilingual_pairs(spark, sf_dir):
    rows = dialogue(spark, sf_dir).where("target is not null")
    return rows.select("id", F.array_join(export.paragraph_texts(True, True, F.col("kind"), F.col("source"), F.col("target")), "\n").alias("shown"))


@query(
    f"""with {DIALOGUE}, heads as (select distinct book, chapter, case when chapter % 3 = 0 then chapter_id end as target_title from dialogue),
found as (select book, chapter, -1 as ordinal, 'title is not translated' as reason from heads where target_title is null
  union all select book, chapter, ordinal, case when status <> 'translated' then 'segment is not translated' else 'translation is empty' end from dialogue where status <> 'translated' or trim(coalesce(target, '')) = '')
select book::bigint as book, chapter, ordinal::int as ordinal, reason from (select *, row_number() over (partition by book order by chapter, ordinal) as n from found) where n = 1"""
)
def export_violation(spark, sf_dir):
    rows = dialogue(spark, sf_dir).withColumn("ordinal", F.col("ordinal").cast("int"))
    heads = rows.select("book", "chapter", F.when(F.col("chapter") % 3 == 0, F.col("chapter_id")).alias("target_title")).distinct()
    return export.first_violation(export.violations(heads, rows, ["book"]), ["book"])


@query("select doc_id, text, source from documents where contains(lower(text), 'license') or contains(lower(source), 'license')")
def search_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"), F.col("source").alias("target"))
    return logs.searched(rows, " License ").select("doc_id", F.col("source").alias("text"), F.col("target").alias("source"))


@query(f"with {DIALOGUE} select book::bigint as book, sha256(string_agg((case when protected then chr(1) else chr(0) end) || id || chr(31) || draft || chr(30), '' order by chapter, ordinal)) as digest from dialogue where draft is not null group by 1")
def draft_digest(spark, sf_dir):
    return progress.drafts_digest(dialogue(spark, sf_dir), ["book"], ["chapter", "ordinal"])


@query(f"with {DIALOGUE} select chapter, sha256(string_agg(source, chr(10) order by ordinal)) as digest, length(string_agg(target, chr(10) order by ordinal))::int as n_target from dialogue group by chapter")
def chapter_text(spark, sf_dir):
    rows = dialogue(spark, sf_dir)
    source = progress.joined_text(rows, ["chapter"], ["ordinal"], "source").select("chapter", F.sha2("joined", 256).alias("digest"))
    target = progress.joined_text(rows, ["chapter"], ["ordinal"], "target").select("chapter", F.length("joined").alias("n_target"))
    return source.join(target, "chapter", "left")


RESPONSES = [
    ("strict", '{"translations": ["a", "b"]}', 2),
    ("fenced", 'Here:\n```json\n{"translations": ["a", "b"]}\n```', 2),
    ("prose", 'Sure! {"translations": ["a", "b"]} Done.', 2),
    ("comma", '{"translations": ["a", "b",],}', 2),
    ("single", "{'translations': ['a', 'b']}", 2),
    ("apostrophe", '{"translations": ["it\'s", "b"]}', 2),
    ("blank", '{"translations": ["a", " "]}', 2),
    ("count", '{"translations": ["a"]}', 2),
    ("extra", '{"translations": ["a", "b"], "note": "x"}', 2),
    ("none", "no json at all", 2),
]


@query(
    "select * from (values " + ", ".join(f"('{n}', {v})" for n, v in [("strict", "'a|b', true"), ("fenced", "'a|b', true"), ("prose", "'a|b', true"), ("comma", "'a|b', true"), ("single", "'a|b', true"), ("apostrophe", "'it''s|b', true"), ("blank", "null, false"), ("count", "null, false"), ("extra", "null, false"), ("none", "null, false")]) + ") as t(name, joined, ok)"
)
def json_repair(spark, sf_dir):
    rows = spark.createDataFrame(RESPONSES, "name string, raw string, expected int")
    found = rows.select("name", translations_of(F.col("raw"), F.col("expected")).alias("x"))
    return found.select("name", F.array_join("x.translations", "|").alias("joined"), F.col("x.error").isNull().alias("ok"))


@query()
def version_diff(spark, sf_dir):
    rows = context.neighbours(dialogue(spark, sf_dir), ["chapter"], "ordinal", "source", 1_000_000)
    return rows.where("before <> ''").select("chapter", "ordinal", difference("source", "before").alias("d")).select("chapter", "ordinal", "d.*")


@query(
    f"""with {DIALOGUE}, cut as (select id, list_filter(string_split(source, chr(10)), lambda x: trim(x) <> '') as a, list_filter(string_split(target, chr(10)), lambda x: trim(x) <> '') as b, source, target from dialogue where target is not null)
select id, len(a)::int as n_source, case when len(a) = len(b) and len(a) > 1 then len(a) else 1 end::int as n_pairs, case when len(a) = len(b) and len(a) > 1 then a[1] || '|' || b[1] else source || '|' || target end as first_pair from cut"""
)
def paragraph_pairs(spark, sf_dir):
    rows = dialogue(spark, sf_dir).where("target is not null").withColumn("pairs", export.zipped_lines(F.col("source"), F.col("target")))
    n = F.size(F.filter(F.split("source", "\n"), lambda x: ~text.is_blank(x)))
    return rows.select("id", n.alias("n_source"), F.size("pairs").alias("n_pairs"), F.concat_ws("|", F.col("pairs")[0]["source"], F.col("pairs")[0]["target"]).alias("first_pair"))


@query(
    """select event_id, event_type, case when event_type = 'error' then 'ignored' when event_type = 'view' then 'non_fixed' when event_type = 'click' then 'conflict' when event_type = 'signup' then 'resolved' else 'normal' end as term_state,
  lower('C' || user_id || ':S' || event_id || ':' || event_type) as issue_id, (1 << least(event_id % 10, 6)::int)::int as backoff,
  case when s < 60 then s || ' 秒' when s % 60 = 0 then (s // 60) || ' 分钟' else (s // 60) || ' 分 ' || (s % 60) || ' 秒' end as duration,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad((extract(microsecond from ts)::int % 1000000 // 1000)::varchar, 3, '0') || 'Z' as stamp, strftime(ts, '%m-%d %H:%M:%S') as shown,
  case when length(props) > 8 then left(props, 8) || '…' else props end as short
from (select *, floor(value + 0.5)::bigint as s from events)"""
)
def scalar_labels(spark, sf_dir):
    kind = F.col("event_type")
    policy = F.when(kind == "error", "ignored").when(kind == "view", "non_fixed").otherwise("automatic")
    status = F.when(kind == "click", "conflict").when(kind == "signup", "resolved").otherwise("ok")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        text.term_state(policy, status).alias("term_state"),
        text.issue_id(F.concat(F.lit("C"), "user_id"), F.concat(F.lit("S"), "event_id"), kind).alias("issue_id"),
        hashing.backoff_seconds(F.col("event_id") % 10).alias("backoff"),
        hashing.duration_label(F.col("value") * 1000).alias("duration"),
        hashing.rfc3339(F.col("ts")).alias("stamp"),
        hashing.short_date(F.col("ts")).alias("shown"),
        text.truncated("props", 8).alias("short"),
    )


@query(
    r"""select page_id, regexp_extract(url, '[^/\\]*$') as file_name, lower(string_split(url, ':')[-1]) as local_name, 'data:text/html;base64,' || to_base64(encode(left(html, 60))) as data_url,
  sha256(html) as digest, len(list_filter(regexp_split_to_array(html, '[\s\p{Z}]+'), lambda x: x <> ''))::int as n_words from pages"""
)
def page_labels(spark, sf_dir):
    data = F.encode(F.left("html", F.lit(60)), "UTF-8")
    url = F.regexp_replace(hashing.data_url(F.lit("text/html"), data), r"\s", "")
    return table(spark, sf_dir, "pages").select("page_id", text.file_name("url").alias("file_name"), text.local_name("url").alias("local_name"), url.alias("data_url"), hashing.content_hash(F.col("html")).alias("digest"), text.words("html").alias("n_words"))


PLAN = f"""with recursive {CHUNKED}, normal as (select *, trim(regexp_replace(chunk, '[\\s\\p{{Z}}]+', ' ', 'g')) as n, 'chapter-' || (doc_id + 1) || '-' || sha256(book) as chapter_id from chunks),
numbered as (select *, length(chunk) as size, row_number() over (partition by doc_id order by k) as place from normal where n <> ''),
packed as (select *, 0 as batch, size::bigint as chars from numbered where place = 1
  union all select n.*, case when p.chars + n.size > {BUDGET} or p.chars >= {BUDGET} then p.batch + 1 else p.batch end,
    case when p.chars + n.size > {BUDGET} or p.chars >= {BUDGET} then n.size else p.chars + n.size end
  from packed p join numbered n on p.doc_id = n.doc_id and n.place = p.place + 1),
batched as (select doc_id, chapter_id, batch, min(place) as first_item, max(place) as last_item, count(*) as n_items, sum(size)::bigint as chars,
  sha256(string_agg('[mock zh-CN] ' || chunk, chr(10) order by place)) as translated from packed group by all)
select b.doc_id, b.chapter_id, b.batch::int as batch, (first_item - 1)::int as first_item, (last_item - 1)::int as last_item, n_items, b.chars, translated,
  coalesce(right(x.chunk, {AROUND}), '') as before, coalesce(left(y.chunk, {AROUND}), '') as after
from batched b left join numbered x on x.doc_id = b.doc_id and x.place = b.first_item - 1 left join numbered y on y.doc_id = b.doc_id and y.place = b.last_item + 1"""


@query(PLAN)
def translation_plan(spark, sf_dir):
    """The whole plan: chunks with ids, batches within the budget, what stands around each batch, and its mock translation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("chapter"), F.col("source").alias("chapter_title"), F.lit("paragraph").alias("kind"), F.col("text").alias("source"), F.lit(0).alias("place"))
    # One exchange of whole documents serves every window and group below, which are all within a document.
    segments = segment.segments(docs.repartition("doc_id"), ["doc_id"], ["place"], CHUNK)
    rows = context.neighbours(segments, ["doc_id"], "ordinal", "source", AROUND)
    items = rows.select("doc_id", "ordinal", "chapter_id", "source", F.length("source").alias("size"), "before", "after")
    rows = packing.batch_rows(items, ["doc_id"], "ordinal", "size", BUDGET)
    own = F.col("items")
    lines = F.transform(own, lambda x: mock_translation(x["source"]))
    return packing.batches(rows.withColumn("__lines", lines), ["doc_id", "items", "__lines"], "ordinal", "size").select(
        "doc_id",
        own[0]["chapter_id"].alias("chapter_id"),
        "batch",
        "first_item",
        "last_item",
        "n_items",
        "chars",
        F.sha2(F.array_join("__lines", "\n"), 256).alias("translated"),
        own[0]["before"].alias("before"),
        F.element_at(own, -1)["after"].alias("after"),
    )


@query()
def tolerant_parse(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", parsed_json("props").alias("parsed"))
