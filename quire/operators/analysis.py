"""Book analysis and term extraction around the model: samples, reuse of what is done, prompts, and evidence of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.hashing import content_hash
from quire.functions.structured import parsed_json
from quire.functions.text import is_blank, language_code, sampled_text, samples
from quire.model import Client, call_model
from quire.operators import context, progress
from quire.operators.terms import term_error, usable_extractions

BOOK_SAMPLES, BOOK_SAMPLE_CHARS, CHAPTER_SAMPLE_CHARS, LANGUAGE_SAMPLE_CHARS = 3, 4000, 12_000, 1000
TERM = "struct<source: string, target: string, reading: string, type: string, gender: string, aliases: array<string>, note: string>"


def book_text(segments: DataFrame, book: list[str], order: list[str]) -> DataFrame:
    """(book, joined): all sources of a book, line by line."""
    return progress.joined_text(segments, book, order, "source")


def book_samples(segments: DataFrame, book: list[str], order: list[str]) -> DataFrame:
    """(book, samples): three long windows of each book."""
    return book_text(segments, book, order).select(*book, samples("joined", BOOK_SAMPLE_CHARS, BOOK_SAMPLES).alias("samples"))


def chapter_samples(segments: DataFrame, chapter: list[str], order: list[str]) -> DataFrame:
    return book_text(segments, chapter, order).select(*chapter, sampled_text("joined", CHAPTER_SAMPLE_CHARS).alias("sample"))


def language_text(segments: DataFrame, book: list[str], order: list[str]) -> DataFrame:
    """(book, joined): paragraphs and quotes; all kinds where a book has neither."""
    rows = segments.where(~is_blank("source"))
    prose = F.max(F.col("kind").isin("paragraph", "quote"))
    has = rows.groupBy(*book).agg(prose.alias("__prose"))
    kept = rows.join(has, book).where(~F.col("__prose") | F.col("kind").isin("paragraph", "quote"))
    return progress.joined_text(kept, book, order, "source")


def detected_languages(segments: DataFrame, book: list[str], order: list[str], client: Client, seed: int = 0, retries: int = 3) -> DataFrame:
    """(book, choice): the language that the model names for three random windows of a book, if all agree."""
    texts = language_text(segments, book, order).select(*book, F.explode(context.random_windows(F.col("joined"), LANGUAGE_SAMPLE_CHARS, 3, seed)).alias("sample"))
    asked = call_model(texts.select(*book, F.array("sample").alias("texts")), client, "language", "texts", retries)
    votes = asked.select(*book, language_code(F.col("answers")[0]).alias("vote"))
    return context.unanimous(votes.withColumn("vote", F.coalesce("vote", F.lit("?"))), book, "vote").withColumn("choice", F.when(F.col("choice") != "?", F.col("choice")))


def to_do(rows: DataFrame, done: DataFrame, keys: list[str], text: str, force: bool = False) -> DataFrame:
    """Rows whose text has no result yet: results are kept by key and hash of the text; all rows if ``force``."""
    marked = rows.withColumn("digest_of", content_hash(F.col(text)))
    return marked if force else marked.join(done.select(*keys, "digest_of"), [*keys, "digest_of"], "left_anti")


def digests(chapters: DataFrame, done: DataFrame, keys: list[str], client: Client, force: bool = False, retries: int = 3) -> DataFrame:
    """(keys, digest_of, digest) for chapter samples that have none; blank answers fall back to the sample's beginning."""
    open_ = to_do(chapters, done, keys, "sample", force)
    asked = call_model(open_.select(*keys, "digest_of", "sample", F.array("sample").alias("texts")), client, "digest", "texts", retries)
    return asked.select(*keys, "digest_of", F.coalesce(F.col("answers")[0], F.left("sample", F.lit(200))).alias("digest"))


def extracted_terms(raw: Column) -> Column:
    """array of TERM of an extraction response; empty for anything else."""
    found = F.from_json(parsed_json(raw), f"terms array<{TERM}>")["terms"]
    return F.coalesce(found, F.array().cast(f"array<{TERM}>"))


def extractions(pairs: DataFrame, client: Client, keys: list[str], retries: int = 3) -> DataFrame:
    """(keys, source, target, ...): valid terms that the model finds in pairs (source_text, target_text), that occur in both."""
    prompt = F.to_json(F.struct("source_text", "target_text"))
    asked = call_model(pairs.withColumn("texts", F.array(prompt)), client, "extract", "texts", retries)
    rows = asked.select(*keys, "source_text", "target_text", F.explode(extracted_terms(F.col("answers")[0])).alias("t")).select(*keys, "source_text", "target_text", "t.*")
    valid = rows.where(term_error(F.col("source"), F.col("target"), F.col("type")).isNull())
    return usable_extractions(valid, "source_text", "target_text")


def as_events(entries: DataFrame, seq: Column, chapter: Column) -> DataFrame:
    """Extracted terms as insert events of the term base."""
    return entries.select("source", seq.alias("seq"), F.lit("insert").alias("action"), "target", chapter.cast("int").alias("chapter"), F.lit(None).cast("string").alias("policy"))


def pending_places(queue: DataFrame, segments: DataFrame) -> DataFrame:
    """(chapter_id, batch_key, before): where a queued extraction stands in its chapter: behind the last of its segments (ids joined by bars), or behind all for the whole chapter. Queue rows of missing chapters have null."""
    known = segments.groupBy("chapter_id").agg(F.count("*").alias("__n"))
    ids = queue.where("batch_key <> '__chapter__'").select("chapter_id", "batch_key", F.explode(F.split("batch_key", r"\|")).alias("id"))
    last = ids.join(segments.select("chapter_id", "id", "ordinal"), ["chapter_id", "id"]).groupBy("chapter_id", "batch_key").agg((F.max("ordinal") + 1).alias("__last"))
    rows = queue.select("chapter_id", "batch_key").join(known, "chapter_id", "left").join(last, ["chapter_id", "batch_key"], "left")
    place = F.when(F.col("batch_key") == "__chapter__", F.col("__n")).when(F.col("__n").isNotNull(), F.coalesce("__last", F.lit(0)))
    return rows.select("chapter_id", "batch_key", place.cast("long").alias("before"))


def failed_first(segments: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """Ids of the first segments that failed, for the log."""
    return segments.where("status = 'failed'").orderBy(*order).select("id").limit(most)


def overlapping(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (first, last) that reach into the next one of their document."""
    from pyspark.sql import Window

    after = F.lead("first").over(Window.partitionBy(*keys).orderBy("first", "last"))
    return blocks.withColumn("__after", after).where(F.col("__after") < F.col("last")).drop("__after")


def saved_context(recent: DataFrame, path: str) -> None:
    """The recent translations before a position, as one JSON document that replaces the last."""
    recent.coalesce(1).write.mode("overwrite").json(path)
