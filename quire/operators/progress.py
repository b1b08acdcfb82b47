"""Roll-ups: progress of chapters and projects, polish jobs, token usage, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.revisions import complete

USAGE = ["input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "cache_creation_input_tokens", "reasoning_tokens", "tool_use_prompt_tokens"]


def by_chapter(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, translated, total) of each chapter."""
    return segments.groupBy(*keys).agg(F.count_if(complete()).alias("translated"), F.count("*").alias("total"))


def chapter_status(chapters: DataFrame, segments: DataFrame, keys: list[str], by_status_only: bool = False) -> DataFrame:
    """Chapters with is_complete: all segments are translated, and have a text unless only the status counts; a chapter without segments is complete."""
    done = F.coalesce(F.col("status") == "translated", F.lit(False)) if by_status_only else complete()
    found = segments.groupBy(*keys).agg(F.bool_and(done).alias("__done"))
    return chapters.join(found, keys, "left").withColumn("is_complete", F.coalesce("__done", F.lit(True))).drop("__done")


def project_progress(statuses: DataFrame, book: list[str], need_titles: bool = True) -> DataFrame:
    """(book, chapters_completed, chapters_total, status) from chapters with is_complete and target_title."""
    titled = F.bool_and(F.col("target_title").isNotNull()) if need_titles else F.lit(True)
    found = statuses.groupBy(*book).agg(F.count_if("is_complete").alias("chapters_completed"), F.count("*").alias("chapters_total"), titled.alias("__titled"))
    whole = (F.col("chapters_completed") == F.col("chapters_total")) & F.col("__titled")
    return found.withColumn("status", F.when(whole, "translated").otherwise("translating")).drop("__titled")


def polish_summary(batches: DataFrame, book: list[str]) -> DataFrame:
    """Batches by status; running ones count as pending."""
    status = F.col("status")
    return batches.groupBy(*book).agg(F.count_if(status.isin("pending", "running")).alias("pending"), F.count_if(status == "succeeded").alias("succeeded"), F.count_if(status == "failed").alias("failed"), F.count("*").alias("total"))


def usage_totals(usage: DataFrame, keys: list[str], measures: list[str] = USAGE) -> DataFrame:
    """Sums of the measures, nulls as zero."""
    return usage.groupBy(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in measures])


def usage_rollup(usage: DataFrame, keys: list[str], measures: list[str] = USAGE) -> DataFrame:
    """Sums at every level of ``keys``, null standing for all."""
    return usage.rollup(*keys).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in measures])


def running_counts(items: DataFrame, keys: list[str], order: str, ok: Column) -> DataFrame:
    """Items with done and failed so far."""
    own = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("done", F.sum(ok.cast("int")).over(own)).withColumn("failed", F.sum((~ok).cast("int")).over(own))


def joined_text(rows: DataFrame, keys: list[str], order: list[str], value: str, separator: str = "\n") -> DataFrame:
    """(keys, joined): values in order; nulls are left out."""
    own = F.sort_array(F.collect_list(F.struct(*order, value)))
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(own, lambda x: x[value]), separator).alias("joined"))


def drafts_digest(segments: DataFrame, book: list[str], order: list[str]) -> DataFrame:
    """(book, digest): SHA-256 over the drafts in order, each with its protection byte, id and separators."""
    protection = F.when(F.coalesce("protected", F.lit(False)), F.char(F.lit(1))).otherwise(F.decode(F.unhex(F.lit("00")), "UTF-8"))
    one = F.concat(protection, "id", F.char(F.lit(0x1F)), "draft", F.char(F.lit(0x1E)))
    rows = segments.where("draft is not null").select(*book, *order, one.alias("one"))
    return joined_text(rows, book, order, "one", "").select(*book, F.sha2("joined", 256).alias("digest"))


def terms_digest(terms: DataFrame, book: list[str]) -> DataFrame:
    """(book, digest): SHA-256 over the terms as JSON, by source."""
    rows = terms.select(*book, "source", F.to_json(F.struct(*[c for c in sorted(terms.columns) if c not in book])).alias("one"))
    return joined_text(rows, book, ["source"], "one", ",").select(*book, F.sha2("joined", 256).alias("digest"))


def failure_streak(calls: DataFrame, keys: list[str], order: str, failed: Column, most: int = 5) -> DataFrame:
    """(keys, first_break): the place at which ``most`` calls in a row have failed for the first time; null if they never do."""
    sofar = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = calls.withColumn("__failed", F.coalesce(failed, F.lit(False)))
    df = df.withColumn("__run", F.sum((~F.col("__failed")).cast("int")).over(sofar))
    df = df.withColumn("__streak", F.when(F.col("__failed"), F.sum(F.col("__failed").cast("int")).over(Window.partitionBy(*keys, "__run").orderBy(order))).otherwise(0))
    return df.groupBy(*keys).agg(F.min(F.when(F.col("__streak") == most, F.col(order))).alias("first_break"))
