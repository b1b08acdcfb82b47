"""Aligned, bilingual export: checks, alignment of originals with segments, and plain text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.punctuation import normalized
from quire.functions.text import collapse_space, is_blank, split_long


def violations(chapters: DataFrame, segments: DataFrame, book: list[str]) -> DataFrame:
    """(book, chapter, ordinal, reason): titles and segments that cannot be exported; ordinal -1 is the title."""
    heads = chapters.where(is_blank("target_title")).select(*book, "chapter", F.lit(-1).alias("ordinal"), F.lit("title is not translated").alias("reason"))
    reason = F.when(F.coalesce("status", F.lit("")) != "translated", "segment is not translated").when(is_blank("target"), "translation is empty")
    body = segments.select(*book, "chapter", "ordinal", reason.alias("reason")).where("reason is not null")
    return heads.unionByName(body)


def first_violation(found: DataFrame, book: list[str]) -> DataFrame:
    own = Window.partitionBy(*book).orderBy("chapter", "ordinal")
    return found.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def show_source(bilingual: bool, kind: Column, source: Column, target: Column) -> Column:
    return F.lit(bilingual) & (kind != "heading") & ~is_blank(source) & ~source.eqNullSafe(target)


def paragraph_texts(bilingual: bool, source_first: bool, kind: Column, source: Column, target: Column) -> Column:
    """The one or two texts of a paragraph, in the order asked for."""
    both = F.array(source, target) if source_first else F.array(target, source)
    return F.when(show_source(bilingual, kind, source, target), both).otherwise(F.array(target))


def merged_targets(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, target): segment translations run together, then with full-width punctuation."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "target"))), lambda x: x["target"]), "")
    return rows.groupBy(*keys).agg(joined.alias("target")).withColumn("target", normalized("target"))


def without_title(paragraphs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Paragraphs (kind, target, target_title) without each chapter's first heading whose text is the title."""
    is_title = (F.col("kind") == "heading") & (F.col("target") == F.col("target_title"))
    own = Window.partitionBy(*keys, is_title).orderBy(order)
    return paragraphs.withColumn("__n", F.row_number().over(own)).where(~(is_title & (F.col("__n") == 1))).drop("__n")


def plain_text(paragraphs: DataFrame, book: list[str], bilingual: bool = False, source_first: bool = False) -> DataFrame:
    """(book, text): titles and paragraphs (chapter, title, ordinal, kind, source, target) with blank lines between, two between chapters, and a last line end."""
    texts = F.array_join(paragraph_texts(bilingual, source_first, F.col("kind"), F.col("source"), F.col("target")), "\n")
    rows = paragraphs.select(*book, "chapter", "title", "ordinal", F.when(F.col("ordinal").isNotNull(), texts).alias("one"))
    body = F.transform(F.sort_array(F.collect_list(F.when(F.col("one").isNotNull(), F.struct("ordinal", "one")))), lambda x: x["one"])
    chapter = rows.groupBy(*book, "chapter").agg(F.first("title").alias("title"), body.alias("body"))
    chapter = chapter.select(*book, "chapter", F.array_join(F.concat(F.array("title"), "body"), "\n\n").alias("one"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chapter", "one"))), lambda x: x["one"]), "\n\n\n")
    return chapter.groupBy(*book).agg(F.concat(whole, F.lit("\n")).alias("text"))


def aligned(originals: DataFrame, segments: DataFrame, keys: list[str], most: int) -> DataFrame:
    """Chunks of originals (keys, paragraph, source) against saved segments (keys, ordinal, source) by place: (keys, place, paragraph, chunk, segment, ok).

    Segments with a blank source take no part. A side without a partner, or texts that differ beyond white space, are not ok.
    """
    chunked = originals.select(*keys, "paragraph", F.posexplode(split_long("source", most)).alias("__k", "chunk"))
    left = chunked.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("paragraph", "__k")) - 1).drop("__k")
    own = segments.where(~is_blank("source"))
    right = own.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("ordinal")) - 1).alias("place"), F.col("source").alias("segment"), "ordinal")
    found = left.join(right, [*keys, "place"], "full")
    return found.withColumn("ok", F.coalesce(collapse_space("chunk") == collapse_space("segment"), F.lit(False)))


def zipped_lines(source: Column, target: Column) -> Column:
    """array<struct<source, target>>: lines by place if both texts have the same number of two or more, else the texts as one pair."""
    a, b = F.filter(F.split(source, "\n"), lambda x: ~is_blank(x)), F.filter(F.split(target, "\n"), lambda x: ~is_blank(x))
    one = F.array(F.struct(source.alias("source"), target.alias("target")))
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("source"), y.alias("target")))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 1), pairs).otherwise(one)


def zipped(ids: Column, values: Column) -> Column:
    """Ids and values by place; an error if their numbers differ."""
    paired = F.transform(F.arrays_zip(ids.alias("id"), values.alias("value")), lambda x: x)
    return F.when(F.size(ids) == F.size(values), paired).otherwise(F.raise_error(F.lit("ids and values differ in number")))


def output_path(stem: Column, bilingual: bool, extension: str) -> Column:
    return F.concat(F.lit("output/"), stem, F.lit(".zh-bi." if bilingual else ".zh."), F.lit(extension))
