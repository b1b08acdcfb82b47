"""Lines to chapters, paragraphs, chunks and segments with stable ids.

Documents are independent: every window is partitioned by the document's key, and explosions need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.hashing import chapter_id, content_hash, segment_base
from quire.functions.text import collapse_space, is_blank, is_heading, split_long, strip, stripped_markup


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with pos and line for each line; a carriage return at its end goes, and so does a last empty line."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\n\z", "")
    rows = docs.where(F.coalesce(F.length(text), F.lit(0)) > 0)
    return rows.select("*", F.posexplode(F.split(whole, "\n")).alias("pos", "line")).drop(text).withColumn("line", F.regexp_replace("line", r"\r\z", ""))


def chapters(line_rows: DataFrame, keys: list[str], title: Column) -> DataFrame:
    """Lines with chapter (from 0) and chapter_title. A heading line opens a chapter and belongs to none; headings without a line behind them give way to the next one; a document of headings alone is one chapter without lines."""
    own = Window.partitionBy(*keys).orderBy("pos")
    sofar = own.rowsBetween(Window.unboundedPreceding, 0)
    df = line_rows.withColumn("__head", (strip("line") != "") & is_heading(strip("line")))
    df = df.withColumn("__opened", F.sum(F.col("__head").cast("int")).over(sofar))
    df = df.withColumn("chapter_title", F.coalesce(F.last(F.when(F.col("__head"), strip("line")), ignorenulls=True).over(sofar), title))
    body = df.where(~F.col("__head")).withColumn("chapter", F.dense_rank().over(Window.partitionBy(*keys).orderBy("__opened")) - 1)
    whole = Window.partitionBy(*keys)
    bare = df.withColumn("__body", F.sum((~F.col("__head")).cast("int")).over(whole)).withColumn("__last", F.max("pos").over(whole))
    bare = bare.where((F.col("__body") == 0) & (F.col("pos") == F.col("__last"))).withColumn("line", F.lit(None).cast("string")).withColumn("chapter", F.lit(0))
    columns = [*keys, "pos", "line", "chapter", "chapter_title"]
    return body.select(columns).unionByName(bare.select(columns))


def paragraphs(chapter_lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chapter, chapter_title, paragraph, source): runs of lines that are not blank, stripped and joined by a space."""
    own = Window.partitionBy(*keys, "chapter").orderBy("pos")
    df = chapter_lines.withColumn("__blank", is_blank("line"))
    df = df.withColumn("__run", F.sum(F.col("__blank").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("__blank"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", strip("line").alias("line")))), lambda x: x["line"]), " ")
    df = df.groupBy(*keys, "chapter", "__run").agg(F.first("chapter_title").alias("chapter_title"), joined.alias("source"))
    rank = F.row_number().over(Window.partitionBy(*keys, "chapter").orderBy("__run")) - 1
    return df.select(*keys, "chapter", "chapter_title", rank.alias("paragraph"), "source")


def chunks(rows: DataFrame, source: str, most: int, ordinal: str = "chunk") -> DataFrame:
    """``rows`` with one row per chunk of ``source`` (its column holds the chunk) and the chunk's number; no shuffle."""
    others = [c for c in rows.columns if c != source]
    return rows.select(*others, F.posexplode(split_long(source, most)).alias(ordinal, source))


def segments(blocks: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Blocks (keys, chapter, chapter_title, kind, source and what orders them) to segments with ordinal, id and hash; ids of equal segments of a chapter get -2, -3, ..."""
    df = chunks(blocks, "source", most, "__chunk").where(collapse_space("source") != "")
    order = [*order, "__chunk"]
    own = Window.partitionBy(*keys, "chapter").orderBy(*order)
    df = df.withColumn("chapter_id", chapter_id(F.col("chapter"), F.col("chapter_title")))
    df = df.withColumn("__base", segment_base(F.col("chapter_id"), F.col("kind"), F.col("source")))
    df = df.withColumn("ordinal", F.row_number().over(own) - 1)
    again = F.row_number().over(Window.partitionBy(*keys, "chapter", "__base").orderBy(*order))
    df = df.withColumn("__again", again)
    df = df.withColumn("id", F.when(F.col("__again") == 1, F.col("__base")).otherwise(F.concat_ws("-", "__base", F.col("__again").cast("string"))))
    return df.select(*keys, "chapter", "chapter_id", "chapter_title", "ordinal", "id", "kind", "source", content_hash(F.col("source")).alias("source_hash"))


def fallback_blocks(pages: DataFrame, keys: list[str], markup: str = "html") -> DataFrame:
    """(keys, ordinal, source): paragraphs of markup that is not well-formed, with tags stripped."""
    text = pages.select(*keys, stripped_markup(markup).alias("text"))
    bare = lines(text).withColumn("chapter", F.lit(0)).withColumn("chapter_title", F.lit(""))
    return paragraphs(bare, keys).select(*keys, F.col("paragraph").alias("ordinal"), "source")


def grouped_by_start(documents: DataFrame, starts: DataFrame, book: str, pos: str = "pos", path: str = "path") -> DataFrame:
    """Each document of a book with the last start at or before it: chapter (from 0, without empty ones) and chapter_title. Documents before the first start go.

    documents: (book, pos, path, n_blocks); starts: (book, path, title). Empty chapters are left out of the count.
    """
    named = starts.select(F.col(book), F.col(path), F.col("title").alias("__title"))
    df = documents.join(named, [book, path], "left")
    own = Window.partitionBy(book).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("chapter_title", F.last("__title", ignorenulls=True).over(own)).withColumn("__opened", F.count("__title").over(own)).where("__opened > 0")
    df = df.withColumn("__size", F.sum("n_blocks").over(Window.partitionBy(book, "__opened"))).where("__size > 0")
    return df.withColumn("chapter", F.dense_rank().over(Window.partitionBy(book).orderBy("__opened")) - 1).drop("__title", "__opened", "__size")
