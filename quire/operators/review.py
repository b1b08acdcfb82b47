"""Rule-based review: untranslated segments and terms that were not used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.matching import occurring
from quire.functions.text import is_blank, issue_id
from quire.operators.common import FEW, settled


def untranslated(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chapter_id, segment_id, issue_type, severity, summary, place): blank translations, and ones equal to their source."""
    target = F.coalesce("target", F.lit(""))
    blank = F.when(is_blank(target), F.struct(F.lit("critical").alias("severity"), F.lit("blank").alias("summary"), F.lit(0).alias("place")))
    same = F.when((target == F.col("source")) & (F.col("source") != ""), F.struct(F.lit("major").alias("severity"), F.lit("source").alias("summary"), F.lit(1).alias("place")))
    rows = segments.select(*keys, "chapter_id", F.col("id").alias("segment_id"), F.explode(F.array_compact(F.array(blank, same))).alias("x"))
    return rows.select(*keys, "chapter_id", "segment_id", F.lit("untranslated").alias("issue_type"), "x.*")


def terminology(segments: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Segments whose source has a term as it stands while the target lacks its translation.

    Sources are read once by an automaton of all term wordings (in blocks of FEW), and what occurs is joined with the
    terms of the book, so segments never meet terms that they do not hold.
    """
    rows = segments.select(*keys, "chapter_id", F.col("id").alias("segment_id"), "source", F.coalesce("target", F.lit("")).alias("__target"))
    own = terms.select(*keys, F.col("source").alias("__term"), F.col("target").alias("__want")).where("__term is not null and __want is not null")
    words = settled(own.select("__term").where("__term <> ''").distinct())
    blocks = max(1, -(-words.count() // FEW))
    found = None
    for k in range(blocks):
        block = [r[0] for r in words.where(F.pmod(F.xxhash64("__term"), F.lit(blocks)) == k).collect()]  # about FEW rows
        hits = rows.withColumn("__term", F.explode(occurring(rows.sparkSession, sorted(block))("source"))).drop("source")
        found = hits if found is None else found.unionByName(hits)
    found = found.join(own, [*keys, "__term"]).where(~F.contains("__target", F.col("__want")))
    place = F.row_number().over(Window.partitionBy(*keys, "chapter_id", "segment_id").orderBy("__term")) + 1
    return found.select(*keys, "chapter_id", "segment_id", F.lit("terminology").alias("issue_type"), F.lit("major").alias("severity"), F.concat(F.lit("term: "), "__want").alias("summary"), place.alias("place"))


def report(issues: DataFrame, keys: list[str]) -> DataFrame:
    """Issues by id, the first of each id kept."""
    df = issues.withColumn("id", issue_id(F.col("chapter_id"), F.col("segment_id"), F.col("issue_type")))
    own = Window.partitionBy(*keys, "id").orderBy("place")
    return df.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n", "place")


def summary(segments: DataFrame, found: DataFrame, keys: list[str], as_published: bool = True) -> DataFrame:
    """(keys, chapters, segments, incomplete_chapters, reviewed, issues). As published, reviewed takes chapters off segments; else it counts segments that have a translation."""
    blank = is_blank("target")
    chapters = segments.groupBy(*keys, "chapter_id").agg(F.count("*").alias("n"), F.count_if(blank).alias("blank"))
    total = chapters.groupBy(*keys).agg(F.count("*").alias("chapters"), F.sum("n").alias("segments"), F.count_if(F.col("blank") > 0).alias("incomplete_chapters"), F.sum("blank").alias("__blank"))
    reviewed = F.greatest(F.col("segments") - F.col("incomplete_chapters" if as_published else "__blank"), F.lit(0))
    return total.join(found.groupBy(*keys).agg(F.count("*").alias("issues")), keys, "left").withColumn("issues", F.coalesce("issues", F.lit(0))).withColumn("reviewed", reviewed).drop("__blank")
