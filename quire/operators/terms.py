"""Glossary matching: which terms a text calls for, where a term occurs, and which aliases are ambiguous.

The exact predicate cannot be hashed, so a plain join on it compares every text with every term. ``matches`` first
joins on tokens: a term can only match a text that holds the first token of its folded needle (needles with CJK letters,
which match inside words, use their first letter). Only such pairs are verified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.matching import any_of_folded, folded, matches_folded
from quire.functions.text import CJK, has_cjk, strip
from quire.operators.common import settled, small_join

ACTIVE = ["automatic", "fixed"]


def needles(terms: DataFrame, book: list[str]) -> DataFrame:
    """(book, source, needle, is_alias): each term's own wording and its aliases, folded; empty ones go."""
    own = F.array(F.struct(F.col("source").alias("text"), F.lit(False).alias("is_alias")))
    others = F.transform(F.coalesce("aliases", F.expr("cast(array() as array<string>)")), lambda a: F.struct(a.alias("text"), F.lit(True).alias("is_alias")))
    rows = terms.select(*book, "source", F.explode(F.concat(own, others)).alias("__n"))
    return rows.select(*book, "source", folded("__n.text").alias("needle"), F.col("__n.is_alias").alias("is_alias")).where("needle <> ''")


def _tokens(text: Column) -> Column:
    """What a needle's key may be: runs of letters and numbers, and single CJK letters or other characters."""
    runs = F.regexp_extract_all(text, F.lit(r"[\p{IsAlphabetic}\p{N}]+"), F.lit(0))
    single = F.regexp_extract_all(text, F.lit(rf"[{CJK}]|[^\p{{IsAlphabetic}}\p{{N}}]"), F.lit(0))
    return F.array_distinct(F.concat(runs, single))


def _key(needle: Column) -> Column:
    """A token that every matching text has: the first CJK letter, else the run of word characters it begins with, else its first character."""
    run = F.regexp_extract(needle, r"^[\p{IsAlphabetic}\p{N}]+", 0)
    return F.when(has_cjk(needle), F.regexp_extract(needle, f"[{CJK}]", 0)).when(run == "", F.left(needle, F.lit(1))).otherwise(run)


def matches(texts: DataFrame, book: list[str], text_id: str, text: str, terms: DataFrame, stable: bool = False) -> DataFrame:
    """(book, text_id, source, needle, is_alias) for each needle that matches a text; text_id is unique in its book.

    ``stable`` says that lower-casing folds these texts, which then needs no Python. Tokens travel without their text.
    A needle that is one run of word characters matches as soon as the run does; only longer needles, and those with
    CJK letters, are verified, on one row per text.
    """
    held = texts.select(*book, text_id, (F.lower(text) if stable else folded(text)).alias("__text"))
    wanted = needles(terms, book).withColumn("__key", _key(F.col("needle")))
    wanted = settled(wanted.withColumn("__sure", (F.col("needle") == F.col("__key")) & ~has_cjk("needle") & F.col("needle").rlike(r"[\p{IsAlphabetic}\p{N}]")))
    spread = held.select(*book, text_id, F.explode(_tokens(F.col("__text"))).alias("__key"))
    pairs = small_join(spread, wanted, [*book, "__key"]).drop("__key")
    sure = pairs.where("__sure").drop("__sure")
    if wanted.where("not __sure").isEmpty():
        return sure.select(*book, text_id, "source", "needle", "is_alias")
    one = F.collect_set(F.struct("source", "needle", "is_alias")).alias("__pairs")
    open_ = pairs.where("not __sure").groupBy(*book, text_id).agg(one).join(held, [*book, text_id])
    checked = open_.withColumn("__ok", any_of_folded("__text", F.transform("__pairs", lambda x: x["needle"])))
    checked = checked.select(*book, text_id, F.explode(F.arrays_zip("__pairs", "__ok")).alias("__p")).where("__p.__ok").select(*book, text_id, "__p.__pairs.*")
    return sure.unionByName(checked).select(*book, text_id, "source", "needle", "is_alias")


def relevant(texts: DataFrame, book: list[str], text_id: str, text: str, terms: DataFrame, stable: bool = False) -> DataFrame:
    """(book, text_id, source): terms in use whose wording matches, or of which an alias matches that no other alias in the glossary's matches folds to."""
    found = matches(texts, book, text_id, text, terms, stable)
    hits = F.count("*").over(Window.partitionBy(*book, text_id, "needle", "is_alias"))
    good = found.withColumn("__hits", hits).where("not is_alias or __hits = 1").select(*book, text_id, "source").distinct()
    use = terms.where(F.coalesce("policy", F.lit("automatic")).isin(ACTIVE)).select(*book, "source")
    return good.join(use, [*book, "source"], "left_semi")


def alias_conflicts(terms: DataFrame, book: list[str]) -> DataFrame:
    """(book, alias_key, first_source, second_source): folded aliases that two terms share, sources in order."""
    one = needles(terms, book).where("is_alias").select(*book, F.col("needle").alias("alias_key"), "source").distinct()
    a, b = one.withColumnRenamed("source", "first_source"), one.withColumnRenamed("source", "second_source")
    return a.join(b, [*book, "alias_key"]).where("first_source < second_source")


def impact(titles: DataFrame, segments: DataFrame, book: list[str], terms: DataFrame, stable: bool = False) -> DataFrame:
    """(book, source, id, chapter_id, kind, text, target): translated titles and segments that a term occurs in; a heading equal to a title that matched is left out.

    titles: (book, chapter_id, title, target_title); segments: (book, id, chapter_id, kind, source, target).
    """
    bare = terms.select(*book, "source", F.expr("cast(array() as array<string>)").alias("aliases"))
    heads = titles.select(*book, F.concat(F.lit("title:"), "chapter_id").alias("id"), "chapter_id", F.lit("title").alias("kind"), F.col("title").alias("text"), F.col("target_title").alias("target"))
    body = segments.select(*book, "id", "chapter_id", "kind", F.col("source").alias("text"), "target")
    rows = heads.unionByName(body)
    found = matches(rows.select(*book, "id", "text"), book, "id", "text", bare, stable).select(*book, "id", "source").distinct()
    hit = found.join(rows, [*book, "id"])
    title_hit = found.join(heads, [*book, "id"]).select(*book, "source", "chapter_id", strip("text").alias("__title"))
    rest = hit.withColumn("__title", F.when(F.col("kind") == "heading", strip("text"))).join(title_hit, [*book, "source", "chapter_id", "__title"], "left_anti")
    return rest.where("target is not null").select(*book, "source", "id", "chapter_id", "kind", "text", "target")


def impact_of_fixed(found: DataFrame, terms: DataFrame, book: list[str]) -> DataFrame:
    """Contents that any fixed term occurs in, each once."""
    fixed = terms.where("policy = 'fixed'").select(*book, "source")
    return found.join(fixed, [*book, "source"], "left_semi").drop("source").dropDuplicates([*book, "id"])


def merged_metadata(entries: DataFrame, book: list[str], order: str) -> DataFrame:
    """One row per term: aliases in the order of their first mention, the first reading, gender and note that is set, the least first_chapter, the first target."""
    whole = Window.partitionBy(*book, "source").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = [F.first(c, ignorenulls=True).over(whole).alias(c) for c in ("reading", "gender", "note")]
    df = entries.select(*book, "source", order, "aliases", "first_chapter", F.first("target").over(whole).alias("target"), *first)
    aliases = F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(order, F.coalesce("aliases", F.expr("cast(array() as array<string>)")).alias("own")))), lambda x: x["own"])))
    return df.groupBy(*book, "source").agg(F.first("target").alias("target"), *[F.first(c).alias(c) for c in ("reading", "gender", "note")], F.min("first_chapter").alias("first_chapter"), aliases.alias("aliases"))


def first_of_signature(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Entries whose folded source and target did not occur before."""
    own = Window.partitionBy(*keys, folded("source"), folded("target")).orderBy(order)
    return entries.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def with_rules(terms: DataFrame, rules: DataFrame, book: list[str]) -> DataFrame:
    """Terms with policy and manual_target, automatic where no rule is set."""
    return terms.join(rules.select(*book, "source", F.col("policy").alias("__policy"), F.col("manual_target")), [*book, "source"], "left").withColumn("policy", F.coalesce("__policy", F.lit("automatic"))).drop("__policy")


TYPES = ["person", "place", "organization", "term", "appellation", "speech", "fixed_expr"]


def term_error(source: Column, target: Column, kind: Column) -> Column:
    """What is wrong with a term, or null."""
    blank = (strip(F.coalesce(source, F.lit(""))) == "") | (strip(F.coalesce(target, F.lit(""))) == "")
    return F.when(blank, "term source and target must not be empty").when(~F.coalesce(kind.isin(TYPES), F.lit(False)), F.concat(F.lit("unsupported term type: "), F.coalesce(kind, F.lit("null"))))


def usable_extractions(entries: DataFrame, source_text: str, target_text: str) -> DataFrame:
    """Extracted terms that are not copied, and whose wordings occur in both texts."""
    from quire.functions.matching import is_copied

    df = entries.where(~is_copied("source", "target"))
    df = df.where(matches_folded(folded(source_text), folded("source")))
    return df.where(matches_folded(folded(target_text), folded("target")))
