"""The shared test tables in the shape of the engine's model: books, chapters, segments, glossary, events."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.model import TRANSLATED


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as segments: a book is fifty conversations, a chapter one of them; replies are translated, requests pending, system turns failed."""
    role = F.col("role")
    return table(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 50).alias("book"),
        F.col("conv_id").alias("chapter"),
        F.col("turn").alias("ordinal"),
        F.concat(F.lit("c"), "conv_id", F.lit("-s"), "turn").alias("id"),
        F.concat(F.lit("chapter-"), "conv_id").alias("chapter_id"),
        F.lit("paragraph").alias("kind"),
        F.col("text").alias("source"),
        F.when(role == "assistant", F.concat(F.lit(TRANSLATED), "text")).alias("target"),
        F.when(role == "assistant", F.col("text")).alias("draft"),
        F.when(role == "assistant", "translated").when(role == "system", "failed").otherwise("pending").alias("status"),
        (F.col("turn") % 3 == 1).alias("protected"),
    )


#: The same rows for the oracle.
DIALOGUE = """dialogue as (select conv_id // 50 as book, conv_id as chapter, turn as ordinal, 'c' || conv_id || '-s' || turn as id,
  'chapter-' || conv_id as chapter_id, 'paragraph' as kind, text as source,
  case when role = 'assistant' then '[mock zh-CN] ' || text end as target, case when role = 'assistant' then text end as draft,
  case when role = 'assistant' then 'translated' when role = 'system' then 'failed' else 'pending' end as status, turn % 3 = 1 as protected
  from conversations)"""


def glossary(spark: SparkSession, sf_dir: str, most: int = 50) -> DataFrame:
    """Terms of each language: its ``most`` most frequent words of five or more letters, with an upper-case alias shared by pairs of terms now and then."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0))).alias("source"))
    counted = words.groupBy("lang", "source").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "source")) - 1
    top = counted.withColumn("rank", rank).where(F.col("rank") < most)
    upper = F.translate("source", string.ascii_lowercase, string.ascii_uppercase)  # ASCII letters only, as engines differ beyond them
    policies = F.array(*map(F.lit, ["automatic", "fixed", "non_fixed", "ignored"]))
    shared = F.concat(F.lit("ALIAS"), F.floor(F.col("rank") / 2))
    return top.select(
        "lang",
        "rank",
        "source",
        F.concat(F.lit("[t] "), "source").alias("target"),
        F.when(F.col("rank") % 5 == 0, F.array(upper, shared)).when(F.col("rank") % 5 == 1, F.array(shared)).otherwise(F.array(upper)).alias("aliases"),
        F.get(policies, F.col("rank") % 4).alias("policy"),
        F.col("rank").alias("first_chapter"),
    )


GLOSSARY = r"""words as (select lang, unnest(regexp_extract_all(lower(text), '\p{L}{5,}')) as source from documents),
counted as (select lang, source, count(*) as n from words group by all),
ranked as (select lang, source, row_number() over (partition by lang order by n desc, source) - 1 as rank from counted qualify rank < 50),
glossary as (select lang, rank, source, '[t] ' || source as target,
  case when rank % 5 = 0 then [translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'ALIAS' || (rank // 2)] when rank % 5 = 1 then ['ALIAS' || (rank // 2)] else [translate(source, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')] end as aliases,
  ['automatic', 'fixed', 'non_fixed', 'ignored'][rank % 4 + 1] as policy, rank as first_chapter from ranked)"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence: a term per event type and tens digit, wordings by the last digit of its number, chapters by user."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat_ws("-", "event_type", F.floor(k / 10).cast("string")).alias("source"),
        F.concat(F.lit("t"), k % 10 % 4).alias("target"),
        F.col("user_id").cast("int").alias("chapter"),
        F.concat(F.lit("seen at "), "event_id").alias("source_excerpt"),
    )


EVIDENCE = """evidence as (select event_id as id, event_type || '-' || (k // 10) as source, 't' || (k % 10 % 4) as target, user_id::int as chapter,
  'seen at ' || event_id as source_excerpt from (select *, json_extract_string(props, '$.k')::int as k from events))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as token usage of a stage and a model."""
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("stage"),
        F.concat(F.lit("model-"), F.col("user_id") % 3).alias("model"),
        cents.alias("input_tokens"),
        (cents % 97).alias("output_tokens"),
        (cents + cents % 97).alias("total_tokens"),
        F.when(cents % 2 == 0, cents % 13).alias("cached_input_tokens"),
        F.lit(0).cast("long").alias("cache_creation_input_tokens"),
        (cents % 7).alias("reasoning_tokens"),
        F.lit(None).cast("long").alias("tool_use_prompt_tokens"),
    )


USAGE = """usage as (select event_type as stage, 'model-' || (user_id % 3) as model, cents as input_tokens, cents % 97 as output_tokens,
  cents + cents % 97 as total_tokens, case when cents % 2 = 0 then cents % 13 end as cached_input_tokens, 0 as cache_creation_input_tokens,
  cents % 7 as reasoning_tokens, null::bigint as tool_use_prompt_tokens from (select *, round(value * 100)::bigint as cents from events))"""
