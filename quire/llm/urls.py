"""URL filters: host and path rules, and a blocked Bloom filter of listed canonical URLs before an exact join.

The filter has one row of eight 32-bit words per block; a key sets one bit in each word of its block, as in Parquet's
split-block filters. It is built by a bitwise-or aggregate, so its size follows the list and no task holds all of it.
A filter under ``broadcast_bytes`` (its block count is known beforehand) is broadcast to the pages; a larger one is
joined by block number. Pages that miss are done; the distinct URLs of possible hits are joined with the list, which
removes false positives. What is left of them goes back to its pages by broadcast while there are few, else by a join
that cuts the pages of a frequent URL into parts.

Defined cases: a null url, or one without ``://``, has empty host and path, meets no rule and is never listed; an empty
list blocks nothing; repeated pages are judged alike; of rules of equal length the one that sorts first wins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, salted_join, table

#: The eight odd multipliers of the public split-block Bloom filter format.
SALTS = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
#: Listed URLs that may be broadcast: a URL is some 100 bytes.
FEW = 100_000
RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; then what follows up to ``?``, ``#`` or the end."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading ``www.`` or ``m.`` and without a final dot, and path without ``.html`` or final slashes; null without host."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^(?:www|m)\.", ""), r"\.$", "")
    short = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", "")
    return F.when(host != "", F.concat(bare, short))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule (text, verdict) that fits a host, or one above it, and the path's beginning; nulls if none does."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        own, slash, begin = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + begin)
        found, verdict = F.when(fits, text).otherwise(found), F.when(fits, what).otherwise(verdict)
    return found, verdict


def _place(key: Column, n_blocks: int) -> tuple[Column, list[Column]]:
    """Block number and the bit masks of a key, one for each 32-bit word."""
    h = F.xxhash64(key)
    block = F.pmod(F.shiftrightunsigned(h, 32), F.lit(n_blocks))
    low, high = h.bitwiseAND(F.lit(0xFFFF)), F.shiftrightunsigned(h, 16).bitwiseAND(F.lit(0xFFFF))
    # The product modulo 2^32 in two halves, neither of which can overflow a long; its top five bits choose the bit.
    products = [(low * salt + F.shiftleft((high * salt).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(0xFFFFFFFF)) for salt in SALTS]
    return block, [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(p, 27).cast("int")) for p in products]


def bloom_filter(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """(block, w0..w7): the filter's rows that have a bit set."""
    block, masks = _place(F.col(key), n_blocks)
    return keys.select(block.alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(8)])


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str]] = RULES, bits_per_key: int = 16, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(page_id, host, path, rule, verdict, possible, listed) for each row of pages (page_id, url); ``listed`` has the column canonical."""
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    df = df.withColumns({"rule": rule, "ruled": verdict, "canonical": canonical(F.col("host"), F.col("path"))})
    keys = cut(listed.select("canonical").where("canonical is not null").distinct())
    n_blocks = max(1, math.ceil(keys.count() * bits_per_key / 256))
    bloom = bloom_filter(keys, "canonical", n_blocks)
    block, masks = _place(F.col("canonical"), n_blocks)
    small = n_blocks * 72 <= broadcast_bytes
    placed = df.withColumn("block", F.coalesce(block, F.lit(0)))
    seen = placed.join(F.broadcast(bloom), "block", "left") if small else salted_join(cut(placed), bloom, "block", "left")
    hit = F.lit(True)
    for i, m in enumerate(masks):
        hit = hit & (F.coalesce(F.col(f"w{i}"), F.lit(0)).bitwiseAND(m) == m)
    seen = seen.withColumn("possible", F.coalesce(F.col("canonical").isNotNull() & hit, F.lit(False))).drop("block", *[f"w{i}" for i in range(8)])
    seen = cut(seen)  # pages are read once; their judgement has no html
    doubtful = seen.where("possible")
    hits = cut(doubtful.select("canonical").distinct().join(keys, "canonical", "left_semi").withColumn("listed", F.lit(True)))
    judged = doubtful.join(F.broadcast(hits), "canonical", "left") if hits.count() <= FEW else salted_join(doubtful, hits, "canonical", "left")
    judged = judged.unionByName(seen.where("not possible").withColumn("listed", F.lit(None).cast("boolean")))
    judged = judged.withColumn("listed", F.coalesce("listed", F.lit(False)))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "possible", "listed")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    """Listed are the canonical URLs of pages whose id is divisible by 50."""
    pages = table(spark, sf_dir, "pages")
    host, path = host_and_path(F.col("url"))
    listed = pages.where("page_id % 50 = 0").select(canonical(host, path).alias("canonical"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict", "listed")


OP6_SQL = r"""
with rests as (select page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) as rest from pages),
hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw_host from rests),
parts as (select page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') as path from hosts),
named as (select *, case when host <> '' then regexp_replace(regexp_replace(host, '^(?:www|m)\.', ''), '\.$', '')
  || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '') end as canonical from parts),
rules(what, text, own, start) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
  ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
fitting as (select n.page_id, r.what, r.text, row_number() over (partition by n.page_id order by length(r.text) desc, r.text) as k
  from named n join rules r on (n.host = r.own or ends_with(n.host, '.' || r.own)) and starts_with(n.path, r.start)),
listed as (select distinct canonical from named where page_id % 50 = 0 and canonical is not null)
select n.page_id, n.host, n.path, f.text as rule,
  coalesce(f.what, case when l.canonical is not null then 'block' else 'allow' end) as verdict, l.canonical is not null as listed
from named n left join fitting f on f.page_id = n.page_id and f.k = 1 left join listed l on l.canonical = n.canonical
"""
