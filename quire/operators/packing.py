"""Budgeted packing of ordered items into batches.

What a batch takes depends on where the one before it ended, so no window states it. The batch numbers of a chapter are
computed in one pass over the array of its lengths, many chapters at a time; chapters stay in their partition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


def batches_of(lengths, budget: int) -> list[int]:
    """A batch takes items while they fit; one that is too long is alone; a batch that reached the budget is closed."""
    out, batch, chars, size = [], 0, 0, 0
    for n in lengths:
        if size and (chars + n > budget or chars >= budget):
            batch, chars, size = batch + 1, 0, 0
        chars, size = chars + n, size + 1
        out.append(batch)
    return out


def pending_batches_of(lengths, pending, budget: int) -> int:
    """How many batches have something pending, where only a batch that has characters can be closed by the next item."""
    count, chars, open_ = 0, 0, False
    for n, p in zip(lengths, pending):
        if chars > 0 and chars + n > budget:
            count, chars, open_ = count + open_, 0, False
        chars, open_ = chars + n, open_ or bool(p)
        if chars >= budget:
            count, chars, open_ = count + open_, 0, False
    return count + open_


def batch_numbers(lengths: Column, budget: int) -> Column:
    """An array of lengths to the array of their batch numbers."""

    @F.pandas_udf("array<int>")
    def run(own: pd.Series) -> pd.Series:
        return own.map(lambda x: batches_of(x, budget), na_action="ignore")

    return run(lengths)


def pending_batches(lengths: Column, pending: Column, budget: int) -> Column:
    @F.pandas_udf("int")
    def run(own: pd.Series, open_: pd.Series) -> pd.Series:
        return pd.Series([pending_batches_of(a, b, budget) for a, b in zip(own, open_)])

    return run(lengths, pending)


def _gathered(items: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias("__items"))


def pack(items: DataFrame, keys: list[str], order: str, length: str, budget: int) -> DataFrame:
    """``items`` of each key with batch (from 0). A key is a chapter, whose items make one array."""
    others = [c for c in items.columns if c not in (*keys, order)]
    df = _gathered(items, keys, order, others)
    df = df.withColumn("__batch", batch_numbers(F.transform("__items", lambda x: x[length].cast("int")), budget))
    df = df.select(*keys, F.explode(F.arrays_zip("__items", "__batch")).alias("__row"))
    return df.select(*keys, "__row.__items.*", F.col("__row.__batch").alias("batch"))


def ranges_of(lengths, budget: int) -> list[tuple[int, int]]:
    """(first place, size) of each batch."""
    numbers = batches_of(lengths, budget)
    starts = [i for i, n in enumerate(numbers) if i == 0 or n != numbers[i - 1]]
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], len(numbers)])]


def batch_rows(items: DataFrame, keys: list[str], order: str, length: str, budget: int) -> DataFrame:
    """(keys, batch, items): one row per batch with its items (order and all other columns) as an array. Batches come out of their chapter's row, so nothing is exchanged behind the packing."""
    others = [c for c in items.columns if c not in (*keys, order)]
    kind = ArrayType(StructType([StructField("first", IntegerType()), StructField("size", IntegerType())]))

    @F.pandas_udf(kind)
    def run(own: pd.Series) -> pd.Series:
        return own.map(lambda x: [{"first": a, "size": n} for a, n in ranges_of(x, budget)], na_action="ignore")

    df = _gathered(items, keys, order, others)
    df = df.withColumn("__ranges", run(F.transform("__items", lambda x: x[length].cast("int"))))
    df = df.select(*keys, "__items", F.posexplode("__ranges").alias("batch", "__r"))
    return df.select(*keys, "batch", F.slice("__items", F.col("__r.first") + 1, F.col("__r.size")).alias("items"))


def batches(rows: DataFrame, keys: list[str], order: str, length: str) -> DataFrame:
    """Batch rows to first and last item, items and characters."""
    chars = F.aggregate("items", F.lit(0).cast("long"), lambda total, x: total + x[length])
    return rows.select(*keys, "batch", F.col("items")[0][order].alias("first_item"), F.element_at("items", -1)[order].alias("last_item"), F.size("items").cast("long").alias("n_items"), chars.alias("chars"))


def plan_open(items: DataFrame, keys: list[str], order: str, length: str, open_: Column, budget: int) -> DataFrame:
    """Translation plan: all items are packed, then those still open are kept; batches without any are left out."""
    rows = batch_rows(items.withColumn("__open", F.coalesce(open_, F.lit(False))), keys, order, length, budget)
    kept = rows.withColumn("items", F.filter("items", lambda x: x["__open"])).where(F.size("items") > 0)
    return batches(kept, keys, order, length)


def plan_eligible(items: DataFrame, book: list[str], chapter: str, order: str, length: str, eligible: Column, budget: int, prefix: str) -> DataFrame:
    """Polish plan: only eligible items are packed, never across chapters; batches are numbered through the book."""
    keys = [*book, chapter]
    found = batches(batch_rows(items.where(eligible), keys, order, length, budget), keys, order, length)
    rank = F.row_number().over(Window.partitionBy(*book).orderBy(chapter, "batch")) - 1
    return found.withColumn("id", F.concat(F.lit(prefix + "-b"), F.lpad(rank.cast("string"), F.greatest(F.lit(3), F.length(rank.cast("string"))), F.lit("0"))))


def fixed_batches(items: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """Items with batch by count, and first_id, the id of the batch's first item."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1
    df = items.withColumn("batch", F.floor(rank / size).cast("int"))
    return df.withColumn("first_id", F.first("id").over(Window.partitionBy(*keys, "batch").orderBy(order)))


def request_estimate(items: DataFrame, keys: list[str], order: str, length: str, pending: Column, budget: int) -> DataFrame:
    """(keys, requests): how many batches of a chapter have something pending."""
    df = _gathered(items.withColumn("__pending", pending), keys, order, [length, "__pending"])
    count = pending_batches(F.transform("__items", lambda x: x[length].cast("int")), F.transform("__items", lambda x: x["__pending"]), budget)
    return df.select(*keys, count.cast("long").alias("requests"))
