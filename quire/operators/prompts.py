"""What a translation request carries beside its segments: terms, earlier translations and the source around the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators import context
from quire.operators.common import settled
from quire.operators.terms import relevant


def contexts(segments: DataFrame, book: list[str], chapter: list[str], order: str, terms: DataFrame, scope: list[str] | None = None, around: int = 1000, budget: int = 2000, stable: bool = False, **fixed: Column) -> DataFrame:
    """(book, chapter, batch, context): for each batch, a JSON object of its terms, of the translations before it and of its neighbours.

    segments: book, chapter (in the order of the book), order, id, source, target, status and batch, which is null where
    nothing is asked for. terms: scope (columns that they share with segments; none for one term base), source, target,
    aliases, policy. ``terms`` are those in use that match the batch, by source. ``recent_targets`` ends at the first gap
    ahead of the batch's first segment or at ``budget`` characters. ``surrounding_source`` has the segments on both sides
    of the batch, ``around`` characters each, and is left out where both are empty. ``fixed`` (constants) come first. A
    batch without terms or earlier translations has empty arrays; no batches give no rows.
    """
    keys, scope = [*book, *chapter], scope or []
    near = context.neighbours(segments, keys, order, "source", around).where("batch is not null")
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, "source"))), lambda x: x["source"])
    batches = near.groupBy(*keys, "batch").agg(F.min(order).alias("__first"), F.min_by("before", order).alias("before"), F.max_by("after", order).alias("after"), F.array_join(lines, "\n").alias("__text"))
    batches = settled(batches.withColumn("__request", F.to_json(F.struct(*keys, "batch"))))
    hits = relevant(batches, scope, "__request", "__text", terms, stable).join(terms.select(*scope, "source", "target"), [*scope, "source"])
    known = hits.groupBy(*scope, "__request").agg(F.sort_array(F.collect_list(F.struct("source", "target"))).alias("terms"))
    asked = batches.select(*keys, F.col("__first").alias(order), F.lit(True).alias("__asked"))
    marked = segments.join(asked, [*keys, order], "left")
    usable = (F.col("status") == "translated") & F.col("target").isNotNull()
    back = context.recent(marked, book, [*chapter, order], F.col("target"), usable, budget, asked=F.col("__asked"), name="id")
    told = F.sort_array(F.collect_list(F.struct("recent_p", F.struct(F.col("recent_id").alias("segment_id"), F.col("recent").alias("target")).alias("x"))))
    back = back.groupBy(*keys, F.col(order).alias("__first")).agg(F.transform(told, lambda r: r["x"]).alias("recent_targets"))
    both = batches.join(known, [*scope, "__request"], "left").join(back, [*keys, "__first"], "left")
    filled = [F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c) for c in ("terms", "recent_targets")]
    sides = F.when((F.col("before") != "") | (F.col("after") != ""), F.struct("before", "after")).alias("surrounding_source")
    own = F.struct(*[c.alias(name) for name, c in fixed.items()], *filled, sides)
    return both.select(*keys, "batch", F.to_json(own).alias("context"))
