"""Context of a segment: neighbours, translations before it within a budget, samples and excerpts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import sampled_text, samples


def neighbours(items: DataFrame, keys: list[str], order: str, source: str, most: int = 1000) -> DataFrame:
    """Segments with before and after: up to ``most`` characters of each neighbour in the chapter, empty at its ends."""
    own = Window.partitionBy(*keys).orderBy(order)
    before, after = F.lag(source).over(own), F.lead(source).over(own)
    return items.withColumns({"before": F.coalesce(F.right(before, F.lit(most)), F.lit("")), "after": F.coalesce(F.left(after, F.lit(most)), F.lit(""))})


def recent(items: DataFrame, book: list[str], order: list[str], value: Column, usable: Column, budget: int, asked: Column | None = None, name: str | None = None) -> DataFrame:
    """(book, order columns, recent_...): for each segment (that is ``asked`` for), the values ahead of it up to the first gap, within ``budget`` characters; the oldest keeps its end only. ``name`` is a column of which recent_id tells each value's.

    Positions and prefix sums of lengths turn the walk back into a band join on the run between two gaps. The band of a
    segment is at most ``budget`` rows wide where values are not empty.
    """
    own = Window.partitionBy(*book).orderBy(*order)
    sofar = own.rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(usable, value)
    more = [] if name is None else [F.col(name).alias("recent_id")]
    df = items.select(*book, *order, *more, value.alias("value"), F.coalesce(asked if asked is not None else F.lit(True), F.lit(False)).alias("asked"))
    df = df.withColumn("p", F.row_number().over(own)).withColumn("gap", F.col("value").isNull().cast("int"))
    df = df.withColumn("g", F.sum("gap").over(sofar)).withColumn("cs", F.sum(F.coalesce(F.length("value"), F.lit(0))).over(sofar))
    # The run that a segment looks back on, and the characters up to it. What it can reach ends in the same stretch of
    # ``budget`` characters or the one before, so the join is on stretches, not on whole runs.
    stretch = lambda c: F.floor(F.col(c) / max(1, budget)).cast("long")
    ahead = df.where("asked").select(*book, *order, "p", (F.col("g") - F.col("gap")).alias("run"), (F.col("cs") - F.coalesce(F.length("value"), F.lit(0))).alias("upto"))
    ahead = ahead.withColumn("stretch", F.explode(F.array(stretch("upto"), stretch("upto") - 1)))
    past = df.where("gap = 0").select(*book, *(["recent_id"] if more else []), F.col("g").alias("run"), F.col("p").alias("recent_p"), "cs", "value", stretch("cs").alias("stretch"))
    left = F.lit(budget) - (F.col("upto") - F.col("cs"))
    found = ahead.join(past, [*book, "run", "stretch"]).where((F.col("recent_p") < F.col("p")) & (F.col("upto") - F.col("cs") < budget))
    return found.select(*book, *order, "p", "recent_p", *(["recent_id"] if more else []), F.right(F.col("value"), left).alias("recent"))


def sampled(docs: DataFrame, text: str, size: int, count: int) -> DataFrame:
    """One row per sample window of a text."""
    return docs.select("*", F.posexplode(samples(text, size, count)).alias("sample_no", "sample"))


def digest_text(docs: DataFrame, text: str, most: int) -> DataFrame:
    return docs.withColumn("sampled", sampled_text(text, most))


def random_windows(text: Column, size: int, count: int, seed: int) -> Column:
    """``count`` windows of at most ``size`` characters at uniform places."""
    last = F.greatest(F.length(text) - size, F.lit(0))
    return F.array(*[F.substring(text, F.floor(F.rand(seed + i) * (last + 1)).cast("int") + 1, F.lit(size)) for i in range(count)])


def excerpt(text: Column, matches, most: int = 240) -> Column:
    """The first line that ``matches`` (a function of a column), else the first line, cut."""
    rows = F.split(text, "\n")
    found = F.filter(rows, matches)
    return F.left(F.coalesce(F.get(found, F.lit(0)), F.get(rows, F.lit(0)), F.lit("")), F.lit(most))


def unanimous(votes: DataFrame, keys: list[str], vote: str) -> DataFrame:
    """(keys, choice): the vote, ignoring case, if all agree, else null."""
    low = F.lower(vote)
    return votes.groupBy(*keys).agg(F.when(F.min(low) == F.max(low), F.min(low)).alias("choice"))
