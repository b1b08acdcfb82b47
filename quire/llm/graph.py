"""Connected components of an edge table by alternating large and small stars, without a driver-side union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import cut, in_few_tasks, salted_join

FEW = 400_000


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """(u, v) with m, the least of u and its listed neighbours. The minimum is combined before the shuffle; the join with it is a broadcast while there are at most FEW edges, and cuts the edges of a hub into parts beyond."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return edges.join(F.broadcast(least), "u") if n <= FEW else salted_join(edges, least, "u")


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = in_few_tasks(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), n)
    found = _with_least(down if n <= FEW else cut(down), n)
    moved = found.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return in_few_tasks(moved.unionByName(found.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), 2 * n)


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Each node of ``edges`` (u, v of one ordered type) with ``root``, the least node that it reaches.

    Null ends and loops are ignored; repeated edges are harmless; no edges give no rows. Each round halves path
    lengths or better, so the number of rounds is logarithmic in the longest chain; every round is checkpointed.
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v").distinct())
    state = None
    for _ in range(most_rounds):
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen[0] == 0 or seen == state:
            break
        state = seen
        now = cut(_small_star(_large_star(in_few_tasks(now, seen[0]), seen[0]), 2 * seen[0]))
    else:
        raise RuntimeError("components did not settle")
    now = in_few_tasks(now, seen[0])
    roots = in_few_tasks(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct(), seen[0])
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
