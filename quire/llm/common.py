"""Helpers that the training-data operators share: session settings, Arrow plumbing and packing of small results."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and drop its lineage, in the folder that all executors share (``spark.checkpoint.dir``)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Where it is unset, a temporary one on a single machine, and an error on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or tempfile.mkdtemp(prefix="quire-")


#: Narrow rows that may be broadcast.
FEW = 200_000


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """A checkpointed table, marked for broadcast if it is counted to have at most ``most`` (narrow) rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def in_few_tasks(df: DataFrame, rows: int, per_task: int = 100_000) -> DataFrame:
    """``df``, of at most ``rows`` narrow rows, in as many tasks as the cluster runs at once, more where a task would get over ``per_task`` rows.

    An exchange writes files for every task before it, however few its rows are, so iterations over a small table in
    many tasks fill disks with next to empty files. Tables with fewer tasks are left as they are.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def few_tasks(df: DataFrame) -> DataFrame:
    """``df`` checkpointed, counted and read in few tasks."""
    made = cut(df)
    return in_few_tasks(made, made.count())


def salted_join(big: DataFrame, small: DataFrame, on: str, how: str = "inner", least: int = 1_000) -> DataFrame:
    """``big`` joined with ``small`` on one column, with no key in a single task.

    A key that over a two-hundredth of the rows of ``big`` share (and over ``least`` rows) is cut into parts of that
    size: rows of ``big`` go to a part by hash, rows of ``small`` to all parts. So there are at most 200 such keys and 400
    parts of them, whatever the input. ``big`` is read twice. ``how`` is inner, left or left_semi.
    """
    most = max(least, -(-big.count() // 200))
    counts = big.groupBy(on).agg(F.count("*").alias("__n"))
    parts = cut(counts.where((F.col("__n") > most) & F.col(on).isNotNull()).select(F.col(on).alias("__hot"), F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    if parts.isEmpty():
        return big.join(small, on, how)
    hot = F.broadcast(parts)  # at most 200 rows
    left = big.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__part", F.when(F.col("__parts").isNotNull(), F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.col("__parts")).cast("int")).otherwise(F.lit(0)))
    right = small.join(hot, F.col(on) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return left.drop("__hot", "__parts").join(right.drop("__hot", "__parts"), [on, "__part"], how).drop("__part")


def map_arrow(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, at_once: int = 1_000) -> DataFrame:
    """One output batch for each ``at_once`` rows of an input batch, which bounds what a worker holds beside the batch itself; ``rows`` keeps no state between calls except its own bounded caches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, at_once):
                yield rows(batch.slice(a, at_once))
        released()

    return df.mapInArrow(run, schema)


def released() -> None:
    """Give memory that a task has freed back to the system: workers are used again, and allocators keep what they had at most."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """All rows of one task as a table; None for an empty task. Only for tasks whose row count is bounded by the caller."""
    kept = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(kept) if kept else None


def raw(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def crc32_of(col: str):
    """crc32 of a column written as text; what splits training rows from held-out ones."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def partitions_for(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """At least the session's shuffle partitions, more where a task would get over ``rows_per_task`` rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows // rows_per_task))
