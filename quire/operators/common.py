"""Helpers of the operators: small tables that are computed once, and joins that broadcast only what was counted."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 200_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder (``spark.checkpoint.dir``; a folder of this machine where none is set)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint()


def small_join(df: DataFrame, settled_: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a settled table: broadcast while it has at most FEW rows, else shuffled, where Spark splits skewed keys."""
    return df.join(F.broadcast(settled_) if settled_.count() <= FEW else settled_.hint("merge"), on, how)
