"""Logs and term events as streams. The engine's own feature is the tail of a growing log; keyed streaming folds are an extension of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.operators import conflicts, logs


def tail(spark: SparkSession, path: str) -> DataFrame:
    """Log lines as they are appended in new files under a path, parsed."""
    return logs.parsed(spark.readStream.text(path))


def event_counts(rows: DataFrame, every: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per window of event time; lines that come later than ``late`` are dropped."""
    timed = rows.withColumn("at", F.to_timestamp("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", every).alias("span"), "event").agg(F.count("*").alias("n")).select("span.start", "span.end", "event", "n")


CHANGE = "source string, seq long, target string, status string, policy string, n_conflicts int"


def fold_term_events(events: DataFrame) -> DataFrame:
    """Term states as their events arrive: one row per term and batch with what changed. State is one term's history."""
    import pickle

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        term = pickle.loads(state.get[0]) if state.exists else conflicts.Term(key[0])
        seq = -1
        for e in sorted((e for f in frames for e in f.itertuples()), key=lambda e: e.seq):
            plain = lambda v: None if v is None or v != v else v
            chapter = plain(e.chapter)
            term.apply(int(e.seq), plain(e.action), plain(e.target), None if chapter is None else int(chapter), plain(e.policy))
            seq = int(e.seq)
        state.update((pickle.dumps(term),))
        row = term.row()
        yield pd.DataFrame([{"source": key[0], "seq": seq, "target": row["target"], "status": row["status"], "policy": row["policy"], "n_conflicts": len(row["conflicts"])}])

    return events.groupBy("source").applyInPandasWithState(run, CHANGE, "term binary", "update", GroupStateTimeout.NoTimeout)


def changed_only(rows: DataFrame, path: str, checkpoint: str):
    """Write a batch only if it has rows: progress that did not change is not repeated."""

    def put(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            batch.write.mode("append").json(path)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
