"""Activity logs: tab-separated time, event and JSON details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines with timestamp, event and details; details that are no JSON are null, lines with fewer fields go."""
    fields = F.split(value, "\t", 3)
    df = lines.withColumn("__f", fields).where(F.size("__f") == 3)
    details = F.col("__f")[2]
    checked = F.when(F.try_parse_json(details).isNotNull(), details)
    return df.withColumns({"timestamp": F.col("__f")[0], "event": F.col("__f")[1], "details": checked}).drop("__f", value)


def newest(rows: DataFrame, order: list[str], most: int = 100) -> DataFrame:
    """The last ``most`` rows, newest first."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(most)


def projects_with_event(projects: DataFrame, rows: DataFrame, key: str, event: str) -> DataFrame:
    """Projects whose log has an event."""
    return projects.join(rows.where(F.col("event") == event).select(key).distinct(), key, "left_semi")


def log_line(timestamp, event, details):
    """One line to append."""
    return F.concat_ws("\t", timestamp, event, F.to_json(details))


def searched(segments: DataFrame, query: str) -> DataFrame:
    """Segments whose source or target holds the query, ignoring case; all for a blank one."""
    want = query.strip().lower()
    if not want:
        return segments
    return segments.where(F.contains(F.lower("source"), F.lit(want)) | F.coalesce(F.contains(F.lower("target"), F.lit(want)), F.lit(False)))
