"""Project state: JSON documents of projects and chapters, configuration, and idempotent writes.

Writes go through Spark's commit protocol: a partition is replaced whole, or not at all.
"""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.conflicts import latest

PROJECT = "id string, source_file string, source_path string, source_language string, status string, chapters_total long, chapters_completed long, created_at string, updated_at string"
SEGMENT = "id string, ordinal int, source string, target string, target_before_polish string, polish_status string, kind string, status string, source_hash string, meta string"
CHAPTER = f"project_id string, id string, title string, target_title string, status string, meta string, segments array<struct<{SEGMENT.replace(' string', ': string').replace(' int', ': int')}>>"


def read_projects(spark: SparkSession, path: str) -> DataFrame:
    """Every readable project document under a path; others are skipped. Newest first is up to the reader."""
    return spark.read.schema(PROJECT).option("mode", "DROPMALFORMED").option("multiLine", "true").option("pathGlobFilter", "project.json").option("recursiveFileLookup", "true").json(path).where("id is not null")


def read_chapters(spark: SparkSession, path: str) -> DataFrame:
    """Chapters with their place: the number in the id, those without one last."""
    rows = spark.read.schema(CHAPTER).json(path)
    return rows.withColumn("place", F.coalesce(F.regexp_extract("id", r"^chapter-(\d{1,18})", 1).try_cast("long"), F.lit(9_223_372_036_854_775_807)))


def segments_of(chapters: DataFrame) -> DataFrame:
    return chapters.select("project_id", F.col("id").alias("chapter_id"), "place", F.explode("segments").alias("s")).select("project_id", "chapter_id", "place", "s.*")


def write_chapters(chapters: DataFrame, path: str) -> None:
    """Chapter documents, a folder per project; only the folders of projects in ``chapters`` are replaced."""
    chapters.drop("place").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").json(path)


def initialized(held: DataFrame, projects: DataFrame) -> DataFrame:
    """Projects that are new by content: importing the same book again changes nothing."""
    return projects.dropDuplicates(["id"]).join(held.select("id"), "id", "left_anti")


def by_id(projects: DataFrame, project_id: str) -> DataFrame:
    """The project of a content hash (64 hex digits)."""
    if len(project_id) != 64 or not all(c in "0123456789abcdef" for c in project_id):
        raise ValueError("a project id is 64 hex digits")
    return projects.where(F.col("id") == project_id)


def by_path(projects: DataFrame, path: str) -> DataFrame:
    """The project that was updated last among those of a source path."""
    return latest(projects.where(F.col("source_path") == path), ["source_path"], "updated_at")


def checked_snapshot(chapters: DataFrame, sources: DataFrame, projects: DataFrame) -> DataFrame:
    """Chapters for export; raises where the source's hash is not the project's, or chapters are missing."""
    counts = chapters.groupBy("project_id").agg(F.count("*").alias("__n"))
    own = projects.select(F.col("id").alias("project_id"), "chapters_total").join(counts, "project_id", "left").join(sources.select(F.col("project_id"), F.sha2("content", 256).alias("__hash")), "project_id", "left")
    bad = F.when(~F.col("__hash").eqNullSafe(F.col("project_id")), "source differs from the project").when(~F.col("__n").eqNullSafe(F.col("chapters_total")), "chapters are missing")
    own = own.select("project_id", F.when(bad.isNotNull(), F.raise_error(F.concat(bad, F.lit(": "), "project_id")).cast("boolean")).otherwise(F.lit(True)).alias("__ok"))
    return chapters.join(own, "project_id").where("__ok").drop("__ok")


ANALYSIS = ["genre", "tone", "narration", "pacing", "register", "dialogue_style", "rhetoric"]


def analysis_errors(analyses: DataFrame) -> DataFrame:
    """(project_id, error) of style analyses with a blank field, or without style rules, or with a blank rule."""
    from quire.functions.text import is_blank

    error = F.lit(None).cast("string")
    for name in reversed(ANALYSIS):
        error = F.when(is_blank(name), f"{name} is empty").otherwise(error)
    rules = F.when(F.coalesce(F.size("style_guide"), F.lit(0)) < 1, "style guide is empty").when(F.exists("style_guide", is_blank), "a style rule is empty")
    return analyses.select("project_id", F.coalesce(error, rules).alias("error")).where("error is not null")


@dataclass(frozen=True)
class Options:
    """What a workflow run is set to."""

    source_language: str | None = None
    target_language: str = "zh-CN"
    max_segment_chars: int = 1200
    max_batch_chars: int = 1800
    recent_context_chars: int = 2000
    translate_concurrency: int = 3
    retranslate_concurrency: int = 3
    polish_concurrency: int = 3
    polish: bool = False
    max_retries: int = 3
    timeout_seconds: int = 60
    extra: dict = field(default_factory=dict, compare=False)

    def checked(self) -> Options:
        for name in ("max_segment_chars", "max_batch_chars", "translate_concurrency", "retranslate_concurrency", "polish_concurrency", "timeout_seconds"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be positive")
        if self.recent_context_chars < 0 or self.max_retries < 0:
            raise ValueError("budgets and retries must not be negative")
        return self


def read_options(text: str) -> Options:
    """Options of a TOML document; groups are flattened, unknown keys are kept aside."""
    flat: dict = {}
    for key, value in tomllib.loads(text).items():
        flat |= value if isinstance(value, dict) else {key: value}
    known = {f.name for f in fields(Options)} - {"extra"}
    return replace(Options(**{k: v for k, v in flat.items() if k in known}), extra={k: v for k, v in flat.items() if k not in known}).checked()


def write_options(options: Options, path: str) -> None:
    """Options as a TOML document on the driver's own disk; unknown keys that were read are not kept."""
    lines = []
    for f in fields(Options):
        value = getattr(options, f.name)
        if f.name != "extra" and value is not None:
            lines.append(f"{f.name} = {str(value).lower() if isinstance(value, bool) else value if isinstance(value, int) else json.dumps(value)}")
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines) + "\n")


def project_list(projects: DataFrame, logs: DataFrame, covers: DataFrame) -> DataFrame:
    """Projects, the last updated first, with whether their analysis was completed and their cover's data URL."""
    ready = logs.where("event = 'analysis_completed'").select(F.col("project_id").alias("id")).distinct().withColumn("__ready", F.lit(True))
    art = covers.select(F.col("project_id").alias("id"), F.col("url").alias("cover"))
    found = projects.join(ready, "id", "left").join(art, "id", "left")
    return found.withColumn("initialized", F.coalesce("__ready", F.lit(False))).drop("__ready").orderBy(F.desc("updated_at"), "id")
