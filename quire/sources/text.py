"""Plain-text books: strict UTF-8 files to lines, chapters and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import segment

FALLBACK_CHARS = 2000


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, project_id, title, text): every .txt file under a path. A leading byte-order mark goes; bytes that are no UTF-8 raise an error that names the file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[tT][xX][tT]").option("recursiveFileLookup", "true").load(path)
    content = F.when(F.substring("content", 1, 3) == F.unhex(F.lit("EFBBBF")), F.substring("content", 4, 2_147_483_647)).otherwise(F.col("content"))
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), F.col("path"))).cast("string"))
    title = F.regexp_replace(F.regexp_extract("path", r"[^/\\]*$", 0), r"\.[^.]*$", "")
    return files.select("path", F.sha2("content", 256).alias("project_id"), F.url_decode(title).alias("title"), text.alias("text"))


def segments(files: DataFrame, most: int = 1200) -> DataFrame:
    """Segments of books (project_id, title, text); a budget of zero means the fallback."""
    rows = segment.chapters(segment.lines(files.select("project_id", "title", "text")), ["project_id", "title"], F.col("title"))
    found = segment.paragraphs(rows, ["project_id", "title"]).withColumn("kind", F.lit("paragraph"))
    return segment.segments(found, ["project_id", "title"], ["paragraph"], most or FALLBACK_CHARS)


def read_books(spark: SparkSession, path: str, most: int = 1200) -> DataFrame:
    return segments(read_files(spark, path), most)


def write_texts(rows: DataFrame, path: str) -> None:
    """(name, text) as files named by name: one file a row, through Spark's writer, which commits whole partitions or nothing."""
    rows.select("name", "text").write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)
