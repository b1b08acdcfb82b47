"""Content hashes, ids, times and back-off."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import collapse_space


def content_hash(c: Column) -> Column:
    """SHA-256 of text or bytes, lower-case hex."""
    return F.sha2(c, 256)


def chapter_id(index: Column, title: Column) -> Column:
    """``index`` counts from zero."""
    return F.concat(F.lit("chapter-"), (index + 1).cast("string"), F.lit("-"), content_hash(title))


def segment_base(chapter: Column, kind: Column, source: Column) -> Column:
    """The id of a segment before repeats are numbered; kinds enter with a capital initial."""
    return F.concat(F.lit("seg-"), content_hash(F.concat(chapter, F.initcap(kind), collapse_space(source))))


def rfc3339(ts: Column) -> Column:
    """UTC with milliseconds, for a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def run_id(prefix: str, ts: Column) -> Column:
    return F.concat(F.lit(prefix + "-"), F.date_format(ts, "yyyyMMdd'T'HHmmss.SSS'Z'"))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "MM-dd HH:mm:ss")


def duration_label(ms: Column) -> Column:
    """Whole seconds below a minute, else minutes, with seconds where there are any."""
    seconds = F.greatest(F.lit(0), F.floor(ms / 1000 + 0.5))
    minutes, rest = F.floor(seconds / 60), seconds % 60
    return F.when(seconds < 60, F.concat(seconds, F.lit(" 秒"))).when(rest == 0, F.concat(minutes, F.lit(" 分钟"))).otherwise(F.concat(minutes, F.lit(" 分 "), rest, F.lit(" 秒")))


def backoff_seconds(attempt: Column) -> Column:
    """1, 2, 4, ... at most 64."""
    return F.call_function("shiftleft", F.lit(1), F.least(attempt, F.lit(6)).cast("int"))


def percent(done: Column, total: Column) -> Column:
    """Whole percent, halves up; a total of zero counts as one."""
    return F.floor(done / F.greatest(total, F.lit(1)) * 100 + 0.5).cast("long")


def remaining(elapsed: Column, done: Column, left: Column) -> Column:
    """Time left at the pace so far; null before anything is done."""
    return F.when(done > 0, elapsed / done * left)


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content))
