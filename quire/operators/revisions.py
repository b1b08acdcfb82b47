"""Histories of translated segments: revisions, protected edits, optimistic checks and older projects."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from quire.functions.text import is_blank, strip

MANUAL = ("manual", "restore", "adopt")
AUTOMATIC = ("translation", "polish", "retranslation")


def is_protected(meta: str | Column) -> Column:
    """Whether a segment was edited by hand."""
    return F.coalesce(F.get_json_object(meta, "$.translation_protected") == "true", F.lit(False))


def open_segment(target: str = "target", draft: str = "draft") -> Column:
    """Neither translated nor drafted."""
    return F.col(target).isNull() & F.col(draft).isNull()


def complete(status: str = "status", target: str = "target") -> Column:
    return F.coalesce((F.col(status) == "translated") & F.col(target).isNotNull(), F.lit(False))


def polish_eligible(protected: Column, polish_status: Column, draft: Column) -> Column:
    """Not edited by hand, not polished yet, and with a draft."""
    return ~F.coalesce(protected, F.lit(False)) & (F.coalesce(polish_status, F.lit("")) != "succeeded") & ~is_blank(draft)


def legacy_history(previous: Column, draft: Column, current: Column) -> Column:
    """array<struct<id, target, kind>>: the texts that an older project kept, without blanks and repeats, the current one last."""

    def other(c: Column) -> Column:
        return F.when(~is_blank(c) & ~c.eqNullSafe(current), c)

    kept = F.array(
        F.struct(other(previous).alias("target"), F.lit("legacy_previous").alias("kind")),
        F.struct(F.when(~other(draft).eqNullSafe(other(previous)), other(draft)).alias("target"), F.lit("legacy_draft").alias("kind")),
        F.struct(F.when(~is_blank(current), current).alias("target"), F.lit("legacy").alias("kind")),
    )
    rows = F.filter(kept, lambda x: x["target"].isNotNull())
    return F.transform(rows, lambda x, i: F.struct((i + 1).alias("id"), x["target"].alias("target"), x["kind"].alias("kind")))


def current_revisions(revisions: DataFrame, keys: list[str]) -> DataFrame:
    """The last revision of each segment."""
    return revisions.groupBy(*keys).agg(F.max("id").alias("id"), F.max_by("target", "id").alias("target"))


def current_id(history: Column) -> Column:
    return F.coalesce(F.element_at(F.when(F.size(history) > 0, history), -1)["id"], F.lit(0))


def accepted_edits(edits: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Edits whose expected revision and text are the current ones."""
    held = current.select(*keys, F.col("id").alias("expected_revision"), F.col("target").alias("expected_target"))
    return edits.join(held, [*keys, "expected_revision", "expected_target"], "left_semi")


STATE = "segment_id string, target string, previous_target string, draft string, protected boolean, polish_status string, revisions array<struct<id: int, target: string, kind: string, model: string>>, errors array<string>"


class Segment:
    """The text of one segment under a sequence of writes."""

    def __init__(self, segment_id: str):
        self.segment_id, self.target, self.previous, self.draft, self.protected, self.polish = segment_id, None, None, None, False, None
        self.revisions: list[dict] = []
        self.errors: list[str] = []

    def write(self, target: str | None, kind: str, model: str | None = None) -> bool:
        """Whether the write made a revision. Blank texts are refused, and automatic ones where a hand has edited; an equal text changes nothing."""
        if not (target or "").strip():
            self.errors.append("translation must not be empty")
        elif target == self.target:
            return False
        elif self.protected and kind in AUTOMATIC:
            self.errors.append("segment was edited by hand")
        else:
            self.revisions.append({"id": (self.revisions[-1]["id"] if self.revisions else 0) + 1, "target": target, "kind": kind, "model": model})
            self.previous, self.target = self.target, target
            if kind in MANUAL:
                self.protected, self.draft, self.polish = True, target, None
            return True
        return False

    def row(self) -> dict:
        return {"segment_id": self.segment_id, "target": self.target, "previous_target": self.previous, "draft": self.draft, "protected": self.protected, "polish_status": self.polish, "revisions": self.revisions, "errors": self.errors}


def fold_writes(writes: DataFrame) -> DataFrame:
    """STATE of each segment after its writes (segment_id, seq, target, kind, model) in order of seq; kind restore_previous swaps the last two texts."""

    def run(key, own: pd.DataFrame) -> pd.DataFrame:
        segment = Segment(key[0])
        for w in own.sort_values("seq").itertuples():
            target = w.target if isinstance(w.target, str) else None
            kind, model = w.kind, w.model if isinstance(w.model, str) else None
            if kind == "restore_previous":
                target, kind = segment.previous, "restore"
                if target is None:
                    segment.errors.append("no earlier translation")
                    continue
            segment.write(target, kind, model)
        return pd.DataFrame([segment.row()])

    return writes.groupBy("segment_id").applyInPandas(run, STATE)


REWRITTEN = StructType([StructField(c, BooleanType() if c == "changed" else StringType()) for c in ("target", "draft", "polish_status", "meta", "changed", "error")])
#: Keys of a segment's metadata that are fixed by the format of project files.
HISTORY, HAND, BEFORE, PREVIEW, FAILED = "translation_revisions", "translation_protected", "previous_target", "retranslation_preview", "retranslation_error"


def held(meta: str | None) -> dict:
    """Metadata as a dict; what is no object counts as empty."""
    try:
        found = json.loads(meta or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def versions(target: str | None, draft: str | None, meta: dict) -> list[dict]:
    """The revisions of a segment, oldest first; of one without a history, the different texts that it still has (``legacy_history`` for one row)."""
    if HISTORY in meta:
        return list(meta[HISTORY])
    texts = {}
    for text, kind in ((meta.get(BEFORE), "legacy_previous"), (draft, "legacy_draft"), (target, "legacy")):
        if isinstance(text, str) and text.strip() and (text != target or kind == "legacy"):
            texts.setdefault(text, kind)
    return [{"id": k + 1, "target": text, "kind": kind, "model": None} for k, (text, kind) in enumerate(texts.items())]


def rewrite(target: str | None, draft: str | None, polish_status: str | None, meta: str | None, new: str | None, kind: str, model: str | None = None) -> dict:
    """One write to a segment that keeps its history in its metadata (REWRITTEN). A refused write leaves all as it was but for the error."""
    own = held(meta)
    segment = Segment("")
    segment.target, segment.draft, segment.polish, segment.protected = target, draft, polish_status, own.get(HAND) is True
    segment.revisions = versions(target, draft, own)
    changed = segment.write(new, kind, model)
    if changed:
        segment.revisions[-1]["created_at"] = datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        own |= {HISTORY: segment.revisions} | ({} if target is None else {BEFORE: target}) | ({HAND: True} if segment.protected else {})
        own.pop(PREVIEW, None)
        own.pop(FAILED, None)
        if kind == "retranslation":  # the new text is a draft that is to be polished
            segment.draft, segment.polish = new, "pending"
    error = segment.errors[0] if segment.errors else None
    return {"target": segment.target, "draft": segment.draft, "polish_status": segment.polish, "meta": json.dumps(own, ensure_ascii=False) if changed else meta, "changed": changed, "error": error}


@F.pandas_udf(REWRITTEN)
def rewritten(target: pd.Series, draft: pd.Series, polish_status: pd.Series, meta: pd.Series, new: pd.Series, kind: pd.Series) -> pd.DataFrame:
    """``rewrite`` of columns. Rows whose ``kind`` is null stay as they are; those whose ``new`` is null keep their text and are marked as failed."""
    rows = []
    for old, own, state, about, text, what in zip(*[c.where(c.notna(), None) for c in (target, draft, polish_status, meta, new, kind)]):
        row = {"target": old, "draft": own, "polish_status": state, "meta": about, "changed": False, "error": None}
        if what is not None:
            row = row | {"error": "no answer"} if text is None else rewrite(old, own, state, about, text, what)
            if row["error"]:
                row["meta"] = json.dumps(held(about) | {FAILED: row["error"]}, ensure_ascii=False)
        rows.append(row)
    return pd.DataFrame(rows, columns=["target", "draft", "polish_status", "meta", "changed", "error"])


def normalized_polish(protected: Column, target: Column, draft: Column, status: Column, polish_status: Column) -> Column:
    """struct<target, status, polish_status> of segments of an older project."""
    touched = ~F.coalesce(protected, F.lit(False)) & ~is_blank(draft)
    bare = touched & target.isNull()
    return F.struct(
        F.when(bare, draft).otherwise(target).alias("target"),
        F.when(bare, "translated").otherwise(status).alias("status"),
        F.when(touched & polish_status.isNull(), F.when(target.isNull(), "pending").otherwise("succeeded")).otherwise(polish_status).alias("polish_status"),
    )


def synced_headings(segments: DataFrame, titles: DataFrame, keys: list[str]) -> DataFrame:
    """Headings that equal their chapter's title, with the title's translation as target.

    segments: (keys, id, kind, source); titles: (keys, title, target_title).
    """
    named = titles.select(*keys, strip("title").alias("__title"), "target_title")
    heads = segments.where("kind = 'heading'").withColumn("__title", strip("source"))
    return heads.join(named, [*keys, "__title"]).withColumn("target", F.col("target_title")).drop("__title", "target_title")


def applied_batches(segments: DataFrame, results: DataFrame) -> DataFrame:
    """Segments after polish results (segment_id, ok, text): protected ones stay; a success sets target and status, a failure marks what has not succeeded."""
    df = segments.join(results.select(F.col("segment_id"), F.col("ok").alias("__ok"), F.col("text").alias("__text")), "segment_id", "left")
    free = ~F.coalesce("protected", F.lit(False)) & F.col("__ok").isNotNull()
    target = F.when(free & F.col("__ok"), F.col("__text")).otherwise(F.col("target"))
    status = F.when(free & F.col("__ok"), "succeeded").when(free & (F.coalesce("polish_status", F.lit("")) != "succeeded"), "failed").otherwise(F.col("polish_status"))
    return df.withColumns({"target": target, "polish_status": status}).drop("__ok", "__text")


def resumed(batches: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Job states when a round goes on: what was running is pending again, and so is what failed, if asked for."""
    again = ["running", "failed"] if retry_failed else ["running"]
    return batches.withColumn("status", F.when(F.col("status").isin(again), "pending").otherwise(F.col("status")))
