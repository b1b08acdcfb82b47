"""The term base as an event log: upserts, decisions and deletions are folded per term, in order.

What an event does depends on all events of its term before it, so the fold is a grouped map keyed by term. The tables
that follow from the fold (terms, rules, evidence, candidates, conflicts, audit) are plain DataFrames.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.matching import signature

EVENT = "source string, seq long, action string, target string, chapter int, policy string"
STATE = (
    "source string, target string, status string, policy string, manual_target string, first_chapter int, deleted boolean, "
    "evidence array<struct<seq: long, target: string, chapter: int>>, candidates array<struct<target: string, chapter: int>>, "
    "conflicts array<struct<target: string, resolved: boolean>>, audit array<struct<action: string, details: string>>, errors array<string>"
)


class Term:
    """One term of the base; ``apply`` is the meaning of one event."""

    def __init__(self, source: str):
        self.source = source
        self.audit: list[dict] = []
        self.errors: list[str] = []
        self._empty()

    def _empty(self) -> None:
        self.target = self.manual = self.first = None
        self.status, self.policy, self.known = "ok", "automatic", False
        self.evidence: list[dict] = []
        self.candidates: list[dict] = []
        self.conflicts: dict[str, bool] = {}  # target -> resolved, in order of arrival

    def apply(self, seq: int, action: str, target: str | None, chapter: int | None, policy: str | None) -> None:
        if action == "insert":
            self._insert(seq, target, chapter)
        elif action not in ("resolve", "set_policy", "undo", "delete"):
            self.errors.append(f"unknown action: {action}")
        elif action == "resolve" and not (target or "").strip():
            self.errors.append("term source and resolved target must not be empty")
        elif not self.known:
            self.errors.append(f"term not found: {self.source}")
        elif action == "resolve":
            self._log("modify_resolution" if self.policy == "fixed" else "resolve", target=target)
            self.target, self.status, self.policy, self.manual = target, "resolved", "fixed", target
            self.conflicts = dict.fromkeys(self.conflicts, True)
        elif action == "delete":
            self._empty()
            self._log("delete")
        else:
            self._decide("automatic" if action == "undo" else policy)

    def _log(self, action: str, **details: str) -> None:
        self.audit.append({"action": action, "details": json.dumps(details, ensure_ascii=False, sort_keys=True)})

    def _insert(self, seq: int, target: str | None, chapter: int | None) -> None:
        if not self.source.strip() or not (target or "").strip():
            self.errors.append("term source and target must not be empty")
            return
        if self.policy == "ignored":
            return
        seen = {"seq": seq, "target": target, "chapter": chapter}
        if not self.known:
            self.known, self.target, self.first = True, target, chapter
            self.evidence.append(seen)
            return
        held = self.first
        self.first = chapter if self.first is None else self.first if chapter is None else min(self.first, chapter)
        self.evidence.append(seen)
        if signature(self.target) == signature(target):
            return
        for own in ({"target": self.target, "chapter": held}, {"target": target, "chapter": chapter}):
            if own not in self.candidates:
                self.candidates.append(own)
        self.conflicts.setdefault(target, False)
        if self.policy in ("fixed", "non_fixed"):
            self.conflicts[target] = True
        else:
            self.status = "conflict"

    def _decide(self, policy: str | None) -> None:
        if policy not in ("automatic", "fixed", "non_fixed", "ignored"):
            self.errors.append(f"unknown policy: {policy}")
            return
        self.policy, self.manual = policy, self.target if policy == "fixed" else None
        if policy == "automatic":
            # Every conflict opens again, with those that evidence shows; wordings are compared as they stand.
            for seen in self.evidence:
                if seen["target"] != self.target:
                    self.conflicts.setdefault(seen["target"], False)
            self.conflicts = dict.fromkeys(self.conflicts, False)
            self.status = "conflict" if self.conflicts else "ok"
        else:
            self.conflicts = dict.fromkeys(self.conflicts, True)
            self.status = "resolved"
        self._log(policy)

    def row(self) -> dict:
        return {
            "source": self.source, "target": self.target, "status": self.status if self.known else None, "policy": self.policy, "manual_target": self.manual, "first_chapter": self.first, "deleted": not self.known,
            "evidence": self.evidence, "candidates": self.candidates, "conflicts": [{"target": t, "resolved": r} for t, r in self.conflicts.items()], "audit": self.audit, "errors": self.errors,
        }


def _plain(value):
    return None if value is None or value is pd.NA or (isinstance(value, float) and value != value) else value


def fold_terms(events: DataFrame) -> DataFrame:
    """STATE of each term after its events (EVENT), in order of seq. A term's events are one group, whose size is that of its history."""

    def run(key, own: pd.DataFrame) -> pd.DataFrame:
        term = Term(key[0])
        for e in own.sort_values("seq").itertuples():
            chapter = _plain(e.chapter)
            term.apply(int(e.seq), _plain(e.action), _plain(e.target), None if chapter is None else int(chapter), _plain(e.policy))
        out = pd.DataFrame([term.row()])
        out["first_chapter"] = out["first_chapter"].astype("Int32")
        return out

    return events.where("source is not null").groupBy("source").applyInPandas(run, STATE)


def open_candidates(terms: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates of terms in conflict."""
    return candidates.join(terms.where("status = 'conflict'").select("source"), "source", "left_semi")


def evidence_against(terms: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence whose wording is not the term's target as it stands."""
    own = terms.select("source", F.col("target").alias("__target"))
    return evidence.join(own, "source").where("target <> __target").drop("__target")


def conflict_counts(conflicts: DataFrame) -> DataFrame:
    """(source, unresolved, resolved) of conflict events."""
    return conflicts.groupBy("source").agg(F.count_if(~F.col("resolved")).alias("unresolved"), F.count_if("resolved").alias("resolved"))


def conflict_candidates(evidence: DataFrame, order: str = "id") -> DataFrame:
    """(source, target, candidate, occurrences, chapters): wordings in the order in which evidence shows them first, with their chapters in such order."""
    by_chapter = evidence.groupBy("source", "target", "chapter").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    chapters = F.transform(F.sort_array(F.collect_list(F.struct("first", "chapter"))), lambda x: x["chapter"])
    found = by_chapter.groupBy("source", "target").agg(F.sum("n").alias("occurrences"), F.min("first").alias("first"), chapters.alias("chapters"))
    return found.withColumn("candidate", F.row_number().over(Window.partitionBy("source").orderBy("first")) - 1).drop("first")


def top_evidence(evidence: DataFrame, order: str = "id", most: int = 3) -> DataFrame:
    """The first ``most`` pieces of evidence for each wording."""
    own = Window.partitionBy("source", "target").orderBy(order)
    return evidence.withColumn("place", F.row_number().over(own)).where(F.col("place") <= most)


def conflict_details(terms: DataFrame, conflicts: DataFrame, evidence: DataFrame, include_resolved: bool = False) -> DataFrame:
    """One row per term with conflict events: its target, policy, counts of events and its candidates; the target itself where there is no evidence."""
    shown = conflicts if include_resolved else conflicts.where("not resolved")
    counts = conflict_counts(shown)
    one = F.struct("candidate", "target", "occurrences", "chapters")
    found = conflict_candidates(evidence).groupBy("source").agg(F.sort_array(F.collect_list(one)).alias("candidates"))
    kind = found.schema["candidates"].dataType
    only = F.array(F.struct(F.lit(0).alias("candidate"), F.col("target"), F.lit(1).cast("long").alias("occurrences"), F.array("first_chapter").alias("chapters"))).cast(kind)
    return terms.join(counts, "source").join(found, "source", "left").withColumn("candidates", F.coalesce("candidates", only))


def migrated(terms: DataFrame, candidates: DataFrame, evidence: DataFrame, rules: DataFrame, conflicts: DataFrame) -> dict[str, DataFrame]:
    """Tables of an older base brought up to date: rules of resolved terms, evidence of terms and candidates without any, conflict events, and status."""
    new_rules = terms.where("status = 'resolved'").select("source", F.lit("fixed").alias("policy"), F.col("target").alias("manual_target")).join(rules, "source", "left_anti")
    rules = rules.select("source", "policy", "manual_target").unionByName(new_rules)
    first = terms.join(evidence, "source", "left_anti").select("source", "target", F.col("first_chapter").alias("chapter"))
    shown = evidence.select("source", "target", "chapter").unionByName(first)
    shown = shown.unionByName(candidates.select("source", "target", "chapter").join(shown, ["source", "target", "chapter"], "left_anti"))
    state = terms.select("source", F.col("target").alias("__target"), "status")
    other = candidates.join(state, "source").where("target <> __target and status in ('conflict', 'resolved')")
    added = other.select("source", "target", (F.col("status") == "resolved").alias("resolved")).distinct().join(conflicts, ["source", "target"], "left_anti")
    events = conflicts.select("source", "target", "resolved").unionByName(added)
    still = events.where("not resolved").select("source").distinct().withColumn("__open", F.lit(True))
    settled = terms.join(still, "source", "left").withColumn("status", F.when((F.col("status") == "conflict") & F.col("__open").isNull(), "ok").otherwise(F.col("status"))).drop("__open")
    return {"terms": settled, "rules": rules, "evidence": shown, "conflicts": events}


def without_terms(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without the rows of deleted terms; the audit log keeps its rows."""
    return {name: df if name == "audit" else df.join(gone.select("source"), "source", "left_anti") for name, df in tables.items()}


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: keyed replacement, rule upserts, newest by time."""
    own = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(own)).where("__n = 1").drop("__n")


def inserted_if_new(held: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``held`` with those of ``rows`` whose key it does not have, each key once."""
    return held.unionByName(rows.dropDuplicates(keys).join(held, keys, "left_anti").select(held.columns))


def queue(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What is left of a work queue: the last put of each key that no completion follows."""
    return latest(events, keys, order).where("action = 'put'")
