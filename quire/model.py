"""The one user function of the workflow, a model that turns texts into texts, as a DataFrame stage.

``Mock`` answers by rule and needs no call, so it also exists as column expressions. Any object with ``complete`` can
stand in for it; it is shipped to the workers, called once per batch row, retried, and its usage is returned beside the
answer, so that usage can be summed like any fact table.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.structured import tolerant_json
from quire.functions.text import guessed_language

TRANSLATED, POLISHED, TITLED = "[mock zh-CN] ", "[mock polished zh-CN] ", "[mock title zh-CN] "


class Client(Protocol):
    """Texts of one batch to as many texts, and the tokens used. A client that sets ``wants_context`` is given the request's context (JSON) as a third argument where there is one."""

    def complete(self, task: str, texts: list[str]) -> tuple[list[str], dict[str, int]]: ...


class Mock:
    """Marks each text with its task."""

    MARKS = {"translate": TRANSLATED, "polish": POLISHED, "title": TITLED}

    def complete(self, task: str, texts: list[str]) -> tuple[list[str], dict[str, int]]:
        size = sum(map(len, texts))
        if task == "extract":  # its translations do not hold the wordings that mock_terms gives
            return ['{"terms": []}' for _ in texts], {"input_tokens": size, "output_tokens": 0}
        return [self.MARKS[task] + t for t in texts], {"input_tokens": size, "output_tokens": size}


def mock_translation(source: Column) -> Column:
    return F.concat(F.lit(TRANSLATED), source)


def mock_polish(draft: Column) -> Column:
    return F.concat(F.lit(POLISHED), draft)


def mock_title(title: Column) -> Column:
    return F.concat(F.lit(TITLED), title)


def mock_terms(source: Column) -> Column:
    """array<struct<source, target>>: what the mock finds in a text."""
    one = F.struct(F.lit("Alice").alias("source"), F.lit("爱丽丝").alias("target"))
    return F.when(F.contains(source, F.lit("Alice")), F.array(one)).otherwise(F.array().cast("array<struct<source: string, target: string>>"))


def mock_language(text: Column) -> Column:
    return guessed_language(text)


RESULT = "answers array<string>, error string, attempts int, input_tokens long, output_tokens long"


def instruction(target_language: str, source_language: str | None = None) -> str:
    """What a model is told beside the JSON of a request."""
    origin = f" from {source_language}" if source_language else ""
    return (
        f"Translate each entry of segments{origin} into {target_language}. Use the wordings of terms. recent_targets and surrounding_source only help to understand the text; "
        'never translate or repeat them. Answer with JSON alone, {"translations": [...]}, one text for each segment in their order.'
    )


class Prompted:
    """A client on top of ``send(instruction, payload)``, any function that reaches a model and gives (answer, usage)."""

    wants_context = True

    def __init__(self, send, target_language: str = "zh-CN", source_language: str | None = None):
        self.send, self.told = send, instruction(target_language, source_language)

    def complete(self, task: str, texts: list[str], context: str | None = None) -> tuple[list[str], dict[str, int]]:
        numbered = [{"number": k + 1, "source": t} for k, t in enumerate(texts)]
        payload = {"task": task, **(json.loads(context) if context else {}), "segments": numbered}
        raw, usage = self.send(self.told, json.dumps(payload, ensure_ascii=False))
        if task == "extract":
            return [raw], usage
        found = json.loads(tolerant_json(raw) or "null")
        if not isinstance(found, dict) or list(found) != ["translations"] or not all(isinstance(t, str) for t in found["translations"]):
            raise ValueError("response does not have the expected fields")
        return found["translations"], usage


def answered(client: Client, task: str, texts: list[str], retries: int, sleep=time.sleep, context: str | None = None) -> tuple[list[str] | None, str | None, int, dict[str, int]]:
    """Call until as many texts come back as went, none blank, at most ``retries`` times more, with growing pauses."""
    error, used = None, {"input_tokens": 0, "output_tokens": 0}
    for attempt in range(retries + 1):
        if attempt:
            sleep(1 << min(attempt - 1, 6))
        try:
            out, usage = client.complete(task, texts, *([context] if context is not None and getattr(client, "wants_context", False) else []))
            for k in used:
                used[k] += usage.get(k, 0)
            if len(out) != len(texts):
                error = f"{len(out)} answers; expected {len(texts)}"
            elif any(not t.strip() for t in out):
                error = "an answer is empty"
            else:
                return out, None, attempt + 1, used
        except Exception as e:  # noqa: BLE001 - any failure of a call is retried
            error = str(e)
    return None, error, retries + 1, used


def bisected(client: Client, task: str, texts: list[str], retries: int, sleep=time.sleep, context: str | None = None, total: dict[str, int] | None = None) -> list[str | None]:
    """Answers by halving batches that fail, left half first; a single text that fails is None. Tokens are added to ``total``."""
    out, _, _, used = answered(client, task, texts, retries, sleep, context)
    for k in total if total is not None else ():
        total[k] += used[k]
    if out is not None:
        return list(out)
    if len(texts) <= 1:
        return [None] * len(texts)
    half = len(texts) // 2
    return bisected(client, task, texts[:half], retries, sleep, context, total) + bisected(client, task, texts[half:], retries, sleep, context, total)


def call_model(batches: DataFrame, client: Client, task: str, texts: str = "texts", retries: int = 3, context: str | None = None) -> DataFrame:
    """``batches`` with answers, error, attempts and the tokens of all calls. A failed batch is halved until what can be answered is. ``context`` names a column of contexts."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            told = [t if isinstance(t, str) else None for t in frame[context]] if context else [None] * len(frame)
            for own, about in zip(frame[texts], told):
                out, error, attempts, used = answered(client, task, list(own), retries, context=about)
                if out is None and len(own) > 1:
                    half = len(own) // 2
                    out = [a for part in (own[:half], own[half:]) for a in bisected(client, task, list(part), 0, context=about, total=used)]
                rows.append((out, error, attempts, used["input_tokens"], used["output_tokens"]))
            yield pd.concat([frame.reset_index(drop=True), pd.DataFrame(rows, columns=["answers", "error", "attempts", "input_tokens", "output_tokens"])], axis=1)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batches.schema.fields)
    return batches.mapInPandas(run, f"{fields}, {RESULT}")
