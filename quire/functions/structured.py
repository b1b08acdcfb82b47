"""Tolerant JSON, validation of model responses, JSON objects as maps, and differences of two versions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quire.functions.text import is_blank

_FENCE = re.compile(r"```[^\n]*\n(.*?)```", re.S)


def candidates(raw: str) -> list[str]:
    """Texts that may be the JSON of a response: all of it, a fenced block, the outermost object, the outermost array."""
    text = raw.strip()
    found = [text]
    if m := _FENCE.search(text):
        found.append(m.group(1).strip())
    for first, last in ("{}", "[]"):
        a, b = text.find(first), text.rfind(last)
        if 0 <= a < b:
            found.append(text[a : b + 1].strip())
    return found


def mended(text: str) -> str:
    """Without commas before a closing bracket, and with double quotes where there were only single ones."""
    out = text.replace(",}", "}").replace(",]", "]")
    return out if '"' in text else out.replace("'", '"')


def tolerant_json(raw: str | None) -> str | None:
    """The first candidate, then mended candidate, that parses, as compact JSON; null if none does."""
    found = candidates(raw) if raw is not None else []
    for text in [*found, *map(mended, found)]:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def parsed_json(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: tolerant_json(x) if isinstance(x, str) else None)


def translations_of(raw: Column, expected: Column) -> Column:
    """(translations, error) of a response: an error unless it has exactly the field and ``expected`` texts, none blank."""
    good = parsed_json(raw)
    parsed = F.from_json(good, "translations array<string>")["translations"]
    other = F.size(F.json_object_keys(good)) != 1
    blank = F.exists(parsed, is_blank)
    error = (
        F.when(good.isNull(), F.lit("response is not valid JSON"))
        .when(parsed.isNull() | F.coalesce(other, F.lit(True)), F.lit("response does not have the expected fields"))
        .when(F.size(parsed) != expected, F.concat(F.lit("response has "), F.size(parsed), F.lit(" translations; expected "), expected))
        .when(blank, F.concat(F.lit("translation "), F.array_position(F.transform(parsed, is_blank), F.lit(True)) - 1, F.lit(" is empty")))
    )
    return F.struct(F.when(error.isNull(), parsed).alias("translations"), error.alias("error"))


def json_put(obj: Column, key: Column, value: Column) -> Column:
    """A JSON object of texts with one entry set."""
    own = F.coalesce(F.from_json(obj, "map<string,string>"), F.create_map().cast("map<string,string>"))
    return F.to_json(F.map_concat(F.map_filter(own, lambda k, _: k != key), F.create_map(key, value)))


def json_drop(obj: Column, key: Column) -> Column:
    return F.to_json(F.map_filter(F.from_json(obj, "map<string,string>"), lambda k, _: k != key))


def prompt_json(segments: Column, previous: Column, following: Column) -> Column:
    """The payload of a translation request; surroundings are left out where there are none."""
    around = F.when(F.coalesce(previous, following).isNotNull(), F.struct(previous.alias("previous"), following.alias("next")))
    return F.to_json(F.struct(segments.alias("segments"), around.alias("surrounding_source")))


def changed(value: str | None, other: str | None) -> tuple[str, str, str]:
    """Common beginning, own middle and common end of a text against another."""
    a, b = list(value or ""), list(other or "")
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    return "".join(a[:head]), "".join(a[head : len(a) - tail]), "".join(a[len(a) - tail :])


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("before", "changed", "after")]))
def difference(value: pd.Series, other: pd.Series) -> pd.DataFrame:
    rows = [changed(*(x if isinstance(x, str) else None for x in pair)) for pair in zip(value, other)]
    return pd.DataFrame(rows, columns=["before", "changed", "after"])
