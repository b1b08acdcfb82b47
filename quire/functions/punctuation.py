"""Full-width punctuation for Chinese translations; code in back-quotes and URLs stay as they are."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Marks and their full-width forms.
FULL_WIDTH = {",": "，", ";": "；", ":": "：", "!": "！", "?": "？"}
# Kept whole: back-quoted code up to the next back-quote or the end, URLs up to white space, one or two full stops.
_TOKEN = re.compile(r"(?P<keep>`[^`]*(?:`|\Z)|(?:https?://|www\.)\S*)|(?P<dots>\.+)|(?P<dash>--)|(?P<mark>[,;:!?])", re.S)


def full_width(text: str) -> str:
    """Marks become full-width, three or more stops an ellipsis, two hyphens a dash; white space before any of them goes."""
    out, at = "", 0
    for m in _TOKEN.finditer(text):
        out += text[at : m.start()]
        at = m.end()
        own = m.group()
        if m.lastgroup == "keep" or (m.lastgroup == "dots" and len(own) < 3):
            out += own
        else:
            out = out.rstrip() + ("……" if m.lastgroup == "dots" else "——" if m.lastgroup == "dash" else FULL_WIDTH[own])
    return out + text[at:]


@F.pandas_udf(StringType())
def normalized(text: pd.Series) -> pd.Series:
    return text.map(full_width, na_action="ignore")
