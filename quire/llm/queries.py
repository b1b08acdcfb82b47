"""The registered query of each training-data operator, and SQL where it can state the same."""

from __future__ import annotations

from quire.llm import chat, language, licenses, media, packing, pieces, quality, simhash, toxicity, urls

_QUERIES = [
    licenses.op1_licenses,
    pieces.op2_sentencepiece,
    quality.op3_quality,
    media.op4_transport_stream,
    packing.op5_packing,
    urls.op6_url_filter,
    simhash.op7_simhash,
    chat.op8_preferences,
    toxicity.op9_toxicity,
    language.op10_language,
]


def queries():
    return {f.__name__: f for f in _QUERIES}


def oracle_sql():
    return {"op6_url_filter": urls.OP6_SQL, "op8_preferences": chat.OP8_SQL}
