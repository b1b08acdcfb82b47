"""Language identification of mixed texts: script ranges, per-word scores, and Viterbi spans with a switching penalty.

A word's score under a language is its log probability under a character trigram model with marked ends, smoothed by
shorter contexts. The scripts of a word's letters limit the languages to those whose training text uses such letters.
Viterbi over the words then finds the labelling with the best total when each change of language costs ``penalty``, and
spans are its runs. All texts of a batch are decoded side by side, one word position at a time.

Bound: about ``per_lang`` training rows per language, chosen by a hash of the id, make the model, with all of their n-grams.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; words without letters join the span around
them; letters of no known script leave all languages open; rows without language or with the held-out remainder teach
nothing; without any training row every text is ``und``; equal totals go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc32_of, map_arrow, raw, table

LETTERS = re.compile(r"[^\W\d_]+")
#: First and last code points of script blocks.
SCRIPTS = [
    ("latin", 0x0041, 0x024F),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
]
CACHED, MOST_LANGS = 300_000, 1_000
UND = "und"


def script_of(letter: str) -> str | None:
    code = ord(letter)
    return next((name for name, a, b in SCRIPTS if a <= code <= b), None)


class Model:
    """Letter models of the languages. The score of a letter depends on it and the two before it, so each such window is scored once and remembered, within a bound, and a word is the sum of its windows."""

    def __init__(self, langs: list[str], counts: dict[str, dict[str, int]], scripts: dict[str, dict[str, int]]):
        self.langs, self.counts = langs, counts
        self.open = {}
        for s in {name for name, _, _ in SCRIPTS}:
            self.open[s] = np.array([scripts[x].get(s, 0) >= 0.01 * max(1, sum(scripts[x].values())) for x in langs], bool)
        self.sums = [sum(c for g, c in counts[x].items() if len(g) == 1) for x in langs]
        self._forget()

    def _forget(self) -> None:
        self.windows: dict[str, int] = {}
        self.rows = np.zeros((1024, 2 * len(self.langs)))

    def _window(self, window: str) -> int:
        """Place of a window's row: log probability of its last letter under each language, then whether the letter's script is closed to it."""
        at = len(self.windows)
        if at == len(self.rows):
            self.rows = np.concatenate((self.rows, np.zeros_like(self.rows)))
        for j, lang in enumerate(self.langs):
            counts = self.counts[lang]
            p = (counts.get(window[-1], 0) + 0.05) / (self.sums[j] + 50)
            for n in range(2, len(window) + 1):
                p = (counts.get(window[-n:], 0) + 3 * p) / (counts.get("^" + window[-n:-1], 0) + 3)
            self.rows[at, j] = np.log(p)
        script = script_of(window[-1])
        if script and self.open[script].any():
            self.rows[at, len(self.langs) :] = ~self.open[script]
        self.windows[window] = at
        return at

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities of lower-cased words under each language, the best 0 and closed ones far below; letters of each word. Words without letters score 0 everywhere."""
        letters = [w if w.isalpha() else "".join(LETTERS.findall(w)) for w in words]
        sizes = np.array([len(x) for x in letters], np.int64)
        k = len(self.langs)
        if len(self.windows) > CACHED:
            self._forget()
        known, new = self.windows, self._window
        found = []
        for x in letters:
            if x:
                m = f"\x02{x}\x03"
                found.append(known[m[:2]] if m[:2] in known else new(m[:2]))
                for i in range(3, len(m) + 1):
                    w = m[i - 3 : i]
                    at = known.get(w)
                    found.append(new(w) if at is None else at)
        total = np.zeros((len(words), k))
        own = sizes > 0
        if own.any():
            starts = np.cumsum(sizes[own] + 1) - sizes[own] - 1
            sums = np.add.reduceat(self.rows[np.array(found, np.int64)], starts, axis=0)
            closed = sums[:, k:] > 0
            closed[closed.all(axis=1)] = False
            best = np.where(closed, -np.inf, sums[:, :k]).max(axis=1, keepdims=True)
            total[own] = np.where(closed, -1000.0, np.maximum(sums[:, :k] - best, -1000.0))
        return total, sizes


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of many sequences at once. scores: words of all sequences one after another (rows) by language."""
    n, k = len(lengths), scores.shape[1]
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    live, most = lengths[order], int(lengths.max(initial=0))
    begin = starts[order]
    stay = np.zeros(scores.shape, bool)
    best = np.zeros(len(scores), np.int16)
    total = np.zeros((n, k))
    counts = np.searchsorted(-live, -np.arange(most), "left")  # sequences longer than t
    for t in range(most):
        c = counts[t]
        at = begin[:c] + t
        now = total[:c]
        if t:
            top = now.argmax(axis=1)
            lead = now[np.arange(c), top][:, None] - penalty
            best[at] = top
            stay[at] = now >= lead
            now = np.maximum(now, lead)
        total[:c] = now + scores[at]
    labels = np.zeros(len(scores), np.int16)
    state = total.argmax(axis=1) if n else np.zeros(0, int)
    for t in range(most - 1, -1, -1):
        c = counts[t]
        at = begin[:c] + t
        labels[at] = state[:c]
        if t:
            state[:c] = np.where(stay[at, state[:c]], state[:c], best[at])
    return labels


def fit(docs: DataFrame, per_lang: int = 1_500) -> Model:
    """Learn from about ``per_lang`` rows of each language whose crc32(id) mod 4 is not 2."""
    known = docs.where("lang is not null and doc_id is not null and text is not null").where(crc32_of("doc_id") % 4 != 2).select("doc_id", "lang", "text")
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().limit(MOST_LANGS + 1).collect()}
    if len(sizes) > MOST_LANGS:
        raise ValueError("lang does not look like a language")
    langs = sorted(sizes)
    # Rows are dealt by hash against their language's share of all hashes, so no sort, window or join over a language is needed.
    most = F.lit(None).cast("long")
    if langs:
        below = {x: min(2**64, per_lang * 2**64 // sizes[x]) - 2**63 - 1 for x in langs}
        most = F.try_element_at(F.create_map(*[F.lit(x) for lang in langs for x in (lang, below[lang])]), F.col("lang"))
    sample = known.where(F.xxhash64("doc_id") <= most).select("lang", "text")

    def counted(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: dict[str, Counter] = defaultdict(Counter)
        for lang, text in zip(batch.column(0).to_pylist(), raw(batch.column(1))):
            words[lang].update(LETTERS.findall(text.decode("utf-8", "replace").lower()))
        found: Counter = Counter()
        for lang, own in words.items():
            for word, c in own.items():
                marked = f"\x02{word}\x03"
                for i in range(1, len(marked)):
                    for n in (1, 2, 3):
                        if i - n + 1 >= 0:
                            found[lang, marked[i - n + 1 : i + 1]] += c
                            if n > 1:
                                found[lang, "^" + marked[i - n + 1 : i]] += c
                for letter in word:
                    if s := script_of(letter):
                        found[lang, "script:" + s] += c
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], pa.string()), pa.array([x[1] for x in keys], pa.string()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])

    total = map_arrow(sample, counted, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {x: {} for x in langs}
    scripts: dict[str, dict[str, int]] = {x: {} for x in langs}
    for r in total.collect():  # n-grams of the sample
        (scripts if r.gram.startswith("script:") else counts)[r.lang][r.gram.removeprefix("script:")] = r.n
    return Model(langs, counts, scripts)


def labelled(model: Model, texts: list[bytes | None], penalty: float) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: language, share of its letters that this language's spans hold, and spans (first word, words, language)."""
    words = [(t or b"").decode("utf-8", "replace").lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    if not model.langs or not lengths.sum():
        return [(UND, 0.0, [])] * len(texts)
    place: dict[str, int] = {}
    at = np.array([place.setdefault(w, len(place)) for own in words for w in own], np.int64)
    scores, letters = model.scores(list(place))
    labels, weight = viterbi(scores[at], lengths, penalty), letters[at]
    out, start = [], 0
    for n in lengths.tolist():
        own, w = labels[start : start + n], weight[start : start + n]
        start += n
        share = np.bincount(own, w, len(model.langs)) if n else np.zeros(1)
        if not share.sum():
            out.append((UND, 0.0, []))
            continue
        border = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1, [n]))
        spans = [(int(a), int(b - a), model.langs[own[a]]) for a, b in zip(border, border[1:])]
        top = int(share.argmax())
        out.append((model.langs[top], float(share[top] / share.sum()), spans))
    return out


def identified(docs: DataFrame, model: Model, penalty: float = 12.0, at_once: int = 2_000_000) -> DataFrame:
    """(doc_id, lang_pred, score, spans) for each row; up to about ``at_once`` bytes of text are decoded side by side."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found, texts, size = [], [], 0
        for t in [*raw(batch.column(1)), False]:
            if texts and (t is False or size > at_once):
                found += labelled(shared.value, texts, penalty)
                texts, size = [], 0
            texts.append(t)
            size += len(t or b"")
        spans = pa.array([[{"first": a, "words": n, "lang": x} for a, n, x in f[2]] for f in found], pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())])))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), spans], ["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<first: int, words: int, lang: string>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rows, schema)


def op10_language(spark, sf_dir: str) -> DataFrame:
    """Language of each row of ``documents`` and its spans (language, first word, words); defined cases as in the module's docstring."""
    docs = table(spark, sf_dir, "documents")
    found = identified(docs, fit(docs))
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["lang"], F.lit("@"), s["first"], F.lit("+"), s["words"])), ";")
    return found.select("doc_id", (F.coalesce(crc32_of("doc_id") % 4, F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"), spans.alias("spans"))
