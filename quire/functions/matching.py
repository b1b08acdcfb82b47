"""Term matching on normalised text: Unicode compatibility folding, word borders, readings set between base words.

Folding has no built-in counterpart, so it runs in Arrow-batched pandas functions; where a text is known to be stable
under folding, ``borders_match`` is the built-in form.
"""

from __future__ import annotations

import re
import string
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

#: Marks that do not distinguish two translations, beside ASCII punctuation.
DECORATIVE = "。、，．！？：；・·…「」『』《》〈〉【】（）“”‘’—–～〜"
_DROPPED = frozenset(string.punctuation + DECORATIVE)
_CJK = re.compile(r"[ᄀ-ᇿ぀-ヿㇰ-ㇿ㐀-䶿一-鿿가-힯豈-﫿]")
_HAN = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_KANA_ONLY = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ]*")
_KANA = re.compile(r"[぀-ヿㇰ-ㇿｦ-ﾟ]")


def fold(text: str) -> str:
    """Compatibility form, each character lower-cased by itself."""
    return "".join(c.lower() for c in unicodedata.normalize("NFKC", text))


def signature(text: str) -> str:
    """What two translations must share to differ in form only."""
    return "".join(c for c in fold(text) if not c.isspace() and c not in _DROPPED)


_WORD = regex.compile(r"[\p{Alphabetic}\p{N}]")


def is_word(c: str) -> bool:
    """Alphabetic, which some marks are too, or a number of any kind."""
    return bool(_WORD.match(c))


def folded_match(text: str, needle: str) -> bool:
    """Whether a folded text has a folded needle: anywhere if the needle has CJK letters, else between non-word characters."""
    if not needle:
        return False
    if _CJK.search(needle):
        return needle in text or split_match(text, needle)
    at = text.find(needle)
    while at >= 0:
        end = at + len(needle)
        if not (at and is_word(text[at - 1])) and not (end < len(text) and is_word(text[end])):
            return True
        at = text.find(needle, at + 1)
    return False


def split_match(text: str, needle: str) -> bool:
    """Whether the needle is spelled by consecutive words of the text, where words of kana behind a word with Han may be skipped.

    A state is (word to read next, letters of the needle found). Each is visited once.
    """
    words, want = text.split(), "".join(needle.split())
    if len(words) < 2 or not want:
        return False
    seen: set[tuple[int, int]] = set()
    todo = []
    for i, word in enumerate(words):
        for k in range(len(word)):
            rest = word[k:]
            if rest.startswith(want):
                return True
            if want.startswith(rest):
                todo.append((i + 1, len(rest)))
    while todo:
        i, done = state = todo.pop()
        if done == len(want):
            return True
        if state in seen or i >= len(words):
            continue
        seen.add(state)
        word, left = words[i], want[done:]
        if _KANA_ONLY.fullmatch(word) and _HAN.search(words[i - 1]):
            todo.append((i + 1, done))
        if word.startswith(left):
            return True
        if left.startswith(word):
            todo.append((i + 1, done + len(word)))
    return False


def copied(source: str, target: str) -> bool:
    """Whether a translation only repeats a source that has kana."""
    return fold(source) == fold(target) and bool(_KANA.search(target))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


@F.pandas_udf(StringType())
def signed(text: pd.Series) -> pd.Series:
    return text.map(signature, na_action="ignore")


@F.pandas_udf(BooleanType())
def matches_folded(text: pd.Series, needle: pd.Series) -> pd.Series:
    """Null sides never match."""
    return pd.Series([isinstance(t, str) and isinstance(n, str) and folded_match(t, n) for t, n in zip(text, needle)])


@F.pandas_udf(ArrayType(BooleanType()))
def any_of_folded(text: pd.Series, needles: pd.Series) -> pd.Series:
    """For each needle of a list whether it matches the text."""
    return pd.Series([[isinstance(t, str) and folded_match(t, n) for n in own] for t, own in zip(text, needles)])


@F.pandas_udf(BooleanType())
def is_copied(source: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([isinstance(s, str) and isinstance(t, str) and copied(s, t) for s, t in zip(source, target)])


def borders_match(text: Column, needle: Column) -> Column:
    """The built-in form for lower-cased text and needles without CJK letters."""
    return F.rlike(text, F.concat(F.lit(r"(?<![\p{IsAlphabetic}\p{N}])\Q"), needle, F.lit(r"\E(?![\p{IsAlphabetic}\p{N}])")))


_AUTOMATA: dict[int, object] = {}


def occurring(spark, words: list[str]):
    """A function of a text column: the distinct ``words`` that occur in it as they stand, by one automaton that each worker builds once."""
    shared = spark.sparkContext.broadcast(words)
    number = shared._jbroadcast.id()

    @F.pandas_udf(ArrayType(StringType()))
    def run(text: pd.Series) -> pd.Series:
        import ahocorasick

        own = _AUTOMATA.get(number)
        if own is None:
            own = ahocorasick.Automaton()
            for w in shared.value:
                if w:
                    own.add_word(w, w)
            own.make_automaton()
            _AUTOMATA.clear()
            _AUTOMATA[number] = own
        if not len(own):
            return pd.Series([[]] * len(text))
        return text.map(lambda t: sorted({w for _, w in own.iter(t)}) if isinstance(t, str) else [])

    return run
