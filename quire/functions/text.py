"""String and Unicode expressions. All are built-in column expressions, so they stay inside code generation.

``length`` counts code points. White space means Unicode white space, which the built-in ``trim`` does not strip.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code point ranges that the matching rules name.
CJK = r"ᄀ-ᇿ぀-ヿㇰ-ㇿ㐀-䶿一-鿿가-힯豈-﫿"
HAN = r"㐀-䶿一-鿿豈-﫿"
KANA = r"぀-ヿㇰ-ㇿｦ-ﾟ"
SENTENCE_END = ".!?。！？\n"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def is_blank(c: str | Column) -> Column:
    """Null or nothing but white space."""
    return F.coalesce(~_col(c).rlike(r"(?U)\S"), F.lit(True))


def collapse_space(c: str | Column) -> Column:
    """Runs of white space become one space; ends are stripped."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def split_long(c: str | Column, most: int) -> Column:
    """Chunks of at most ``most`` characters: cut behind the last sentence end or line end within reach, else at ``most``; stripped, blanks dropped."""
    if most < 1:
        raise ValueError("most must be positive")
    pattern = rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}}[.!?。！？\n]|.{{1,{most}}}"
    found = F.regexp_extract_all(_col(c), F.lit(pattern), F.lit(0))
    return F.filter(F.transform(found, strip), lambda x: x != "")


def is_heading(c: str | Column) -> Column:
    """A chapter heading: a numbered chapter or section in Chinese, a line that begins with "chapter ", or a short line of capitals without sentence marks."""
    line = _col(c)
    numbered = line.startswith("第") & (line.contains("章") | line.contains("节"))
    capitals = (F.length(line) <= 80) & line.rlike(r"\p{IsUppercase}") & ~line.rlike(r"[\p{IsAlphabetic}&&[^\p{IsUppercase}]]") & ~line.rlike("[.,;。，；]")
    return numbered | line.rlike("^(?i)chapter ") | capitals


def truncated(c: str | Column, most: int) -> Column:
    """At most ``most`` characters, an ellipsis behind what was cut."""
    return F.when(F.length(_col(c)) > most, F.concat(F.left(_col(c), F.lit(most)), F.lit("…"))).otherwise(_col(c))


def has_cjk(c: str | Column) -> Column:
    return _col(c).rlike(f"[{CJK}]")


def has_han(c: str | Column) -> Column:
    return _col(c).rlike(f"[{HAN}]")


def has_kana(c: str | Column) -> Column:
    return _col(c).rlike(f"[{KANA}]")


def guessed_language(c: str | Column) -> Column:
    """ja where there is kana, else zh where there is Han, else en."""
    return F.when(_col(c).rlike(r"[぀-ヿ]"), "ja").when(_col(c).rlike(r"[一-鿿]"), "zh").otherwise("en")


def language_code(c: str | Column) -> Column:
    """A two-letter code, trimmed and lower-cased; null if it is none."""
    code = F.lower(strip(c))
    return F.when(code.rlike("^[a-z]{2}$"), code)


def local_name(c: str | Column) -> Column:
    """An XML name without its prefix, lower-cased."""
    return F.lower(F.substring_index(_col(c), ":", -1))


def file_name(c: str | Column) -> Column:
    return F.regexp_extract(_col(c), r"[^/\\]*$", 0)


def percent_decoded(c: str | Column) -> Column:
    """URI escapes decoded; a plus sign stays one."""
    return F.url_decode(F.replace(_col(c), F.lit("+"), F.lit("%2B")))


def issue_id(chapter: Column, segment: Column, kind: Column) -> Column:
    return F.lower(F.concat_ws(":", chapter, segment, kind))


def term_state(policy: Column, status: Column) -> Column:
    """The label shown for a term: policy before status."""
    return F.when(policy == "ignored", "ignored").when(policy == "non_fixed", "non_fixed").when(status == "conflict", "conflict").when(status == "resolved", "resolved").otherwise("normal")


#: What a system prompt holds, and its stage.
STAGES = [
    ("checking whether an LLM connection", "model_verification"),
    ("language identification", "language_identification"),
    ("TASK:BOOK_STYLE_ANALYSIS", "book_style_analysis"),
    ("TASK:CHAPTER_DIGEST", "chapter_digest"),
    ("TASK:BOOK_SYNOPSIS", "book_synopsis"),
    ("TASK:TERM_EXTRACTION", "term_extraction"),
    ("TASK:POLISH", "polish"),
    ("TASK:TITLE_TRANSLATION", "title_translation"),
]


def stage_of(prompt: str | Column) -> Column:
    """The stage whose mark a system prompt contains, the first that fits, else translation."""
    out = F.lit("translation")
    for mark, label in reversed(STAGES):
        out = F.when(_col(prompt).contains(mark), label).otherwise(out)
    return out


def words(c: str | Column) -> Column:
    """How many white-space separated words."""
    return F.size(F.filter(F.split(_col(c), r"(?U)\s+"), lambda w: w != ""))


def stripped_markup(c: str | Column) -> Column:
    """Text without anything between angle brackets; an open one runs to the end, and a bare closing one goes as well."""
    return F.replace(F.regexp_replace(_col(c), r"(?s)<[^>]*(?:>|\z)", ""), F.lit(">"), F.lit(""))


def samples(c: str | Column, size: int, count: int) -> Column:
    """``count`` windows of ``size`` characters at equal distances; a window equal to the one before it is dropped; a shorter text is its only window."""
    text = _col(c)
    last = F.length(text) - size
    at = [F.floor(last * i / max(1, count - 1)).cast("int") for i in range(count)]
    many = F.array(*[F.substring(text, a + 1, F.lit(size)) for a in at])
    apart = F.filter(many, lambda x, i: (i == 0) | (x != F.get(many, i - 1)))
    return F.when(last <= 0, F.array(text)).otherwise(apart)


def sampled_text(c: str | Column, most: int) -> Column:
    """The text if it is short enough, else three samples of a third of ``most`` joined by an ellipsis line."""
    return F.when(F.length(_col(c)) <= most, _col(c)).otherwise(F.array_join(samples(c, most // 3, 3), "\n…\n"))


def shared_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common beginning, in code points."""
    size = F.least(F.length(a), F.length(b))
    differs = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    return F.when(size == 0, 0).otherwise(F.coalesce(F.get(differs, F.lit(0)) - 1, size))
