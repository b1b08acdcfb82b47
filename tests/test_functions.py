import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import hashing, markup, matching, punctuation, structured, text


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr.alias("x")).first().x


def chunked(value, most):
    """Plain statement of the chunk rule."""
    out, rest = [], value
    while rest:
        if len(rest) <= most:
            cut = len(rest)
        else:
            cut = max((i + 1 for i in range(most) if rest[i] in text.SENTENCE_END), default=most)
        if rest[:cut].strip():
            out.append(rest[:cut].strip())
        rest = rest[cut:]
    return out


def test_split_long(spark):
    found = one(spark, "Rain fell. Nobody spoke! 灯灭了。再见", text.split_long("v", 14))
    assert found == ["Rain fell.", "Nobody spoke!", "灯灭了。再见"]
    rng = random.Random(1)
    values = ["".join(rng.choice("ab .!\n。") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.split_long("v", 7).alias("x")).collect()
    assert all(list(r.x) == chunked(r.v, 7) for r in rows)


def test_headings(spark):
    cases = {"第四十章 渡口": True, "第六节": True, "Chapter 31": True, "chapter seven": True, "BOOK NINE": True, "Book Nine": False, "BOOK; NINE": False, "渡口": False, "Q" * 81: False, "77": False, "": False}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", text.is_heading("v").alias("x")).collect()
    assert {r.v: r.x for r in rows} == cases


def test_samples(spark):
    assert one(spark, "0123456789ABCDEFG", text.samples("v", 3, 3)) == ["012", "789", "EFG"]
    assert one(spark, "kurz", text.samples("v", 9, 3)) == ["kurz"]
    assert one(spark, "zzzzzzzzz", text.samples("v", 2, 3)) == ["zz"]
    assert one(spark, "0123456789ABCDEFG", text.sampled_text("v", 9)) == "012\n…\n789\n…\nEFG"


def test_small_text_functions(spark):
    assert one(spark, "  a\t\u3000b \n", text.collapse_space("v")) == "a b"
    assert one(spark, "\u3000x\t", text.strip("v")) == "x"
    assert one(spark, " JA ", text.language_code("v")) == "ja" and one(spark, "jpn", text.language_code("v")) is None
    assert one(spark, "dc:Title", text.local_name("v")) == "title"
    assert one(spark, r"C:\a\b.txt", text.file_name("v")) == "b.txt"
    assert one(spark, "a+b%20c", text.percent_decoded("v")) == "a+b c"
    assert one(spark, "abcdef", text.truncated("v", 3)) == "abc…" and one(spark, "abc", text.truncated("v", 3)) == "abc"
    assert one(spark, "ひら", text.guessed_language("v")) == "ja" and one(spark, "漢", text.guessed_language("v")) == "zh" and one(spark, "x", text.guessed_language("v")) == "en"
    assert one(spark, "<p>a</p>b>c<i", text.stripped_markup("v")) == "abc"
    assert one(spark, "…TASK:POLISH…", text.stage_of("v")) == "polish" and one(spark, "x", text.stage_of("v")) == "translation"
    assert one(spark, "abcx", text.shared_prefix(F.col("v"), F.lit("abcy"))) == 3
    assert one(spark, "x", hashing.percent(F.lit(1), F.lit(8))) == 13 and one(spark, "x", hashing.percent(F.lit(0), F.lit(0))) == 0
    assert one(spark, "x", hashing.duration_label(F.lit(120_000))) == "2 分钟" and one(spark, "x", hashing.duration_label(F.lit(61_400))) == "1 分 1 秒"
    assert one(spark, "x", hashing.backoff_seconds(F.lit(9))) == 64


def test_matching():
    m = lambda hay, needle: matching.folded_match(matching.fold(hay), matching.fold(needle))
    assert m("「港の 灯 とう 台 だい 守」", "港の灯台守") and not m("港に灯台守がいた", "港の灯台守")
    assert m("An owl hooted", "OWL") and not m("Growled", "owl") and m("ＭＩＲＫＯ?", "mirko") and not m("y", "")
    assert matching.signature("灯塔") == matching.signature("《灯塔》") and matching.signature("渡船") == matching.signature("渡船—")
    assert matching.signature("灯塔") != matching.signature("灯塔守")
    assert matching.copied("ひまわり", "ひまわり") and not matching.copied("音楽", "音楽")


def brute_split(text_, needle):
    """All ways to read the needle off consecutive words, by recursion."""
    words, want = text_.split(), "".join(needle.split())

    def on(i, left):
        if not left:
            return True
        if i >= len(words):
            return False
        w = words[i]
        if i and matching._KANA_ONLY.fullmatch(w) and matching._HAN.search(words[i - 1]) and on(i + 1, left):
            return True
        return here(i, w, left)

    def here(i, w, left):
        return w.startswith(left) or (left.startswith(w) and on(i + 1, left[len(w) :]))

    return len(words) > 1 and bool(want) and any(here(i, w[k:], want) for i, w in enumerate(words) for k in range(len(w)))


@settings(max_examples=300, deadline=None)
@given(st.text("灯台とだ の", max_size=14), st.text("灯台とだ の", min_size=1, max_size=5))
def test_split_match(value, needle):
    assert matching.split_match(value, needle) == brute_split(value, needle)


def test_borders_match(spark):
    for hay, want in (("an owl hooted", True), ("growled", False), ("owl", True), ("owl7", False), ("forêt-owl.", True)):
        assert one(spark, hay, text.F.lit(True) & matching.borders_match(F.col("v"), F.lit("owl"))) == want


def test_full_width():
    assert punctuation.full_width("渡口 ! left; http://q.r/s?t -- ... `n;m!` end") == "渡口！ left； http://q.r/s?t——…… `n;m!` end"
    assert punctuation.full_width("q.. r. s....t `never, closed") == "q.. r. s……t `never, closed"
    assert punctuation.full_width("") == ""


def test_tolerant_json():
    ok = '{"rows":[4,"k"]}'
    for raw in (ok, f"here ```json\n{ok}\n``` there", f"Of course: {ok} and so on", "{'rows': [4, 'k',],}", '{"rows": [4, "k",]}'):
        assert structured.tolerant_json(raw) == ok
    assert structured.tolerant_json('{"m": "o\'clock"}') == '{"m":"o\'clock"}'
    assert structured.tolerant_json("no object") is None and structured.tolerant_json(None) is None


def test_json_objects(spark):
    assert one(spark, '{"a":"1"}', structured.json_put(F.col("v"), F.lit("b"), F.lit("2"))) == '{"a":"1","b":"2"}'
    assert one(spark, '{"a":"1","b":"2"}', structured.json_drop(F.col("v"), F.lit("a"))) == '{"b":"2"}'
    assert one(spark, "x", structured.prompt_json(F.array("v"), F.lit(None).cast("string"), F.lit(None).cast("string"))) == '{"segments":["x"]}'


def test_changed():
    assert structured.changed("left 🐢 right", "left 🐬 right") == ("left ", "🐢", " right")
    assert structured.changed("oo", "o") == ("o", "o", "") and structured.changed("", "x") == ("", "", "") and structured.changed(None, None) == ("", "", "")


def test_blocks():
    assert markup.blocks("<p>Tide <i>tables</i>, 1902.</p>") == [(0, "paragraph", "Tide tables, 1902.")]
    assert markup.blocks("<body><h3>Harbour</h3><blockquote>Low water</blockquote><li>rope</li><pre/></body>") == [(0, "heading", "Harbour"), (1, "quote", "Low water"), (2, "paragraph", "rope")]
    assert markup.blocks("<p>salt&lt;sugar</p><p><![CDATA[5 > 4]]></p>") == [(0, "paragraph", "salt<sugar"), (1, "paragraph", "5 > 4")]
    assert markup.blocks("<p>one<u>two</p>\n\nthree & four") == [(0, "paragraph", "onetwo"), (1, "paragraph", "three & four")]


def test_replace_keeps_tags():
    old = '<html><body><p id="a">One <b>two</b></p><p>x</p></body></html>'
    new = markup.replaced(old, {0: "Eins & zwei"})
    assert new == '<html><body><p id="a">Eins &amp; zwei<b></b></p><p>x</p></body></html>'
    both = markup.replaced(old, {0: "Eins"}, originals=True)
    assert '</p><p data-source="true">One two</p><p>x</p>' in both
    assert markup.replaced(old, {}) == old


def test_paths_and_links():
    assert markup.joined_path("pkg/parts", "../harbour/tide.xhtml") == "pkg/harbour/tide.xhtml"
    docs = {"t/a.xhtml": '<p id="x"><a href="b.xhtml#y">1</a><a href="#x">2</a><a href="http://h/">3</a><a href="c.png">4</a></p>', "t/b.xhtml": "<p>z</p>"}
    assert markup.dangling(docs, {"t/c.png"}) == [("t/a.xhtml", "b.xhtml#y")]
    assert markup.anchors('<p id="x"/><a name="y">z</a><p id="x"/>') == ["x", "y", "x"]
    assert "vertical-rl" in markup.with_layout("<html><body/></html>", "vertical") and markup.with_layout("<html/>", "preserve") == "<html/>"
