import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import conflicts, context, export, logs, packing, progress, review, revisions, segment, terms


def greedy(lengths, budget):
    """Plain statement of the packing rule: ranges of items."""
    out, start = [], 0
    while start < len(lengths):
        end, chars = start, 0
        while end < len(lengths):
            if end > start and chars + lengths[end] > budget:
                break
            chars += lengths[end]
            end += 1
            if chars >= budget:
                break
        out.append((start, end))
        start = end
    return out


def test_packing_rule():
    assert packing.batches_of([2, 2, 4], 3) == [0, 1, 2]
    rng = random.Random(3)
    for _ in range(500):
        lengths, budget = [rng.randint(0, 6) for _ in range(rng.randint(0, 12))], rng.randint(1, 9)
        want = [i for i, (a, b) in enumerate(greedy(lengths, budget)) for _ in range(a, b)]
        assert packing.batches_of(lengths, budget) == want


def test_request_estimate():
    assert packing.pending_batches_of([3, 3, 3], [True, False, True], 1) == 2
    assert packing.pending_batches_of([0, 5], [True, True], 4) == 1  # nothing is closed before it has characters
    assert packing.pending_batches_of([], [], 4) == 0


def test_pack_frame(spark):
    rows = spark.createDataFrame([("c", i, n) for i, n in enumerate([2, 2, 4, 1])] + [("d", 0, 9)], "chapter string, ordinal int, size int")
    packed = packing.pack(rows, ["chapter"], "ordinal", "size", 4)
    assert sorted((r.chapter, r.ordinal, r.batch) for r in packed.collect()) == [("c", 0, 0), ("c", 1, 0), ("c", 2, 1), ("c", 3, 2), ("d", 0, 0)]


def test_polish_plan(spark):
    rows = spark.createDataFrame([(1, c, s, c * 3 + s != 2, c * 3 + s != 4, 5) for c in range(2) for s in range(3)], "book int, chapter int, ordinal int, drafted boolean, open boolean, size int")
    found = packing.plan_eligible(rows, ["book"], "chapter", "ordinal", "size", F.col("drafted") & F.col("open"), 1, "r")
    assert [(r.id, r.chapter, r.first_item) for r in found.orderBy("id").collect()] == [("r-b000", 0, 0), ("r-b001", 0, 1), ("r-b002", 1, 0), ("r-b003", 1, 2)]


def test_chapters_and_paragraphs(spark):
    text = "\nbefore\nChapter 1\nChapter 2\na\nb\n\n c \n第三章\n"
    docs = spark.createDataFrame([(1, text), (2, "CHAPTER ONE\n"), (3, ""), (4, None), (5, "plain\r\ntext")], "id int, text string")
    rows = segment.chapters(segment.lines(docs), ["id"], F.lit("T"))
    heads = {(r.id, r.chapter, r.chapter_title) for r in rows.collect()}
    assert heads == {(1, 0, "T"), (1, 1, "Chapter 2"), (2, 0, "CHAPTER ONE"), (5, 0, "T")}
    found = segment.paragraphs(rows, ["id"]).orderBy("id", "chapter", "paragraph").collect()
    assert [(r.id, r.chapter, r.paragraph, r.source) for r in found] == [(1, 0, 0, "before"), (1, 1, 0, "a b"), (1, 1, 1, "c"), (5, 0, 0, "plain text")]


def test_segment_ids(spark):
    rows = spark.createDataFrame([(1, 0, "t", "paragraph", p, s) for p, s in enumerate(["a", "b", " a ", "  "])], "id int, chapter int, chapter_title string, kind string, paragraph int, source string")
    found = segment.segments(rows, ["id"], ["paragraph"], 10).orderBy("ordinal").collect()
    assert [r.ordinal for r in found] == [0, 1, 2] and found[2].id == found[0].id + "-2" and found[0].chapter_id.startswith("chapter-1-")


def test_spine_grouping(spark):
    docs = spark.createDataFrame([(1, i, f"p{i}", n) for i, n in enumerate([1, 1, 0, 1, 0, 1])], "book int, pos int, path string, n_blocks int")
    starts = spark.createDataFrame([(1, "p1", "A"), (1, "p4", "empty"), (1, "p5", "B")], "book int, path string, title string")
    found = segment.grouped_by_start(docs, starts, "book").orderBy("pos").collect()
    assert [(r.path, r.chapter_title, r.chapter) for r in found] == [("p1", "A", 0), ("p2", "A", 0), ("p3", "A", 0), ("p5", "B", 1)]


def test_recent(spark):
    rows = spark.createDataFrame([(1, 0, 0, "甲乙", True), (1, 1, 0, "丙丁", True), (1, 1, 1, "x", False), (1, 1, 2, "y", True)], "b int, c int, s int, target string, ok boolean")
    found = context.recent(rows, ["b"], ["c", "s"], F.col("target"), F.col("ok"), 3).orderBy("c", "s", "recent_p").collect()
    assert [(r.c, r.s, r.recent) for r in found] == [(1, 0, "甲乙"), (1, 1, "乙"), (1, 1, "丙丁")]


def walk_back(rows, at, budget):
    out, left = [], budget
    for value in reversed(rows[:at]):
        if value is None or left == 0:
            break
        out.append(value[-left:] if len(value) > left else value)
        left = max(0, left - len(value))
    return out[::-1]


def test_recent_random(spark):
    rng = random.Random(7)
    values = [None if rng.random() < 0.15 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "b int, s int, v string")
    found = context.recent(rows, ["b"], ["s"], F.col("v"), F.col("v").isNotNull(), 7).collect()
    for at in range(60):
        own = [r.recent for r in sorted((r for r in found if r.s == at), key=lambda r: r.recent_p)]
        assert own == walk_back(values, at, 7)


def test_neighbours(spark):
    rows = spark.createDataFrame([(1, 0, "a" * 1001), (1, 1, "b"), (2, 0, "c")], "c int, s int, source string")
    found = context.neighbours(rows, ["c"], "s", "source").orderBy("c", "s").collect()
    assert [(len(r.before), r.after) for r in found] == [(0, "b"), (1000, ""), (0, "")]


TERMS = "book int, source string, target string, aliases array<string>, policy string"


def test_relevant_terms(spark):
    own = spark.createDataFrame([(1, "Mirjam", "米", ["ＭＩＲＫＡ"], None), (1, "渡口", "渡口", [], "automatic"), (1, "owl", "鸮", [], "fixed"), (1, "ヒナタ", "日", [], "automatic"), (1, "Tove", "托", [], "ignored")], TERMS)
    docs = spark.createDataFrame([(1, 1, "growled at 渡口: ヒナタが Tove, mirka"), (1, 2, None), (1, 3, "")], "book int, id int, text string")
    assert {r.source for r in terms.relevant(docs, ["book"], "id", "text", own).collect()} == {"Mirjam", "渡口", "ヒナタ"}
    shared = spark.createDataFrame([(1, "P", "p", ["Ferryman"], None), (1, "Q", "q", ["ferryman"], None)], TERMS)
    assert terms.relevant(spark.createDataFrame([(1, 1, "A FERRYMAN waited.")], "book int, id int, text string"), ["book"], "id", "text", shared).count() == 0
    assert [(r.first_source, r.second_source) for r in terms.alias_conflicts(shared, ["book"]).collect()] == [("P", "Q")]


def test_matches_equal_pairwise(spark):
    """The token join finds what comparing every pair finds."""
    from quire.functions import matching

    rng = random.Random(5)
    bits = ["cat", "con", "-", " ", "王", "都", "9", "é", "Cat", ".", "ア"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(80)]
    needles = sorted({"".join(rng.choice(bits) for _ in range(rng.randint(1, 3))) for _ in range(60)})
    own = spark.createDataFrame([(1, n, "x", [], None) for n in needles if n.strip()], TERMS)
    docs = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "book int, id int, text string")
    found = {(r.id, r.source) for r in terms.matches(docs, ["book"], "id", "text", own).collect()}
    assert found == {(i, n) for i, t in enumerate(texts) for n in needles if n.strip() and matching.folded_match(matching.fold(t), matching.fold(n))}


def test_impact(spark):
    own = spark.createDataFrame([(1, "cat", "猫", [], "fixed")], TERMS)
    titles = spark.createDataFrame([(1, "c1", "The cat", "猫"), (1, "c2", "cat", None)], "book int, chapter_id string, title string, target_title string")
    rows = [("h", "heading", " The cat "), ("p", "paragraph", "a cat"), ("q", "quote", "cat!"), ("m", "metadata", "cat"), ("x", "paragraph", "concatenate")]
    segments = spark.createDataFrame([(1, i, "c1", k, s, "t") for i, k, s in rows] + [(1, "n", "c1", "paragraph", "cat", None)], "book int, id string, chapter_id string, kind string, source string, target string")
    found = terms.impact(titles, segments, ["book"], own)
    assert {r.id for r in found.collect()} == {"title:c1", "p", "q", "m"}
    assert terms.impact_of_fixed(found, own, ["book"]).count() == 4


def base(*events):
    term = conflicts.Term("s")
    for i, e in enumerate(events):
        term.apply(i, *(list(e) + [None] * (4 - len(e))))
    return term


def test_term_conflicts():
    term = base(("insert", "渡船", 1), ("insert", "摆渡船", 2))
    assert term.status == "conflict" and term.target == "渡船" and len(term.candidates) == 2
    assert base(("insert", "a b", 1), ("insert", "《A B》", 2)).status == "ok"
    resolved = base(("insert", "a", 1), ("insert", "b", 2), ("resolve", "b"), ("insert", "c", 3))
    assert (resolved.status, resolved.target, resolved.conflicts) == ("resolved", "b", {"b": True, "c": True})
    undone = base(("insert", "a", 1), ("insert", "b", 2), ("resolve", "b"), ("insert", "c", 3), ("undo",))
    assert undone.status == "conflict" and undone.conflicts == {"b": False, "c": False, "a": False}
    loose = base(("insert", "a", 1), ("insert", "b", 2), ("insert", "c", 2), ("set_policy", None, None, "non_fixed"), ("insert", "d", 3))
    assert loose.conflicts == {"b": True, "c": True, "d": True} and loose.status == "resolved"
    assert base(("insert", "a", 1), ("set_policy", None, None, "ignored"), ("insert", "b", 2)).conflicts == {}
    gone = base(("insert", "a", 1), ("delete",), ("resolve", "x"))
    assert not gone.known and [a["action"] for a in gone.audit] == ["delete"] and gone.errors == ["term not found: s"]
    assert base(("insert", " ", 1)).errors and base(("insert", "a", 1), ("resolve", " ")).errors


def test_fold_terms(spark):
    events = spark.createDataFrame([("s", 0, "insert", "a", 1, None), ("s", 1, "insert", "b", 2, None), ("t", 5, "insert", "x", None, None), (None, 1, "insert", "a", 1, None)], conflicts.EVENT)
    found = {r.source: r for r in conflicts.fold_terms(events).collect()}
    assert found["s"].status == "conflict" and found["t"].first_chapter is None and len(found) == 2


def test_revisions(spark):
    rows = spark.createDataFrame([("p1", "d1", "c1"), ("c2", None, "c2"), (None, " ", None), ("x", "x", "y")], "p string, d string, c string")
    found = [[x.target for x in r.h] for r in rows.select(revisions.legacy_history(F.col("p"), F.col("d"), F.col("c")).alias("h")).collect()]
    assert found == [["p1", "d1", "c1"], ["c2"], [], ["x", "y"]]
    own = revisions.Segment("s")
    assert own.write("a", "translation") and not own.write("a", "polish") and own.write("b", "manual")
    assert not own.write("c", "retranslation") and own.errors and own.protected and own.write("d", "restore")
    assert [r["id"] for r in own.revisions] == [1, 2, 3] and not own.write(" ", "manual")


def test_normalized_polish(spark):
    rows = spark.createDataFrame([(False, None, "d", "pending", None), (False, "t", "d", "translated", None), (False, None, None, "pending", None), (True, "t", "d", "translated", None)], "p boolean, t string, d string, s string, ps string")
    found = [r.x.polish_status for r in rows.select(revisions.normalized_polish(*map(F.col, ["p", "t", "d", "s", "ps"])).alias("x")).collect()]
    assert found == ["pending", "succeeded", None, None]


def test_progress(spark):
    heads = spark.createDataFrame([(1, 1, "t"), (1, 2, None), (1, 3, "t")], "b int, c int, target_title string")
    rows = spark.createDataFrame([(1, 1, "translated", "x"), (1, 2, "translated", None)], "b int, c int, status string, target string")
    full = progress.chapter_status(heads, rows, ["b", "c"])
    assert [r.is_complete for r in full.orderBy("c").collect()] == [True, False, True]
    assert progress.project_progress(full, ["b"]).first().status == "translating"
    assert all(r.is_complete for r in progress.chapter_status(heads, rows, ["b", "c"], by_status_only=True).collect())
    usage = spark.createDataFrame([("a", 10, 4, 14), ("a", 8, 3, 11)], "stage string, input_tokens int, output_tokens int, total_tokens int")
    assert tuple(progress.usage_totals(usage, ["stage"], ["input_tokens", "output_tokens", "total_tokens"]).first())[1:] == (18, 7, 25)


def test_failure_streak(spark):
    rows = spark.createDataFrame([(1, i, i not in (2,)) for i in range(9)], "k int, i int, bad boolean")
    assert progress.failure_streak(rows, ["k"], "i", F.col("bad")).first().first_break == 7


def test_review(spark):
    rows = spark.createDataFrame([("c", "s1", "cat", None), ("c", "s2", "same", "same"), ("c", "s3", "Concat cat", "x")], "chapter_id string, id string, source string, target string")
    own = spark.createDataFrame([("cat", "猫")], "source string, target string")
    found = review.untranslated(rows, []).unionByName(review.terminology(rows, own, []))
    kept = review.report(found, [])
    assert {(r.segment_id, r.issue_type, r.severity) for r in kept.collect()} == {("s1", "untranslated", "critical"), ("s1", "terminology", "major"), ("s2", "untranslated", "major"), ("s3", "terminology", "major")}


def test_export(spark):
    rows = spark.createDataFrame([(1, 0, "第一章", 0, "paragraph", "Hello", "你好"), (1, 1, "空", None, None, None, None)], "b int, chapter int, title string, ordinal int, kind string, source string, target string")
    assert export.plain_text(rows, ["b"]).first().text == "第一章\n\n你好\n\n\n空\n"
    assert export.plain_text(rows, ["b"], bilingual=True, source_first=True).first().text == "第一章\n\nHello\n你好\n\n\n空\n"
    heads = spark.createDataFrame([(1, 0, 0, "heading", "T", "T"), (1, 0, 1, "heading", "T", "T"), (1, 0, 2, "paragraph", "T", "T")], "b int, chapter int, ordinal int, kind string, target string, target_title string")
    assert [r.ordinal for r in export.without_title(heads, ["b", "chapter"], "ordinal").orderBy("ordinal").collect()] == [1, 2]
    merged = export.merged_targets(spark.createDataFrame([(1, 1, "b !"), (1, 0, "a,")], "b int, o int, target string"), ["b"], "o")
    assert merged.first().target == "a，b！"


def test_alignment(spark):
    originals = spark.createDataFrame([(1, 0, "aa. bb."), (1, 1, "cc")], "d int, paragraph int, source string")
    good = spark.createDataFrame([(1, 0, "aa."), (1, 1, " "), (1, 2, "bb."), (1, 3, "cc")], "d int, ordinal int, source string")
    assert all(r.ok for r in export.aligned(originals, good, ["d"], 4).collect())
    short = good.where("ordinal <> 3")
    assert [r.place for r in export.aligned(originals, short, ["d"], 4).where("not ok").collect()] == [2]
    with pytest.raises(Exception, match="differ in number"):
        spark.range(1).select(export.zipped(F.array(F.lit(1)), F.array(F.lit(1), F.lit(2)))).collect()


def test_logs(spark):
    rows = spark.createDataFrame([('2026-01-01\tstart\t{"a":1}',), ("2026-01-02\tend\t{x",), ("short\tline",), ("",)], "value string")
    assert [(r.timestamp, r.event, r.details) for r in logs.newest(logs.parsed(rows), ["timestamp"]).collect()] == [("2026-01-02", "end", None), ("2026-01-01", "start", '{"a":1}')]


def test_queue_and_upserts(spark):
    rows = spark.createDataFrame([(1, 1, "put"), (1, 2, "done"), (2, 1, "put"), (2, 3, "put")], "k int, t int, action string")
    assert [(r.k, r.t) for r in conflicts.queue(rows, ["k"], "t").collect()] == [(2, 3)]
    held = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(map(tuple, conflicts.inserted_if_new(held, new, ["k"]).collect())) == [(1, "a"), (2, "c")]


def test_model_calls(spark):
    from quire import model

    class Flaky:
        """Fails on batches that hold "bad", and answers too few once."""

        def __init__(self):
            self.calls = 0

        def complete(self, task, texts):
            self.calls += 1
            if self.calls == 1:
                return [], {}
            if "bad" in texts and len(texts) > 1:
                raise ValueError("refused")
            return [t.upper() for t in texts], {"input_tokens": 1}

    out, error, attempts, used = model.answered(Flaky(), "t", ["a"], 2, sleep=lambda s: None)
    assert (out, error, attempts, used["input_tokens"]) == (["A"], None, 2, 1)
    assert model.bisected(Flaky(), "t", ["a", "bad", "c"], 1, sleep=lambda s: None) == ["A", "BAD", "C"]
    rows = spark.createDataFrame([(1, ["x", "y"])], "id int, texts array<string>")
    found = model.call_model(rows, model.Mock(), "translate").first()
    assert list(found.answers) == ["[mock zh-CN] x", "[mock zh-CN] y"] and found.input_tokens == 2


def test_failed_batches_are_halved_and_counted(spark):
    from quire import model

    class Strict(model.Mock):
        """Refuses batches that hold "bad", after it has used tokens on none."""

        def complete(self, task, texts):
            if "bad" in texts:
                raise ValueError("refused")
            return super().complete(task, texts)

    rows = spark.createDataFrame([(1, ["aa", "bad", "c", "dd"]), (2, [])], "id int, texts array<string>")
    found = {r.id: r for r in model.call_model(rows, Strict(), "translate", retries=0).collect()}
    assert list(found[1].answers) == ["[mock zh-CN] aa", None, "[mock zh-CN] c", "[mock zh-CN] dd"] and found[1].input_tokens == 5
    assert list(found[2].answers) == []


def test_contexts(spark):
    """Terms, neighbours and earlier translations up to the first gap; batches without them have empty arrays."""
    from quire.operators import prompts

    rows = spark.createDataFrame(
        [("b", 1, 0, "s0", "Cold harbour", "T0", "translated", None), ("b", 1, 1, "s1", "the Gull cried", None, "pending", 0), ("b", 1, 2, "s2", "alone", None, "pending", 1), ("b", 2, 0, "s3", "far", None, "pending", 0)],
        "book string, chapter int, ordinal int, id string, source string, target string, status string, batch int",
    )
    own = spark.createDataFrame([("gull", "鸥", [], "fixed"), ("cried", "叫", [], "ignored"), ("far", None, None, None)], "source string, target string, aliases array<string>, policy string")
    found = {(r.chapter, r.batch): json.loads(r.context) for r in prompts.contexts(rows, ["book"], ["chapter"], "ordinal", own, style=F.lit("x")).collect()}
    assert found[1, 0] == {"style": "x", "terms": [{"source": "gull", "target": "鸥"}], "recent_targets": [{"segment_id": "s0", "target": "T0"}], "surrounding_source": {"before": "Cold harbour", "after": "alone"}}
    assert found[1, 1] == {"style": "x", "terms": [], "recent_targets": [], "surrounding_source": {"before": "the Gull cried", "after": ""}}
    assert found[2, 0] == {"style": "x", "terms": [{"source": "far"}], "recent_targets": []}
    assert prompts.contexts(rows.where("false"), ["book"], ["chapter"], "ordinal", own).count() == 0
