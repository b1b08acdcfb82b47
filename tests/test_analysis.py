import json

from pyspark.sql import functions as F

from quire.operators import analysis
from quire.sources import state


def client():
    class Answers:
        """Names a language by letter, returns terms for extraction, blanks one digest."""

        def complete(self, task, texts):
            if task == "language":
                return ["JA " if "あ" in t else "en" for t in texts], {}
            if task == "extract":
                terms = [{"source": "Alice", "target": "爱丽丝", "type": "person"}, {"source": "Nobody", "target": "无", "type": "person"}, {"source": "Alice", "target": "爱丽丝", "type": "animal"}]
                return [json.dumps({"terms": terms}) for _ in texts], {}
            return ["" if "quiet" in t else t.upper() for t in texts], {}

    return Answers()


def test_samples_and_language(spark):
    rows = spark.createDataFrame([(1, 0, "heading", "TITLE"), (1, 1, "paragraph", "あ" * 50), (1, 2, "quote", " "), (2, 0, "heading", "Only")], "book int, ordinal int, kind string, source string")
    assert {r.book: r.joined for r in analysis.language_text(rows, ["book"], ["ordinal"]).collect()} == {1: "あ" * 50, 2: "Only"}
    assert {r.book: r.choice for r in analysis.detected_languages(rows, ["book"], ["ordinal"], client(), retries=0).collect()} == {1: "ja", 2: "en"}
    assert analysis.book_samples(rows, ["book"], ["ordinal"]).where("book = 2").first().samples == ["Only"]


def test_digests_are_reused(spark):
    rows = spark.createDataFrame([("c1", "words"), ("c2", "quiet")], "chapter string, sample string")
    none = spark.createDataFrame([], "chapter string, digest_of string")
    first = analysis.digests(rows, none, ["chapter"], client(), retries=0)
    assert {r.chapter: r.digest for r in first.collect()} == {"c1": "WORDS", "c2": "quiet"}
    again = analysis.digests(rows, first, ["chapter"], client(), retries=0)
    assert again.count() == 0 and analysis.digests(rows, first, ["chapter"], client(), force=True, retries=0).count() == 2


def test_extraction(spark):
    pairs = spark.createDataFrame([("c", "Alice went", "爱丽丝 去了"), ("d", "Bob", "鲍勃")], "chapter string, source_text string, target_text string")
    found = analysis.extractions(pairs, client(), ["chapter"], retries=0)
    assert [(r.chapter, r.source, r.target) for r in found.collect()] == [("c", "Alice", "爱丽丝")]
    events = analysis.as_events(found, F.lit(1).cast("long"), F.lit(0))
    assert events.columns == ["source", "seq", "action", "target", "chapter", "policy"]


def test_pending_places(spark):
    queue = spark.createDataFrame([("c", "s0|s2"), ("c", "__chapter__"), ("c", "zz"), ("gone", "s0")], "chapter_id string, batch_key string")
    rows = spark.createDataFrame([("c", f"s{i}", i) for i in range(4)], "chapter_id string, id string, ordinal int")
    found = {(r.chapter_id, r.batch_key): r.before for r in analysis.pending_places(queue, rows).collect()}
    assert found == {("c", "s0|s2"): 3, ("c", "__chapter__"): 4, ("c", "zz"): 0, ("gone", "s0"): None}


def test_small_checks(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"s{i}", "failed" if i % 2 else "translated") for i in range(60)], "k int, id string, status string")
    assert analysis.failed_first(rows, ["id"]).count() == 20
    spans = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (1, 9, 12)], "d int, first int, last int")
    assert [(r.first, r.last) for r in analysis.overlapping(spans, ["d"]).collect()] == [(0, 5)]
    own = state.Options(max_batch_chars=7, source_language="ja")
    state.write_options(own, str(tmp_path / "o.toml"))
    assert state.read_options((tmp_path / "o.toml").read_text()) == own
    style = spark.createDataFrame([("p", "g", "t", "n", "x", "r", "d", " ", ["a"]), ("q", "g", "t", "n", "x", "r", "d", "z", ["a", ""]), ("ok", "g", "t", "n", "x", "r", "d", "z", ["a"])], "project_id string, genre string, tone string, narration string, pacing string, register string, dialogue_style string, rhetoric string, style_guide array<string>")
    assert {r.project_id: r.error for r in state.analysis_errors(style).collect()} == {"p": "rhetoric is empty", "q": "a style rule is empty"}
    projects = spark.createDataFrame([("1", "2026"), ("2", "2027")], "id string, updated_at string")
    logs = spark.createDataFrame([("1", "analysis_completed")], "project_id string, event string")
    covers = spark.createDataFrame([("2", "data:x")], "project_id string, url string")
    assert [(r.id, r.initialized, r.cover) for r in state.project_list(projects, logs, covers).collect()] == [("2", False, "data:x"), ("1", True, None)]
