import json

import pytest
from test_sources import make_book

from quire.__main__ import parser, run
from quire.model import Mock, Prompted
from quire.operators import conflicts, revisions
from quire.sources import epub
from quire.sources.state import Options
from quire.workflow import Workflow


def test_text_book_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tale.txt").write_text("Chapter 1\nHello, world!\n\nBye.\nChapter 2\nMirjam came.\n")
    own = Workflow(spark, str(tmp_path / "state"))
    (project,) = own.add(str(tmp_path / "in"))
    assert own.add(str(tmp_path / "in")) == [project] and own.projects().count() == 1
    with pytest.raises(ValueError, match="title is not translated"):
        own.export(project)
    assert own.translate(project, 0) == 1
    assert [(r.translated, r.total) for r in own.status(project).collect()] == [(2, 2), (0, 1)]
    assert own.translate(project) == 0 and own.projects().first().status == "translated"
    text = bytes(own.export(project).first().content).decode()
    assert text == "[mock title zh-CN] Chapter 1\n\n[mock zh-CN] Hello， world！\n\n[mock zh-CN] Bye.\n\n\n[mock title zh-CN] Chapter 2\n\n[mock zh-CN] Mirjam came.\n"
    assert own.polish(project) == 0
    assert own.segments(project).where("polish_status = 'succeeded' and target like '[mock polished%'").count() == 3
    own.record_terms(spark.createDataFrame([("Mirjam", 0, "insert", "米里", 1, None), ("Mirjam", 1, "insert", "迷铃", 1, None)], conflicts.EVENT))
    assert own.terms().first().status == "conflict"
    own.resolve("Mirjam", "迷铃")
    assert own.terms().first().target == "迷铃"
    _, issues = own.review(project)
    assert [r.issue_type for r in issues.collect()] == ["terminology"]
    args = parser().parse_args(["--state", str(tmp_path / "state"), "export", project, str(tmp_path / "o.epub"), "--format", "epub", "--bilingual"])
    assert run(args, spark) == 0
    book = epub.parse((tmp_path / "o.epub").read_bytes())
    assert [b["source"] for b in book["chapters"][1]["blocks"]][1:] == ["[mock polished zh-CN] [mock zh-CN] Mirjam came.", "Mirjam came."]
    assert run(parser().parse_args(["--state", str(tmp_path / "state"), "status", project]), spark) == 0


def test_archive_book_and_partial_failure(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.epub").write_bytes(make_book())

    class Picky(Mock):
        """Refuses texts that hold "Second"; defined here, so that workers need not import this file."""

        def complete(self, task, texts):
            if any("Second" in t for t in texts):
                raise ValueError("refused")
            return super().complete(task, texts)

    own = Workflow(spark, str(tmp_path / "state"), client=Picky(), options=Options(max_retries=0))
    (project,) = own.add(str(tmp_path / "in"))
    assert own.segments(project).count() == 4 and own.translate(project) == 1
    assert own.projects().first().status == "translating"


def test_failed_save_keeps_the_old_table(spark, tmp_path):
    """A write that fails midway, or is cut off before its commit, leaves the projects as they were."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "tide.txt").write_text("Chapter 1\nLow water.\n")
    own = Workflow(spark, str(tmp_path / "state"))
    (project,) = own.add(str(tmp_path / "in"))
    before = own.projects().collect()
    broken = own.projects().selectExpr("*", "raise_error('lost') as x")
    with pytest.raises(Exception, match="lost"):
        own._replace("projects", broken)
    (tmp_path / "state" / "projects" / "99999999999999999999").mkdir()
    assert own.projects().collect() == before and len(own._versions("projects")) == 1
    own.delete(project)
    assert own.projects().count() == 0


def teller(mark="v1"):
    """A client that answers with what it was told: the number of its terms, the last earlier translation, and its neighbours."""

    def send(told, payload):
        own = json.loads(payload)
        if own["task"] == "extract":
            return json.dumps({"terms": [{"source": "heron", "target": "鹭", "type": "term"}]}), {}
        if any("refuse" in s["source"] for s in own["segments"]) and mark != "v1":
            raise ValueError("refused")
        about = f"{len(own.get('terms', []))}{mark}" + "".join(r["target"][-1:] for r in own.get("recent_targets", []))
        return "Sure:\n" + json.dumps({"translations": [f"{about} {s['source']} 鹭" for s in own["segments"]]}), {"input_tokens": 1}

    return Prompted(send)


def test_retranslation_and_edits(spark, tmp_path):
    """Contexts reach the client; a term's contents are translated anew, failures and edits by hand stay; edits are checked."""
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "pond.txt").write_text("Chapter 1\nThe heron slept.\n\nNobody came.\nChapter 2\nA heron, refuse me.\nChapter heron\nHis heron left.\n")
    options = Options(max_retries=0, max_batch_chars=20)
    own = Workflow(spark, str(tmp_path / "state"), teller(), options)
    (project,) = own.add(str(tmp_path / "in"))
    assert own.translate(project) == 0
    rows = {r.source: r for r in own.segments(project).collect()}
    assert rows["The heron slept."].target == "0v1 The heron slept. 鹭"
    assert own.extract(project) >= 3 and own.extract(project) == 0
    assert [(r.source, r.target) for r in own.terms().collect()] == [("heron", "鹭")]
    held = own.detail(project, rows["His heron left."].id)
    assert held["revision"] == 1 and [r["kind"] for r in held["revisions"]] == ["legacy"]
    with pytest.raises(ValueError, match="changed meanwhile"):
        own.save(project, held["segment"]["id"], 1, "something else", "mine")
    with pytest.raises(ValueError, match="must not be empty"):
        own.save(project, held["segment"]["id"], 1, held["segment"]["target"], " ")
    mine = own.save(project, held["segment"]["id"], 1, held["segment"]["target"], "mine")
    assert mine["revision"] == 2 and revisions.held(mine["segment"]["meta"])["translation_protected"] is True
    again = Workflow(spark, str(tmp_path / "state"), teller("v2"), options)
    assert again.retranslate(project, "heron") == 2  # one refused, one edited by hand
    new = {r.source: r for r in again.segments(project).collect()}
    first = new["The heron slept."]
    assert first.target == "1v2 The heron slept. 鹭" and first.target_before_polish == first.target and first.polish_status == "pending"
    assert [r["kind"] for r in again.detail(project, first.id)["revisions"]] == ["legacy", "retranslation"]
    assert new["Nobody came."].target == rows["Nobody came."].target
    refused = new["A heron, refuse me."]
    assert refused.target == rows["A heron, refuse me."].target and json.loads(refused.meta)["retranslation_error"] == "no answer"
    assert new["His heron left."].target == "mine" and "by hand" in json.loads(new["His heron left."].meta)["retranslation_error"]
    titles = {r.title: r.target_title for r in again.chapters(project).collect()}
    assert "v2" in titles["Chapter heron"] and "v1" in titles["Chapter 1"]
    seen = again.preview(project, held["segment"]["id"])["preview"]
    with pytest.raises(ValueError, match="suggestion"):
        again.save(project, held["segment"]["id"], 2, "mine", adopt="other")
    taken = again.save(project, held["segment"]["id"], 2, "mine", adopt=seen["id"])
    assert taken["segment"]["target"] == seen["target"] and taken["preview"] is None and taken["revision"] == 3
    back = again.save(project, held["segment"]["id"], 3, seen["target"], restore=2)
    assert back["segment"]["target"] == "mine" and [r["kind"] for r in back["revisions"]] == ["legacy", "manual", "adopt", "restore"]
    files, path = again._at(f"locks/{project}")
    assert files.createNewFile(path)
    with pytest.raises(ValueError, match="in use"):
        again.retranslate(project, "heron")
    again.unlock(project)
    assert run(parser().parse_args(["--state", str(tmp_path / "state"), "segment", project, first.id]), spark) == 0


def test_rewrite_keeps_what_it_does_not_know():
    """Odd metadata, equal texts and refused writes."""
    new = revisions.rewrite("a", "d", None, '{"x": [1], "previous_target": "p"}', "b", "polish")
    assert [(r["id"], r["target"], r["kind"]) for r in json.loads(new["meta"])["translation_revisions"]] == [(1, "p", "legacy_previous"), (2, "d", "legacy_draft"), (3, "a", "legacy"), (4, "b", "polish")]
    assert json.loads(new["meta"])["x"] == [1] and json.loads(new["meta"])["previous_target"] == "a"
    for meta in (None, "", "[1]", "{broken"):
        assert revisions.rewrite("a", None, None, meta, "a", "manual") == {"target": "a", "draft": None, "polish_status": None, "meta": meta, "changed": False, "error": None}
        assert revisions.rewrite(None, None, None, meta, "n", "translation")["changed"]
    held = revisions.rewrite("a", None, "succeeded", '{"translation_protected": true}', "b", "retranslation")
    assert held["target"] == "a" and held["error"] and not held["changed"]
