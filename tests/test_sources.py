import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.operators import conflicts
from quire.sources import epub, state, text
from quire.streaming import logs


def make_book(nav=True, ncx=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        items = '<item id="a" href="t/a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="t/b.xhtml" media-type="application/xhtml+xml"/><item id="cov" href="cover.png" media-type="image/png" properties="cover-image"/>'
        items += '<item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>' * nav + '<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>' * ncx
        z.writestr("OEBPS/book.opf", f'<package xmlns:dc="d"><metadata><dc:title>My Book</dc:title><dc:language>en</dc:language></metadata><manifest>{items}</manifest><spine toc="ncx"><itemref idref="a"/><itemref idref="missing"/><itemref idref="b"/></spine></package>')
        z.writestr("OEBPS/t/a.xhtml", '<html><body><h1>One</h1><p id="x">First <i>text</i>.</p><p><a href="b.xhtml">go</a></p></body></html>')
        z.writestr("OEBPS/t/b.xhtml", "<html><body><p>Second.</p></body></html>")
        z.writestr("OEBPS/cover.png", b"\x89PNG....")
        if nav:
            z.writestr("OEBPS/nav.xhtml", '<html><body><nav type="toc"><ol><li><a href="nav.xhtml">Contents</a></li><li><a href="t/a.xhtml#x">Chapter A</a></li><li><a href="t/b.xhtml">Chapter B</a></li></ol></nav></body></html>')
        if ncx:
            z.writestr("OEBPS/toc.ncx", '<ncx><navMap><navPoint><navLabel><text>A</text></navLabel><content src="t/a.xhtml"/><navPoint><navLabel><text>deep</text></navLabel><content src="t/b.xhtml"/></navPoint></navPoint></navMap></ncx>')
    return out.getvalue()


def test_parse_book():
    book = epub.parse(make_book())
    assert (book["title"], book["language"], book["cover"]) == ("My Book", "en", b"\x89PNG....")
    assert [(c["title"], [b["source"] for b in c["blocks"]]) for c in book["chapters"]] == [("Chapter A", ["One", "First text.", "go"]), ("Chapter B", ["Second."])]
    assert [c["title"] for c in epub.parse(make_book(nav=False))["chapters"]] == ["One", "Chapter 2"]
    assert [(c["title"], len(c["blocks"])) for c in epub.parse(make_book(nav=False, ncx=True))["chapters"]] == [("A", 4)]


def test_book_frames(spark, tmp_path):
    (tmp_path / "x.epub").write_bytes(make_book())
    (tmp_path / "broken.EPUB").write_bytes(b"no zip")
    found = epub.read_epub(spark, str(tmp_path)).cache()
    assert {bool(r.error) for r in found.collect()} == {True, False}
    rows = epub.blocks(found)
    assert rows.count() == 4 and epub.covers(found).first().url.startswith("data:image/png;base64,")
    archives = spark.createDataFrame([("k", bytearray(make_book()))], "path string, content binary")
    new = spark.createDataFrame([("k", "OEBPS/t/a.xhtml", 1, "Erster & Text", "Kapitel A")], "path string, document string, ordinal int, target string, chapter_title string")
    filled = epub.refill(archives, new, bilingual=True, layout="vertical").first().content
    with zipfile.ZipFile(io.BytesIO(bytes(filled))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        doc, nav = z.read("OEBPS/t/a.xhtml").decode(), z.read("OEBPS/nav.xhtml").decode()
        assert "Erster &amp; Text" in doc and 'data-source="true">First text.' in doc and "vertical-rl" in doc and "Kapitel A" in nav and "Chapter B" in nav


def test_generated_book_reads_back(spark):
    rows = spark.createDataFrame([(1, "T", 0, "C0", 0, ["a<b"]), (1, "T", 0, "C0", 1, ["c", "src"]), (1, "T", 1, "C1", 0, ["d"])], "b int, book_title string, chapter int, chapter_title string, ordinal int, texts array<string>")
    content = bytes(epub.generate(rows, "b").first().content)
    book = epub.parse(content)
    assert book["title"] == "T" and [(c["title"], [b["source"] for b in c["blocks"]]) for c in book["chapters"]] == [("C0", ["C0", "a<b", "c", "src"]), ("C1", ["C1", "d"])]


def test_dangling_links_are_refused():
    with pytest.raises(ValueError, match="lacks"):
        broken = io.BytesIO()
        with zipfile.ZipFile(io.BytesIO(make_book())) as old, zipfile.ZipFile(broken, "w") as new:
            for n in old.namelist():
                if n != "OEBPS/t/b.xhtml":
                    new.writestr(n, old.read(n))
        epub.parse(broken.getvalue())


def test_text_books(spark, tmp_path):
    (tmp_path / "My Tale.TXT").write_bytes(b"\xef\xbb\xbfChapter 1\r\nHello there.\r\n\r\nBye.")
    rows = text.read_books(spark, str(tmp_path), 1200).orderBy("ordinal").collect()
    assert [(r.title, r.chapter_title, r.source) for r in rows] == [("My Tale", "Chapter 1", "Hello there."), ("My Tale", "Chapter 1", "Bye.")]
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        text.read_files(spark, str(tmp_path)).collect()


def test_state_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("p1", "chapter-10-x", "T", None, "pending", None, []), ("p1", "chapter-2-x", "U", None, "pending", None, [("s", 0, "a", None, None, None, "paragraph", "pending", "h", "{}")]), ("p2", "other", "V", None, "pending", None, [])], state.CHAPTER)
    state.write_chapters(rows, str(tmp_path / "c"))
    state.write_chapters(rows.where("project_id = 'p2'"), str(tmp_path / "c"))
    found = state.read_chapters(spark, str(tmp_path / "c"))
    assert [r.id for r in found.orderBy("place").collect()] == ["chapter-2-x", "chapter-10-x", "other"]
    held = spark.createDataFrame([("p1",)], "id string")
    assert [r.id for r in state.initialized(held, spark.createDataFrame([("p1",), ("p3",), ("p3",)], "id string")).collect()] == ["p3"]


def test_projects_skip_damaged(spark, tmp_path):
    for name, body in (("a", json.dumps({"id": "1", "source_path": "/x", "updated_at": "2026"})), ("b", "{broken"), ("c", json.dumps({"id": "2", "source_path": "/x", "updated_at": "2027"}))):
        (tmp_path / name).mkdir()
        (tmp_path / name / "project.json").write_text(body)
    found = state.read_projects(spark, str(tmp_path))
    assert {r.id for r in found.collect()} == {"1", "2"} and state.by_path(found, "/x").first().id == "2"
    with pytest.raises(ValueError):
        state.by_id(found, "xyz")


def test_snapshot_check(spark):
    body = bytearray(b"book")
    digest = spark.range(1).select(F.sha2(F.lit(bytes(body)), 256)).first()[0]
    projects = spark.createDataFrame([(digest, 1)], "id string, chapters_total long")
    chapters = spark.createDataFrame([(digest, "c")], "project_id string, id string")
    sources = spark.createDataFrame([(digest, body)], "project_id string, content binary")
    assert state.checked_snapshot(chapters, sources, projects).count() == 1
    with pytest.raises(Exception, match="chapters are missing"):
        state.checked_snapshot(chapters, sources, projects.withColumn("chapters_total", F.lit(2).cast("long"))).collect()


def test_options():
    own = state.read_options("max_batch_chars = 5\n[polish]\npolish_concurrency = 2\nother = 1\n")
    assert (own.max_batch_chars, own.polish_concurrency, own.extra) == (5, 2, {"other": 1})
    with pytest.raises(ValueError):
        state.read_options("max_batch_chars = 0")


def test_log_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('2026-01-01T00:00:10Z\tstart\t{"a":1}\nnoise\n2026-01-01T00:00:50Z\tstart\tx\n')
    run = logs.changed_only(logs.tail(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_term_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([("s", 0, "insert", "a", 1, None), ("s", 1, "insert", "b", 2, None), ("t", 2, "insert", "x", 1, None), ("s", 3, "resolve", "b", None, None)], conflicts.EVENT)
    events.coalesce(1).write.json(str(tmp_path / "in"))
    stream = logs.fold_term_events(spark.readStream.schema(conflicts.EVENT).json(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("term_states").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(120)
    found = {r.source: (r.target, r.status) for r in spark.table("term_states").collect()}
    assert found == {r.source: (r.target, r.status) for r in conflicts.fold_terms(events).collect()}
