"""EPUB books: a source that parses archives into chapters and blocks, and sinks that refill or generate archives.

An archive is one binary row. It is opened in the worker that reads it, so books are read in parallel and no book
crosses the network before it is text.
"""

from __future__ import annotations

import html
import io
import posixpath
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markup

MIMETYPE = b"application/epub+zip"
COVER_LIMIT = 20 << 20
TEXT_TYPES = {"application/xhtml+xml", "text/html"}
IMAGE_TYPES = {"image/jpeg", "image/png", "image/gif", "image/webp"}
SKIPPED_TITLES = {"目次", "Contents", "Table of Contents"}


@dataclass
class Package:
    """What the package file of a book lists; paths are those of the archive."""

    path: str = ""
    title: str = ""
    language: str = ""
    spine: list[str] = field(default_factory=list)
    items: dict[str, tuple[str, str, str]] = field(default_factory=dict)  # id -> path, media type, properties
    nav: str | None = None
    ncx: str | None = None
    cover: str | None = None


def _tag(e: ElementTree.Element) -> str:
    return markup.local(e.tag.rpartition("}")[2])


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if markup.local(k.rpartition("}")[2]) == name), None)


def package(archive: zipfile.ZipFile) -> Package:
    container = ElementTree.fromstring(archive.read("META-INF/container.xml"))
    path = next((p for e in container.iter() if _tag(e) == "rootfile" and (p := _attr(e, "full-path"))), None)
    if path is None:
        raise ValueError("container names no package")
    out, root = Package(path), ElementTree.fromstring(archive.read(path))
    base, refs, toc, cover_id = posixpath.dirname(path), [], None, None
    for e in root.iter():
        name = _tag(e)
        if name == "title" and (e.text or "").strip():
            out.title = e.text.strip()
        elif name == "language" and not out.language:
            out.language = (e.text or "").strip()
        elif name == "item" and _attr(e, "id") and _attr(e, "href"):
            out.items[_attr(e, "id")] = (markup.joined_path(base, markup.unquote(_attr(e, "href"))), _attr(e, "media-type") or "", _attr(e, "properties") or "")
        elif name == "spine":
            toc = _attr(e, "toc")
        elif name == "itemref" and _attr(e, "idref"):
            refs.append(_attr(e, "idref"))
        elif name == "meta" and _attr(e, "name") == "cover":
            cover_id = _attr(e, "content")
    out.spine = [out.items[r][0] for r in refs if r in out.items and out.items[r][1] in TEXT_TYPES]
    out.nav = next((p for p, _, props in out.items.values() if "nav" in props.split()), None)
    out.ncx = out.items[toc][0] if toc in out.items else next((p for p, kind, _ in out.items.values() if kind == "application/x-dtbncx+xml"), None)
    covers = [(p, kind) for p, kind, props in out.items.values() if "cover-image" in props.split()] or ([out.items[cover_id][:2]] if cover_id in out.items else [])
    out.cover = next((p for p, kind in covers if kind in IMAGE_TYPES), None)
    return out


def _text(e: ElementTree.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def nav_entries(text: bytes, path: str) -> list[tuple[str, str]]:
    """(path, title) of the links of a navigation document: those of its table of contents, else of its first list."""
    root = ElementTree.fromstring(text)
    navs = [e for e in root.iter() if _tag(e) == "nav"]
    own = next((e for e in navs if "toc" in (_attr(e, "type") or "").split()), navs[0] if navs else root)
    return [(markup.resolved(path, _attr(e, "href"))[0], _text(e)) for e in own.iter() if _tag(e) == "a" and _attr(e, "href")]


def ncx_entries(text: bytes, path: str) -> list[tuple[str, str]]:
    """(path, title) of the first level of an older navigation file."""
    out = []
    for nav_map in (e for e in ElementTree.fromstring(text).iter() if _tag(e) == "navmap"):
        for point in (e for e in nav_map if _tag(e) == "navpoint"):
            label = next((_text(e) for e in point if _tag(e) == "navlabel"), "")
            src = next((_attr(e, "src") for e in point if _tag(e) == "content"), None)
            if src:
                out.append((markup.resolved(path, src)[0], label))
    return out


def chapter_starts(archive: zipfile.ZipFile, own: Package) -> dict[str, str]:
    """Spine path to chapter title; the first entry of a path counts, and tables of contents themselves do not."""
    for path, read in ((own.nav, nav_entries), (own.ncx, ncx_entries)):
        if path and path in archive.namelist():
            found = {}
            for target, title in read(archive.read(path), path):
                if title.strip() and title.strip() not in SKIPPED_TITLES and target in own.spine:
                    found.setdefault(target, title.strip())
            if found:
                return found
    return {}


def cover(archive: zipfile.ZipFile, own: Package) -> bytes | None:
    if own.cover is None or own.cover not in archive.namelist() or archive.getinfo(own.cover).file_size > COVER_LIMIT:
        return None
    return archive.read(own.cover) or None


def parse(content: bytes) -> dict:
    """Title, language, cover and chapters of a book: (title, blocks of kind, source, path, ordinal). Without navigation every spine document with text is a chapter, titled by its first heading."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        own = package(archive)
        starts = chapter_starts(archive, own)
        chapters: list[dict] = []
        for path in own.spine:
            if path not in archive.namelist():
                raise ValueError(f"spine names {path}, which the archive lacks")
            found = [{"kind": k, "source": t, "path": path, "ordinal": o} for o, k, t in markup.blocks(archive.read(path).decode("utf-8-sig")) if t.strip()]
            if starts:
                if path in starts:
                    chapters.append({"title": starts[path], "blocks": []})
                if chapters:
                    chapters[-1]["blocks"] += found
            elif found:
                title = next((b["source"] for b in found if b["kind"] == "heading"), None)
                chapters.append({"title": title or f"Chapter {len(chapters) + 1}", "blocks": found})
        return {"title": own.title, "language": own.language, "cover": cover(archive, own), "chapters": [c for c in chapters if c["blocks"]]}


BOOK = "title string, language string, cover binary, chapters array<struct<title: string, blocks: array<struct<kind: string, source: string, path: string, ordinal: int>>>>, error string"


def books(archives: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, BOOK) of each archive; one that cannot be read has an error and no chapters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, c in zip(frame[key], frame[content]):
                try:
                    rows.append({key: k, **parse(bytes(c)), "error": None})
                except Exception as e:  # noqa: BLE001 - any damage of an archive is reported in its row
                    rows.append({key: k, "title": None, "language": None, "cover": None, "chapters": None, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(rows, columns=[key, "title", "language", "cover", "chapters", "error"])

    kind = dict(archives.dtypes)[key]
    return archives.select(key, content).mapInPandas(run, f"`{key}` {kind}, {BOOK}")


def read_epub(spark: SparkSession, path: str) -> DataFrame:
    """All books under a path, by any file system that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[eE][pP][uU][bB]").option("recursiveFileLookup", "true").load(path)
    return books(files.select("path", "content"))


def blocks(found: DataFrame, key: str = "path") -> DataFrame:
    """(key, chapter, chapter_title, place, kind, source, document, ordinal): one row per block."""
    rows = found.select(key, F.posexplode("chapters").alias("chapter", "c"))
    return rows.select(key, "chapter", F.col("c.title").alias("chapter_title"), F.posexplode("c.blocks").alias("place", "b")).select(key, "chapter", "chapter_title", "place", F.col("b.kind").alias("kind"), F.col("b.source").alias("source"), F.col("b.path").alias("document"), F.col("b.ordinal").alias("ordinal"))


def copied(content: bytes, replacements: dict[str, bytes]) -> bytes:
    """The archive with some entries replaced; the media type comes first and is not compressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as old, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        new.writestr(zipfile.ZipInfo("mimetype"), MIMETYPE, zipfile.ZIP_STORED)
        for info in old.infolist():
            if info.filename != "mimetype" and not info.is_dir():
                new.writestr(zipfile.ZipInfo(info.filename, info.date_time), replacements.get(info.filename, old.read(info.filename)), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def refilled(content: bytes, texts: dict[str, dict[int, str]], titles: dict[str, str] | None = None, bilingual: bool = False, layout: str = "preserve") -> bytes:
    """A book with the texts of blocks (by document and ordinal) and of navigation titles replaced. Links inside the book must lead somewhere."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        own, names = package(archive), set(archive.namelist())
        out, documents = {}, {}
        for path in own.spine:
            old = archive.read(path).decode("utf-8-sig")
            documents[path] = markup.with_layout(markup.replaced(old, texts.get(path, {}), bilingual), layout)
        broken = set(markup.dangling(documents, names)) - set(markup.dangling({p: archive.read(p).decode("utf-8-sig") for p in own.spine}, names))
        if broken:
            raise ValueError(f"links lead nowhere: {sorted(broken)[:3]}")
        out = {p: t.encode() for p, t in documents.items()}
        for path in (own.nav, own.ncx):
            if titles and path and path in names and path not in out:
                out[path] = _retitled(archive.read(path).decode("utf-8-sig"), path, titles).encode()
    return copied(content, out)


def _retitled(text: str, path: str, titles: dict[str, str]) -> str:
    """Navigation with the labels of known targets replaced: link texts, or labels before a content element."""
    own = list(markup.tokens(text))
    out, label, link = [t.raw for t in own], [], None
    for i, t in enumerate(own):
        if t.kind == "start" and t.name == "a":
            link = titles.get(markup.resolved(path, markup.attributes(t).get("href", ""))[0])
            label = []
        elif t.kind == "start" and t.name == "navlabel":
            label = []
        elif t.kind == "text" and t.raw.strip():
            label.append(i)
        elif t.kind == "end" and t.name == "a" and link is not None:
            _put(out, label, link)
            link = None
        elif t.kind in ("start", "empty") and t.name == "content":
            title = titles.get(markup.resolved(path, markup.attributes(t).get("src", ""))[0])
            if title is not None:
                _put(out, label, title)
    return "".join(out)


def _put(out: list[str], places: list[int], text: str) -> None:
    for k, p in enumerate(places):
        out[p] = html.escape(text, quote=False) if k == 0 else ""


def generated(title: str, language: str, chapters: list[tuple[str, list[list[str]]]], layout: str = "preserve") -> bytes:
    """A new book: (title, paragraphs, each of one or two texts) per chapter."""
    esc = lambda x: html.escape(x, quote=False)
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    names = [f"chapter-{i + 1:04d}.xhtml" for i in range(len(chapters))]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:

        def put(name: str, text: str) -> None:
            new.writestr(zipfile.ZipInfo(name), text.encode(), zipfile.ZIP_DEFLATED)

        new.writestr(zipfile.ZipInfo("mimetype"), MIMETYPE, zipfile.ZIP_STORED)
        put("META-INF/container.xml", head + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        refs = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
        direction = ' page-progression-direction="rtl"' if layout == "vertical" else ""
        put(
            "OEBPS/content.opf",
            head + f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{esc(title)}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:language>{esc(language)}</dc:language></metadata>'
            f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine{direction}>{refs}</spine></package>',
        )
        rows = "".join(f'<li><a href="{n}">{esc(t)}</a></li>' for n, (t, _) in zip(names, chapters))
        put("OEBPS/nav.xhtml", head + f'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{esc(title)}</title></head><body><nav epub:type="toc"><ol>{rows}</ol></nav></body></html>')
        for name, (heading, paragraphs) in zip(names, chapters):
            body = "".join(f"<p>{esc(p[0])}</p>" + "".join(f'<p data-source="true">{esc(x)}</p>' for x in p[1:]) for p in paragraphs)
            put(f"OEBPS/{name}", markup.with_layout(head + f'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{esc(heading)}</title></head><body><h1>{esc(heading)}</h1>{body}</body></html>', layout))
    return out.getvalue()


def generate(rows: DataFrame, book: str, language: str = "zh", layout: str = "preserve") -> DataFrame:
    """(book, content): a generated archive per book of rows (book, book_title, chapter, chapter_title, ordinal, texts: array of one or two)."""

    def run(key, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["chapter", "ordinal"])
        chapters = [(str(c["chapter_title"].iloc[0]), [list(t) for t in c["texts"]]) for _, c in own.groupby("chapter", sort=True)]
        return pd.DataFrame({book: [key[0]], "content": [generated(str(own["book_title"].iloc[0]), language, chapters, layout)]})

    return rows.groupBy(book).applyInPandas(run, f"`{book}` {dict(rows.dtypes)[book]}, content binary")


def refill(archives: DataFrame, rows: DataFrame, key: str = "path", bilingual: bool = False, layout: str = "preserve") -> DataFrame:
    """(key, content): each archive with the texts of rows (key, document, ordinal, target, chapter_title) in place of its blocks."""

    def run(k, old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if old.empty:
            return pd.DataFrame({key: [], "content": []})
        texts: dict[str, dict[int, str]] = {}
        for r in new.itertuples():
            texts.setdefault(r.document, {})[int(r.ordinal)] = r.target
        first = new.sort_values("ordinal").drop_duplicates("document") if len(new) else new
        titles = {r.document: r.chapter_title for r in first.itertuples() if isinstance(r.chapter_title, str)}
        return pd.DataFrame({key: [k[0]], "content": [refilled(bytes(old["content"].iloc[0]), texts, titles, bilingual, layout)]})

    return archives.select(key, "content").groupBy(key).cogroup(rows.groupBy(key)).applyInPandas(run, f"`{key}` {dict(archives.dtypes)[key]}, content binary")


def covers(found: DataFrame, key: str = "path") -> DataFrame:
    """(key, url): covers as data URLs."""
    kind = F.when(F.hex(F.substring("cover", 1, 3)) == "FFD8FF", "image/jpeg").when(F.hex(F.substring("cover", 1, 4)) == "89504E47", "image/png").when(F.hex(F.substring("cover", 1, 3)) == "474946", "image/gif").otherwise("image/webp")
    return found.where("cover is not null").select(key, F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("cover")).alias("url"))
