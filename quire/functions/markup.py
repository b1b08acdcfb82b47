"""XHTML as a stream of tokens: text blocks, replacement of their text, anchors and links, layout.

A tokenizer rather than a tree, so that everything that is not replaced is written back byte for byte.
"""

from __future__ import annotations

import html
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
QUOTES = {"blockquote", "q"}
PARAGRAPHS = {"p", "li", "pre", "div"}
#: Marks that take no space before them, and ones that take none behind them.
NO_SPACE_BEFORE, NO_SPACE_AFTER = ".,;:!?。，；：！？)]}", "([{“「"
_TOKEN = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![^>\[]*(?:\[[^\]]*\])?[^>]*>|<(?P<end>/?)(?P<name>[^\s/>!?<]+)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|&(?P<ref>[#\w]+);|(?P<text>[^<&]+)", re.S)
_ATTR = re.compile(r"([^\s=\"'/]+)\s*=\s*(\"[^\"]*\"|'[^']*')")
_XML_REFS = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}


class Malformed(ValueError):
    """Markup that is not well-formed."""


@dataclass
class Token:
    kind: str  # start, end, empty, text, cdata, ref, other
    raw: str
    name: str = ""
    attrs: str = ""


def tokens(markup: str) -> Iterator[Token]:
    """The tokens of well-formed markup, whose texts join to it; elements left open at the end are allowed."""
    at, open_ = 0, []
    while at < len(markup):
        m = _TOKEN.match(markup, at)
        if m is None:
            raise Malformed(f"at {at}")
        at, raw = m.end(), m.group()
        if m["text"] is not None:
            yield Token("text", raw)
        elif m["ref"] is not None:
            yield Token("ref", raw, m["ref"])
        elif m["cdata"] is not None:
            yield Token("cdata", raw, attrs=m["cdata"])
        elif m["name"] is None:
            yield Token("other", raw)
        elif m["end"]:
            if not open_ or open_.pop() != m["name"]:
                raise Malformed(f"end tag {m['name']}")
            yield Token("end", raw, local(m["name"]))
        elif m["empty"]:
            yield Token("empty", raw, local(m["name"]), m["attrs"])
        else:
            open_.append(m["name"])
            yield Token("start", raw, local(m["name"]), m["attrs"])


def local(name: str) -> str:
    return name.rpartition(":")[2].lower()


def attributes(token: Token) -> dict[str, str]:
    return {local(k): html.unescape(v[1:-1]) for k, v in _ATTR.findall(token.attrs)}


def reference(name: str) -> str:
    """What a reference stands for; nothing for names that XML does not define."""
    if name.startswith("#"):
        try:
            return chr(int(name[2:], 16) if name[1:2] in "xX" else int(name[1:]))
        except ValueError:
            return ""
    return _XML_REFS.get(name, "")


def kind_of(name: str) -> str | None:
    return "heading" if name in HEADINGS else "quote" if name in QUOTES else "paragraph" if name in PARAGRAPHS else None


def needs_space(left: str, right: str) -> bool:
    """Whether two texts that inline markup separates are joined by a space."""
    first = right.lstrip()[:1]
    return bool(left and first) and not left[-1].isspace() and first not in NO_SPACE_BEFORE and left[-1] not in NO_SPACE_AFTER


def blocks(markup: str) -> list[tuple[int, str, str]]:
    """(ordinal, kind, text) of each block. A block that begins inside another takes its place, except an inline quote; markup that is not well-formed is read as plain paragraphs."""
    try:
        return [(o, k, t) for o, k, t, _, _ in _scan(list(tokens(markup)))]
    except Malformed:
        text = re.sub(r"<[^>]*(?:>|\Z)", "", markup, flags=re.S).replace(">", "")
        return [(i, "paragraph", p) for i, p in enumerate(paragraphs(text.splitlines()))]


def paragraphs(lines: list[str]) -> list[str]:
    out: list[list[str]] = [[]]
    for line in lines:
        if line.strip():
            out[-1].append(line.strip())
        elif out[-1]:
            out.append([])
    return [" ".join(own) for own in out if own]


def _scan(own: list[Token]) -> list[tuple[int, str, str, int, list[int]]]:
    """(ordinal, kind, text, place of the start tag, places of text tokens) of each block."""
    found, current, ordinal, depth, block_depth, behind_ref = [], None, 0, 0, 0, False
    for i, t in enumerate(own):
        if t.kind == "start":
            depth += 1
            kind = kind_of(t.name)
            if kind:
                if t.name != "q" or current is None:
                    current, block_depth = [ordinal, kind, "", i, []], depth
                ordinal += 1
        elif t.kind == "end":
            if kind_of(t.name) and depth == block_depth and current is not None:
                found.append(tuple(current))
                current = None
            depth = max(0, depth - 1)
        elif current is not None and t.kind == "text" and t.raw.strip():
            value = t.raw.strip()
            if not behind_ref and needs_space(current[2], value):
                current[2] += " "
            current[2] += value
            current[4].append(i)
            behind_ref = False
        elif current is not None and t.kind == "cdata":
            if needs_space(current[2], t.attrs):
                current[2] += " "
            current[2] += t.attrs
            current[4].append(i)
        elif current is not None and t.kind == "ref":
            current[2] += reference(t.name)
            current[4].append(i)
            behind_ref = True
    return found


def replaced(markup: str, texts: dict[int, str], originals: bool = False) -> str:
    """Markup with the text of blocks (by ordinal) replaced. Tags stay; the new text stands where the first old text stood. With ``originals`` a copy of the old text follows as a block of its own, without ids."""
    own = list(tokens(markup))
    out = [t.raw for t in own]
    ends: dict[int, str] = {}
    for ordinal, kind, old, start, places in _scan(own):
        if ordinal not in texts or not places:
            continue
        out[places[0]] = html.escape(texts[ordinal], quote=False)
        for p in places[1:]:
            out[p] = ""
        if originals and kind != "heading" and old.strip() and old != texts[ordinal]:
            ends[start] = f"<p data-source=\"true\">{html.escape(old, quote=False)}</p>"
    for start, extra in ends.items():
        depth = 0
        for i in range(start, len(own)):
            depth += (own[i].kind == "start") - (own[i].kind == "end")
            if depth == 0:
                out[i] += extra
                break
    return "".join(out)


def anchors(markup: str) -> list[str]:
    """All ids (and names of links) in order; a repeated one is listed again."""
    out = []
    for t in tokens(markup):
        if t.kind in ("start", "empty"):
            own = attributes(t)
            out += [own["id"]] if "id" in own else [own["name"]] if t.name == "a" and "name" in own else []
    return out


def links(markup: str) -> list[str]:
    return [own["href"] for t in tokens(markup) if t.kind in ("start", "empty") for own in [attributes(t)] if t.name == "a" and "href" in own]


def resolved(base: str, href: str) -> tuple[str, str]:
    """(path, fragment) of a link relative to the document ``base`` of the same archive; an outside link has no path."""
    if re.match(r"[A-Za-z][\w+.-]*:", href):
        return "", href
    path, _, fragment = href.partition("#")
    return (joined_path(posixpath.dirname(base), unquote(path)) if path else base), unquote(fragment)


def joined_path(base: str, relative: str) -> str:
    """An archive path without ``.`` and ``..`` parts; parts above the root are dropped."""
    out: list[str] = []
    for part in f"{base}/{relative}".split("/"):
        if part == "..":
            out[-1:] = []
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def dangling(documents: dict[str, str], resources: set[str]) -> list[tuple[str, str]]:
    """(document, link) for links inside a book that lead nowhere."""
    known = {path: set(anchors(markup)) for path, markup in documents.items()}
    out = []
    for path, markup in documents.items():
        for href in links(markup):
            target, fragment = resolved(path, href)
            if not target:
                continue
            if target in known:
                if fragment and fragment not in known[target]:
                    out.append((path, href))
            elif target not in resources:
                out.append((path, href))
    return out


def with_layout(markup: str, layout: str) -> str:
    """Markup whose root asks for a writing direction: vertical or horizontal; preserve leaves it."""
    if layout == "preserve":
        return markup
    mode = {"vertical": "vertical-rl", "horizontal": "horizontal-tb"}[layout]
    style = f"writing-mode: {mode}; -epub-writing-mode: {mode};"
    out, done = [], False
    for t in tokens(markup):
        if not done and t.kind == "start" and t.name == "html":
            old = attributes(t).get("style", "")
            kept = "; ".join(s.strip() for s in old.split(";") if s.strip() and "writing-mode" not in s)
            bare = re.sub(r"\s+style\s*=\s*(\"[^\"]*\"|'[^']*')", "", t.raw[:-1])
            t = Token("start", f'{bare} style="{html.escape((kept + "; " if kept else "") + style)}">', t.name)
            done = True
        out.append(t.raw)
    return "".join(out)
