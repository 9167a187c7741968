"""What a markdown body holds, in one pass: code regions, links, wiki links, headings, citations.

A scanner for fenced and indented code, code spans, inline, reference and automatic
links. One Arrow UDF per body returns all of it; positions count characters.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r" {0,3}(`{3,}|~{3,})([^\n]*)$")
_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#*)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_DEFINITION = re.compile(r"^ {0,3}\[([^\[\]]+)\]:[ \t]*<?([^\s>]+)>?", re.M)
_INLINE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\](?:\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)|\[([^\[\]]*)\])?")
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_WIKI = re.compile(r"\[\[([^\[\]]+)\]\]")
_TAG = re.compile(r"(^|\s)#([A-Za-z][A-Za-z0-9_/-]*)")
_REWRITE = re.compile(r"(!?)\[([^\]]*)\]\(([^)]+)\)")
_HEAD = re.compile(r"#{1,6}\s+(.*)$")
_ITEM = re.compile(r"\s*[-*]\s+(.*)$")
_LINK = re.compile(r"\[([^\]]*)\]\(([^)]+)\)")
_URL = re.compile(r"<?(https?://[^\s>]+)>?$")


def code_regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of fenced and indented blocks and of code spans, in order."""
    out, at, fence, start, paragraph = [], 0, "", 0, False
    plain: list[tuple[int, int]] = []
    for line in text.splitlines(keepends=True):
        bare, end = line.rstrip("\r\n"), at + len(line)
        m = _FENCE.match(bare)
        if fence:
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not m[2].strip():
                out.append((start, end))
                fence = ""
        elif m and not (m[1][0] == "`" and "`" in m[2]):
            fence, start, paragraph = m[1], at, False
        elif bare.strip() and (bare.startswith("    ") or bare.startswith("\t")) and not paragraph:
            out.append((at, end))
        else:
            plain.append((at, end))
            paragraph = bool(bare.strip()) and not _ATX.match(bare)
        at = end
    if fence:
        out.append((start, len(text)))
    k = 0
    while k < len(plain):  # spans may run over the lines of one paragraph
        j = k
        while j + 1 < len(plain) and plain[j + 1][0] == plain[j][1] and text[plain[j + 1][0] : plain[j + 1][1]].strip():
            j += 1
        a, z = plain[k][0], plain[j][1]
        runs = [(m.start() + a, m.end() + a) for m in re.finditer("`+", text[a:z])]
        i = 0
        while i < len(runs):
            size = runs[i][1] - runs[i][0]
            close = next((n for n in range(i + 1, len(runs)) if runs[n][1] - runs[n][0] == size), None)
            if close is not None and not (runs[i][0] and text[runs[i][0] - 1] == "\\"):
                out.append((runs[i][0], runs[close][1]))
                i = close
            i += 1
        k = j + 1
    return sorted(out)


def masked(text: str, regions: list[tuple[int, int]]) -> str:
    """Code blanked; line ends and positions stay."""
    parts, at = [], 0
    for a, z in regions:
        if z > at:
            parts += [text[at : max(a, at)], re.sub(r"[^\n]", " ", text[max(a, at) : z])]
            at = z
    return "".join([*parts, text[at:]])


def _within(pos: int, regions: list[tuple[int, int]]) -> bool:
    return any(a <= pos < z for a, z in regions)


def links(text: str, clear: str) -> list[dict]:
    """Links as a reader of CommonMark finds them: inline, by reference, images and automatic ones (empty text)."""
    known = {m[1].strip().lower(): m[2] for m in _DEFINITION.finditer(clear)}
    out = []
    for m in _INLINE.finditer(clear):
        if m.start() and clear[m.start() - 1] == "\\":
            continue
        label = text[m.start(2) : m.end(2)]
        if m[3] is not None or m[4] is not None:
            out.append({"pos": m.start(), "text": label, "dest": m[3] if m[3] is not None else m[4]})
        elif (ref := (m[5] or m[2]).strip().lower()) in known and clear[m.end() : m.end() + 1] != ":":
            out.append({"pos": m.start(), "text": label, "dest": known[ref]})
        for inner in _INLINE.finditer(m[2]) if "](" in m[2] else ():
            if inner[4]:
                out.append({"pos": m.start(2) + inner.start(), "text": inner[2], "dest": inner[4]})
    for m in _AUTO.finditer(clear):
        out.append({"pos": m.start(), "text": "", "dest": m[1] if ":" in m[1] else "mailto:" + m[1]})
    return sorted(out, key=lambda x: x["pos"])


def headings(clear: str) -> list[dict]:
    out, before, at = [], "", 0
    for line in clear.splitlines():
        m = _ATX.match(line)
        if m:
            out.append({"pos": at, "level": len(m[1]), "text": (m[2] or "").strip()})
        elif before.strip() and (s := _SETEXT.match(line)) and not _ATX.match(before):
            out.append({"pos": at, "level": 1 if s[1][0] == "=" else 2, "text": before.strip()})
            line = ""
        before = line
        at += 1
    return out


def citations(text: str) -> list[dict]:
    """List items under a heading named Citations, as (title, resource): a link, an address alone, or else a title."""
    out, inside = [], False
    for line in text.split("\n"):
        if h := _HEAD.match(line):
            inside = h[1].strip().lower() == "citations"
        elif inside and (m := _ITEM.match(line)) and (item := m[1].strip()):
            if l := _LINK.search(item):
                out.append({"title": l[1].strip(), "resource": l[2].strip()})
            elif u := _URL.match(item):
                out.append({"title": "", "resource": u[1]})
            else:
                out.append({"title": item, "resource": ""})
    return out


def slugged(heads: list[dict]) -> list[dict]:
    """Anchors in order; the n-th repeat of one gets -n."""
    seen: dict[str, int] = {}
    for h in heads:
        s = re.sub(r"[^a-z0-9_ -]", "", re.sub(r"<[^>]*>", "", h["text"].lower())).replace(" ", "-")
        n = seen.get(s, 0)
        seen[s] = n + 1
        h["slug"] = s if not n else f"{s}-{n}"
    return heads


def parsed(text: str | None) -> dict | None:
    if text is None:
        return None
    regions = code_regions(text) if "`" in text or "~~~" in text or "\t" in text or "    " in text else []
    clear = masked(text, regions)
    wiki = [{"pos": m.start(), "target": m[1].partition("|")[0].strip(), "alias": m[1].partition("|")[2].strip()} for m in _WIKI.finditer(text) if not _within(m.start(), regions)] if "[[" in text else []
    tags = list(dict.fromkeys(m[2] for m in _TAG.finditer(text) if not _within(m.start(2) - 1, regions))) if "#" in text else []
    return {"code": [{"start": a, "end": z} for a, z in regions], "links": links(text, clear) if "[" in text or "<" in text else [], "wikilinks": wiki, "headings": slugged(headings(clear)), "hashtags": tags, "citations": citations(text) if "itations" in text.lower() else []}


SCHEMA = "struct<code: array<struct<start: int, end: int>>, links: array<struct<pos: int, text: string, dest: string>>, wikilinks: array<struct<pos: int, target: string, alias: string>>, headings: array<struct<pos: int, level: int, text: string, slug: string>>, hashtags: array<string>, citations: array<struct<title: string, resource: string>>>"
_i, _s = pa.int32(), pa.string()
_ARROW = pa.struct([
    ("code", pa.list_(pa.struct([("start", _i), ("end", _i)]))), ("links", pa.list_(pa.struct([("pos", _i), ("text", _s), ("dest", _s)]))),
    ("wikilinks", pa.list_(pa.struct([("pos", _i), ("target", _s), ("alias", _s)]))), ("headings", pa.list_(pa.struct([("pos", _i), ("level", _i), ("text", _s), ("slug", _s)]))),
    ("hashtags", pa.list_(_s)), ("citations", pa.list_(pa.struct([("title", _s), ("resource", _s)]))),
])


def _parse(bodies: pa.Array) -> pa.Array:
    return pa.array([parsed(b) for b in bodies.to_pylist()], _ARROW)


def parse(body: Column) -> Column:
    """All that :func:`parsed` finds, as one struct; null for a null body."""
    return F.arrow_udf(_parse, SCHEMA)(body)


def rewrite(text: str, markdown: dict[str, str], wiki: dict[str, tuple[str, str]]) -> str:
    """``text`` with resolved targets: markdown links by raw target, wiki links by (path, title); the rest stays verbatim."""
    regions = code_regions(text)
    clear, parts, at = masked(text, regions), [], 0
    for m in _REWRITE.finditer(clear):
        target = text[m.start(3) : m.end(3)].strip()
        if target in markdown:
            parts += [text[at : m.start(3)], markdown[target]]
            at = m.end(3)
    text = "".join([*parts, text[at:]])
    regions, parts, at = code_regions(text), [], 0
    for m in _WIKI.finditer(text):
        target, _, alias = (x.strip() for x in m[1].partition("|"))
        if target in wiki and not _within(m.start(), regions):
            parts += [text[at : m.start()], f"[{alias or wiki[target][1] or target}]({wiki[target][0]})"]
            at = m.end()
    return "".join([*parts, text[at:]])
