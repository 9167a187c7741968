"""Frontmatter: ordered YAML to rows and back, keeping the text of what didn't change.

YAML is read by its node tree: timestamps and yes/no stay texts, only null, true,
false, integers and floats are typed. Values travel as JSON texts.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
import yaml
from pyspark.sql import Column
from pyspark.sql import functions as F

from .spec import SOURCE, STAMP, TRUST

_NULL = re.compile(r"^(~|null|Null|NULL|)$")
_BOOL = re.compile(r"^(true|True|TRUE|false|False|FALSE)$")
_INT = re.compile(r"^[-+]?(0|[1-9][0-9]*|0x[0-9a-fA-F]+|0o[0-7]+)$")
_FLOAT = re.compile(r"^[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?$")


# a mapping of plain and quoted texts, a line each, in characters that mean nothing else to YAML: read without its parser, to the same values
_LINE = r"""[A-Za-z][A-Za-z0-9_-]{0,99}: (?:"[ !#-\[\]-~]*"|'[ -&(-~]*'|[A-Za-z0-9_/](?:[A-Za-z0-9_/.+,()@&=;%#-]|:(?=[A-Za-z0-9_/.])| +(?=[A-Za-z0-9_/.+(@&=-]))*)\n"""
_SIMPLE = re.compile(f"(?:{_LINE})+")

DEEPEST, MOST_VALUES = 100, 100_000
_KEPT, _SHORT = 4096, 1000  # written values that are remembered, and their longest


class FrontmatterError(ValueError):
    """Text that isn't an ordered mapping."""


def value_of(node: yaml.Node, depth: int = 0, seen: list[int] | None = None):
    """A node's value: text, number, boolean, None, list or dict.

    Integers beyond 64 bits and floats beyond their range stay texts. Deep nesting (an
    alias that holds itself included) and aliases that multiply are errors.
    """
    seen = [0] if seen is None else seen
    seen[0] += 1
    if depth > DEEPEST or seen[0] > MOST_VALUES:
        raise FrontmatterError("frontmatter is nested too deeply" if depth > DEEPEST else "frontmatter has too many values")
    if isinstance(node, yaml.SequenceNode):
        return [value_of(n, depth + 1, seen) for n in node.value]
    if isinstance(node, yaml.MappingNode):
        return {key_of(k): value_of(v, depth + 1, seen) for k, v in node.value}
    s = node.value
    if node.style or node.tag == "tag:yaml.org,2002:str" and not _plain(s):
        return s
    return _scalar(s)


def _scalar(s: str):
    """The value of a text without quotes."""
    if _NULL.match(s):
        return None
    if _BOOL.match(s):
        return s.lower() == "true"
    if _INT.match(s):
        n = (int(s, 0) if s.lstrip("+-")[:2] in ("0x", "0o") else int(s)) if len(s) < 24 else 1 << 64
        return n if -(1 << 63) <= n < 1 << 63 else s
    return float(s) if _FLOAT.match(s) and math.isfinite(float(s)) else s


def key_of(node: yaml.Node) -> str:
    if not isinstance(node, yaml.ScalarNode):
        raise FrontmatterError("a key is not a scalar")
    return str(node.value)


def _plain(s: str) -> bool:
    return bool(_NULL.match(s) or _BOOL.match(s) or _INT.match(s) or _FLOAT.match(s))


def compose(text: str) -> yaml.MappingNode | None:
    try:
        node = yaml.compose(text, Loader=yaml.SafeLoader)
    except RecursionError as e:
        raise FrontmatterError("frontmatter is nested too deeply") from e
    except (yaml.YAMLError, ValueError) as e:
        raise FrontmatterError(" ".join(str(e).split())) from e
    if node is not None and not isinstance(node, yaml.MappingNode):
        raise FrontmatterError("frontmatter is not a mapping")
    return node


def load(text: str) -> dict:
    """An ordered mapping; a repeated key is an error."""
    if _SIMPLE.fullmatch(text):
        pairs = ((k, v[1:-1] if v[0] in "\"'" else _scalar(v)) for k, _, v in (x.partition(": ") for x in text.split("\n")[:-1]))
    else:
        node = compose(text)
        pairs = ((key_of(k), v) for k, v in (node.value if node else ()))
        pairs = ((k, value_of(v)) for k, v in pairs)
    out: dict = {}
    for key, value in pairs:
        if key in out:
            raise FrontmatterError(f"key {key!r} is there twice")
        out[key] = value
    return out


def split(text: str) -> tuple[str | None, str]:
    """(frontmatter text, body); no fence: (None, text). An open fence without its end is an error."""
    m = re.match(r"---\r?\n", text)
    if not m and text != "---":
        return None, text
    start = at = m.end() if m else 3
    while at < len(text):
        end = text.find("\n", at)
        line = text[at : end if end >= 0 else len(text)]
        after = end + 1 if end >= 0 else len(text)
        if line.rstrip("\r") == "---":
            return text[start:at], text[after:]
        at = after
    raise FrontmatterError("frontmatter has no end")


ENTRY = "struct<fm: array<struct<key: string, value: string>>, raw: string, body: string, error: string>"
_ARROW = pa.struct([("fm", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))), ("raw", pa.string()), ("body", pa.string()), ("error", pa.string())])


def parsed(text: str | None) -> dict | None:
    """Ordered keys with JSON values, or the error and the whole text as body: a bad file is a value, not a failure."""
    if text is None:
        return None
    try:
        raw, body = split(text)
        fm = load(raw) if raw is not None else {}
    except FrontmatterError as e:
        return {"fm": [], "raw": None, "body": text, "error": str(e)}
    return {"fm": [{"key": k, "value": json.dumps(v, ensure_ascii=False)} for k, v in fm.items()], "raw": raw, "body": body, "error": None}


def _parse(texts: pa.Array) -> pa.Array:
    return pa.array([parsed(t) for t in texts.to_pylist()], _ARROW)


def parse(text: Column) -> Column:
    """:func:`parsed` of each text, as one struct."""
    return F.arrow_udf(_parse, ENTRY)(text)


# projections of parsed frontmatter


def raw_value(fm: Column, key: str) -> Column:
    """A key's JSON; null where it is absent."""
    return F.try_element_at(F.transform(F.filter(fm, lambda e: e["key"] == key), lambda e: e["value"]), F.lit(1))


def text_value(fm: Column, key: str) -> Column:
    """A key's value if it is a text."""
    j = raw_value(fm, key)
    return F.when(j.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), j, F.lit("}")), "$.v"))


def any_text(fm: Column, key: str) -> Column:
    """A key's scalar as text."""
    return F.get_json_object(F.concat(F.lit('{"v":'), raw_value(fm, key), F.lit("}")), "$.v")


def _objects(fm: Column, key: str, kind: str, single: bool) -> Column:
    """A list's mappings as structs; other entries are dropped; a mapping alone counts as a list of one if ``single``."""
    j = raw_value(fm, key)
    items = F.when(j.startswith("["), F.from_json(j, "array<string>"))
    if single:
        items = items.when(j.startswith("{"), F.array(j))
    return F.transform(F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: x.startswith("{")), lambda x: F.from_json(x, kind))


def _object(fm: Column, key: str, kind: str) -> Column:
    j = raw_value(fm, key)
    return F.when(j.startswith("{"), F.from_json(j, kind))


def trust(fm: Column) -> Column:
    """Trust signals; a projection that never fails. Numbers read as their text."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    stamp = lambda v: F.struct(blank(v["by"]).alias("by"), blank(v["at"]).alias("at"))
    names = ("id", "resource", "title", "author", "usage_count", "last_modified")
    return F.struct(
        F.transform(_objects(fm, "sources", SOURCE, False), lambda s: F.struct(*[blank(s[n]).alias(n) for n in names])).alias("sources"),
        _object(fm, "usage_window", "struct<from: string, to: string>").alias("usage_window"),
        _object(fm, "generated", STAMP).alias("generated"),
        F.transform(_objects(fm, "verified", STAMP, True), stamp).alias("verified"),
        blank(any_text(fm, "status")).alias("status"),
        blank(any_text(fm, "stale_after")).alias("stale_after"),
    ).cast(TRUST)


def text_list(fm: Column, key: str) -> Column:
    """A list's texts, or a scalar as a list of one; wiki brackets are taken off."""
    j = raw_value(fm, key)
    items = F.when(j.startswith("["), F.from_json(j, "array<string>")).when(j.startswith('"'), F.array(text_value(fm, key)))
    return F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda s: F.regexp_replace(F.trim(s), r"^\[\[|\]\]$", ""))


# writing


class _Dumper(yaml.SafeDumper):
    def increase_indent(self, flow=False, indentless=False):
        return super().increase_indent(flow, False)


_written: dict[str, str] = {}


def _apart(value, seen: set[int]) -> bool:
    """No list or mapping is there twice, which YAML would write as an alias."""
    if not isinstance(value, list | dict):
        return True
    if id(value) in seen:
        return False
    seen.add(id(value))
    return all(_apart(x, seen) for x in (value.values() if isinstance(value, dict) else value))


def dump(value: dict) -> str:
    """Block YAML with two blanks a level, keys in order. Short values are remembered: files of a corpus have many in common."""
    if not value:
        return ""
    name = repr(value)
    if (known := _written.get(name)) is not None and _apart(value, set()):
        return known
    out = yaml.dump(value, Dumper=_Dumper, sort_keys=False, allow_unicode=True, default_flow_style=False, width=1 << 30)
    if len(name) <= _SHORT and _apart(value, set()):
        if len(_written) >= _KEPT:
            _written.clear()
        _written[name] = out
    return out


def splice(raw: str, new: dict) -> str:
    """``raw`` with the keys of ``new``: unchanged ones keep their text, comments and style, others are written afresh.

    A list that only grew keeps the lines of its leading items; a flow list or a
    mapping that becomes part of a list moves into block form with its text. Removed
    keys lose their block; added ones follow at the end in order. A carriage return is an error.
    """
    if "\r" in raw:
        raise FrontmatterError("frontmatter holds a carriage return")
    had = load(raw)
    if had == new and list(had) == list(new):
        return raw
    lines = raw.splitlines(keepends=True)
    if _SIMPLE.fullmatch(raw):  # a line a key
        kept = [line if value == new[k] else dump({k: new[k]}) for (k, value), line in zip(had.items(), lines) if k in new]
        return "".join(kept) + "".join(dump({k: v}) for k, v in new.items() if k not in had)
    node = compose(raw)
    entries = node.value if node else []
    if node is not None and node.flow_style:
        return dump(new)
    starts = [k.start_mark.line for k, _ in entries] + [len(lines)]
    out = lines[: starts[0]] if entries else list(lines)
    for n, (k, v) in enumerate(entries):
        first, last = starts[n], starts[n + 1]
        end = last
        while end > first + 1 and (not lines[end - 1].strip() or lines[end - 1].lstrip().startswith("#")) and not _literal(v):
            end -= 1  # comments and blanks before the next key belong to it
        tail = lines[end:last]
        key = str(k.value)
        if key not in new:
            out += tail
            continue
        old = value_of(v)
        out += lines[first:end] if old == new[key] else _changed(lines, first, end, key, v, old, new[key])
        out += tail
    if out and not out[-1].endswith("\n"):
        out[-1] += "\n"
    known = {str(k.value) for k, _ in entries}
    return "".join(out) + "".join(dump({k: v}) for k, v in new.items() if k not in known)


def _literal(v: yaml.Node) -> bool:
    return isinstance(v, yaml.ScalarNode) and v.style in ("|", ">")


def _changed(lines: list[str], first: int, end: int, key: str, v: yaml.Node, old, new) -> list[str]:
    head = lines[first].split(":", 1)[0]
    if isinstance(new, list) and isinstance(v, yaml.SequenceNode) and old:
        same = next((i for i, (a, b) in enumerate(zip(old, new)) if a != b), min(len(old), len(new)))
        if same and v.flow_style:
            kept = [f"  - {_source(lines, n)}\n" for n in v.value[:same]]
            return [f"{head}:\n", *kept, *_items(new[same:], 2)]
        if same:
            indent = lines[v.value[0].start_mark.line].index("-")
            stop = v.value[same].start_mark.line if same < len(v.value) else end
            return [*lines[first:stop], *_items(new[same:], indent)]
    if isinstance(new, list) and isinstance(v, yaml.MappingNode) and new and new[0] == old:
        if v.flow_style:
            return [f"{head}:\n", f"  - {_source(lines, v)}\n", *_items(new[1:], 2)]
        block = lines[v.start_mark.line : end]
        indent = v.start_mark.column
        moved = [f"  - {block[0][indent:]}", *("    " + x[indent:] if x.strip() else x for x in block[1:])]
        return [lines[first], *moved, *_items(new[1:], 2)]
    return dump({key: new}).splitlines(keepends=True)


def _items(values: list, indent: int) -> list[str]:
    """List items as lines, their dashes at ``indent``."""
    lines = dump({"x": values}).splitlines(keepends=True)[1:] if values else []
    return [" " * indent + x[2:] if x.strip() else x for x in lines]


def _source(lines: list[str], n: yaml.Node) -> str:
    a, z = n.start_mark, n.end_mark
    if a.line == z.line:
        return lines[a.line][a.column : z.column]
    return " ".join([lines[a.line][a.column :].strip(), *(x.strip() for x in lines[a.line + 1 : z.line]), lines[z.line][: z.column].strip()]).strip()


def serialise(fm: dict, body: str, raw: str | None = None) -> str:
    """A concept's file: fences, frontmatter, body; a blank line only before a body that had no frontmatter."""
    block = splice(raw, fm) if raw is not None else dump(fm)
    return f"---\n{block}---\n" + ("" if raw is not None else "\n" * bool(body)) + body.replace("\r\n", "\n")
