"""Text rules as Columns: slugs, titles, hashtags, paths, dates, escapes and predicates.

Everything here stays inside the JVM's generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spec import RESERVED, STATUSES

Text = Column | str


def _c(x: Text) -> Column:
    return F.col(x) if isinstance(x, str) else x


# reading


def normalise_input(text: Text) -> Column:
    """Without a byte-order mark; lone carriage returns become line feeds."""
    return F.regexp_replace(F.regexp_replace(_c(text), "^﻿", ""), "\r(?!\n)", "\n")


def input_notes(text: Text) -> Column:
    """What :func:`normalise_input` changes, as notes."""
    t = _c(text)
    return F.filter(F.array(F.when(t.startswith("﻿"), "byte-order mark removed"), F.when(t.rlike("\r(?!\n)"), "lone carriage returns became line feeds")), lambda n: n.isNotNull())


def opens_fence(text: Text) -> Column:
    """Frontmatter opens at the first character."""
    return _c(text).rlike(r"\A---(\r?\n|\z)")


def frontmatter(text: Text) -> Column:
    """Text between the opening fence and the next line that is exactly ``---``; null where there is no such block."""
    m = F.regexp_extract(_c(text), r"(?s)\A---\r?\n(.*?)(?:(?<=\n)|\A)---(?:\r?\n|\z)", 1)
    closed = _c(text).rlike(r"(?s)\A---\r?\n(?:.*?\n)?---(?:\r?\n|\z)")
    return F.when(closed, m)


def body(text: Text) -> Column:
    """What follows the frontmatter, or the whole text."""
    return F.when(frontmatter(text).isNotNull(), F.regexp_replace(_c(text), r"(?s)\A---\r?\n(?:.*?\n)?---(?:\r?\n|\z)", "")).otherwise(_c(text))


def concept_id(rel_path: Text) -> Column:
    """Path without ``.md``; empty for reserved names and other suffixes (both by exact case)."""
    p = _c(rel_path)
    name = F.element_at(F.split(p, "/"), -1)
    return F.when(name.isin(*RESERVED) | ~p.endswith(".md"), "").otherwise(F.regexp_replace(p, r"\.md$", ""))


# slugs, titles, tags


def heading_slug(text: Text) -> Column:
    """Anchor of a heading: lower case, no tags, only letters, digits, ``_``, ``-``; each blank a dash."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(_c(text)), "<[^>]*>", ""), "[^a-z0-9_ -]", ""), " ", "-")


def title_slug(text: Text) -> Column:
    """Key for resolving links by title: runs of other characters become one dash."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_c(text))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def hashtags(text: Text) -> Column:
    """Distinct tags by first appearance."""
    return F.array_distinct(F.regexp_extract_all(_c(text), F.lit(r"(^|\s)#([A-Za-z][A-Za-z0-9_/-]*)"), F.lit(2)))


def first_heading(text: Text) -> Column:
    """First level-one heading without hashtags at its end; null where there is none."""
    line = F.regexp_extract(_c(text), r"(?m)^[ \t]*# (.*)$", 1)
    return F.nullif(F.trim(F.regexp_replace(line, r"(\s+#[A-Za-z][A-Za-z0-9_/-]*)+\s*$", "")), F.lit(""))


def humanise(name: Text) -> Column:
    """A file's name as a title: no suffix, blanks for dashes, each word's first letter in upper case."""
    bare = F.regexp_replace(F.regexp_replace(F.element_at(F.split(_c(name), "/"), -1), r"\.[^.]*$", ""), "[-_]", " ")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def sanitise(name: Text) -> Column:
    """An identifier: other characters become ``_``; never empty, never a digit first."""
    s = F.regexp_replace(_c(name), "[^A-Za-z0-9_]", "_")
    return F.when(s == "", "_").when(s.rlike("^[0-9]"), F.concat(F.lit("_"), s)).otherwise(s)


# paths


def clean_path(path: Text) -> Column:
    """``.``, empty and ``..`` segments resolved; ``..`` beyond the start stays, or vanishes in a rooted path."""
    p = _c(path)
    rooted = p.startswith("/")

    def step(acc: Column, s: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        return F.when(s.isin("", "."), acc).when((s == "..") & up, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when((s == "..") & rooted, acc).otherwise(F.array_append(acc, s))

    parts = F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), lambda acc, s: F.when((s == "..") & (F.size(acc) == 0) & rooted, acc).otherwise(_guarded(acc, s, step)))
    joined = F.array_join(parts, "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)


def _guarded(acc: Column, s: Column, step) -> Column:
    """``step`` only ever looks at the last element of a list that has one."""
    return F.when(F.size(acc) == 0, F.when(s.isin("", "."), acc).otherwise(F.array_append(acc, s))).otherwise(step(acc, s))


def directory(path: Text) -> Column:
    """The part before the last slash; ``.`` for none."""
    d = F.regexp_extract(_c(path), "^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def under(path: Text, root: Text) -> Column:
    """Same path, or below it by whole segments."""
    return (_c(path) == _c(root)) | _c(path).startswith(F.concat(_c(root), F.lit("/")))


def file_address(target: Text) -> Column:
    """The path of a ``file:`` address of this machine, decoded and cleaned; null for other targets and hosts."""
    t = F.element_at(F.split(_c(target), "#"), 1)
    host, path = F.regexp_extract(t, "(?i)^file:(?://([^/]*))?(/.*)$", 1), F.regexp_extract(t, "(?i)^file:(?://([^/]*))?(/.*)$", 2)
    local = (path != "") & F.lower(host).isin("", "localhost")
    return F.when(local, clean_path(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))))


# predicates

_SCHEME = r"^(mailto|tel|ftp):"


def is_external_reference(target: Text) -> Column:
    """As the converter judges: empty, an anchor, any scheme with ``://``, mail or telephone."""
    t = F.lower(_c(target))
    return (t == "") | t.startswith("#") | t.contains("://") | t.rlike(_SCHEME)


def is_external_when_read(target: Text) -> Column:
    """As the bundle's reader judges: an explicit scheme or an anchor."""
    t = _c(target)
    return t.contains("://") | t.startswith("#") | t.startswith("mailto:")


def is_concept_reference(target: Text) -> Column:
    """As the linter judges: points at a markdown file of the bundle."""
    t = _c(target)
    local = (t != "") & ~t.startswith("#") & ~t.contains("://") & ~t.rlike(_SCHEME)
    return local & F.lower(F.element_at(F.split(t, "#"), 1)).endswith(".md")


def is_actor(actor: Text) -> Column:
    """``human:x``, ``process:x``, ``team:x`` or ``producer/version`` without blanks."""
    a = F.trim(_c(actor))
    prefixed = a.rlike("^(human|process|team):")
    return F.when(prefixed, a.rlike("^(human|process|team):.+")).otherwise(a.rlike("^[^/]+/.+") & ~a.rlike("[ \t]"))


def is_iso_date(s: Text) -> Column:
    return _c(s).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(_c(s), "yyyy-MM-dd").isNotNull()


def is_iso_datetime(s: Text) -> Column:
    """A date, or a date and a time with minutes, seconds, fractions and a zone."""
    day = F.substring(_c(s), 1, 10)
    timed = _c(s).rlike(r"^[0-9-]{10}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})?)?$")
    return is_iso_date(s) | (is_iso_date(day) & timed)


def is_status(status: Text) -> Column:
    return _c(status).isin(*STATUSES)


# dates


def shifted_date(day: Text, rule: Text) -> Column:
    """``+3d``, ``+1m``, ``+2y`` after a date, or an ISO date as it is; days beyond a month's end run into the next."""
    d = F.to_date(_c(day))
    n, unit = F.regexp_extract(_c(rule), r"^\+(\d+)[dmy]$", 1).try_cast("int"), F.regexp_extract(_c(rule), r"^\+\d+([dmy])$", 1)
    months = F.when(unit == "y", 12 * n).otherwise(n)
    moved = F.date_add(F.add_months(F.trunc(d, "MM"), months), F.dayofmonth(d) - 1)
    return F.when(unit == "d", F.date_format(F.date_add(d, n), "yyyy-MM-dd")).when(unit.isin("m", "y"), F.date_format(moved, "yyyy-MM-dd")).when(is_iso_date(rule), _c(rule))


# escapes


def sql_literal(value: Text) -> Column:
    """A quoted SQL string; NULL for null."""
    q = _c(value)
    for a, b in (("\\", "\\\\"), ("'", "\\'"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return F.coalesce(F.concat(F.lit("'"), q, F.lit("'")), F.lit("NULL"))


def dot_literal(value: Text) -> Column:
    q = F.replace(F.replace(_c(value), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(q, F.lit("\n"), F.lit("\\n")), F.lit('"'))


def xml_escape(value: Text) -> Column:
    q = _c(value)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        q = F.replace(q, F.lit(a), F.lit(b))
    return q
