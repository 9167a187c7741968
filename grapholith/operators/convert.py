"""From a markdown corpus to a bundle: defaults, resolved links, tags, trust and lifecycle.

Stage one parses every file once and completes types and titles; those tables resolve
all links by joins; stage two rewrites each body and its frontmatter in one Arrow UDF.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import markdown as md
from ..functions import text as t
from ..functions.spec import MARKER, PROTECTED, STATUS_ALIASES, STATUSES, VERSION, VERSION_KEY
from ..sources import bundle as bd
from . import resolve as rs
from .lineage import kept


@dataclass
class Options:
    """What a conversion does besides completing types and titles and resolving links; all off by default."""

    types: dict[str, str] = field(default_factory=dict)  # folder -> type, "default" for the rest
    statuses: dict[str, str] = field(default_factory=dict)  # folder -> status, "default" for the rest
    canonical: bool = False  # statuses' aliases become what they stand for
    stale: dict[str, str] = field(default_factory=dict)  # folder -> +Nd, +Nm, +Ny or a date
    fm_refs: tuple[str, ...] = ()  # frontmatter keys that refer to other files
    source_keys: tuple[str, ...] = ()  # frontmatter keys that name sources
    map_draft: bool = False  # draft: true becomes the status
    map_citations: bool = False  # items under Citations become sources
    verified_by: str = ""  # an actor who attests every concept
    explicit: bool = True  # the actor was named for this run, not by a default: they may co-sign
    root: str = ""  # the corpus folder's absolute path, to resolve file: addresses
    workspace: str = ""  # the folder that such addresses may not leave; the corpus folder if empty
    external_roots: tuple[str, ...] = ()  # other folders that they may point into without a note
    tool: str = "grapholith/0.1.0"
    forget: tuple[str, ...] = ()  # keys that are computed as if they weren't there


@dataclass
class Converted:
    files: DataFrame  # rel_path, output_path, text
    links: DataFrame  # rel_path, kind, target, target_id, resolved
    facts: DataFrame
    notes: DataFrame  # rel_path, note; rel_path is empty for notes on options
    index: DataFrame  # rel_path, text of every folder's index

    def bundle(self) -> DataFrame:
        """(path, text) of all files to write."""
        return self.files.select(F.col("output_path").alias("path"), "text").unionByName(self.index.select(F.col("rel_path").alias("path"), "text"))

    def gate(self) -> DataFrame:
        """(part, n): what fails a strict run."""
        bad = self.links.where("not resolved").select(F.lit("unresolved").alias("part")).unionByName(self.facts.where("recovered").select(F.lit("recovered").alias("part")))
        return bad.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


_PAIRS = "array<struct<k: string, v: string, title: string>>"
_ACTOR = re.compile(r"(human|process|team):.+|(?!(human|process|team):)[^/]+/[^ \t]+")
_TEXT_NOTES = "struct<text: string, notes: array<string>>"


def as_text(value) -> str:
    return "" if value is None else str(value).lower() if isinstance(value, bool) else str(value)


def has_text(fm_: dict, key: str) -> bool:
    """The key is there with more than blanks."""
    return as_text(fm_.get(key)).strip() != ""


def is_true(value) -> bool:
    return value is True or isinstance(value, str) and value.strip().lower() == "true"


def resolved_statuses(statuses: dict[str, str], canonical: bool) -> tuple[dict[str, str], list[str], list[str]]:
    """(statuses, notes, warnings): aliases replaced if ``canonical``; the warnings, among the notes too, are those on values outside the vocabulary."""
    out, told, warned = {}, [], []
    for key, value in sorted(statuses.items()):
        real = STATUS_ALIASES.get(value) if value not in STATUSES else None
        out[key] = real if canonical and real else value
        if canonical and real:
            told.append(f"status {value!r} of {key!r} became {real!r}")
        elif value not in STATUSES:
            warned.append(f"status {value!r} of {key!r} is not one of {'|'.join(STATUSES)}; written unchanged" + (f", stands for {real!r}" if real else ""))
    return out, sorted(told + warned), sorted(warned)


def parse_map(text: str) -> dict[str, str]:
    """``k=v,k=v``: blanks around both are dropped; an entry without key, value or ``=`` is an error; the last of equal keys counts."""
    out = {}
    for entry in filter(None, (x.strip() for x in text.split(","))):
        key, sign, value = (x.strip() for x in entry.partition("="))
        if not (key and sign and value):
            raise ValueError(f"{entry!r} is not key=value")
        out[key if key == "default" else key.strip("/")] = value
    return out


def version_number(text: str) -> str:
    """A version without the v before it."""
    return text[1:] if text[:1] in "vV" and text[1:2].isdigit() else text


def sources(fm_: dict, cited: list[dict], o: Options) -> list | None:
    """The sources with those of the chosen keys, an entry each, and of citations, by first (resource, title, author); None where none is added."""
    found = [{"author" if k == "author" else "resource": as_text(fm_[k]).strip()} for k in o.source_keys if has_text(fm_, k)]
    if o.map_citations:
        found += [e for c in cited if (e := {k: c[k] for k in ("resource", "title") if c[k]})]
    if not found:
        return None
    have = fm_["sources"] if isinstance(fm_.get("sources"), list) else []
    key = lambda e: tuple(as_text(e.get(k)) for k in ("resource", "title", "author")) if isinstance(e, dict) else as_text(e)
    every = {}
    for e in found:
        every.setdefault(key(e), e)
    for e in have:
        every.pop(key(e), None)
    return [*have, *every.values()]


def sign(verified, at: str, o: Options) -> tuple[list | None, str]:
    """(stamps, note): ``verified`` with the actor's stamp; None where it stays, the note says why.

    A value that is neither a stamp nor a list stays as it is. An actor who wasn't named
    for this run doesn't sign what another one attested. An equal stamp isn't repeated.
    """
    if verified is not None and not isinstance(verified, list | dict):
        return None, f"verified: {as_text(verified)!r} is not a stamp or a list of them; kept, nothing appended"
    stamps = [] if verified is None else [verified] if isinstance(verified, dict) else verified
    other = next((by for v in stamps if isinstance(v, dict) and (by := as_text(v.get("by"))) not in ("", o.verified_by)), "")
    if other and not o.explicit:
        return None, f"verified: attested by {other!r}, not signed by {o.verified_by!r}"
    if any(isinstance(v, dict) and (as_text(v.get("by")), as_text(v.get("at"))) == (o.verified_by, at) for v in stamps):
        return None, ""
    return [*stamps, {"by": o.verified_by, "at": at}], ""


def complete(row: dict, now: str, status: str, stale_after: str, o: Options) -> dict:
    """One file's final text, and notes on it."""
    notes, new = [], {e["key"]: json.loads(e["value"]) for e in row["fm"]}
    for key in ("type", "title"):
        if not isinstance(new.get(key), str) or not new[key].strip():
            new[key] = row[key]
    body = md.rewrite(row["body"], {p["k"]: p["v"] for p in row["markdown"]}, {p["k"]: (p["v"], p["title"]) for p in row["wiki"]})
    if row["related"]:
        seen = list(dict.fromkeys((p["v"], p["title"]) for p in row["related"]))
        body = body.rstrip("\n") + "\n\n## Related\n\n" + "".join(f"* [{title}]({path})\n" for path, title in seen)
    parsed = md.parsed(body)
    have = new.get("tags") if isinstance(new.get("tags"), list) else [new["tags"]] if isinstance(new.get("tags"), str) else []
    if fresh := [x for x in parsed["hashtags"] if x not in have]:
        new["tags"] = [*have, *fresh]
    if o.map_draft and is_true(new.get("draft")) and not has_text(new, "status"):
        new["status"] = "draft"
    if (found := sources(new, parsed["citations"], o)) is not None and found != new.get("sources"):
        new["sources"] = found
    if status and not has_text(new, "status"):
        new["status"] = status
    if stale_after and not has_text(new, "stale_after"):
        new["stale_after"] = stale_after
    if o.verified_by:
        stamps, note = sign(new.get("verified"), now, o)
        if stamps is not None:
            new["verified"] = stamps
        notes += [note] * bool(note)
    new.setdefault("generated", {"by": o.tool, "at": now})
    if row["error"]:
        new[MARKER] = {"recovered": True, "reason": row["error"]}
        notes.append(f"frontmatter could not be read, the file became a plain concept: {row['error']}")
    raw = row["raw"]
    if raw is not None and "\r" in raw:  # no splice over carriage returns: the lines get plain ends first, which keeps comments and style
        raw = raw.replace("\r\n", "\n").replace("\r", "\n")
        notes.append("carriage returns in the frontmatter became line feeds")
    return {"text": fm.serialise(new, body, raw), "notes": notes}


def index_files(concepts: DataFrame, version: str = VERSION, key: str = VERSION_KEY) -> DataFrame:
    """(rel_path, text): an index of every folder that has concepts in or below it, and of the root, which declares the version.

    ``concepts``: (rel_path, title, description). A folder's own concepts come first, then its folders, both by path.
    """
    parts = F.split("rel_path", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), (i < F.size(parts) - 1).alias("folder"), F.element_at(parts, i + 1).alias("name")))
    x = concepts.select("title", "description", F.explode(up).alias("u"))
    own = x.where("not u.folder").select("u.*", "title", F.coalesce("description", F.lit("")).alias("description"))
    folders = x.where("u.folder").select("u.*").distinct().select("*", F.col("name").alias("title"), F.lit("").alias("description"))
    line = F.concat(F.lit("* ["), "title", F.lit("]("), "name", F.when(F.col("folder"), "/index.md").otherwise(""), F.lit(")"), F.when(F.col("description") != "", F.concat(F.lit(" - "), "description")).otherwise(""), F.lit("\n"))
    every = own.unionByName(folders).select("dir", "folder", F.struct("name", line.alias("line")).alias("x"))
    dirs = every.groupBy("dir").agg(*[F.sort_array(F.collect_list(F.when(F.col("folder") == f, F.col("x")))).alias(n) for f, n in ((False, "files"), (True, "dirs"))])
    root = concepts.sparkSession.createDataFrame([("",)], "dir string")
    dirs = root.unionByName(dirs.select("dir").where("dir <> ''")).join(dirs, "dir", "left")
    listed = lambda c, head: F.when(F.size(c) > 0, F.concat(F.lit(f"# {head}\n\n"), F.array_join(F.transform(c, lambda e: e["line"]), ""))).otherwise("")
    gap = F.when((F.size("files") > 0) & (F.size("dirs") > 0), "\n").otherwise("")
    head = F.when(F.col("dir") == "", f'---\n{key}: "{version}"\n---\n\n').otherwise("")
    path = F.concat(F.col("dir"), F.when(F.col("dir") == "", "").otherwise("/"), F.lit("index.md"))
    return dirs.select(path.alias("rel_path"), F.concat(head, listed("files", "Concepts"), gap, listed("dirs", "Subdirectories")).alias("text"))


def convert(found: DataFrame, now: str, options: Options | None = None, keep: bool = False) -> Converted:
    """Bundle files of a corpus (rel_path, text); a file that doesn't parse becomes a plain concept with a note.

    Files are parsed once, into a table. ``keep``: so are the finished ones, for those who read both them and the notes.
    """
    o = options or Options()
    if o.verified_by and not _ACTOR.fullmatch(o.verified_by.strip()):
        raise ValueError(f"{o.verified_by!r} is no actor")
    statuses, told, _ = resolved_statuses(o.statuses, o.canonical)
    parsed = kept(bd.concepts(found), "parsed")
    if o.forget:
        blank = {k: F.lit("") for k in ("type", "title") if k in o.forget}
        parsed = parsed.withColumn("fm", F.filter("fm", lambda e: ~e["key"].isin(*o.forget))).withColumns(blank)
    c = bd.with_defaults(parsed, o.types).join(bd.output_paths(found), "rel_path")
    authored = bd.facts(parsed.join(bd.output_paths(found), "rel_path").withColumn("id", t.concept_id("output_path")))  # before any default
    bare = lambda col: F.regexp_replace(F.col(col), r"(?i)\.md$", "")
    files = c.select(bare("rel_path").alias("source_path"), bare("output_path").alias("output_path"), "title")
    titles = c.select(bare("output_path").alias("target_id"), F.col("title").alias("target_title"))
    refs = F.array().cast("array<string>")
    for key in o.fm_refs:
        refs = F.concat(refs, fm.text_list(F.col("fm"), key))
    kinds = F.array(F.struct(F.lit("markdown").alias("kind"), F.transform("md.links", lambda l: l["dest"]).alias("targets")), F.struct(F.lit("wiki").alias("kind"), F.transform("md.wikilinks", lambda l: l["target"]).alias("targets")), F.struct(F.lit("related").alias("kind"), refs.alias("targets")))
    asked = c.select("rel_path", F.explode(kinds).alias("x")).select("rel_path", "x.kind", F.posexplode("x.targets").alias("pos", "target")).withColumn("from_dir", t.directory("rel_path"))
    wiki = rs.resolve(asked.where("kind <> 'markdown'").withColumn("link_id", F.concat_ws("\x00", "rel_path", "kind", F.col("pos").cast("string"))), files).drop("link_id")
    addressed = asked.where("kind = 'markdown' and not startswith(target, '#')").withColumn("raw_target", rs.workspace_target(F.col("target"), o.root, o.workspace or o.root))
    plain = rs.resolve_markdown(addressed, files).drop("raw_target")
    links = plain.unionByName(wiki).join(titles, "target_id", "left")
    path = F.concat(F.lit("/"), "target_id", F.lit(".md"), F.when(F.col("kind") == "markdown", F.regexp_extract("target", "(#.*)$", 1)).otherwise(""))
    hit = links.where("resolved").select("rel_path", "kind", "pos", F.struct(F.col("target").alias("k"), path.alias("v"), F.coalesce("target_title", F.lit("")).alias("title")).alias("p"))
    of = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", "p")))), lambda x: x["p"]).alias(kind)
    x = c.join(hit.groupBy("rel_path").agg(*map(of, ("markdown", "wiki", "related"))), "rel_path", "left")
    none = F.lit(None).cast("string")
    status = rs.longest_prefix(x, "rel_path", {k: v for k, v in statuses.items() if k != "default"}, F.lit(statuses.get("default", "")))
    after = F.coalesce(t.shifted_date(F.lit(now[:10]), rs.longest_prefix(x, "rel_path", o.stale, none)), F.lit(""))
    kind = pa.struct([("text", pa.string()), ("notes", pa.list_(pa.string()))])

    @F.arrow_udf(_TEXT_NOTES)
    def finish(rows: pa.Array, status: pa.Array, after: pa.Array) -> pa.Array:
        return pa.array([complete(r, now, s, a, o) for r, s, a in zip(rows.to_pylist(), status.to_pylist(), after.to_pylist())], kind)

    pairs = [F.coalesce(k, F.array().cast(_PAIRS)).cast(_PAIRS).alias(k) for k in ("markdown", "wiki", "related")]
    done = x.select("rel_path", "output_path", finish(F.struct("fm", "raw", "body", "error", "type", "title", *pairs), F.coalesce(status, F.lit("")), after).alias("x"))
    done = kept(done, "finished") if keep else done
    outside = rs.address_note(F.col("target"), o.root, o.workspace or o.root, o.external_roots)
    notes = done.select("rel_path", F.explode("x.notes").alias("note")).unionByName(asked.where("kind = 'markdown'").select("rel_path", outside.alias("note")).where("note is not null"))
    if told:
        notes = notes.unionByName(found.sparkSession.createDataFrame([("", n) for n in told], "rel_path string, note string"))
    ready = c.select(F.col("output_path").alias("rel_path"), "title", fm.text_value(F.col("fm"), "description").alias("description"))
    return Converted(done.select("rel_path", "output_path", "x.text"), links.select("rel_path", "kind", "target", "target_id", "resolved"), authored, notes, index_files(ready))


def overwritable(keys: list[str]) -> list[str]:
    """Keys that enriching may recompute; protected trust keys are refused."""
    if refused := [k for k in keys if k in PROTECTED]:
        raise ValueError(f"protected trust keys can't be overwritten: {', '.join(refused)}")
    return keys


def enrich(found: DataFrame, now: str, overwrite: tuple[str, ...] = (), dry_run: bool = False, options: Options | None = None) -> DataFrame:
    """(rel_path, status, added, overwritten, notes, text): what converting in place would change; keys are told by name."""
    o = replace(options or Options(), forget=tuple(overwritable(list(overwrite))))
    before = bd.concepts(found).select("rel_path", F.col("fm").alias("old"), "error")
    done = convert(found, now, o, keep=True)
    notes = done.notes.groupBy("rel_path").agg(F.sort_array(F.collect_list("note")).alias("notes"))
    x = before.join(done.files.select("rel_path", "text"), "rel_path").join(notes, "rel_path", "left").withColumn("p", fm.parse(F.col("text")))
    keys = lambda c: F.transform(c, lambda e: e["key"])
    added = F.array_except(keys("p.fm"), keys("old"))
    changed = F.array_intersect(keys(F.array_except("p.fm", "old")), keys("old"))
    status = F.when(F.col("error").isNotNull(), "skipped").when((F.size(added) == 0) & (F.size(changed) == 0), "unchanged").otherwise("would-enrich" if dry_run else "enriched")
    return x.select("rel_path", status.alias("status"), added.alias("added"), changed.alias("overwritten"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), "text")


def enrich_gate(enriched: DataFrame) -> DataFrame:
    """(part, n): skipped files and notes, which fail a strict run."""
    n = enriched.agg(F.count_if(F.col("status") == "skipped").alias("skipped"), F.sum(F.size("notes")).alias("notes"))
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias("n")) for k in ("skipped", "notes")])).alias("x")).select("x.*")
