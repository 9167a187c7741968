import json
import re

import pytest
from pyspark.sql import functions as F

from grapholith.functions import frontmatter as fm
from grapholith.functions import markdown as md
from grapholith.functions import text as t
from grapholith.functions import trust as tr
from grapholith.operators import analytics as an
from grapholith.operators import convert as cv
from grapholith.operators import graph as g
from grapholith.operators import resolve as rs
from grapholith.sources import bundle as bd
from grapholith.sources import sinks

CORPUS = {
    "README.md": "# Welcome\n\nSee [orders](tables/orders.md#schema) and [[Set Up]].\n",
    "tables/orders.md": "---\ntype: Table\ntitle: Orders\ntags: [sales]\nverified:\n  - by: human:ann\n    at: 2024-01-02\nstale_after: 2024-05-01\n---\n# Orders #core\n\n## Schema\n\n`[no](link.md)` [[README|home]] [gone](missing.md)\n",
    "guides/setup.md": "---\ntitle: Set Up\nrelated: '[[Orders]]'\nsource: https://x.org/a\n---\nText #howto\n\n    [code](x.md)\n",
    "broken.md": "---\na: [1\n---\nbody\n",
    "notes/index.md": "# Index\n",
}


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus") / "a b+c"
    for name, text in CORPUS.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_text_rules(spark):
    cases = [
        (t.heading_slug(F.lit("A <b>b</b>  C! d_e")), "a-b--c-d_e"), (t.title_slug(F.lit("  Orders & Co. ")), "orders-co"), (t.humanise(F.lit("x/set-up_GUIDE.md")), "Set Up GUIDE"),
        (t.first_heading(F.lit("x\n# Title #a #b\n# Two")), "Title"), (t.hashtags(F.lit("#a b #c-d\n#a x#no #1")), ["a", "c-d"]), (t.sanitise(F.lit("9 a-b")), "_9_a_b"), (t.sanitise(F.lit("")), "_"),
        (t.clean_path(F.lit("a/./b/../c//d")), "a/c/d"), (t.clean_path(F.lit("../a")), "../a"), (t.clean_path(F.lit("/../a")), "/a"), (t.clean_path(F.lit("a/..")), "."),
        (t.shifted_date(F.lit("2024-01-31"), F.lit("+1m")), "2024-03-02"), (t.shifted_date(F.lit("2024-02-29"), F.lit("+1y")), "2025-03-01"), (t.shifted_date(F.lit("2024-01-01"), F.lit("+3d")), "2024-01-04"),
        (t.is_actor(F.lit("human:")), False), (t.is_actor(F.lit("tool/1.0")), True), (t.is_actor(F.lit("a tool/1")), False), (t.is_iso_date(F.lit("2024-02-30")), False), (t.is_iso_datetime(F.lit("2024-02-03T10:20:30.5Z")), True),
        (t.is_concept_reference(F.lit("A.MD#x")), True), (t.is_concept_reference(F.lit("http://a/b.md")), False),
        (t.concept_id(F.lit("a/b.md")), "a/b"), (t.concept_id(F.lit("a/index.md")), ""), (t.sql_literal(F.lit("a'b\\")), "'a\\'b\\\\'"), (t.frontmatter(F.lit("---\na: 1\n---\nx")), "a: 1\n"), (t.body(F.lit("---\na: 1\n---\nx")), "x"),
        (tr.tier(F.from_json(F.lit('[{"by":"human:x"}]'), "array<struct<by:string,at:string>>")), "human-reviewed"), (tr.tier(F.lit(None).cast("array<struct<by:string,at:string>>")), "unverified"),
        (an.type_of_file(F.lit("adr-1.md")), "Decision"), (an.type_of_folder(F.lit("x/Policies")), "Policy"), (an.type_of_folder(F.lit("team-stories")), "TeamStory"),
    ]
    for column, want in cases:
        assert one(spark, column) == want, column


def test_yaml_keeps_texts_and_order():
    assert fm.load("b: 2024-01-02\na: yes\nn: ~\ni: 12\nf: 1.5\nq: '12'\nl: [1, {x: y}]\n") == {"b": "2024-01-02", "a": "yes", "n": None, "i": 12, "f": 1.5, "q": "12", "l": [1, {"x": "y"}]}
    assert fm.split("---\na: 1\n---\nbody") == ("a: 1\n", "body") and fm.split("x") == (None, "x")
    assert fm.parsed("---\na: [1\n---\n")["error"] and fm.parsed("---\na: 1\n")["error"] and fm.parsed("---\n- a\n---\n")["error"]


@pytest.mark.parametrize("raw, change, want", [
    ("a: 1 # c\nb: x\n", {"b": "y"}, "a: 1 # c\nb: y\n"),
    ("tags: [s, 't']\nz: 1\n", {"tags": ["s", "t", "u"]}, "tags:\n  - s\n  - 't'\n  - u\nz: 1\n"),
    ("l:\n  - a # one\n  - b\nz: 1\n", {"l": ["a", "b", "c"]}, "l:\n  - a # one\n  - b\n  - c\nz: 1\n"),
    ("v:\n  by: human:a\n  at: x\n", {"v": [{"by": "human:a", "at": "x"}, {"by": "b"}]}, "v:\n  - by: human:a\n    at: x\n  - by: b\n"),
    ("a: 1\nb: 2\n", {"b": None, "c": "n"}, "a: 1\nc: n\n"),
])
def test_splice_keeps_what_did_not_change(raw, change, want):
    new = {k: v for k, v in {**fm.load(raw), **change}.items() if v is not None}
    assert fm.splice(raw, new) == want and fm.load(want) == new
    assert fm.splice(raw, fm.load(raw)) == raw


def test_markdown_in_one_pass():
    p = md.parsed("# A\n\n[x](y.md) ![i](p.png) <http://u.v> [r][k] `[c](d.md)` [[W|al]]\n\n```\n[n](o.md) [[no]]\n```\nA\n===\n\n[k]: z.md\n# Citations\n- [T](http://c)\n- http://d\n- plain\n")
    assert [(x["text"], x["dest"]) for x in p["links"]] == [("x", "y.md"), ("i", "p.png"), ("", "http://u.v"), ("r", "z.md"), ("T", "http://c")]
    assert [w["target"] for w in p["wikilinks"]] == ["W"] and [h["slug"] for h in p["headings"]] == ["a", "a-1", "citations"]
    assert p["citations"] == [{"title": "T", "resource": "http://c"}, {"title": "", "resource": "http://d"}, {"title": "plain", "resource": ""}]
    assert md.rewrite("[a](b.md) `[a](b.md)` [[W]] [[no]]", {"b.md": "/c.md"}, {"W": ("/w.md", "Dub")}) == "[a](/c.md) `[a](b.md)` [Dub](/w.md) [[no]]"


def test_read_and_convert(spark, corpus, tmp_path):
    found = bd.files(spark, corpus)
    assert {r["rel_path"] for r in found.collect()} == set(CORPUS)
    out = cv.convert(found, "2024-06-01T00:00:00Z", cv.Options(fm_refs=("related",)))
    rows = {r["output_path"]: r["text"] for r in out.files.collect()}
    assert set(rows) == {"README.md", "tables/orders.md", "guides/setup.md", "broken.md", "notes/index-note.md"}
    assert "[orders](/tables/orders.md#schema)" in rows["README.md"] and "[Set Up](/guides/setup.md)" in rows["README.md"]
    assert "`[no](link.md)` [home](/README.md) [gone](missing.md)" in rows["tables/orders.md"] and "  - sales\n  - core\n" in rows["tables/orders.md"]
    assert "## Related" in rows["guides/setup.md"] and "[Orders](/tables/orders.md)" in rows["guides/setup.md"] and "howto" in rows["guides/setup.md"]
    assert "x_recovery" in rows["broken.md"] and rows["broken.md"].endswith("a: [1\n---\nbody\n")
    again = {r["output_path"]: r["text"] for r in cv.convert(found, "2024-06-01T00:00:00Z", cv.Options(fm_refs=("related",))).files.collect()}
    assert rows == again
    sinks.write_files(out.files.select(F.col("output_path").alias("path"), "text"), str(tmp_path / "out"))
    c = bd.bundle(spark, str(tmp_path / "out")).cache()
    n, e = g.nodes_of(c, "2024-06-01"), g.edges_of(bd.bundle_links(c))
    by = {r["id"]: r for r in n.collect()}
    assert by["tables/orders"]["tier"] == "human-reviewed" and by["tables/orders"]["stale"] and by["README"]["title"] == "Welcome"
    assert {(r["from"], r["to"]) for r in e.collect()} >= {("README", "tables/orders"), ("README", "guides/setup"), ("tables/orders", "README"), ("guides/setup", "tables/orders"), ("tables/orders", "tables/missing")}
    assert [tuple(r) for r in an.dangling(e, n).select("from", "to").collect()] == [("tables/orders", "tables/missing")]
    roles = {r["id"]: r["role"] for r in an.node_roles(n, e, False).collect()}
    assert roles == {"README": "linked", "tables/orders": "linked", "guides/setup": "linked", "broken": "orphan", "notes/index-note": "orphan"}
    for kind in ("dot", "graphml", "html"):
        assert "tables/orders" in sinks.export(n, e, kind)
    assert len(json.loads(sinks.export(n, e, "json"))["nodes"]) == 5
    bad = an.broken_links(bd.bundle_links(c), n, bd.anchors(c)).collect()
    assert [tuple(r) for r in bad] == [("tables/orders", "missing.md")]
    lines = an.catalog(c, an.catalog_edges(n, e, True)).collect()
    assert [r["type"] for r in lines][-1] == "Table" and "backlink: [Welcome](/README.md) (orders)" in lines[-1]["line"]


def test_validation_findings(spark):
    text = "---\ntype: Attested Computation\ngenerated: {by: '', at: x}\nverified: [{by: bad actor}, {at: y}]\nstatus: odd\nstale_after: soon\nsources: [{title: t, author: no}]\nusage_window: {from: a}\n---\n"
    df = spark.createDataFrame([("a.md", text), ("b.md", "---\nx: [\n---\n"), ("c.md", "---\ntype: T\n---\n")], "rel_path string, text string")
    f = an.validate(bd.concepts(df)).cache()
    rows = f.orderBy("rel_path", "at").collect()
    assert [r["message"].split(" ")[0] for r in rows if r["rel_path"] == "a.md"] == ["generated", "generated.at", "verified[0].by", "verified[1]", "verified[1].at", "status", "stale_after", "sources[0]", "sources[0].author", "usage_window.from", "Attested"]
    assert [r["severity"] for r in rows if r["rel_path"] == "b.md"] == ["error"] and not any(r["rel_path"] == "c.md" for r in rows)
    assert tuple(an.conformance(f).first()) == (1, 11, False)


def test_resolution_cascade(spark):
    files = spark.createDataFrame([("a/x", "a/x", "Same"), ("b/x", "b/x", "Other"), ("b/y", "b/y", "Same"), ("z", "z", "Unique One")], "source_path string, output_path string, title string")
    ask = [("1", ".", "a/x"), ("2", "a", "./x.md"), ("3", ".", "x"), ("4", ".", "Y"), ("5", ".", "same"), ("6", ".", "unique one"), ("7", ".", "../z"), ("8", "b", "/z")]
    got = {r["link_id"]: r["target_id"] for r in rs.resolve(spark.createDataFrame(ask, "link_id string, from_dir string, target string"), files).collect()}
    assert got == {"1": "a/x", "2": "a/x", "3": "", "4": "b/y", "5": "", "6": "z", "7": "", "8": "z"}


def test_infer_types(spark):
    rows = [("d", "a.md", "Table"), ("d", "b.md", "Table"), ("d", "c.md", None), ("e", "adr-1.md", ""), ("e", "adr-2.md", None), ("e", "x.md", None), ("guides", "x.md", None), ("o", "x.md", "Z")]
    got = {r["dir"]: (r["type"], r["tier"]) for r in an.infer_types(spark.createDataFrame(rows, "dir string, name string, authored string"), {"o": "Given"}).collect()}
    assert got == {"d": ("Table", "frontmatter"), "e": ("Decision", "pattern"), "guides": ("Guide", "folder"), "o": ("Given", "override")}


def test_infer_types_by_frontmatter_keys(spark):
    rows = [("p", "adr-1.md", None, ["goal", "title"]), ("p", "adr-2.md", None, None), ("m", "x.md", None, ["formula", "metric"]), ("m", "y.md", None, ["sql"]), ("m", "z.md", None, ["metric"]), ("w", "a.md", "Own", ["schema"]), ("few", "a.md", None, ["goal"]), ("few", "b.md", None, []), ("few", "c.md", None, ["title"]), ("tie", "a.md", "", ["schema", "query"])]
    got = {r["dir"]: (r["type"], r["tier"]) for r in an.infer_types(spark.createDataFrame(rows, "dir string, name string, authored string, keys array<string>")).collect()}
    assert got == {"p": ("Proposal", "frontmatter"), "m": ("Metric", "frontmatter"), "w": ("Own", "frontmatter"), "few": ("Few", "folder"), "tie": ("Schema", "frontmatter")}


DEEP = "[" * 3000 + "]" * 3000
BOMB = "a: &a [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"{b}: &{b} [{', '.join(['*' + a] * 10)}]\n" for a, b in zip("abcdef", "bcdefg"))


@pytest.mark.parametrize("raw, reason", [("a: &x [*x]\n", "deeply"), (f"a: {DEEP}\n", "deeply"), ("? {b: c}\n: d\n", "scalar"), ("[a]: b\n", "scalar"), (BOMB, "many"), ("a: 1\na: 2\n", "twice"), ("- x\n", "mapping"), ("a: [1\n", ""), ("a: \x07\n", "")])
def test_no_frontmatter_fails_a_job(raw, reason):
    got = fm.parsed(f"---\n{raw}---\nbody\n")
    assert got["fm"] == [] and got["body"] == f"---\n{raw}---\nbody\n" and reason in got["error"]


def test_numbers_beyond_their_range_stay_texts():
    raw = f"a: {'7' * 5000}\nb: 9223372036854775808\nc: -9223372036854775808\nd: 1e999\ne: 0x1F\nf: 1.5\n"
    assert fm.load(raw) == {"a": "7" * 5000, "b": "9223372036854775808", "c": -(1 << 63), "d": "1e999", "e": 31, "f": 1.5}
    assert fm.parsed(f"---\n{raw}---\n")["error"] is None


def test_stamps_and_sources():
    o = cv.Options(verified_by="human:me")
    mine, other = {"by": "human:me", "at": "t"}, {"by": "human:you", "at": "s"}
    assert cv.sign(None, "t", o) == ([mine], "") and cv.sign(other, "t", o) == ([other, mine], "")
    assert cv.sign([mine], "t", o) == (None, "") and cv.sign([mine], "u", o)[0] == [mine, {"by": "human:me", "at": "u"}]
    assert cv.sign("yes", "t", o)[0] is None and "yes" in cv.sign("yes", "t", o)[1]
    quiet = cv.Options(verified_by="human:me", explicit=False)
    assert cv.sign([other], "t", quiet)[0] is None and "human:you" in cv.sign([other], "t", quiet)[1] and cv.sign([mine], "u", quiet)[0]
    o = cv.Options(source_keys=("source", "author", "none", "blank"), map_citations=True)
    cited = [{"title": "T", "resource": "r"}, {"title": "", "resource": "http://a"}, {"title": "T", "resource": "r"}]
    got = cv.sources({"source": " http://a ", "author": "human:x", "blank": " ", "sources": [{"resource": "r", "title": "T"}, "odd"]}, cited, o)
    assert got == [{"resource": "r", "title": "T"}, "odd", {"resource": "http://a"}, {"author": "human:x"}]
    assert cv.sources({}, [], o) is None and cv.has_text({"a": " "}, "a") is False and cv.has_text({"a": 0}, "a") and cv.is_true(" TRUE ") and not cv.is_true(1)


def test_arguments():
    assert cv.parse_map(" a/b/ = T , default=D,") == {"a/b": "T", "default": "D"} and cv.parse_map("") == {}
    for bad in ("a", "=b", "a="):
        with pytest.raises(ValueError):
            cv.parse_map(bad)
    assert [cv.version_number(v) for v in ("v1.2", "1.2", "V3", "vx")] == ["1.2", "1.2", "3", "vx"]
    given = {"a": "wip", "b": "odd", "c": "draft"}
    same, told, warned = cv.resolved_statuses(given, False)
    assert same == given and len(told) == len(warned) == 2 and "'draft'" in warned[1]
    real, told, warned = cv.resolved_statuses(given, True)
    assert real == {"a": "draft", "b": "odd", "c": "draft"} and len(told) == 2 and len(warned) == 1


def test_convert_with_options(spark):
    rows = [("n/a.md", "---\ntype: T\ndraft: true\nstatus: ' '\nsource: http://s\nverified: yes please\n---\n# A\n[b](file:///home/me/work/n/b%20c.md#x) [o](file:///home/me/other/z.md) [e](file:///elsewhere/z.md) [r](file://host/home/me/work/n/a.md) [w](file:///home/me/work2/q.md)\n"), ("n/b c.md", "# B\r\n## X\n"), ("index.md", "bundle_version: '0.2'\n"), ("log.md", "l"), ("index-note.md", "i")]
    found = spark.createDataFrame(rows, "rel_path string, text string")
    o = cv.Options(map_draft=True, source_keys=("source",), verified_by="human:me", root="/home/me/work", workspace="/home/me/work", external_roots=("/home/me/other",), statuses={"default": "active"}, stale={"n": "+1m"})
    out = cv.convert(found, "2024-01-31T00:00:00Z", o)
    files = {r["output_path"]: r["text"] for r in out.files.collect()}
    assert set(files) == {"n/a.md", "n/b c.md", "index-note.md", "index-note-2.md", "log-note.md"}
    a = files["n/a.md"]
    assert "status: draft" in a and "stale_after: '2024-03-02'" in a and "verified: yes please" in a and "  - resource: http://s" in a
    assert "[b](/n/b c.md#x)" in a and "file:///home/me/other/z.md" in a and "file://host/" in a
    assert "status: active" in files["n/b c.md"] and "by: human:me\n    at: '2024-01-31T00:00:00Z'" in files["n/b c.md"]
    notes = sorted((r["rel_path"], r["note"]) for r in out.notes.collect())
    assert [n[0] for n in notes] == ["", "n/a.md", "n/a.md", "n/a.md", "n/a.md"] and sum("outside" in n[1] for n in notes) == 2 and sum("another machine" in n[1] for n in notes) == 1
    assert {r["part"]: r["n"] for r in out.gate().collect()} == {"unresolved": 4}
    assert {r["path"] for r in out.bundle().collect()} == {*files, "index.md", "n/index.md"}
    assert bd.root_version(found).first()["version"] == "0.2"
    plan = cv.enrich(found, "2024-01-31T00:00:00Z", options=o)
    assert {r["part"]: r["n"] for r in cv.enrich_gate(plan).collect()} == {"skipped": 0, "notes": 4}
    assert cv.convert(found.where("false"), "2024-01-31T00:00:00Z").index.count() == 1
    with pytest.raises(ValueError):
        cv.convert(found, "2024-01-31T00:00:00Z", cv.Options(verified_by="nobody"))
    with pytest.raises(ValueError):
        cv.enrich(found, "2024-01-31T00:00:00Z", overwrite=("verified",))


def test_carriage_returns_keep_comments(spark):
    row = {"fm": [{"key": "a", "value": "1"}, {"key": "type", "value": '"T"'}, {"key": "title", "value": '"x"'}], "raw": "a: 1 # why\r\ntype: T\r\ntitle: x\r\n", "body": "b\n", "error": None, "type": "T", "title": "x", "markdown": [], "wiki": [], "related": []}
    got = cv.complete(row, "2024-01-01T00:00:00Z", "", "", cv.Options())
    assert got["text"].startswith("---\na: 1 # why\ntype: T\n") and "\r" not in got["text"] and len(got["notes"]) == 1


def test_sinks(spark, tmp_path):
    n = spark.createDataFrame([("b", 't"x'), ("a", None)], "id string, title string")
    sinks.write_csv(n, str(tmp_path / "n"), ("id",))
    text = "".join(p.read_text() for p in sorted((tmp_path / "n").glob("part-*")))
    assert text.replace("id,title\n", "") == 'a,""\nb,"t\\"x"\n' or "a," in text
    report = json.loads(sinks.envelope("lint", {"b": 1, "a": "é<"}))
    assert list(report) == ["grapholith", "command", "schema", "result"] and report["result"] == {"b": 1, "a": "é<"} and "é<" in sinks.envelope("x", {"a": "é<"})
    with pytest.raises(ValueError):
        sinks.export(spark.range(sinks.MOST_EXPORTED + 1).select(F.col("id").cast("string")), n, "dot")


def test_catalog_text(spark):
    rows = [("Table", "b.md", "* [B](/b.md)"), ("(untyped)", "z.md", "* [Z](/z.md)"), ("Table", "a.md", "* [A](/a.md)\n  * link: [Z](/z.md)")]
    text = an.catalog_text(spark.createDataFrame(rows, "type string, rel_path string, line string")).first()["text"]
    assert text == "\n# Catalog\n\n## Table\n\n* [A](/a.md)\n  * link: [Z](/z.md)\n* [B](/b.md)\n\n## (untyped)\n\n* [Z](/z.md)\n"


def test_streaming_ingest(spark, tmp_path):
    from grapholith.streaming import ingest

    root = tmp_path / "corpus"
    (root / "d").mkdir(parents=True)
    (root / "d/a.md").write_text("---\ntype: T\n---\n# A\n")
    (root / "b.MD").write_text("\ufeff# B\r")
    (root / "c.txt").write_text("no")
    run = lambda: ingest.ingest(ingest.changes(spark, str(root)), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert run()
    assert {r["rel_path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"d/a.md", "b.MD"}
    (root / "e.md").write_text("---\nx: [\n---\n")
    assert run()
    got = {r["rel_path"]: (r["type"], r["recovered"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"d/a.md": ("T", False), "b.MD": ("", False), "e.md": ("", True)}
    seen = ingest.arrivals(ingest.changes(spark, str(root))).writeStream.format("memory").queryName("arrivals").outputMode("complete").trigger(availableNow=True).start()
    assert seen.awaitTermination(120) and spark.table("arrivals").agg(F.sum("n")).first()[0] == 3


SIMPLE = ["a: x\n", "title: Customer#1\nstatus: stable\nstale_after: \"1999-01-01\"\nat: 'x: #y'\n", "n: 12\nf: 1.5\nb: yes\nt: true\nx: 0x1F\nd: 2000-01-01T00:00:00Z\n", "u: http://x/y#z\ns: a  b (c) -d\n"]
HARDER = ["a: b: c\n", "a: b #c\n", "a:\n  - b\n", "a: |\n  b\n", "a: [x, y]\n", "a: \"x\\ty\"\n", "a: 'it''s'\n", "a: \n", "- a\n", "a: é\n", "a: b:\n", "a: x", "a: b\n c\n", "a: &x y\n", "a: x\ty\n"]


@pytest.mark.parametrize("raw", [*SIMPLE, *HARDER])
def test_a_line_a_key_is_read_as_yaml_reads_it(raw, monkeypatch):
    result = lambda f, *a: _result(f, *a)
    fast = result(fm.load, raw)
    new = {"a": "z", "title": "Customer#1", "tags": ["x", "y"], "generated": {"by": "me", "at": "2000-01-01"}}
    spliced = result(fm.splice, raw, new)
    monkeypatch.setattr(fm, "_SIMPLE", re.compile("(?!)"))  # all by the parser
    assert repr(fast) == repr(result(fm.load, raw)) and spliced == result(fm.splice, raw, new)


def _result(f, *args):
    try:
        return f(*args)
    except fm.FrontmatterError as e:
        return str(e)


def test_simple_frontmatter_needs_no_parser(monkeypatch):
    fm.dump({"status": "stable"})
    monkeypatch.setattr(fm.yaml, "compose", None)
    monkeypatch.setattr(fm.yaml, "dump", None)
    assert [list(fm.load(x)) for x in SIMPLE[:2]] == [["a"], ["title", "status", "stale_after", "at"]]
    assert fm.splice("a: x\n", {"a": "x", "status": "stable"}) == "a: x\nstatus: stable\n"
    with pytest.raises(fm.FrontmatterError, match="twice"):
        fm.load("a: x\na: y\n")


def test_a_list_that_is_there_twice_is_not_remembered():
    one = ["x"]
    assert fm.dump({"a": ["x"], "b": ["x"]}) == "a:\n  - x\nb:\n  - x\n"
    assert "&id001" in fm.dump({"a": one, "b": one}) and "&id001" not in fm.dump({"a": ["x"], "b": ["x"]})


def test_files_are_parsed_and_finished_once(spark):
    found = spark.createDataFrame([("a/b.md", "---\ntype: X\n---\nsee [[c]]\n"), ("a/c.md", "# C\n")], "rel_path string, text string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    done = cv.convert(found, "2024-06-01T00:00:00Z")
    for part in (done.files, done.links, done.facts, done.notes, done.index):
        assert "_parse(" not in plan(part)  # each part parsed all files again, some of them several times
    assert plan(done.files).count("finish(") == 1
    out = cv.enrich(found, "2024-06-01T00:00:00Z")
    assert "finish(" not in plan(out) and {r["rel_path"]: r["status"] for r in out.collect()} == {"a/b.md": "enriched", "a/c.md": "enriched"}
    parts = an.lint(bd.concepts(found), bd.facts(bd.concepts(found)), "2024-06-01")
    assert all("_parse(" not in plan(x) for x in parts.values())
    named = found.select(t.directory("rel_path").alias("dir"), F.element_at(F.split("rel_path", "/"), -1).alias("name"), fm.text_value(fm.parse(F.col("text"))["fm"], "type").alias("authored"))
    assert "_parse(" not in plan(an.infer_types(named))


def test_rows_of_one_row_group_go_to_all_cores(spark):
    from grapholith.plans import corpus as plan

    cores = spark.sparkContext.defaultParallelism
    rows = plan.files(spark, "/root/testdata/sf0.001").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(rows) > 3 * cores and max(r["count"] for r in rows) <= 60  # 185 files, of which one task had 150
