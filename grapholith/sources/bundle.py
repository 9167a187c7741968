"""Reading markdown folders: corpora to convert, and bundles of concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import markdown as md
from ..functions import text as t
from ..functions.spec import DEFAULT_TYPE, MARKER, VERSION_KEY
from ..operators.resolve import read_target

_GLOB = "*.[mM][dD]"


def files(spark: SparkSession, root: str, hidden: bool = True) -> DataFrame:
    """(rel_path, text, notes) of every markdown file under ``root``, normalised; order is left to sinks."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", _GLOB).load(root).select("path", "content")
    base = root.removeprefix("file:").rstrip("/").lstrip("/")
    rel = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", "^file:/*", ""), "^" + _quoted(base) + "/", ""), "^/+", "")
    text = F.decode("content", "UTF-8")
    out = raw.select(F.url_decode(F.replace(rel, F.lit("+"), F.lit("%2B"))).alias("rel_path"), t.normalise_input(text).alias("text"), t.input_notes(text).alias("notes"))
    return out if hidden else out.where(~F.col("rel_path").rlike(r"(^|/)(\.[^/]+|node_modules)(/|$)"))


def _quoted(s: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "/" else c for c in s)


def concepts(found: DataFrame) -> DataFrame:
    """Parsed files (rel_path, text): id, frontmatter, body, trust, links and what the author wrote before defaults."""
    p = found.withColumn("p", fm.parse(F.col("text")))
    x = p.select("rel_path", t.concept_id("rel_path").alias("id"), F.col("p.fm").alias("fm"), F.col("p.raw").alias("raw"), F.col("p.body").alias("body"), F.col("p.error").alias("error"))
    typed = F.coalesce(F.trim(fm.text_value(F.col("fm"), "type")), F.lit(""))
    title = F.coalesce(fm.text_value(F.col("fm"), "title"), F.lit(""))
    recovered = F.coalesce(F.get_json_object(fm.raw_value(F.col("fm"), MARKER), "$.recovered") == "true", F.lit(False)) | F.col("error").isNotNull()
    return x.withColumns({"type": typed, "title": title, "trust": fm.trust(F.col("fm")), "has_runtime": fm.raw_value(F.col("fm"), "runtime").isNotNull(), "recovered": recovered, "md": md.parse(F.col("body"))})


def bundle(spark: SparkSession, root: str, hidden: bool = True) -> DataFrame:
    """The concepts of a bundle: no reserved files, no files that don't parse."""
    return concepts(files(spark, root, hidden).where(t.concept_id("rel_path") != "")).where("error is null")


def bundle_links(c: DataFrame) -> DataFrame:
    """(concept_id, ordinal, raw_target, text, target_id, resolved) of a bundle's own links."""
    x = c.select(F.col("id").alias("concept_id"), F.posexplode("md.links").alias("ordinal", "l"))
    target = read_target(F.col("l")["dest"], F.col("concept_id"))
    return x.select("concept_id", "ordinal", F.col("l")["dest"].alias("raw_target"), F.col("l")["text"].alias("text"), target.alias("target_id")).withColumn("resolved", F.col("target_id") != "")


def anchors(c: DataFrame) -> DataFrame:
    return c.select(F.col("id").alias("concept_id"), F.explode("md.headings").alias("h")).select("concept_id", "h.slug")


def facts(c: DataFrame) -> DataFrame:
    """(concept_id, title_present, type_present, recovered, error) before any default."""
    return c.select(F.col("id").alias("concept_id"), (F.col("title") != "").alias("title_present"), (F.col("type") != "").alias("type_present"), "recovered", "error")


def with_defaults(c: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Type: authored, of the longest folder in ``types``, or the default; title: authored, first heading, file name."""
    from ..operators.resolve import longest_prefix

    named = longest_prefix(c, "__dir", {k: v for k, v in (types or {}).items() if k != "default"}, F.lit((types or {}).get("default", DEFAULT_TYPE)))
    x = c.withColumn("__dir", t.directory("rel_path"))
    kind = F.when(F.col("type") != "", F.col("type")).otherwise(named)
    title = F.coalesce(F.nullif("title", F.lit("")), t.first_heading("body"), t.humanise("rel_path"))
    return x.withColumn("type", kind).withColumn("title", title).drop("__dir")


def root_version(found: DataFrame, key: str = VERSION_KEY) -> DataFrame:
    """(version) that the root index declares under ``key``, in the first such line."""
    line = F.regexp_extract("text", rf"(?m)^{key}:[ \t]*[\"']?([^\"'\r\n]*)", 1)
    return found.where("rel_path = 'index.md'").select(F.trim(line).alias("version"))


def output_paths(found: DataFrame) -> DataFrame:
    """(rel_path, output_path): reserved names become ``index-note.md``, ``index-note-2.md`` and so on where that is taken."""
    stem = F.regexp_replace("rel_path", r"\.md$", "-note")
    reserved = found.where(F.element_at(F.split("rel_path", "/"), -1).isin("index.md", "log.md")).select("rel_path", stem.alias("stem"))
    like = F.regexp_extract("rel_path", r"^((?:.*/)?(?:index|log)-note)(?:-([2-9]|[1-9][0-9]+))?\.md$", 1)
    number = F.regexp_extract("rel_path", r"-note-([0-9]+)\.md$", 1)
    taken = found.select(like.alias("stem"), F.when(number == "", 1).otherwise(number.try_cast("int")).alias("n")).where("stem <> '' and n is not null")
    free = F.aggregate(F.sort_array(F.collect_set("n")), F.lit(1), lambda acc, n: F.when(n == acc, acc + 1).otherwise(acc))  # the least number that isn't taken
    named = reserved.join(taken.groupBy("stem").agg(free.alias("n")), "stem", "left")
    name = F.concat("stem", F.when(F.coalesce("n", F.lit(1)) > 1, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), F.lit(".md"))
    renamed = named.select("rel_path", name.alias("output_path"))
    return found.select("rel_path").join(renamed, "rel_path", "left").select("rel_path", F.coalesce("output_path", "rel_path").alias("output_path"))
