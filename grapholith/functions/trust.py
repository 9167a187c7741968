"""Trust signals: tiers, staleness, stamps and the rules that frontmatter must follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as t
from .spec import ATTESTED, HUMAN, MACHINE, SOURCE, UNVERIFIED


def is_human(by: Column) -> Column:
    return by.startswith("human:")


def tier(verified: Column) -> Column:
    """From an array of (by, at) stamps; a null array counts as empty."""
    n = F.coalesce(F.size(verified), F.lit(0))
    return F.when(n <= 0, UNVERIFIED).when(F.exists(verified, lambda v: F.coalesce(is_human(v["by"]), F.lit(False))), HUMAN).otherwise(MACHINE)


def tier_of_counts(stamps: Column, humans: Column) -> Column:
    return F.when(F.coalesce(stamps, F.lit(0)) == 0, UNVERIFIED).when(humans > 0, HUMAN).otherwise(MACHINE)


def tier_basis(verified: Column) -> Column:
    """The stamps that justify the tier: the human ones, or all of them."""
    humans = F.filter(verified, lambda v: is_human(v["by"]))
    return F.when(F.size(humans) > 0, humans).otherwise(verified)


def stale(stale_after: Column, today: Column) -> Column:
    """Texts are compared as they are: equal to a comparison of dates where both are ISO dates."""
    return F.coalesce((stale_after != "") & (today >= stale_after), F.lit(False))


def attested(type_: Column) -> Column:
    return F.coalesce(type_ == ATTESTED, F.lit(False))


def findings(trust: Column, type_: Column, has_runtime: Column, error: Column) -> Column:
    """All of a concept's findings in one pass: array of (severity, message), in the order of the rules."""

    def rule(when: Column, message: str, *args: Column, severity: str = "advisory") -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.format_string(message, *args).alias("message")))

    def some(c: Column) -> Column:
        return F.coalesce(c != "", F.lit(False))

    g, w = trust["generated"], trust["usage_window"]
    head = F.array(
        rule(error.isNotNull(), "invalid frontmatter: %s", error, severity="error"),
        rule(error.isNull() & F.coalesce(F.trim(type_) == "", F.lit(True)), "missing type", severity="error"),
        rule(g.isNotNull() & ~some(g["by"]), "generated is present but generated.by is empty"),
        rule(some(g["by"]) & ~t.is_actor(g["by"]), 'generated.by "%s" does not follow the actor convention', g["by"]),
        rule(some(g["at"]) & ~t.is_iso_datetime(g["at"]), 'generated.at "%s" is not an ISO 8601 datetime', g["at"]),
    )
    none = F.array().cast("array<struct<by: string, at: string>>")
    stamps = F.flatten(F.transform(F.coalesce(trust["verified"], none), lambda v, i: F.array(
        rule(~some(v["by"]), "verified[%d] is missing 'by'", i),
        rule(some(v["by"]) & ~t.is_actor(v["by"]), 'verified[%d].by "%s" does not follow the actor convention', i, v["by"]),
        rule(some(v["at"]) & ~t.is_iso_datetime(v["at"]), 'verified[%d].at "%s" is not an ISO 8601 datetime', i, v["at"]),
    )))
    state = F.array(
        rule(some(trust["status"]) & ~t.is_status(trust["status"]), 'status "%s" is not one of draft|stable|deprecated', trust["status"]),
        rule(some(trust["stale_after"]) & ~t.is_iso_date(trust["stale_after"]), 'stale_after "%s" is not an absolute YYYY-MM-DD date', trust["stale_after"]),
    )
    sources = F.flatten(F.transform(F.coalesce(trust["sources"], F.array().cast(f"array<{SOURCE}>")), lambda s, i: F.array(
        rule(~some(s["resource"]), "sources[%d] is missing required 'resource'", i),
        rule(some(s["author"]) & ~t.is_actor(s["author"]), 'sources[%d].author "%s" does not follow the actor convention', i, s["author"]),
        rule(some(s["last_modified"]) & ~t.is_iso_date(s["last_modified"]), 'sources[%d].last_modified "%s" is not an absolute YYYY-MM-DD date', i, s["last_modified"]),
    )))
    rest = F.array(
        rule(some(w["from"]) & ~t.is_iso_date(w["from"]), 'usage_window.from "%s" is not an absolute YYYY-MM-DD date', w["from"]),
        rule(some(w["to"]) & ~t.is_iso_date(w["to"]), 'usage_window.to "%s" is not an absolute YYYY-MM-DD date', w["to"]),
        rule(attested(type_) & ~has_runtime, "Attested Computation is missing required 'runtime'"),
    )
    return F.filter(F.concat(head, stamps, state, sources, rest), lambda f: f.isNotNull())
