"""Vocabulary of knowledge bundles: reserved names, statuses, trust keys, limits."""

from __future__ import annotations

RESERVED = ("index.md", "log.md")
STATUSES = ("draft", "stable", "deprecated")
STATUS_ALIASES = {"active": "stable", "wip": "draft", "in-progress": "draft", "archived": "deprecated", "legacy": "deprecated"}
TRUST_FIELDS = ("sources", "usage_window", "generated", "verified", "status", "stale_after")
PROTECTED = tuple(f for f in TRUST_FIELDS if f not in ("status", "stale_after")) + ("verified_by",)
UNVERIFIED, MACHINE, HUMAN = "unverified", "machine-confirmed", "human-reviewed"
ATTESTED = "Attested Computation"
DEFAULT_TYPE = "Note"
MARKER = "x_recovery"  # key of the note that a file which couldn't be parsed gets
VERSION, VERSION_KEY = "0.2", "bundle_version"  # what a root index declares, and under which key
MAX_DEPTH, MAX_RESULTS = 5, 1000
NODE_COLUMNS = ("id", "title", "type", "tier", "stale")
NODE_PROPERTIES = ("id", "stale", "tier", "title", "type")

STAMP = "struct<by: string, at: string>"
SOURCE = "struct<id: string, resource: string, title: string, author: string, usage_count: string, last_modified: string>"
TRUST = f"struct<sources: array<{SOURCE}>, usage_window: struct<from: string, to: string>, generated: {STAMP}, verified: array<{STAMP}>, status: string, stale_after: string>"
