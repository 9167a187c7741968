"""Personal data and secrets by weak supervision.

1. Candidate spans of each kind come from broad patterns, wherever a text can hold one.
2. Labelers vote for, against or not at all: strict patterns, check sums and ranges,
   gazetteers, keywords before the span, and its borders.
3. Equal votes are counted over all documents. Expectation-maximisation on these
   counts estimates each labeler's reliability and each pattern's probability.
4. A logistic classifier over votes, kind and length, fitted on those probabilities,
   decides each span. A second pass over the texts redacts what it accepts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .quality import per_row
from .words import raw, slices

KINDS = ("EMAIL", "IP", "CARD", "SSN", "PHONE", "SECRET", "IBAN", "NAME")
LABELERS = ("strict", "check", "gazetteer", "context", "against", "borders")
ACCEPT = 0.5

_NUMBERS = re.compile(
    r"(?P<IP>(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d))"
    r"|(?P<CARD>(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\d))"
    r"|(?P<SSN>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<PHONE>(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,5}\)[ .-]?)?\d{2,5}(?:[ .-]\d{2,5}){1,4}(?!\d|\.\d)|\+\d{8,15}(?!\d))"
)
_KEYS = re.compile(r"(?<![A-Za-z0-9_-])(?:(?P<SECRET>[0-9a-fA-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{20,}\.[A-Za-z0-9_-]{10,}(?:\.[A-Za-z0-9_-]{10,})?)|(?P<IBAN>[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?))(?![A-Za-z0-9_])")
_DIGITS = re.compile(r"[0-9]+(?:[^0-9]{1,40}[0-9]+)*")  # near digits together: numbers lie within _REACH of them
_KEY_STARTS = r"(?:AKIA|ASIA)[0-9A-Z]{16}|[spr]k[-_][A-Za-z0-9_-]{16}|gh[pousr]_[A-Za-z0-9]{30}|xox[abprs]-[A-Za-z0-9-]{10}|eyJ[A-Za-z0-9_-]{20,}\.|[0-9a-fA-F]{32}|[A-Z]{2}\p{Nd}{2}(?: ?[A-Z0-9]{4}){2}"  # of _KEYS, for Arrow
_NAMES = re.compile(r"[A-Z][a-zà-ÿ]{2,15} [A-Z][a-zà-ÿ]{2,20}\b")
_LEFT, _RIGHT = re.compile(r"[\w.+%'-]{1,64}$"), re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}")
_GIVEN = frozenset("James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen Christopher Nancy Daniel Lisa Matthew Anthony Mark Sandra Paul Andrew Emily Emma Olivia Anna Hans Peter Klaus Jürgen Sabine Monika Stefan Pierre Jean Marie Nathalie Julien Camille Juan José María Carmen Carlos Luis Ana Laura Pedro Miguel".split())
_TITLES = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.? ?|\b(?i:name|dear|contact|nombre|nom):? ?)$")
_TITLE_WORDS = frozenset("Mrs Prof Herr Frau Monsieur Madame Mme Señor Señora Sra Name Dear Contact Nombre Nom".split())  # those of _TITLES that _NAMES can begin with
_TLDS = frozenset("com org net edu gov mil int info biz io co us uk de fr es it nl eu ch at be pt pl se no dk fi ru cn jp in br au ca mx ar".split())
_COUNTRY = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 380 420".split())
_PREFIX = re.compile(r"AKIA|ASIA|sk[-_]|pk[-_]|rk[-_]|gh[pousr]_|xox|eyJ")
_CUES = {
    "EMAIL": r"e-?mail|contact|write|kontakt|correo|courriel|adresse|address",
    "IP": r"\bip\b|host|server|address|client|from|login",
    "CARD": r"card|visa|master|amex|credit|debit|tarjeta|carte|karte|konto|account|payment",
    "SSN": r"ssn|social|security|taxpayer",
    "PHONE": r"tel|phone|call|fax|mobile|handy|ruf|móvil|appel|whatsapp",
    "SECRET": r"token|key|secret|passw|pwd|auth|bearer|api|credential",
    "IBAN": r"iban|bank|konto|account|compte|cuenta",
    "NAME": r"\b(?:mr|mrs|ms|dr|herr|frau|madame|señora?|name|dear|contact)\b",
}
_CUES = {k: re.compile(v, re.I) for k, v in _CUES.items()}
_AGAINST = re.compile(r"version|licen[cs]e|isbn|issn|doi|page|section|chapter|§|commit|sha\d*|md5|checksum|\bv$|order no|invoice", re.I)
_BUCKETS = (8, 12, 16, 20, 32, 40)
_WINDOW, _REACH = 40, 130
_CAPITAL, _SMALL = np.zeros(256, bool), np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL[97:123] = _SMALL[128:] = True


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def possible(texts: pa.Array) -> np.ndarray:
    """Which texts can hold a candidate at all: 1 for an @, 2 for four digits, 4 for a capital after a small letter and a blank, 8 for how a key or an IBAN begins."""
    data, offsets = raw(texts)
    out = np.zeros(len(offsets) - 1, np.uint8)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        pair = np.zeros(len(part), bool)
        pair[2:] = _CAPITAL[part[2:]] & (part[1:-1] == 32) & _SMALL[part[:-2]]
        out[i:j] = (per_row(part == 64, at) > 0) + 2 * (per_row((part >= 48) & (part < 58), at) > 3) + 4 * (per_row(pair, at) > 0)
    return out + 8 * pc.match_substring_regex(texts, _KEY_STARTS).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)


def candidates(text: str, flags: int = 15) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of everything that a labeler could vote for."""
    at = text.find("@") if flags & 1 else -1
    while at >= 0:
        left, right = _LEFT.search(text, max(0, at - 64), at), _RIGHT.match(text, at + 1)
        if left and right:
            yield "EMAIL", left.start(), right.end()
        at = text.find("@", at + 1)
    done = 0
    for d in _DIGITS.finditer(text) if flags & 2 else ():
        if d.end() - d.start() < 4:
            continue
        a, z = max(done, d.start() - _REACH), d.end() + _REACH
        for m in _NUMBERS.finditer(text, a, z):
            if m.start() < d.end() and m.end() > d.start():
                yield m.lastgroup, m.start(), m.end()
                done = max(done, m.end())
    for m in _KEYS.finditer(text) if flags & 8 else ():
        yield m.lastgroup, m.start(), m.end()
    m = _NAMES.search(text) if flags & 4 else None
    while m:
        first, at = m.group().split(" ")[0], m.end()
        if m.start() and text[m.start() - 1].isalnum():
            at = m.start() + 1
        elif first not in _TITLE_WORDS and (first in _GIVEN or _TITLES.search(text, max(0, m.start() - 12), m.start())):
            yield "NAME", m.start(), m.end()
        else:
            at = m.start() + len(first)  # the second word may begin a name
        m = _NAMES.search(text, at)


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """One vote a labeler: 1 for, -1 against, 0 none."""
    s, before = text[start:end], text[max(0, start - _WINDOW) : start]
    digits = re.sub(r"[^0-9]", "", s) if kind in ("CARD", "PHONE", "SSN") else ""
    strict = check = gazetteer = 0
    if kind == "EMAIL":
        local = s.partition("@")[0]
        strict = 1 if not (local.startswith(".") or ".." in s) else -1
        check = 1 if any(c.isalnum() for c in local) else -1
        gazetteer = 1 if s.rpartition(".")[2].lower() in _TLDS else 0
    elif kind == "IP":
        octets = s.split(".")
        strict = 1 if all(o == str(int(o)) for o in octets) else -1
        check = 1 if all(int(o) < 256 for o in octets) else -1
        gazetteer = -1 if octets[0] in ("0", "127") or s == "255.255.255.255" else 0
    elif kind == "CARD":
        strict = 1 if len(digits) in (14, 15, 16, 19) else -1
        check = 1 if _luhn(digits) else 0
        gazetteer = 1 if digits[0] in "3456" else 0
    elif kind == "SSN":
        strict, check = 1, -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "PHONE":
        strict = 1 if s[0] in "+(" else -1
        check = 1 if 9 <= len(digits) <= 15 else -1
        gazetteer = 1 if s[0] == "+" and any(digits[:k] in _COUNTRY for k in (1, 2, 3)) else 0
    elif kind == "SECRET":
        strict = 1 if len(s) in (32, 40, 56, 64, 96, 128) or _PREFIX.match(s) else -1
        check = 1 if any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and len(set(s.lower())) >= 8 else -1
        gazetteer = 1 if _PREFIX.match(s) else 0
    elif kind == "IBAN":
        check = 1 if _iban(s) else -1
        strict, gazetteer = check, 0
    elif kind == "NAME":
        gazetteer = 1 if s.split(" ")[0] in _GIVEN else -1
        strict = 1 if _TITLES.search(before) else 0
    context = 1 if _CUES[kind].search(before) else 0
    against = -1 if _AGAINST.search(before[-18:]) else 0
    glued = start > 0 and text[start - 1].isalnum() or end < len(text) and text[end].isalnum()
    return strict, check, gazetteer, context, against, -1 if glued else 1


def pattern(text: str, kind: str, start: int, end: int) -> int:
    """Kind, votes and length class as one number: nothing else of a span decides."""
    code = KINDS.index(kind)
    for v in votes(text, kind, start, end):
        code = code * 3 + v + 1
    return code * (len(_BUCKETS) + 1) + sum(end - start >= b for b in _BUCKETS)


def unpacked(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kinds, votes, length classes)."""
    bucket, rest = codes % (len(_BUCKETS) + 1), codes // (len(_BUCKETS) + 1)
    v = np.zeros((len(codes), len(LABELERS)), np.int64)
    for k in range(len(LABELERS) - 1, -1, -1):
        v[:, k], rest = rest % 3 - 1, rest // 3
    return rest, v, bucket


def estimate(kinds: np.ndarray, v: np.ndarray, counts: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(probability of each pattern, reliability[labeler, true?, vote + 1]) by expectation-maximisation.

    Reliabilities are shared by all kinds; each kind has its own share of true
    spans. Counts that stand for labelers which are right four times in five keep
    what nothing was learned about in place.
    """
    prior = np.empty((len(LABELERS), 2, 3))
    prior[:, 1], prior[:, 0] = (1, 3, 6), (6, 3, 1)
    prior *= 2 + 0.02 * counts.sum() / 10
    logs = np.log(prior / prior.sum(2, keepdims=True))
    share = np.full(len(KINDS), 0.5)
    every = np.arange(len(LABELERS))
    p = np.zeros(len(counts))
    for _ in range(steps):
        score = np.log(share[kinds] / (1 - share[kinds])) + sum(logs[k, 1, v[:, k] + 1] - logs[k, 0, v[:, k] + 1] for k in every)
        p = 1 / (1 + np.exp(-np.clip(score, -40, 40)))
        for k in range(len(KINDS)):
            own = kinds == k
            share[k] = (p[own] @ counts[own] + 5) / (counts[own].sum() + 10)
        total = prior.copy()
        for k in every:
            for side, w in ((1, p * counts), (0, (1 - p) * counts)):
                total[k, side] += np.bincount(v[:, k] + 1, w, 3)
        logs = np.log(total / total.sum(2, keepdims=True))
    return p, np.exp(logs)


def _design(kinds: np.ndarray, v: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    return np.concatenate([np.eye(len(KINDS))[kinds], v > 0, v < 0, np.eye(len(_BUCKETS) + 1)[bucket]], 1).astype(float)


def train(kinds: np.ndarray, v: np.ndarray, bucket: np.ndarray, p: np.ndarray, counts: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights of a logistic classifier on the patterns' probabilities, by Newton's method with a ridge."""
    x, w = _design(kinds, v, bucket), np.zeros(len(KINDS) + 2 * len(LABELERS) + len(_BUCKETS) + 1)
    c = counts / max(1.0, counts.sum() / 1000)
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (c * (p - q)) - 0.05 * w
        h = (x * (c * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step * min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
    return w


def fit(docs: DataFrame, text_col: str = "text") -> dict[int, float]:
    """Probability of each pattern that occurs; from counts over all documents, a few thousand at most."""
    scratch.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, int] = {}
            flags = possible(b.column(0))
            for k in np.flatnonzero(flags):
                t = b.column(0)[k].as_py()
                for kind, a, z in candidates(t, int(flags[k])):
                    code = pattern(t, kind, a, z)
                    seen[code] = seen.get(code, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["code", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()
    if not rows:
        return {}
    codes, counts = np.array([r["code"] for r in rows]), np.array([r["n"] for r in rows], float)
    kinds, v, bucket = unpacked(codes)
    p, _ = estimate(kinds, v, counts)
    q = 1 / (1 + np.exp(-np.clip(_design(kinds, v, bucket) @ train(kinds, v, bucket, p, counts), -30, 30)))
    return dict(zip(codes.tolist(), q.tolist()))


def spans(text: str, model: dict[int, float], accept: float = ACCEPT, flags: int = 15) -> list[tuple[str, int, int, float]]:
    """Accepted (kind, start, end, probability), left to right; of overlapping ones the likelier, then longer."""
    found = [(kind, a, z, model.get(pattern(text, kind, a, z), 0.0)) for kind, a, z in candidates(text, flags)]
    taken: list[tuple[str, int, int, float]] = []
    for s in sorted((f for f in found if f[3] >= accept), key=lambda f: (-f[3], f[1] - f[2], f[1])):
        if all(s[2] <= t[1] or s[1] >= t[2] for t in taken[-200:]) and (len(taken) <= 200 or all(s[2] <= t[1] or s[1] >= t[2] for t in taken)):
            taken.append(s)
    return sorted(taken, key=lambda t: t[1])


def redacted(text: str, found: list[tuple[str, int, int, float]]) -> str:
    parts, at = [], 0
    for kind, a, z, _ in found:
        parts += [text[at:a], f"[{kind}]"]
        at = z
    return "".join([*parts, text[at:]])


_SPANS = "array<struct<kind: string, start: int, end: int, probability: double>>"
_ARROW = pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))])


def found(model: dict[int, float], text: Column, accept: float = ACCEPT) -> Column:
    """(redacted text, spans) of the texts with a span; null for the others."""

    @F.arrow_udf(f"struct<text: string, spans: {_SPANS}>")
    def run(texts: pa.Array) -> pa.Array:
        flags, out = possible(texts), [None] * len(texts)
        for k in np.flatnonzero(flags):
            t = texts[k].as_py()
            if s := spans(t, model, accept, int(flags[k])):
                out[k] = {"text": redacted(t, s), "spans": [{"kind": c, "start": a, "end": z, "probability": round(p, 6)} for c, a, z, p in s]}
        return pa.array(out, _ARROW)

    return run(text.cast("string"))


def detect(docs: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans) of the documents that hold personal data; ``text`` is redacted.

    Spans (kind, start, end, probability) count characters of the whole original text
    and never overlap. Null and empty texts hold none; repeated rows come each; an
    empty table gives no rows; other columns are left behind.
    """
    model = fit(docs, text_col)
    both = docs.select(F.col(id_col).alias("doc_id"), found(model, F.col(text_col), accept).alias("f"))
    return both.where("f is not null").select("doc_id", "f.text", "f.spans")


def redact(docs: DataFrame, accept: float = ACCEPT, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets; all rows and columns stay, null texts too."""
    model = fit(docs, text_col)
    return docs.withColumn(text_col, F.coalesce(found(model, F.col(text_col), accept)["text"], F.col(text_col)))
