"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Densities of three given lexicons and of one mined from the labelled sample, bad
words near a second person, capitals, marks, and how often a bad word appears only
once digits, marks or dots that disguise it are undone. Half of the sample mines
the lexicon, three eighths grow the trees, one eighth calibrates them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import labelled, scratch
from .quality import _DIGIT, _HIGH, _LOWER, _UPPER, _set, per_row
from .trees import Boosted, calibrated, fit_boosted, isotonic
from .words import bounds, grams, hashes, raw, slices

INSULTS = "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass loser losers clown clowns scum trash garbage worthless pathetic disgusting imbecile cretin fool fools jerk creep weirdo freak pig pigs rat vermin parasite coward liar lunatic psycho retard retarded ugly useless braindead dimwit halfwit scumbag lowlife degenerate filth filthy idiota idiotas estúpido estúpida imbécil tonto tonta basura asqueroso asquerosa inútil payaso escoria dummkopf idioten dumm trottel abschaum müll widerlich erbärmlich wertlos versager clownerie idiote imbécile stupide crétin débile ordure déchet minable dégoûtant dégoûtante nul bouffon".split()
OBSCENE = "fuck fucking fucked fucker motherfucker shit shitty bullshit asshole assholes bitch bitches bastard bastards crap damn dick dickhead cunt slut whore puta mierda cabrón pendejo joder scheiße scheisse arschloch hure fotze putain merde connard connasse salope enculé".split()
THREATS = "kill die death murder hang shoot burn suffer destroy hate hated despise attack beat hurt punch stab exterminate matar muere odio töte töten stirb hasse hass tuer crève haine déteste".split()
SECOND = "you your yours yourself u ur tú tu tus usted ustedes vosotros te du dich dir dein deine ihr euch sie vous votre vos toi ton ta".split()
NAMES = ("insults", "obscene", "threats", "near_second", "second", "distinct_hits", "hits", "capitals", "exclaims", "marks", "disguised", "mixed_words", "mined", "mined_distinct", "log_words")
TOXIC = 0.5
MINED, LEAST = 1000, 4  # words of the mined lexicon at most; toxic texts that one must be in
_NEAR = 6  # words between a second person and an insult

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_LEET = _LOWERED.copy()
for _a, _b in zip("013457@$!", "oieastasi"):
    _LEET[ord(_a)] = ord(_b)
_DISGUISE = _set("013457@$!")
_DROPPED = _set("*._-~")
_WORDLIKE = _UPPER | _LOWER | _DIGIT | _HIGH


def _table(words: list[str]) -> np.ndarray:
    parts = [w.encode() for w in sorted(set(words))]
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    return np.sort(hashes(data, ends - [len(p) for p in parts], ends))


def _in(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


_TABLES = [_table(x) for x in (INSULTS, OBSCENE, THREATS)]
_SECOND, _ALL = _table(SECOND), _table(INSULTS + OBSCENE)


def _undone(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lowered bytes with look-alikes inside words replaced, and marks between single letters dropped."""
    n = len(data)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    letter = _WORDLIKE[data] | _DISGUISE[data]
    before[1:], after[:-1] = letter[:-1], letter[1:]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[heads] = False
    after[heads[1:] - 1] = False
    inside = _DISGUISE[data] & (before | after)
    out = np.where(inside, _LEET[data], _LOWERED[data])
    keep = ~(_DROPPED[data] & before & after)
    total = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    return out[keep], total[offsets]


def _per_text(rows: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes per row."""
    if not len(h):
        return np.zeros(n)
    k = np.unique(np.stack([rows.astype(np.uint64), h], 1), axis=0)[:, 0].astype(np.int64)
    return np.bincount(k, minlength=n).astype(float)


def features(data: np.ndarray, offsets: np.ndarray, mined: np.ndarray) -> np.ndarray:
    """Rates of each text; all are 0 for an empty one. ``mined``: sorted hashes of a lexicon's words."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    low = _LOWERED[data]
    s, e, rows = bounds(low, offsets)
    words = np.bincount(rows, minlength=n).astype(float)
    some = np.maximum(words, 1)
    h = hashes(low, s, e)
    hits = [_in(h, t) for t in _TABLES]
    counts = [np.bincount(rows[x], minlength=n) for x in hits]
    own = _in(h, mined) if len(mined) else np.zeros(len(h), bool)
    bad = np.flatnonzero(hits[0] | hits[1] | own)
    you = np.flatnonzero(_in(h, _SECOND))
    near = np.zeros(n)
    if len(bad) and len(you):
        k = np.searchsorted(you, bad)
        close = np.zeros(len(bad), bool)
        for at in (np.maximum(k - 1, 0), np.minimum(k, len(you) - 1)):
            close |= (np.abs(you[at] - bad) <= _NEAR) & (rows[you[at]] == rows[bad])
        near = np.bincount(rows[bad[close]], minlength=n).astype(float)
    distinct = _per_text(rows[bad], h[bad], n)
    plain = np.bincount(rows[bad], minlength=n)
    known = np.union1d(_ALL, mined)
    clear, at = _undone(data, offsets)
    s2, e2, rows2 = bounds(clear, at)
    after = np.bincount(rows2[_in(hashes(clear, s2, e2), known)], minlength=n)
    disguised = np.maximum(after - plain, 0)
    digit, alpha = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum(_DIGIT[data], out=digit[1:])
    np.cumsum((_UPPER | _LOWER)[data], out=alpha[1:])
    mixed = np.bincount(rows[(digit[e] > digit[s]) & (alpha[e] > alpha[s])], minlength=n)
    letters = np.maximum(per_row((_UPPER | _LOWER)[data], offsets), 1)
    return np.stack([*(c / some for c in counts), near / some, np.bincount(rows[you], minlength=n) / some, distinct, np.log1p(plain + disguised), per_row(_UPPER[data], offsets) / letters, per_row(data == ord("!"), offsets) / size, per_row(~(_WORDLIKE | _set(" \n\t\r"))[data], offsets) / size, disguised / some, mixed / some, np.bincount(rows[own], minlength=n) / some, _per_text(rows[own], h[own], n), np.log1p(words)], 1)


def mine(rows: DataFrame, most: int = MINED) -> np.ndarray:
    """Hashes of the words that mark toxic texts in the sample's first four folds.

    A word counts once for all near copies of a text, told by the least of its
    5-gram hashes. It must be in ``LEAST`` toxic texts, mostly in toxic ones, and five
    deviations more often than by chance; the ``most`` strongest stay.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column(1).to_numpy()
            data, offsets = raw(b.column(2))
            for i, j in slices(offsets):
                low, at = _LOWERED[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
                s, e, of = bounds(low, at)
                h = hashes(low, s, e)
                g, whose, _ = grams(h, of, 5, True)
                least = np.full(j - i, np.iinfo(np.uint64).max, np.uint64)
                np.minimum.at(least, whose, g)
                k = np.unique(np.stack([of.astype(np.uint64), h], 1), axis=0) if len(h) else np.zeros((0, 2), np.uint64)
                of = k[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(k[:, 1].view(np.int64)), pa.array(least[of].view(np.int64)), pa.array(y[i:j][of] > 0)], ["word", "text", "toxic"])

    seen = rows.where("fold < 4").select("id", "y", "text").mapInArrow(run, "word bigint, text bigint, toxic boolean").distinct()
    total = rows.where("fold < 4").agg(F.avg(F.col("y"))).first()[0] or 0.0
    counts = seen.groupBy("word").agg(F.count_if("toxic").alias("a"), F.count(F.lit(1)).alias("n"))
    chance = F.col("n") * total
    sure = counts.where((F.col("a") >= LEAST) & (2 * F.col("a") > F.col("n"))).withColumn("z", (F.col("a") - chance) / F.sqrt(chance)).where("z >= 5")
    return np.sort(np.array([r["word"] for r in sure.orderBy(F.desc("z"), "word").limit(most).collect()], np.int64).view(np.uint64))


class Model:
    """A mined lexicon, trees, and the calibration of their scores."""

    def __init__(self, mined: np.ndarray, trees: Boosted, steps: tuple[np.ndarray, np.ndarray]):
        self.mined, self.trees, self.steps = mined, trees, steps

    def texts(self, texts: pa.Array) -> np.ndarray:
        x = labelled.by_slices(texts, lambda d, o: features(d, o, self.mined), len(NAMES))
        return np.where(x[:, -1] > 0, calibrated(self.trees.raw(x), self.steps), 0.0)


def fit(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fitted on at most ``most`` labelled rows; without any, every text scores 0."""
    rows = labelled.chosen(docs, labels, "toxic", most, id_col, text_col)
    mined = mine(rows)
    x, y, fold = labelled.matrix(rows.where("fold >= 4"), lambda d, o: features(d, o, mined), len(NAMES), most)
    held = fold == 7 if (y[fold == 7] > 0).sum() >= 8 else np.ones(len(y), bool)  # too few to calibrate on: all do
    trees = fit_boosted(x[~held], y[~held]) if not held.all() else fit_boosted(x, y)
    return Model(mined, trees, isotonic(trees.raw(x[held]), y[held]))


def score(model: Model, text: Column) -> Column:
    """The calibrated probability; 0 for a text without words, null or empty."""

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(model.texts(texts))

    return run(text.cast("string"))


def scores(docs: DataFrame, labels: DataFrame, most: int = labelled.MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, toxicity) of every row: a calibrated probability.

    Texts that are null, empty or without words score 0. Repeated rows are scored
    each; an empty table gives no rows; other columns are left behind.
    """
    model = fit(docs, labels, most, id_col, text_col)
    scratch.small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), score(model, F.col(text_col)).alias("toxicity"))


def toxic(docs: DataFrame, labels: DataFrame, least: float = TOXIC, most: int = labelled.MOST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of :func:`scores` of ``least`` and more."""
    return scores(docs, labels, most, id_col, text_col).where(F.col("toxicity") >= least)
