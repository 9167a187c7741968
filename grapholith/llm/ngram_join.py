"""N-gram Jaccard self-join with prefix trees.

1. Every document's set of hashed word n-grams is cut into packed arrays by hash
   bucket; each bucket counts document frequencies. Grams of one document alone
   can match nothing: they are only counted.
2. The others, ordered rarest first (frequency, then hash), come back to their
   documents. Two sets of Jaccard t share a gram among the first |x| - ceil(t|x|) + 1
   of each, so a document whose lone grams fill this prefix leaves the join.
3. Equal sets meet by fingerprint; one representative goes on.
4. A set lives in the tree of its least-hashed gram. Buckets of prefix grams find the
   trees that a set must visit besides its own: pairs with equal preceding
   grams were found there already, and the length and position bounds drop
   pairs that cannot reach t.
5. Each tree is walked once for all its probes together: the overlap of a path is
   shared by all sets below it, and a subtree is left when no probe can still
   reach its bound with the grams that remain. Trees of many sets or visitors are walked
   in blocks of both.
6. A walk counts its links and joins what they tie (union of labels), so that a task
   hands on a number a set and a forest, not its pairs: a group of thousands of near
   copies costs thousands of rows. Stars over the forests give the classes.

Grams are told apart by 48 bits within their bucket (57 and more in all).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .words import bounds, grams, hashes, mix, pack48, raw, slices, unpack48

N, T = 5, 0.5
_U = np.uint64
_PAIRS = 300_000  # pairs that are judged at once
_TREE, _PROBES = 3000, 9000  # sets and visitors of one tree that are walked in one task; more are split into blocks, each met by each
_HOT = 400  # holders of a gram from which whole trees are judged, not pairs


def need(a, b, t: float):
    """Least overlap of sets of a and b grams with Jaccard t."""
    return np.ceil(np.round(t / (1 + t) * (a + b), 6))


def _prefix(size, t: float):
    return size - np.ceil(np.round(t * size, 6)).astype(np.int64) + 1


def _gram_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, gram) of a slice, sorted by row."""
    s, e, rows = bounds(data, offsets)
    g, rows, _ = grams(hashes(data, s, e), rows, n, True)
    order = np.lexsort((g, rows))
    g, rows = g[order], rows[order]
    keep = np.r_[True, (g[1:] != g[:-1]) | (rows[1:] != rows[:-1])] if len(g) else np.zeros(0, bool)
    return rows[keep], g[keep]


def _split(b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by bucket, and the n + 1 cuts."""
    order = np.argsort(b, kind="stable")
    return order, np.searchsorted(b[order], np.arange(n + 1))


def _emit_grams(n: int, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            data, offsets = raw(b.column(1))
            for i, j in slices(offsets):
                rows, g = _gram_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                block = (part << 32) + seq
                seq += 1
                counts = np.bincount(rows, minlength=j - i).astype(np.int32)
                which = (g % _U(n_buckets)).astype(np.int64)
                order, cuts = _split(which, n_buckets)
                tokens, of = (g[order] >> _U(16)), rows[order].astype(np.uint16 if j - i < 65536 else np.uint32)
                full = np.flatnonzero(np.diff(cuts))
                out = [[int(k) for k in full], [block] * len(full), [False] * len(full), [of[cuts[k] : cuts[k + 1]].astype(np.uint32).tobytes() if of.dtype != np.uint16 else of[cuts[k] : cuts[k + 1]].tobytes() for k in full], [pack48(tokens[cuts[k] : cuts[k + 1]]) for k in full]]
                for column, x in zip(out, (block % n_buckets, block, True, ids[i:j].tobytes(), counts.tobytes())):
                    column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.binary())], ["bucket", "block", "head", "rows", "grams"])

    return run


def _row_numbers(rows: bytes, grams_: bytes) -> np.ndarray:
    return np.frombuffer(rows, np.uint16 if len(rows) * 3 == len(grams_) else np.uint32).astype(np.int64)


def _frequencies(t: pa.Table) -> pa.Table:
    """Grams of two documents and more, back to their blocks with their frequency (255: that or more)."""
    head = t.filter(t["head"])
    t = t.filter(pa.compute.invert(t["head"]))
    out = [head["block"].to_pylist(), head["head"].to_pylist(), head["rows"].to_pylist(), head["grams"].to_pylist(), [b""] * len(head)]
    if len(t):
        g = [unpack48(x) for x in t["grams"].to_pylist()]
        at = np.repeat(np.arange(len(g)), [len(x) for x in g])
        rows = np.concatenate([_row_numbers(a, b) for a, b in zip(t["rows"].to_pylist(), t["grams"].to_pylist())])
        g = np.concatenate(g)
        order = np.argsort(g, kind="stable")
        s = g[order]
        firsts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        df = np.empty(len(s), np.int64)
        runs = np.diff(np.r_[firsts, len(s)])
        df[order] = np.repeat(runs, runs)
        keep = df > 1
        at, rows, g, df = at[keep], rows[keep], g[keep], np.minimum(df[keep], 255).astype(np.uint8)
        cuts = np.searchsorted(at, np.arange(len(t) + 1))
        blocks = t["block"].to_pylist()
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            out[0].append(blocks[k])
            out[1].append(False)
            out[2].append(rows[a:b].astype(np.uint32).tobytes())
            out[3].append(pack48(g[a:b]))
            out[4].append(df[a:b].tobytes())
    return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.bool_()), *(pa.array(x, pa.binary()) for x in out[2:])], ["block", "head", "rows", "grams", "df"])


def _sets(t_: float):
    """Ordered sets of the documents of some blocks that can have a partner."""

    def run(t: pa.Table) -> pa.Table:
        heads = {b: (np.frombuffer(i, np.int64), np.frombuffer(c, np.int32)) for b, h, i, c in zip(*(t[x].to_pylist() for x in ("block", "head", "rows", "grams"))) if h}
        parts: dict[int, list] = {}
        for b, h, r, g, d in zip(*(t[x].to_pylist() for x in ("block", "head", "rows", "grams", "df"))):
            if not h:
                parts.setdefault(b, []).append((r, g, d))
        out: list[list] = [[], [], [], [], [], [], []]
        for b, mine in parts.items():
            ids, counts = heads[b]
            rows = np.concatenate([np.frombuffer(r, np.uint32) for r, _, _ in mine]).astype(np.int64)
            key = np.concatenate([unpack48(g) | (np.frombuffer(d, np.uint8).astype(np.uint64) << _U(48)) for _, g, d in mine])
            order = np.lexsort((key, rows))
            rows, key = rows[order], key[order]
            cuts = np.searchsorted(rows, np.arange(len(ids) + 1))
            shared, total = np.diff(cuts), counts.astype(np.int64)
            lone = total - shared
            alive = np.flatnonzero((shared > 0) & (_prefix(total, t_) > lone))
            f1, f2 = mix(key), mix(key ^ _U(0x5555555555555555))
            least = mix(key & _U((1 << 48) - 1))
            for k in alive:
                a, z = cuts[k], cuts[k + 1]
                own = int(mix(np.array([ids[k]], np.int64).view(np.uint64))[0]) if lone[k] else 0  # lone grams: no equal set
                out[0].append(int(ids[k]))
                out[1].append(int(total[k]))
                out[2].append(int(lone[k]))
                out[3].append(int(np.add.reduce(f1[a:z]).view(np.int64)) ^ (own >> 1))
                out[4].append(int(np.add.reduce(f2[a:z]).view(np.int64)))
                out[5].append(int(least[a:z].min() >> _U(1)))
                out[6].append(key[a:z].tobytes())
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds)], ["doc_id", "total", "lone", "f1", "f2", "tree", "grams"])

    return run


def gram_sets(docs: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, total, lone, f1, f2, tree, grams) of the documents that can have a partner."""
    spark = docs.sparkSession
    scratch.small_batches(spark)
    slim = docs.select(scratch.whole(docs, id_col).alias("doc_id"), F.lower(F.col(text_col).cast("string")).alias("text")).where("doc_id is not null and text is not null")
    b = scratch.buckets(slim, 2_500_000)
    packed = slim.mapInArrow(_emit_grams(n, b), "bucket int, block bigint, head boolean, rows binary, grams binary")
    counted = packed.groupBy("bucket").applyInArrow(_frequencies, "block bigint, head boolean, rows binary, grams binary, df binary")
    m = max(8, b // 2)
    return counted.withColumn("some", F.expr(f"pmod(hash(block), {m})")).groupBy("some").applyInArrow(_drop_first(_sets(t)), "doc_id bigint, total int, lone int, f1 bigint, f2 bigint, tree bigint, grams binary")


def _drop_first(f):
    return _without("some", f)


def _without(column: str, f):
    """``f`` without the grouping column; what Arrow's pool holds unused goes back, as idle workers keep theirs."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t.drop_columns([column]))
        pa.default_memory_pool().release_unused()
        return out

    return run


def _emit_prefixes(t: float, n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, total, lone, tree = (b.column(k).to_numpy() for k in range(4))
            take = np.minimum(_prefix(total.astype(np.int64), t) - lone, [len(x.as_py()) // 8 for x in b.column(4)])
            key = [np.frombuffer(x.as_py(), np.uint64, k) & _U((1 << 48) - 1) for x, k in zip(b.column(4), take)]
            if not len(key):
                continue
            before = np.concatenate([np.r_[_U(0), k[:-1]] for k in key])
            key = np.concatenate(key)
            of = np.repeat(np.arange(len(ids)), take)
            at = (np.arange(len(of)) - np.repeat(np.cumsum(take) - take, take) + lone[of]).astype(np.int32)
            order, cuts = _split((mix(key) % _U(n_buckets)).astype(np.int64), n_buckets)
            full = np.flatnonzero(np.diff(cuts))
            cols: list[list] = [[] for _ in range(8)]
            for k in full:
                o = order[cuts[k] : cuts[k + 1]]
                docs, back = np.unique(of[o], return_inverse=True)
                for c, x in zip(cols, (int(k), ids[docs].tobytes(), tree[docs].tobytes(), total[docs].tobytes(), back.astype(np.uint16).tobytes(), pack48(key[o]), pack48(before[o]), at[o].tobytes())):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "ids", "trees", "totals", "of", "grams", "before", "at"])

    return run


def _visits(t_: float, hot: int):
    """(tree, no): sets that must be probed in the tree of a smaller number."""

    def run(t: pa.Table) -> pa.Table:
        ids, tree, total, base, of = [], [], [], 0, []
        for i, r, n, o in zip(*(t[x].to_pylist() for x in ("ids", "trees", "totals", "of"))):
            ids.append(np.frombuffer(i, np.int64))
            tree.append(np.frombuffer(r, np.int64))
            total.append(np.frombuffer(n, np.int32).astype(np.int64))
            of.append(np.frombuffer(o, np.uint16).astype(np.int64) + base)
            base += len(ids[-1])
        of, ids, tree, total = (np.concatenate(x) for x in (of, ids, tree, total))
        g = np.concatenate([unpack48(x) for x in t["grams"].to_pylist()])
        before = np.concatenate([unpack48(x) for x in t["before"].to_pylist()])
        at = np.concatenate([np.frombuffer(x, np.int32) for x in t["at"].to_pylist()]).astype(np.int64)
        order = np.lexsort((ids[of], g))
        of, g, before, at = of[order], g[order], before[order], at[order]
        firsts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        runs = np.diff(np.r_[firsts, len(g)])
        mixed = np.maximum.reduceat(tree[of], firsts) != np.minimum.reduceat(tree[of], firsts)
        found: list[np.ndarray] = []

        def judge(a: np.ndarray, b: np.ndarray) -> None:
            x, y = of[a], of[b]
            ok = (tree[x] != tree[y]) & (ids[x] != ids[y]) & ((before[a] != before[b]) | (before[a] == 0))
            a, b, x, y = a[ok], b[ok], x[ok], y[ok]
            nx, ny = total[x], total[y]
            ok = 1 + np.minimum(nx - at[a] - 1, ny - at[b] - 1) >= need(nx, ny, t_)
            if ok.any():
                found.append(np.unique(np.stack([tree[x[ok]], ids[y[ok]]], 1), axis=0))

        def judge_trees(h: int, size: int) -> None:
            """All sets of a hot gram against its trees: a visit too many finds no pair twice, as a pair meets in one tree alone."""
            x = of[h : h + size]
            names, back = np.unique(tree[x], return_inverse=True)
            by = np.argsort(back, kind="stable")
            cuts = np.searchsorted(back[by], np.arange(len(names)))
            least, low, high = ids[x[by[cuts]]], np.minimum.reduceat(total[x[by]], cuts), np.maximum.reduceat(total[x[by]], cuts)
            most = total[x] - at[h : h + size]
            for k in range(len(names)):
                ok = (back != k) & (ids[x] > least[k]) & (np.minimum(high[k], most) >= need(low[k], total[x], t_))
                found.append(np.stack([np.full(int(ok.sum()), names[k]), ids[x[ok]]], 1))
                if len(found) > 256:
                    found[:] = [np.unique(np.concatenate(found), axis=0)]

        for size in np.unique(runs[mixed & (runs > 1)]):
            heads = firsts[mixed & (runs == size)]
            if size > hot:
                for h in heads:
                    judge_trees(int(h), int(size))
                continue
            i, j = np.triu_indices(size, 1)
            step = max(1, _PAIRS // len(i))
            for k in range(0, len(heads), step):
                h = heads[k : k + step, None]
                judge((h + i).ravel(), (h + j).ravel())
                if len(found) > 64:
                    found[:] = [np.unique(np.concatenate(found), axis=0)]
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table([pa.array(out[:, 0]), pa.array(out[:, 1])], ["tree", "no"])

    return run


def walk(owners: list[tuple[int, int, np.ndarray]], probes: list[tuple[int, int, np.ndarray]], t: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(owner, probes, Jaccards) of the pairs with owner number < probe number, by one walk over the owners' prefix tree."""
    all_ = np.concatenate([s for _, _, s in probes])
    names, local = np.unique(all_, return_inverse=True)
    frequency = np.bincount(local, minlength=len(names))
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((names, -frequency))] = np.arange(len(names))  # here frequent grams first: paths are shared longer
    local = rank[local]
    of = np.repeat(np.arange(len(probes)), [len(s) for _, _, s in probes])
    order = np.argsort(local, kind="stable")
    posts, cuts = of[order], np.searchsorted(local[order], np.arange(len(names) + 1))
    pid = np.array([i for i, _, _ in probes])
    size = np.array([n for _, n, _ in probes], np.int64)
    shared = np.array([len(s) for _, _, s in probes], np.int64)

    def path(grams_: np.ndarray) -> np.ndarray:
        """Ranks in order; grams of no probe, which match nothing, last."""
        at = np.minimum(np.searchsorted(names, grams_), len(names) - 1)
        known = names[at] == grams_
        return np.r_[np.sort(rank[at[known]]), np.sort(grams_[~known].astype(np.int64) + len(names))]

    paths = sorted(((path(s), i, n) for i, n, s in owners), key=lambda x: (x[0].tolist(), x[1]))

    def add(overlap: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        tokens = tokens[tokens < len(names)]
        if not len(tokens):
            return overlap
        hits = np.concatenate([posts[cuts[k] : cuts[k + 1]] for k in tokens])
        return overlap + np.bincount(hits, minlength=len(pid))

    stack = [(0, len(paths), 0, np.zeros(len(pid), np.int64))]
    while stack:
        lo, hi, depth, overlap = stack.pop()
        first, last = paths[lo][0], paths[hi - 1][0]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m])
        to = depth + int(differ[0]) if len(differ) else m
        overlap = add(overlap, first[depth:to])
        totals = np.array([n for _, _, n in paths[lo:hi]])
        rest = max(len(p) for p, _, _ in paths[lo:hi]) - to
        least = need(size, int(totals.min()), t)
        if not (overlap + np.minimum(rest, shared - overlap) >= least).any():
            continue
        k = lo
        while k < hi and len(paths[k][0]) == to:  # sets that end here
            _, i, n = paths[k]
            hit = np.flatnonzero((overlap >= need(size, n, t)) & (pid > i))
            if len(hit):
                yield i, pid[hit], overlap[hit] / (n + size[hit] - overlap[hit])
            k += 1
        while k < hi:
            tok, z = paths[k][0][to], k + 1
            while z < hi and paths[z][0][to] == tok:
                z += 1
            stack.append((k, z, to, overlap))
            k = z


class Links:
    """Numbers of links and connected groups of the sets of one task."""

    def __init__(self, numbers: np.ndarray, copies: np.ndarray):
        self.order = np.argsort(numbers)
        self.numbers, self.copies = numbers[self.order], copies[self.order]
        self.count, self.group = np.zeros(len(numbers), np.int64), np.arange(len(numbers))

    def add(self, one: int, others: np.ndarray) -> None:
        i, j = int(np.searchsorted(self.numbers, one)), np.searchsorted(self.numbers, others)
        self.count[j] += self.copies[i]
        self.count[i] += self.copies[j].sum()
        own = self.group[i]
        met = self.group[j]
        if len(met := met[met != own]):
            met = np.unique(np.r_[met, own])
            self.group[np.isin(self.group, met)] = met[0]


def _trees(t_: float):
    """(a, no, b, links): a set's number of links, or (b) an edge of the forest of representatives' ids."""

    def run(t: pa.Table) -> pa.Table:
        trees: dict[tuple[int, int, int], list[tuple]] = {}
        for r, i, j, *row in zip(*(t[x].to_pylist() for x in ("tree", "ob", "pb", "owner", "probe", "no", "rep", "copies", "total", "grams"))):
            trees.setdefault((r, i, j), []).append(row)
        out: list[list[np.ndarray]] = [[], [], [], []]
        for rows in trees.values():
            owners, probes = ([(no, n, np.frombuffer(g, np.uint64)) for *flags, no, _, _, n, g in rows if flags[k]] for k in (0, 1))
            if not owners or not probes:
                continue
            links, rep = Links(*(np.array([r[k] for r in rows], np.int64) for k in (2, 4))), np.array([r[3] for r in rows], np.int64)
            for one, others, _ in walk(owners, probes, t_):
                links.add(one, others)
            rep, some, tied = rep[links.order], np.flatnonzero(links.count), np.flatnonzero(links.group != np.arange(len(rep)))
            for c, x in zip(out, (rep[some], links.numbers[some], np.full(len(some), -1), links.count[some])):
                c.append(x)
            for c, x in zip(out, (rep[links.group[tied]], links.numbers[tied], rep[tied], np.full(len(tied), -1))):
                c.append(x)
        a, no, b, n = (np.concatenate([np.zeros(0, np.int64), *c]) for c in out)
        return pa.table([pa.array(a), pa.array(no), pa.array(b, mask=n >= 0), pa.array(n, mask=n < 0)], ["a", "no", "b", "links"])

    return run


def _linked(docs: DataFrame, n: int, t: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, class_id, links) of the documents that can have a partner."""
    sets = scratch.table(gram_sets(docs, n, t, id_col, text_col), "sets")
    key = ["total", "f1", "f2"]
    members = sets.select("doc_id", *key).distinct()
    equal = members.groupBy(key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    one = sets.join(equal.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"]).dropDuplicates([*key, "doc_id"])
    reps = scratch.table(one.select(F.monotonically_increasing_id().alias("no"), F.col("doc_id").alias("rep"), "copies", *key, "lone", "tree", "grams"), "reps")
    scratch.small_batches(docs.sparkSession, 2000)
    b = scratch.buckets(reps, 2_000_000)
    prefixes = reps.select("no", "total", "lone", "tree", "grams").mapInArrow(_emit_prefixes(t, b), "bucket int, ids binary, trees binary, totals binary, of binary, grams binary, before binary, at binary")
    visits = scratch.table(prefixes.groupBy("bucket").applyInArrow(_without("bucket", _visits(t, _HOT)), "tree bigint, no bigint").distinct(), "visits")
    rows = ["no", "rep", "copies", "total", "grams"]
    own = reps.select("tree", F.lit(True).alias("own"), *rows)
    guests = visits.join(reps.select(*rows), "no").select("tree", F.lit(False).alias("own"), *rows)
    count = reps.select("tree", F.lit(1).alias("own")).unionByName(visits.select("tree", F.lit(0).alias("own"))).groupBy("tree").agg(F.ceil(F.sum("own") / _TREE).cast("int").alias("so"), F.ceil(F.count(F.lit(1)) / _PROBES).cast("int").alias("sp"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    every = own.unionByName(guests).join(count.drop("sets"), "tree").withColumn("i", F.expr("cast(pmod(xxhash64(no), so) as int)")).withColumn("j", F.expr("cast(pmod(xxhash64(no, 1), sp) as int)"))
    both = F.expr("array_distinct(concat(if(own, transform(sequence(0, sp - 1), x -> struct(i as ob, x as pb)), array()), transform(sequence(0, so - 1), x -> struct(x as ob, j as pb))))")
    placed = every.withColumn("at", F.explode(both)).select("tree", "at.ob", "at.pb", F.expr("own and at.ob = i").alias("owner"), F.expr("at.pb = j").alias("probe"), *rows)
    m = max(12, b * 4)
    met = scratch.table(placed.withColumn("some", F.expr(f"pmod(hash(tree, ob, pb), {m})")).groupBy("some").applyInArrow(_drop_first(_trees(t)), "a bigint, no bigint, b bigint, links bigint"), "linked")
    several = members.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("doc_id")
    torn = members.join(several, "doc_id").join(reps.select(*key, "rep"), key).select(F.col("rep").alias("doc_a"), F.col("doc_id").alias("doc_b"))
    roots = components(met.where("b is not null").select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).unionByName(torn))
    counts = met.where("b is null").groupBy("no").agg(F.sum("links").alias("others"))
    told = reps.select(*key, "no", "rep", "copies").join(counts, "no", "left").join(roots.withColumnRenamed("doc_id", "rep"), "rep", "left")
    told = told.select(*key, F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    return members.join(told, key).groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))


def classes(docs: DataFrame, n: int = N, t: float = T, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, links): the whole self-join, one row per id.

    ``links`` is the number of other documents whose n-gram set has a Jaccard
    of at least ``t`` with this one's, copies included; ``class_id`` is the smallest id
    that such links lead to, the document's own where it has none. All links count, of however
    large a group, but pairs aren't told.

    A text of fewer than n words, but one at least, has one gram of all its words; a
    text without words and a null text have no link; a null id has no row. Rows of one
    id with the same grams count once. Rows of one id with different grams are documents
    of their own, each with its links (to each other too), and share one row: the sum of the
    links and one class. An empty table gives no rows; other columns are left behind.
    """
    ids = docs.select(scratch.whole(docs, id_col).alias("doc_id")).where("doc_id is not null").distinct()
    found = _linked(docs, n, t, id_col, text_col)
    return ids.join(found, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("bigint").alias("links"))


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the smallest id of each connected group, from (doc_a, doc_b).

    Large-star and small-star rounds until nothing changes: every round halves the
    paths, and a table in the shared folder cuts the lineage.
    """

    def links(e: DataFrame) -> DataFrame:
        return e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    e = scratch.table(edges.select(F.greatest("doc_a", "doc_b").alias("a"), F.least("doc_a", "doc_b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = links(e)
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        e, before = scratch.table(small, "edges"), e
        scratch.drop(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return e.select(F.col("a").alias("doc_id"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, n: int = N, t: float = T, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, root) of every document that a smaller id stands for: all but one of each group."""
    return _linked(docs, n, t, id_col, text_col).where("class_id <> doc_id").select("doc_id", F.col("class_id").alias("root"))


def without_near_duplicates(docs: DataFrame, n: int = N, t: float = T, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each connected group; all columns stay.

    A null id, a null or empty text has no group and stays; rows that repeat an id stay or go together.
    """
    gone = scratch.fresh(docs, "gone")
    found = near_duplicates(docs, n, t, id_col, text_col).select(F.col("doc_id").alias(gone))
    return docs.join(found, F.col(id_col) == F.col(gone), "left_anti")
