"""SentencePiece encoding and decoding, each kind of model by its own rule, as a stream.

BPE (the installed model): of all neighbours whose concatenation is a piece, the
pair of the highest score merges, the leftmost of equals, until none is left.
No merge crosses two characters that are neighbours in no piece: ids are
committed there.

Unigram: the best segmentation maximises the sum of piece scores; among equal
sums the longer last piece wins. A character in no piece costs the lowest score
less ten. Only starts within the longest piece's length can still be extended, so
the Viterbi decoder keeps that window of states and commits ids whenever the
backpointers of all of them meet in one boundary.

A character in no piece becomes its UTF-8 byte pieces (or the unknown id).
A blank after a word is a settled boundary of either kind in any
vocabulary whose pieces have blanks at their beginning only: what lies between
two of them is looked up in a bounded memo.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .words import hashes, raw, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
TOGETHER = 100  # bytes of a chunk that the vectorised lattice takes; longer ones are streamed
SLICE = 4_000_000  # bytes of texts encoded at once, or one longer text


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while b[at] & 128:
        n |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return n | b[at] << shift, at + 1


def _field(b: bytes, number: int) -> int | bytes | None:
    """The last value of a field of a protobuf message; None without one."""
    at, out = 0, None
    while at < len(b):
        key, at = _varint(b, at)
        if key & 7 == 0:
            x, at = _varint(b, at)
        else:
            n, at = _varint(b, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            x, at = b[at : at + n], at + n
        if key >> 3 == number:
            out = x
    return out


_TRAINER, _KIND, _BPE = 2, 3, 2  # ModelProto.trainer_spec, TrainerSpec.model_type, its value


class Vocabulary:
    """Pieces and scores of a model file; small, and sent to the executors as it is."""

    def __init__(self, path: str = MODEL):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(p.get_piece_size())
        special = [p.is_control(i) or p.is_unknown(i) or p.is_unused(i) for i in every]
        self.bytes_ = {int(p.id_to_piece(i)[1:-1], 16): i for i in every if p.is_byte(i)}
        self.pieces = {p.id_to_piece(i): (i, p.get_score(i)) for i in every if not special[i] and not p.is_byte(i)}
        self.unk = p.unk_id()
        self.merges = _field(_field(p.serialized_model_proto(), _TRAINER) or b"", _KIND) == _BPE
        self.names = [b"" if special[i] else bytes([int(p.id_to_piece(i)[1:-1], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace(BLANK, " ").encode() for i in every]
        self.key = (path, hash(p.serialized_model_proto()))
        self._finish()

    def _finish(self) -> None:
        self.longest = max(map(len, self.pieces), default=1)
        self.unk_score = min((s for _, s in self.pieces.values()), default=0.0) - 10
        long = [p for p in self.pieces if len(p) > 1]
        self.words_part = not any(BLANK in p.lstrip(BLANK) for p in long)
        self.line_parts = not any("\n" in p for p in long)
        self.near = {p[i : i + 2] for p in long for i in range(len(p) - 1)} if self.merges else set()

    @classmethod
    def of(cls, pieces: dict[str, float], merges: bool = False) -> Vocabulary:
        """A vocabulary for tests: ids 1.. in order, 0 unknown, no bytes."""
        v = cls.__new__(cls)
        v.bytes_, v.unk, v.merges, v.key = {}, 0, merges, None
        v.pieces = {p: (i, s) for i, (p, s) in enumerate(pieces.items(), 1)}
        v.names = [b"", *(p.replace(BLANK, " ").encode() for p in pieces)]
        v._finish()
        return v

    def unknown(self, char: str) -> list[int]:
        return [self.bytes_[b] for b in char.encode()] if self.bytes_ else [self.unk]


def merge(parts: list[str], v: Vocabulary) -> list[int]:
    """Ids of characters by the model's merges, from a heap of the pairs that are pieces."""
    n, pieces = len(parts), v.pieces
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(-got[1], i, 2) for i in range(n - 1) if (got := pieces.get(parts[i] + parts[i + 1]))]
    heapify(heap)
    while heap:
        _, a, size = heappop(heap)
        b = after[a]
        if not parts[a] or b == n or len(parts[a]) + len(parts[b]) != size:
            continue  # one of the two has merged since
        parts[a] += parts[b]
        parts[b] = ""
        after[a] = after[b]
        if after[a] < n:
            before[after[a]] = a
        for x, y in ((before[a], a), (a, after[a])):
            if x >= 0 and y < n and (got := pieces.get(parts[x] + parts[y])):
                heappush(heap, (-got[1], x, len(parts[x]) + len(parts[y])))
    out: list[int] = []
    for p in filter(None, parts):
        got = pieces.get(p)
        out += [got[0]] if got else v.unknown(p)
    return out


def _stream_merges(text: Iterable[str], v: Vocabulary, stats: dict | None) -> Iterator[list[int]]:
    held: list[str] = []
    for c in text:
        if held and held[-1] + c not in v.near:
            yield merge(held, v)
            held = []
        held.append(c)
        if stats is not None:
            stats["held"] = max(stats.get("held", 0), len(held))
    if held:
        yield merge(held, v)


def stream(text: Iterable[str], v: Vocabulary, stats: dict | None = None) -> Iterator[list[int]]:
    """Yield lists of ids as they are settled; ``text`` is an iterable of characters.

    ``stats`` gets ``held``, the most characters held back at once.
    """
    if v.merges:
        yield from _stream_merges(text, v, stats)
        return
    pieces, longest, unk = v.pieces, v.longest, v.unk_score
    held, look = "", 2 * longest  # characters since the last commit, and at how many the paths are walked
    best: list[float] = [0.0]  # by position in held
    back: list[int] = [0]

    def ids(a: int, b: int) -> list[int]:
        path = []
        while b > a:
            path.append((back[b], b))
            b = back[b]
        out: list[int] = []
        for s, e in reversed(path):
            got = pieces.get(held[s:e])
            out += [got[0]] if got else v.unknown(held[s:e])
        return out

    for c in text:
        held += c
        end = len(held)
        top, at = None, end - 1
        for s in range(max(0, end - longest), end):
            got = pieces.get(held[s:end])
            score = got[1] if got else unk if s == end - 1 else None
            if score is not None and (top is None or best[s] + score > top):
                top, at = best[s] + score, s
        best.append(top)
        back.append(at)
        if stats is not None:
            stats["held"] = max(stats.get("held", 0), end)
        if end >= look:
            alive = set(range(end - longest + 1, end + 1))
            while len(alive) > 1:  # walk the latest state back until all paths meet
                last = max(alive)
                alive.discard(last)
                alive.add(back[last])
            meet = alive.pop()
            if meet > 0:
                yield ids(0, meet)
                low = best[meet]
                held, best, back = held[meet:], [b - low for b in best[meet:]], [max(0, b - meet) for b in back[meet:]]
            look = len(held) + max(longest, len(held) // 2)  # paths that don't meet are walked rarely: linear time in all
    if held:
        yield ids(0, len(held))


class Table:
    """Piece ids and scores by substring hash: direct slots, then two overflow tables."""

    BITS = 18

    def __init__(self, v: Vocabulary):
        todo = {}
        for p, (i, s) in v.pieces.items():
            h = 0
            for c in p.replace(BLANK, " "):
                h = (h * _BASE + ord(c) + 1) & _ALL
            todo[h] = (i, s)
        self.keys, self.slots = [], []
        self.ids = np.array([i for i, _ in todo.values()] + [-1], np.int32)
        self.scores = np.array([s for _, s in todo.values()] + [-np.inf])
        left = list(enumerate(todo))
        for level in range(3):
            keys, slots, rest = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, len(todo), np.int32), []
            for k, h in left:
                at = ((h * _ODD[level]) & _ALL) >> (64 - self.BITS)
                if slots[at] == len(todo):
                    keys[at], slots[at] = h, k
                else:
                    rest.append((k, h))
            self.keys.append(keys)
            self.slots.append(slots)
            left = rest
        if left:
            raise ValueError("the vocabulary's hashes collide")

    def find(self, h: np.ndarray) -> np.ndarray:
        """The row in ids and scores of each hash; the last one where there is no piece."""
        none = len(self.ids) - 1
        at = (h * np.uint64(_ODD[0])) >> np.uint64(64 - self.BITS)
        out = self.slots[0][at]
        left = np.flatnonzero(((self.keys[0][at] != h) & (out != none)).ravel())  # the slot is another's: it may have overflowed
        flat, rest = out.reshape(-1), h.ravel()[left]
        flat[left] = none
        for level in (1, 2):
            at = (rest * np.uint64(_ODD[level])) >> np.uint64(64 - self.BITS)
            hit = (self.keys[level][at] == rest) & (self.slots[level][at] != none)
            flat[left[hit]] = self.slots[level][at[hit]]
        return out


_BASE, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_ODD = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def lattice(chunks: list[str], n: int, t: Table, v: Vocabulary) -> list[bytes | None]:
    """Ids of chunks of one length, all at once; None where a character is in no piece."""
    k = len(chunks)
    chars = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32).reshape(k, n).T.astype(np.uint64) + np.uint64(1)
    best = np.full((n + 1, k), -np.inf)
    size = np.zeros((n + 1, k), np.int8)
    best[0] = 0
    found, h = [], np.zeros((n, k), np.uint64)
    for m in range(1, min(n, v.longest) + 1):
        h = h[: n - m + 1] * np.uint64(_BASE) + chars[m - 1 :]
        found.append(t.find(h))
    scores = [t.scores[f] for f in found]
    scores[0] = np.where(found[0] < len(t.ids) - 1, scores[0], v.unk_score)  # any character may stand alone
    for e in range(1, n + 1):
        for m in range(1, min(e, v.longest) + 1):  # a longer last piece wins a tie
            score = scores[m - 1][e - m] + best[e - m]
            up = score >= best[e]
            np.copyto(best[e], score, where=up)
            np.copyto(size[e], m, where=up)
    ids, lens, at = np.zeros((k, n), np.int32), np.zeros(k, np.int32), np.full(k, n)
    every = np.arange(k)
    while (live := every[at > 0]).size:
        m = size[at[live], live]
        start = at[live] - m
        lens[live] += 1
        which = np.empty(len(live), np.int32)
        for x in np.unique(m):
            of = m == x
            which[of] = found[x - 1][start[of], live[of]]
        ids[live, n - lens[live]] = t.ids[which]
        at[live] = start
    flat, bad = ids.tobytes(), (ids < 0).any(axis=1).tolist()
    return [None if bad[i] else flat[4 * (i * n + n - c) : 4 * (i + 1) * n] for i, c in enumerate(lens.tolist())]


def merged(chunks: list[str], n: int, t: Table, v: Vocabulary) -> list[bytes | None]:
    """Ids of chunks of up to n characters by the model's merges; None where a character is in no piece."""
    lens = np.fromiter(map(len, chunks), np.int64, len(chunks))
    return _merged(np.frombuffer("".join([c.ljust(n) for c in chunks]).encode("utf-32-le"), np.uint32), lens, n, t)


def _merged(chars: np.ndarray, lens: np.ndarray, n: int, t: Table) -> list[bytes | None]:
    """``merged`` of n code points a chunk, of which the first ``lens`` count: one merge in each chunk a round."""
    k, base, none = len(lens), np.uint64(_BASE), len(t.ids) - 1
    cols = np.arange(n)
    alive = cols < lens[:, None]
    h = chars.astype(np.uint64) + np.uint64(1)
    power = np.full(n + 1, base)
    power[0] = 1
    np.multiply.accumulate(power, out=power)
    pair = np.full((k, n), none, np.int32)  # the piece that a part and the next one make
    two = alive[:, 1:]
    grid = h.reshape(k, n)
    pair[:, :-1][two] = t.find((grid[:, :-1] * base + grid[:, 1:])[two])
    scores = t.scores.astype(np.float32)
    score = scores[pair]
    pair, flat, alive = pair.ravel(), score.ravel(), alive.ravel()
    part, size = np.full(k * n, -1, np.int32), np.ones(k * n, np.int32)
    after = np.arange(1, k * n + 1)
    before = after - 2
    first, end = np.arange(k) * n, np.arange(k) * n + lens
    while True:
        a = score.argmax(1) + first  # the leftmost of equals
        go = np.flatnonzero(flat[a] > -np.inf)
        if not go.size:
            break
        a = a[go]
        b = after[a]
        h[a] = h[a] * power[size[b]] + h[b]
        size[a] += size[b]
        part[a] = pair[a]
        alive[b] = False
        flat[b] = flat[a] = -np.inf
        c, stop = after[b], end[go]
        after[a] = c
        right = c < stop
        before[c[right]] = a[right]
        p = before[a]
        left = p >= first[go]
        x, y = np.r_[a[right], p[left]], np.r_[c[right], a[left]]  # the two pairs that have the merged part
        pair[x] = t.find(h[x] * power[size[y]] + h[y])
        flat[x] = scores[pair[x]]
    kept = np.flatnonzero(alive)
    part = part[kept]
    single = np.flatnonzero(part < 0)
    part[single] = t.find(h[kept[single]])
    ids = t.ids[part]
    cuts = np.searchsorted(kept, np.r_[first, k * n])
    bad = np.zeros(k, bool)
    bad[kept[ids < 0] // n] = True
    out, cuts = ids.tobytes(), (4 * cuts).tolist()
    return [None if x else out[i:j] for x, i, j in zip(bad.tolist(), cuts[:-1], cuts[1:])]


_WIDTHS = (4, 6, 8, 10, 12, 16, 24, 40, TOGETHER)  # chunks of about one length merge together


class Memo:
    """Ids of chunks (UTF-8) between settled boundaries, in two generations: when the younger is full, the older goes. So memory is bounded and frequent chunks stay."""

    def __init__(self, v: Vocabulary, most: int = 250_000):
        self.v, self.most, self.table, self.young, self.older = v, most, None, {}, {}

    def ids(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of different chunks, 32 bits each."""
        if len(self.young) > self.most:
            self.young, self.older = {}, self.young
        got = list(map(self.young.get, chunks))
        left = [i for i, x in enumerate(got) if x is None]
        if self.older:
            for i, x in zip(left, map(self.older.get, [chunks[i] for i in left])):
                if x is not None:
                    self.young[chunks[i]] = got[i] = x
            left = [i for i in left if got[i] is None]
        self.learn([chunks[i] for i in left if len(chunks[i]) <= TOGETHER])
        for i in left:
            got[i] = self.young.get(chunks[i]) or self.streamed(chunks[i])
        return got

    def learn(self, new: list[bytes]) -> None:
        """Encode unknown chunks of up to ``TOGETHER`` bytes together, by length."""
        if not new:
            return
        self.table = self.table or Table(self.v)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        data, starts = np.frombuffer(b"".join(new), np.uint8), np.cumsum(sizes) - sizes
        plain = np.maximum.reduceat(data, starts) < 128
        if self.v.merges:
            width = np.array(_WIDTHS)[np.searchsorted(_WIDTHS, sizes)]
        else:
            width = np.fromiter((len(c) if p else len(c.decode()) for c, p in zip(new, plain.tolist())), np.int64, len(new))
        for n in np.unique(width).tolist():
            for ascii_ in (True, False):
                group = np.flatnonzero((width == n) & (plain == ascii_))
                if self.v.merges and len(group) < 20:
                    continue  # so few are faster one by one
                for i in range(0, len(group), 8192):
                    at = group[i : i + 8192]
                    part = [new[k] for k in at.tolist()]
                    if self.v.merges and ascii_:
                        got = _merged(data[np.minimum(starts[at, None] + np.arange(n), len(data) - 1)].ravel(), sizes[at], n, self.table)
                    else:
                        got = (merged if self.v.merges else lattice)([c.decode() for c in part], n, self.table, self.v)
                    self.young.update((c, ids) for c, ids in zip(part, got) if ids is not None)

    def streamed(self, chunk: bytes) -> bytes:
        ids = np.fromiter((i for part in stream(chunk.decode().replace(" ", BLANK), self.v) for i in part), np.int32).tobytes()
        if len(chunk) <= TOGETHER:
            self.young[chunk] = ids
        return ids


def gather(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ranges of ``flat``, one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends):
        return flat[:0]
    return flat[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]))]


class Codec:
    """Encode and decode whole texts in one process, a slice of them at a time."""

    def __init__(self, v: Vocabulary, dummy_prefix: bool = True):
        self.v, self.dummy, self.memo = v, dummy_prefix, Memo(v)
        names = [*v.names, "\ufffd".encode()]  # the last one stands for ids outside the vocabulary
        self.sizes = np.array([len(n) for n in names], np.int64)
        self.starts, self.bytes_ = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(names), np.uint8)

    def encode_slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts; a null has none. Each different chunk is looked up once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if self.dummy:
            texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())))
        data, offsets = raw(texts)
        whole = data.tobytes()
        if BLANK.encode() in whole:
            data, offsets = raw(pc.replace_substring(texts, BLANK, " "))
            whole = data.tobytes()
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if not self.v.words_part:
            parts = [np.fromiter((i for part in stream(whole[a:z].decode().replace(" ", BLANK), self.v) for i in part), np.int32) for a, z in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])]
        blank, line = data == 32, (data == 10) & self.v.line_parts
        head = line.copy()
        head[1:] |= line[:-1] | (blank[1:] & ~blank[:-1])
        head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(head)
        ends = np.r_[starts[1:], len(data)]
        _, at, back = np.unique(hashes(data, starts, ends), return_index=True, return_inverse=True)
        chunks = [whole[a:z] for a, z in zip(starts[at].tolist(), ends[at].tolist())]
        known = self.memo.ids(chunks)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        counts = sizes[back]
        ids = gather(np.frombuffer(b"".join(known), np.int32), (np.cumsum(sizes) - sizes)[back], counts)
        return ids, np.r_[0, np.cumsum(counts)][np.searchsorted(starts, offsets)]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_slice(pa.array([text], pa.large_string()))[0]

    def decode_slice(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(UTF-8 bytes, offsets) of lists of ids, with the leading blank."""
        ids = np.asarray(ids, np.int64)
        none = len(self.sizes) - 1
        ids = np.where((ids < 0) | (ids > none), none, ids)
        sizes = self.sizes[ids]
        return gather(self.bytes_, self.starts[ids], sizes), np.r_[0, np.cumsum(sizes)][offsets]

    def decode(self, ids: np.ndarray) -> str:
        text = self.decode_slice(ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace")
        return text[1:] if self.dummy and text[:1] == " " else text

    def lossless(self, texts: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether each text comes back from its ids."""
        got, at = self.decode_slice(ids, offsets)
        data, own = raw(texts)
        got, data, skip = got.tobytes(), data.tobytes(), int(self.dummy)
        return [data[a:z] == got[p + skip * (z > a) : q] for a, z, p, q in zip(own[:-1].tolist(), own[1:].tolist(), at[:-1].tolist(), at[1:].tolist())]


_CODECS: dict[tuple, Codec] = {}


def codec(v: Vocabulary) -> Codec:
    """This process's codec of the vocabulary: what one task has learned serves the next ones of the same worker."""
    if v.key not in _CODECS:
        _CODECS.clear()  # memory for one
        _CODECS[v.key] = Codec(v)
    return _CODECS[v.key]


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, pa.int32()))


def encode_documents(docs: DataFrame, path: str = MODEL, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """(doc_id, ids, n_tokens[, lossless]) of every row; other columns are left behind.

    A null or empty text has no ids and is lossless. Repeated rows are encoded
    each; an empty table gives no rows. ``lossless``: the decoded ids are the text
    (false only where the text holds the blank mark itself, or unknown ids).
    """
    scratch.small_batches(docs.sparkSession)
    v = Vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(v)
        for b in batches:
            for i, j in slices(raw(b.column(1))[1], SLICE):
                texts = b.column(1).slice(i, j - i)
                ids, offsets = own.encode_slice(texts)
                cols = [b.column(0).slice(i, j - i), _lists(ids, offsets), pa.array(np.diff(offsets))]
                if check:
                    cols.append(pa.array(own.lossless(texts, ids, offsets), pa.bool_()))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "ids", "n_tokens", "lossless"][: len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens bigint" + ", lossless boolean" * check)


def decode_documents(encoded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) from token ids; null ids give a null text, no ids an empty one.

    A null among the ids, and an id that the vocabulary doesn't have, negative ones too, gives
    the replacement character. Other columns are left behind; an empty table gives no rows.
    """
    v = Vocabulary(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(v)
        for b in batches:
            texts = [None if x is None else own.decode(np.array([-1 if i is None else i for i in x], np.int64)) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<bigint>").alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
