"""Scoring texts with a probabilistic suffix tree over words.

The root of the tree is the add-one unigram distribution P0 of the training words. A context is the run of the
1 to DEPTH words just before a word, within its text; its parent is the run without the farthest word, the
root for one word. A context is a state when its next-word distribution diverges from the one its parent
gives by a leave-one-out log-likelihood ratio of more than TEST nats; its next words are smoothed to that,
P(w | context) = (c + BETA * P(w | parent)) / (n + BETA), and a context that is no state hands on P(w | parent).
So a word is scored with the longest suffix before it that is a state. As P = P0 * (P / P0), a text's score is
its unigram score plus the logarithms of P / P0 at its places.

A context and all its suffixes end in the same word, so places are dealt into buckets by that word, and the
contexts of a bucket are counted, tested and used there. A word too frequent for one bucket is split by the
word before it; its own next-word counts are then summed over all rows and given to each of its buckets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .counts import top_k
from .store import keep, small_batches
from .textkit import groups, mix

DEPTH = 3
BETA = 1.0
TEST = 6.0
LEAST = 3
"""A context seen less often is never kept."""
HOT = 1 << 18
"""Words whose counts every task has at hand (4 MB); counts of other words are joined."""
BUCKET = 1 << 19
"""Mean number of training words for one bucket; each bucket is counted and scored in one task."""
BUCKETS_A_TASK = 8
ROWS = 36
"""Bits of a text's number in its task, in its row number."""
EMIT = 1 << 20
"""Places that a reading task packs at once."""
NONE = (1 << 24) - 1
"""In packed places, stands for no word before the text's first."""

_U = np.uint64
END = mix(np.array([0xE0D], _U))[0]


class Hot:
    """Counts of the most frequent words; rank 0 is the most frequent."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, tokens: int, kinds: int, size: int = BUCKET) -> None:
        order = np.lexsort((words, -counts))
        self.words, self.counts = words[order], counts[order]
        # two tables from bits of a word to a rank with these bits; words that lost both places are searched for
        self.bits = _U(max(1, int(4 * len(self.words)).bit_length()))
        self.tables, left = [], np.arange(len(self.words))
        for turn in range(2):
            table = np.full(1 << int(self.bits), -1, np.int32)
            slot = self._slot(self.words[left], turn)
            table[slot] = left
            self.tables.append(table)
            left = left[table[slot] != left]
        by = np.argsort(self.words[left])
        self.sorted, self.rank_of = self.words[left][by], left[by]
        self.tokens, self.kinds = tokens, kinds
        self.log_total = np.log10(tokens + kinds + 1)
        # parts that the places after a word are split into: about size in each
        self.splits = np.where(self.counts > 2 * size, -(-self.counts // size), 1).astype(_U)
        self.n_split = int((self.splits > 1).sum())  # the first ranks

    def _slot(self, w: np.ndarray, turn: int) -> np.ndarray:
        return ((w >> (self.bits * _U(turn))) & _U((1 << int(self.bits)) - 1)).astype(np.int64)

    def ranks(self, w: np.ndarray) -> np.ndarray:
        """Rank of each word, -1 where it is not among them."""
        out = np.full(len(w), -1, np.int32)
        if not len(self.words):
            return out
        open_ = None
        for turn, table in enumerate(self.tables):
            x = w if open_ is None else w[open_]
            r = table[self._slot(x, turn)]
            r[self.words[np.maximum(r, 0)] != x] = -1
            if open_ is None:
                out, open_ = r, np.flatnonzero(r < 0)
            else:
                out[open_] = r
                open_ = open_[r < 0]
        if len(self.sorted) and len(open_):
            at = np.minimum(np.searchsorted(self.sorted, w[open_]), len(self.sorted) - 1)
            hit = self.sorted[at] == w[open_]
            out[open_[hit]] = self.rank_of[at[hit]]
        return out


def _sequences(texts: pa.Array):
    """(first text, end text, words with an end after each text, bounds) of runs of texts."""
    for lo, hi, h, bounds in groups(texts):
        n = np.diff(bounds) + 1
        out = np.concatenate([[0], np.cumsum(n)])
        seq = np.full(int(out[-1]), END, _U)
        where = np.ones(len(seq), bool)
        where[out[1:] - 1] = False
        seq[where] = h
        yield lo, hi, seq, out


def _chain(before: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the runs of the 1, 2, ... words before a place; before: the nearest word first."""
    keys = [mix(before[0].astype(_U) + _U(0x51ED270B0A1F39C5))]
    for k, w in enumerate(before[1:], 2):
        keys.append(mix(keys[-1] + w.astype(_U) * _U(2 * k + 1)))
    return keys


def _pair(key: np.ndarray, nxt: np.ndarray) -> np.ndarray:
    return mix(key + nxt * _U(0x9E3779B97F4A7C15))


def _bucket(key: np.ndarray, part: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of places whose last word has this key; part: which of the parts the word is split into."""
    return (((mix(key + part) >> _U(32)) * _U(buckets)) >> _U(32)).astype(np.int64)


def _fold(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _count_words(batches):
    held, many = [], 0

    def emit():
        w, c = _fold(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        for at in range(0, len(w), 65536):
            yield pa.RecordBatch.from_arrays([pa.array(w[at : at + 65536].view(np.int64)), pa.array(c[at : at + 65536])], ["w", "c"])

    for b in batches:
        for _, _, seq, _ in _sequences(b.column("text")):
            u, c = np.unique(seq, return_counts=True)
            held.append((u, c.astype(np.int64)))
            many += len(u)
            if many > 4_000_000:
                held = [_fold(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))]
                many = len(held[0][0])
                if many > 2_000_000:
                    yield from emit()
                    held, many = [], 0
    if held:
        yield from emit()


def _press(*planes: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(b"".join(p.tobytes() for p in planes))


def _planes(v: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T)


_TEXT = [
    ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_hot", pa.int64()), ("base_hot", pa.float64()), ("tail", pa.list_(pa.int64())),
]
_TEXT_DDL = "row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_hot bigint, base_hot double, tail array<bigint>"
_READ = pa.schema([*_TEXT, ("bucket", pa.int64()), ("part", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_READ_DDL = f"{_TEXT_DDL}, bucket bigint, part bigint, n bigint, body binary"


def _batch(n: int, schema: pa.Schema, /, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def _splits(hot: Hot, w: np.ndarray) -> np.ndarray:
    """How many parts the places after each word are split into; w: ranks, or more for other words."""
    if not len(hot.splits):
        return np.ones(len(w), _U)
    return np.where(w < len(hot.splits), hot.splits[np.minimum(w, len(hot.splits) - 1)], _U(1))


def _home(hot: Hot, last: np.ndarray, names: tuple[np.ndarray, np.ndarray], buckets: int) -> np.ndarray:
    """Bucket of places with these last words; names: what the last word and the one before it are known by."""
    return _bucket(_chain([names[0]])[0], mix(names[1] + _U(1)) % _splits(hot, last), buckets)


def _read(shared, buckets: int):
    """Two kinds of rows from one pass of the texts: each text's unigram sums (bucket below 0, one for each task), and
    its places with a word before them, packed by bucket into a few large rows.

    A place is its DEPTH words before, its word and a code: twice the text's number in the task, plus 1 when held
    out. Words are ranks, or HOT and more for the packed row's own list of others.
    """

    def run(batches):
        from pyspark import TaskContext

        hot: Hot = shared.value
        many_hot = len(hot.words)
        part, row = TaskContext.get().partitionId(), 0
        known_log = np.log10(hot.counts + 1.0) - hot.log_total
        held: list[tuple[np.ndarray, ...]] = []
        others: list[np.ndarray] = []
        many = seen = 0

        def emit():
            *before, nxt, code = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            others_, place = np.unique(np.concatenate(others), return_inverse=True)
            others.clear()
            # words outside the hot table get one number for each different word; -1 is no word
            if len(place):
                place = place.astype(np.int32)
                for w in (*before, nxt):
                    far = np.flatnonzero(w >= many_hot)
                    w[far] = many_hot + place[w[far] - many_hot]
            names = np.concatenate([np.arange(many_hot, dtype=_U), others_])
            name = lambda w: names[w] if len(names) else w.astype(_U)
            bucket = _home(hot, before[0], (name(before[0]), name(np.maximum(before[1], 0))), buckets).astype(np.uint16 if buckets < 1 << 16 else np.int64)
            low = [w.astype(_U) & _U(NONE) for w in before]
            order = np.argsort(low[0] << _U(40) | low[1] << _U(16) | low[2] >> _U(8))
            del low
            order = order[np.argsort(bucket[order], kind="stable")]
            before, nxt, code, bucket = [w[order] for w in before], nxt[order], code[order], bucket[order].astype(np.int64)
            one = lambda x: pa.array([int(x)], pa.int64())
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, z in zip(first, np.append(first[1:], len(bucket)), strict=True):
                columns = [w[a:z] for w in (*before, nxt)]
                own = np.unique(np.concatenate([w[w >= many_hot] for w in columns]))
                for w in columns:
                    far = np.flatnonzero(w >= many_hot)
                    w[far] = many_hot + np.searchsorted(own, w[far])
                    w[w < 0] = NONE
                listed = others_[own - many_hot] if len(own) else np.zeros(0, _U)
                body = _press(listed, *(_planes(w, 3) for w in columns), _planes(code[a:z], 5))
                yield _batch(1, _READ, bucket=one(bucket[a]), part=one(part), n=one(z - a), body=pa.array([body], pa.binary()))

        for b in batches:
            out = b.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64)
            for lo, hi, seq, bounds in _sequences(b.column("text")):
                owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
                ranks = hot.ranks(seq)
                near = ranks >= 0
                tails = np.flatnonzero(~near)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(owner[tails], np.arange(hi - lo + 1)).astype(np.int32)), pa.array(seq[tails].view(np.int64))
                )
                yield _batch(
                    hi - lo, _READ, row=pa.array((part << ROWS) + row + np.arange(hi - lo)), doc_id=b.column("doc_id").slice(lo, hi - lo),
                    held_out=b.column("held_out").slice(lo, hi - lo), n_tokens=pa.array(np.diff(bounds).astype(np.int64)),
                    n_hot=pa.array(np.bincount(owner[near], minlength=hi - lo).astype(np.int64)),
                    base_hot=pa.array(np.bincount(owner[near], weights=known_log[ranks[near]], minlength=hi - lo).astype(np.float64)), tail=lists,
                    bucket=pa.array(np.full(hi - lo, -1 - part)),
                )
                words = ranks
                words[tails] = many_hot + seen + np.arange(len(tails))
                others.append(seq[tails])
                seen += len(tails)
                place = np.arange(len(seq)) - np.repeat(bounds[:-1], np.diff(bounds))
                at = np.flatnonzero(place > 0)
                before = [np.where(place[at] >= k, words[at - k], np.int32(-1)) for k in range(1, DEPTH + 1)]
                held.append((*before, words[at], 2 * (row + owner[at]) + out[lo + owner[at]]))
                many += len(at)
                row += hi - lo
                if many > EMIT:
                    yield from emit()
                    many = seen = 0
        if many:
            yield from emit()

    return run


_NEED_DDL = "bucket bigint, w bigint, nxt bigint, c bigint"


def _needs(shared, buckets: int):
    """What buckets need besides their places: (bucket, -1, word, 0) of words outside the hot table, and (-1, rank,
    next word, count) of what follows split words in training texts."""

    def run(batches):
        hot: Hot = shared.value
        many_hot = len(hot.words)

        def batch(bucket, w, nxt, c):
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64, copy=False)) for x in (bucket, w, nxt.view(np.int64), c)], ["bucket", "w", "nxt", "c"])

        def fold():
            bucket, w, nxt, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = _groups(mix(_pair(bucket.astype(_U), nxt) + w.astype(_U)))
            take = order[first]
            return bucket[take], w[take], nxt[take], np.add.reduceat(c[order], first)

        held, many = [], 0
        for b in batches:
            out = b.column("held_out").to_numpy(zero_copy_only=False)
            for lo, hi, seq, bounds in _sequences(b.column("text")):
                ranks = hot.ranks(seq)
                inner = np.ones(len(seq), bool)  # places with a word before them
                inner[bounds[:-1]] = False
                at = np.flatnonzero(inner & (ranks < 0))
                if len(at):
                    name = lambda k: np.where(ranks[k] >= 0, ranks[k].astype(_U), seq[k])
                    second = np.where(inner[at - 1], name(at - 2), _U(0))
                    bucket = _home(hot, np.where(ranks[at - 1] >= 0, ranks[at - 1], many_hot), (name(at - 1), second), buckets)
                    held.append((bucket, np.full(len(at), -1), seq[at], np.zeros(len(at), np.int64)))
                learn = np.repeat(~out[lo:hi], np.diff(bounds)) & inner
                learn[1:] &= (ranks[:-1] >= 0) & (ranks[:-1] < hot.n_split)
                learn[0] = False
                at = np.flatnonzero(learn)
                if len(at):
                    held.append((np.full(len(at), -1), ranks[at - 1].astype(np.int64), np.where(ranks[at] >= 0, ranks[at].astype(_U), seq[at]), np.ones(len(at), np.int64)))
                many += sum(len(x[0]) for x in held[-2:])
                if many > EMIT:
                    held = [fold()]
                    many = len(held[0][0])
                    if many > EMIT // 2:
                        yield batch(*held[0])
                        held, many = [], 0
        if held:
            done = fold()
            for k in range(0, len(done[0]), 65536):
                yield batch(*(x[k : k + 65536] for x in done))

    return run


def _unpack(body, n: int, hot: Hot) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(words before, nearest first; whether each is there; words; codes) of a packed row's places. A word is its
    rank in the hot table or else its hash."""
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    many_hot, at = len(hot.words), len(raw) - n * (3 * (DEPTH + 1) + 5)
    names = np.concatenate([np.arange(many_hot, dtype=_U), raw[:at].view("<u8").astype(_U)])

    def take(width):
        nonlocal at
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = raw[at : at + n * width].reshape(width, n).T
        at += n * width
        return out.reshape(-1).view("<u8").astype(np.int64)

    before, there = [], []
    for _ in range(DEPTH):
        w = take(3)
        there.append(w < NONE)
        before.append(np.where(there[-1], names[np.minimum(w, len(names) - 1)], _U(NONE)) if len(names) else np.full(n, NONE, _U))
    nxt = take(3)
    return before, there, names[nxt], take(5)


class Roots:
    """P0 of words, by rank or hash."""

    def __init__(self, hot: Hot, words: np.ndarray, counts: np.ndarray) -> None:
        """words, counts: hashes and training counts of words outside the hot table."""
        self.hot = hot
        self.words, first = np.unique(words, return_index=True)
        self.counts = counts[first]

    def __call__(self, w: np.ndarray) -> np.ndarray:
        many, c = len(self.hot.counts), np.zeros(len(w))
        near = w < _U(many)
        c[near] = self.hot.counts[w[near].astype(np.int64)]
        if len(self.words):
            far = np.flatnonzero(~near)
            at = np.minimum(np.searchsorted(self.words, w[far]), len(self.words) - 1)
            c[far] = np.where(self.words[at] == w[far], self.counts[at], 0)
        return (c + 1) / (self.hot.tokens + self.hot.kinds + 1)


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order of the keys, first of each group of equal ones in that order)."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)


class Tree:
    """The states of one bucket, by length: every context that passes the divergence test, with all its next words."""

    def __init__(self, before: list[np.ndarray], there: list[np.ndarray], nxt: np.ndarray, c: np.ndarray, whole: tuple[np.ndarray, ...], roots: Roots) -> None:
        """before, there, nxt, c: counts of the bucket's training places. whole (word, next word, count): the counts over
        all rows of the words that are split, in place of the bucket's own."""
        self.levels: list[tuple[np.ndarray, ...]] = []
        keys, p0 = _chain(before), roots(nxt)
        split = np.unique(whole[0])
        for d in range(DEPTH):
            if d == 0:
                own = np.flatnonzero(there[0] & ~np.isin(before[0], split))
                key = np.concatenate([keys[0][own], _chain([whole[0]])[0]])
                word, many = np.concatenate([nxt[own], whole[1]]), np.concatenate([c[own], whole[2]])
                lower = np.concatenate([p0[own], roots(whole[1])])
            else:
                own = np.flatnonzero(there[d])
                key, word, many = keys[d][own], nxt[own], c[own]
                lower = None
            order, first = _groups(key)
            if len(first):  # rare contexts go before the costlier part
                n = np.repeat(np.add.reduceat(many[order], first), np.diff(np.append(first, len(order))))
                often = order[n >= LEAST]
                n = n[n >= LEAST]
            if not len(first) or not len(often):
                self.levels.append((np.zeros(0, _U), np.zeros(0), np.zeros(0, _U), np.zeros(0)))
                continue
            pair = _pair(key[often], word[often])
            order, first = _groups(pair)
            take, count, n = often[order[first]], np.add.reduceat(many[often[order]], first).astype(float), n[order[first]].astype(float)
            pair, key = pair[order[first]], key[take]
            if lower is None:
                at = own[take]
                parent = self.probability([k[at] for k in keys[:d]], [x[at] for x in there[:d]], nxt[at], p0[at])
            else:
                parent = lower[take]
            gain = count * np.log(((count - 1) / parent + BETA) / (n - 1 + BETA))
            order, first = _groups(key)
            passed = np.add.reduceat(gain[order], first) > TEST
            states, seen = key[order[first]][passed], n[order[first]][passed]
            stay = np.zeros(len(key), bool)
            stay[order] = np.repeat(passed, np.diff(np.append(first, len(order))))
            self.levels.append((states, seen, pair[stay], count[stay]))

    def probability(self, keys: list[np.ndarray], there: list[np.ndarray], nxt: np.ndarray, p0: np.ndarray) -> np.ndarray:
        """P of each next word, with the longest states there are among the given contexts."""
        p = p0.copy()
        for key, here, (states, seen, pairs, counts) in zip(keys, there, self.levels, strict=False):
            if not len(states):
                continue
            s = np.minimum(np.searchsorted(states, key), len(states) - 1)
            at = np.flatnonzero((states[s] == key) & here)
            pair = _pair(key[at], nxt[at])
            j = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
            c = np.where(pairs[j] == pair, counts[j], 0.0)
            p[at] = (c + BETA * p[at]) / (seen[s[at]] + BETA)
        return p


def _together(held: list[tuple]) -> tuple:
    before, there = ([np.concatenate(x) for x in zip(*(h[k] for h in held), strict=True)] for k in (0, 1))
    return before, there, *(np.concatenate([h[k] for h in held]) for k in (2, 3))


def _merged(held: list[tuple]) -> tuple:
    """Places with counts, those that are alike as one: words before, whether there, next word, count."""
    before, there, nxt, c = _together(held)
    order, first = _groups(_pair(_chain(before)[-1], nxt))
    take = order[first]
    return [w[take] for w in before], [x[take] for x in there], nxt[take], np.add.reduceat(c[order], first) if len(first) else c


_FOUND = pa.schema([*_TEXT, ("part", pa.int64()), ("n", pa.int64()), ("body", pa.binary())])
_FOUND_DDL = f"{_TEXT_DDL}, part bigint, n bigint, body binary"


def _score(shared, size: int):
    """The states of a bucket from its training places, and the sums of log10(P / P0) of all its places by text.

    Places are unpacked one packed row at a time, and equal ones merged in between, so a run of words that very many
    texts share costs memory for its different neighbours only. A bucket below 0 holds texts, which pass through.
    """

    def run(key, packed, extra):
        hot: Hot = shared.value
        if key[0].as_py() < 0:
            return packed.select(_FOUND.names)
        rows = [(p, n, x.as_buffer()) for p, n, x in zip(*(packed.column(c).to_pylist() for c in ("part", "n")), packed.column("body"), strict=True)]
        w, nxt, c, known = (extra.column(x).to_numpy() for x in ("w", "nxt", "c", "known"))
        far, whole = known >= 0, w >= 0
        roots = Roots(hot, nxt[far].view(_U), known[far])
        few = sum(n for _, n, _ in rows) <= 2 * size
        held, open_, many = [], [], 0
        for _, n, body in rows:
            places = _unpack(body, n, hot)
            if few:
                open_.append(places)
            before, there, word, code = places
            learn = np.flatnonzero(code & 1 == 0)
            held.append(([x[learn] for x in before], [x[learn] for x in there], word[learn], np.ones(len(learn), np.int64)))
            many += len(learn)
            if many > 2 * size:
                held = [_merged(held)]
                many = len(held[0][2])
        out = []
        if held:
            tree = Tree(*_together(held), (w[whole].astype(_U), nxt[whole].view(_U), c[whole]), roots)
            del held
        for k, (part, n, body) in enumerate(rows):
            before, there, word, code = open_[k] if few else _unpack(body, n, hot)
            p0 = roots(word)
            p = tree.probability(_chain(before), there, word, p0)
            at = np.flatnonzero(p != p0)
            if len(at):
                value = np.log10(p[at] / p0[at])
                texts, own = np.unique(code[at] >> 1, return_inverse=True)
                sums = np.bincount(own, weights=value).astype("<f4")
                out.append({"part": part, "n": len(texts), "body": _press(_planes(np.diff(texts, prepend=0), 5), sums)})
        return pa.Table.from_pylist(out, schema=_FOUND)

    return run


def _gather(key, table):
    """Sums by text of the buckets' sums: the texts of one task of _read."""
    import zstandard

    part, texts, sums = key[0].as_py(), [], []
    for n, body in zip(table.column("n").to_pylist(), table.column("body").to_pylist(), strict=True):
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :5] = raw[: 5 * n].reshape(5, n).T
        texts.append(np.cumsum(wide.reshape(-1).view("<u8")).astype(np.int64))
        sums.append(raw[5 * n :].view("<f4"))
    texts, own = np.unique(np.concatenate(texts), return_inverse=True)
    return pa.table({"row": pa.array((part << ROWS) + texts), "extra": pa.array(np.bincount(own, weights=np.concatenate(sums)).astype(np.float64))})


def _to_buckets(shared, buckets: int):
    """Rows (bucket, w, nxt, c, known) of split words w, each for all buckets of its word."""

    def run(batches):
        hot: Hot = shared.value
        homes: dict[int, np.ndarray] = {}
        for b in batches:
            ranks, own = np.unique(b.column("w").to_numpy(), return_inverse=True)
            for r in ranks.tolist():
                if r not in homes:
                    parts = np.arange(int(hot.splits[r]), dtype=_U)
                    homes[r] = np.unique(_bucket(np.repeat(_chain([np.array([r], _U)])[0], len(parts)), parts, buckets))
            many = np.array([len(homes[r]) for r in ranks.tolist()])
            for k in range(int(many.max(initial=0))):  # each row's k-th bucket
                rows = b.filter(pa.array(many[own] > k))
                at = own[many[own] > k]
                home = np.array([homes[r][k] if len(homes[r]) > k else -1 for r in ranks.tolist()])[at]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int64)), *rows.columns[1:]], rows.schema.names)

    return run


def score_texts(docs: DataFrame, hot_words: int = HOT, size: int = BUCKET) -> DataFrame:
    """docs (doc_id, text, held_out boolean): learn from rows not held out, score all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known, train_tokens, base_score (unigram,
    add one), score (suffix tree); logarithms to base 10. Null texts count as empty: one end token. Counts
    of words and contexts are taken over all training texts and merged by shuffles; every context that passes
    the test is a state, and places meet the states in the bucket of their last word. On the driver come
    hot_words word counts only; neither that number nor size (training words for a bucket) changes a score.
    A table without training rows scores with N = V = 0; an empty table gives no rows; repeated rows are
    learned and scored as often as they stand there; a null doc_id is scored like any; a null held_out is
    false; other columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    docs = docs.select("doc_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    train = docs.where("not held_out").select("text")
    words = keep(train.mapInArrow(_count_words, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c")), "words")
    stats = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = int(stats["n"]), int(stats["v"])
    ranked = words.withColumn("tie", F.shiftright("w", 2))
    top = ranked.where(top_k(ranked, hot_words, "c", "tie")).select("w", "c").toArrow()  # hot_words rows
    hot_shared = sc.broadcast(hot := Hot(top["w"].to_numpy().view(_U), top["c"].to_numpy(), tokens, kinds, size))

    buckets = max(8, tokens // size)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS_A_TASK)
    needs = docs.mapInArrow(_needs(hot_shared, buckets), _NEED_DDL).groupBy("bucket", "w", "nxt").agg(F.sum("c").alias("c"))
    needs = needs.join(words.select(F.col("w").alias("nxt"), F.col("c").alias("known")), "nxt", "left")
    needs = keep(needs.select("bucket", "w", "nxt", "c", F.coalesce("known", F.lit(-1)).alias("known")).where("w >= 0 or known >= 0"), "next-words")
    split = needs.where("w >= 0").mapInArrow(_to_buckets(hot_shared, buckets), f"{_NEED_DDL}, known bigint")
    extra = needs.where("w < 0").unionByName(split)
    with small_batches(spark):
        read = docs.mapInArrow(_read(hot_shared, buckets), _READ_DDL).repartition(tasks, "bucket").groupBy("bucket")
        found = keep(read.cogroup(extra.repartition(tasks, "bucket").groupBy("bucket")).applyInArrow(_score(hot_shared, size), _FOUND_DDL), "contexts")
    scored = found.where("row is not null").select("row", "doc_id", "held_out", "n_tokens", "n_hot", "base_hot", "tail")
    sums = found.where("body is not null").select("part", "n", "body").groupBy("part").applyInArrow(_gather, "row bigint, extra double")

    log_total = F.lit(float(hot.log_total))
    tail = (
        scored.select("row", F.explode("tail").alias("w")).join(words, "w", "left").groupBy("row")
        .agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - log_total).alias("base_tail"), F.count("c").alias("n_tail"))
    )
    base = F.col("base_hot") + F.coalesce("base_tail", F.lit(0.0))
    return scored.drop("tail").join(tail, "row", "left").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_hot") + F.coalesce("n_tail", F.lit(0))).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (base + F.coalesce("extra", F.lit(0.0))).alias("score"),
    )


def op3_suffix_tree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return score_texts(docs.select("doc_id", "text", held.alias("held_out")))
