"""Near-duplicate passages by compact windows.

A document is a sequence of 5-word shingles (lower case, white space between
words). For one hash function, the Cartesian tree of the shingles' hashes gives
each shingle c the widest window in which it is the least; every passage of
`width` shingles in that window has its min-hash at c. A passage of 50 words
has 46 shingles, which is `width`. Two passages of similarity s share the
min-hash of a function with chance s.

1. Interval join within a document. The functions are taken in pairs; where the
   windows of the two functions of a pair overlap by `width` shingles or more,
   they make a run with both min-hashes as its key. Such a run is as rare as the
   two shingles together, so documents that merely share a phrase seldom meet.
   A run carries two sketches, 4 bits of the min-hash of every function in the
   `HALF` shingles up to its middle and in those from there on. Wherever it lies
   in a passage, one of the two halves is inside the passage.
2. Interval join between documents. Runs shuffle by key. Of runs with the same
   key and sketches the first stands for all, and each other one is linked to
   it. Of runs with the same key and the same sketch of one half, `ALIKE` stand
   for all, and each other one is linked to one of these that is about as alike
   as any. That is done in blocks of `COMBINE` runs before the shuffle and again
   after it, so a passage in a third of all documents sends a few runs a block.
   Of the runs that stand for others, each is linked to the first of
   those of its key that are about as alike as any earlier one (`AGREE` functions
   or more of a half, within `ABOUT` of the most), not to the first of all: a document that holds a passage in part does not stand between
   two that hold it whole.
3. Links are aggregated by pair of documents to the stretch that they cover in
   either one. Each text is read once and gives the stretches that any pair
   asks for; texts never travel with pairs.
4. Verification on all shingles (as 32-bit hashes) of both stretches: the
   segments of `width` shingles or more with the best scores (+1 for a shared
   shingle, a loss for any other) are proposed on both sides, for shares from
   that of equally long sides down to `similarity`; one counts from a Jaccard
   similarity of `similarity`, whatever its share.
5. The rest. Steps 2 to 4 look at a few partners of each run only. Every run of
   a key that more than two have, those that others stand for too, gets labels
   of its place: the same ones where chains of verified passages link two places
   (cells of `CELL` shingles). Runs of a key without a label in common, directly
   or through others, are in different components. All pairs of runs of different
   components that can hold similar passages are found by their shingles, with
   `HALF` more on both sides, and verified as in step 4. Of what turns out similar
   on the way, pairs that make one component of two are enough.
6. A passage that two documents share with each other is left out where both
   share it with the first partner of each: they are linked by that one.

Chances. At similarity 0.8 a stretch of 46 shingles shares a key with its
counterpart with chance 0.98 (1 - 0.36^4); longer passages hold many stretches.
Exact passages share all keys, and a half's sketch with each.

Many runs of one key. In step 2 up to `DENSE` are compared each with each, by
their sketches alone; above, those that agree in four functions of a half meet,
in blocks of `DENSE` in the order of their sketches. This only chooses what is
verified first: `ALIKE`, `ABOUT`, `DENSE` and `COMBINE` bound no result, as step 5
holds all components of a key against each other. A group too large for a task
is dealt in blocks of which each two meet, but for those of one component.
Places that adjoin a linked passage by less than `CELL` shingles count as linked.

Defined results
  null, empty or short text  (under 50 words) no passage
  copies of a document       linked to the first of them, by one row
  a passage twice in one     not reported (passages that repeat across documents are)
  document
  null doc_id                left out: it can't be named
  repeated rows              rows with one doc_id are one document
  very long text             cut into overlapping parts of `PART` shingles
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbiter.llm.common import materialise, partitions
from arbiter.llm.components import connected_components
from arbiter.llm.pretokens import pieces

SHINGLE = 5
WORDS = 50
WIDTH = WORDS - SHINGLE + 1
FUNCTIONS = 8
HALF = WIDTH // 2  # shingles of a sketch
AGREE = 4  # functions of FUNCTIONS
ALIKE = 16
ABOUT = 3  # functions of both halves
SIMILARITY = 0.8
BATCH = 1 << 18  # shingles worked on together
STEP = 256  # documents hashed together
PART, OVERLAP = 1 << 22, 1 << 12  # shingles of a part of a very long text, and how many of them the next one repeats
COMBINE = 1_500_000  # runs combined before the shuffle, and looked at together after it
DENSE = 256
CELL, LABELS, EDGE = HALF, 4, 4  # shingles under one label, labels of a run's place, and shingles at its ends that don't count for them
LONGEST = 2048  # shingles of a stretch that is looked at for segments before its pairs are verified
TOGETHER = 8192  # runs of a block where a key's unlinked runs are too many for one task
PAIRS = 1 << 22  # pairs looked at together
FIRST = 1 << 12  # and how many of them at first, as what they link needs no more pairs
ROWS = 1024  # stretches whose shingles are counted together
SCORE = 10_000  # of a hit, so that scores are whole numbers
TRIES = 2  # pairs of two components that are verified in full before the rest of them wait for the verification of all
LONG = 8 * WIDTH  # shingles of two stretches that wait for it at once
MARKS = 1 << 22  # marks and shingles held at a time while pairs are looked at
_POS = np.uint64((1 << 24) - 1)
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_FACTORS = np.random.default_rng(20).integers(0, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLES, _LOW = np.uint64(0x1111111111111111), np.uint64((1 << 32) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words without spaces: each byte times a factor of its place, summed and mixed."""
    if not words:
        return np.empty(0, np.uint64)
    raw = np.frombuffer((" ".join(words) + " ").encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.flatnonzero(raw == 32) + 1
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts)
    value = (raw.astype(np.uint64) + np.uint64(1)) * _FACTORS[place % len(_FACTORS)]
    if (ends - starts).max() > len(_FACTORS):
        value *= (place // len(_FACTORS) * 2 + 1).astype(np.uint64)
    return _mix(np.add.reduceat(value, starts))


def shingles(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's shingles."""
    return all_shingles([text])[0]


def all_shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The same of many texts."""
    sizes, hashes, words, n = [], [], [], 0
    for text in texts:
        size = 0
        for piece in pieces(text or ""):
            found = piece.lower().split()
            words.append(found)
            size += len(found)
            n += len(found)
            if n >= BATCH:
                hashes.append(word_hashes(list(chain.from_iterable(words))))
                words, n = [], 0
        sizes.append(size)
    h = np.concatenate([*hashes, word_hashes(list(chain.from_iterable(words)))])
    m = max(0, len(h) - SHINGLE + 1)
    mixed = np.zeros(m, np.uint64)
    for k in range(SHINGLE):
        mixed = (mixed ^ h[k : k + m]) * np.uint64(_MIX[k])
        mixed ^= mixed >> np.uint64(29)
    out, at = [], 0
    for size in sizes:
        out.append(mixed[at : at + max(0, size - SHINGLE + 1)])
        at += size
    return out


class Windows:
    """Compact windows of several documents laid end to end, with a 0 between them that no window crosses."""

    def __init__(self, docs: list[np.ndarray], width: int = WIDTH):
        self.width = width
        gap = np.zeros(1, np.uint64)
        self.flat = np.concatenate([gap, *[x for d in docs for x in (d, gap)]])
        lengths = np.array([len(d) for d in docs])
        self.starts = np.concatenate(([1], 1 + np.cumsum(lengths + 1)[:-1]))
        self.ends = self.starts + lengths
        self.edge = np.zeros(len(self.flat), bool)
        self.edge[np.concatenate((self.starts - 1, [len(self.flat) - 1]))] = True
        n = len(self.flat) - width + 1
        crossed = np.concatenate(([0], np.cumsum(self.edge)))
        self.valid = np.flatnonzero(crossed[width:] == crossed[: len(self.flat) - width + 1]) if n > 0 else np.empty(0, np.int64)

    def order(self, function: int) -> np.ndarray:
        """Hashes of one function, with the place in the low bits: all differ, and of equal shingles the first is least."""
        h = _mix(self.flat + np.uint64((function + 1) * _MIX[0] & (1 << 64) - 1))
        h = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
        h[self.edge] = np.flatnonzero(self.edge).astype(np.uint64)  # below every shingle
        return h

    def minima(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the least of each stretch of `width` shingles (those that start at `valid`), and the least of half as many from each place on."""
        short = self.half(h)
        size, m = self.width // 2, short
        w = np.minimum(m[: len(m) - size], m[size:])
        if self.width % 2:
            w = np.minimum(w[:-1], h[self.width - 1 :])
        return (w[self.valid] & _POS).astype(np.int64), short

    def half(self, h: np.ndarray) -> np.ndarray:
        m, size, half = h, 1, self.width // 2
        while size * 2 <= half:
            m = np.minimum(m[: len(m) - size], m[size:])
            size *= 2
        rest = half - size
        return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each pair of functions (key, sketch, first shingle, last shingle); runs of one key that overlap in a document are one."""
        if not len(self.valid):
            return
        hashes = [self.order(f) for f in range(FUNCTIONS)]
        least, halves = zip(*map(self.minima, hashes))
        half = self.width // 2
        for pair, f in enumerate(range(0, FUNCTIONS, 2)):
            c, d = least[f], least[f + 1]
            at = np.flatnonzero((np.diff(c, prepend=-1) != 0) | (np.diff(d, prepend=-1) != 0))
            start, last = self.valid[at], self.valid[np.append(at[1:], len(self.valid)) - 1]
            c, d = c[at], d[at]
            bits = np.uint64(24)
            key = _mix(_mix((hashes[f][c] >> bits) + np.uint64(_MIX[pair])) ^ (hashes[f + 1][d] >> bits))
            key = (key & ~np.uint64(3)) | np.uint64(pair)
            middle, doc = (c + d) // 2, np.searchsorted(self.starts, start, side="right")
            low, high = self.starts[doc - 1], self.ends[doc - 1] - half
            sketch = np.zeros(len(at), np.uint64)
            for shift, about in ((0, np.clip(middle - half + 1, low, high)), (32, np.clip(middle, low, high))):
                for k, m in enumerate(halves):
                    sketch |= (m[about] >> bits & np.uint64(15)) << np.uint64(shift + 4 * k)
            end = last + self.width - 1
            by = np.lexsort((start, key))
            key, start, end, sketch, doc = key[by], start[by], end[by], sketch[by], doc[by]
            first = np.ones(len(key), bool)
            first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
            to = np.flatnonzero(first)
            yield key[to], sketch[to], start[to], end[np.append(to[1:], len(key)) - 1]


def _laid_out(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Ids, places in the text and shingles of documents or parts of them, about BATCH shingles at a time."""
    ids, places, docs, n = [], [], [], 0
    for b in batches:
        for lo in range(0, b.num_rows, STEP):
            part = b.slice(lo, STEP)
            for i, s in zip(part.column(0).to_pylist(), all_shingles(part.column(1).to_pylist())):
                for at in range(0, max(1, len(s) - OVERLAP), PART - OVERLAP):
                    cut = s[at : at + PART]
                    if len(cut) < WIDTH:
                        continue
                    if n and n + len(cut) > BATCH:
                        yield ids, places, docs
                        ids, places, docs, n = [], [], [], 0
                    ids.append(i)
                    places.append(at)
                    docs.append(cut)
                    n += len(cut)
    if ids:
        yield ids, places, docs


#: A run (to = _RUN; b counts runs of its key that were left out in its block, at one of them), one that another stands for (to = _LEFT; its key in `sketch`), or a link of a run to
#: the one at `to` in document b. Places hold the first and last shingle in 32 bits each.
_RUNS = "key long, sketch long, doc_id long, place long, b long, to long"
_RUN, _LEFT = -1, -2
#: A link; or, where lb is -1, a run of a key that more than two runs have: the key, the document, and its first and last shingle.
_LINKS = "a long, b long, la int, ra int, lb int, rb int"


def _place(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 32 | end.astype(np.int64)


def _turned(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, at, b, to) of links between documents, the larger id first."""
    turn, other = a < b, a != b
    return tuple(x[other] for x in (np.where(turn, b, a), np.where(turn, to, at), np.where(turn, a, b), np.where(turn, at, to)))


def _ends(at: np.ndarray, to: np.ndarray) -> list[np.ndarray]:
    """(la, ra, lb, rb) of places."""
    return [x.astype(np.int32) for x in (at >> 32, at & (1 << 32) - 1, to >> 32, to & (1 << 32) - 1)]


def _hulls(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, ...]:
    """(a, at, b, to) with one row for each pair of documents: the stretches that its links cover."""
    by = np.lexsort((b, a))
    a, at, b, to = a[by], at[by], b[by], to[by]
    k = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, np.int64)
    if not len(k):
        return a, at, b, to
    la, ra, lb, rb = _ends(at, to)
    low, high = (lambda x: np.minimum.reduceat(x, k)), (lambda x: np.maximum.reduceat(x, k))
    return a[k], _place(low(la), high(ra)), b[k], _place(low(lb), high(rb))


def _agreement(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In how many functions two sketches with the difference x agree: in the better half, and in both."""
    x = x | x >> np.uint64(1)
    x = (x | x >> np.uint64(2)) & _NIBBLES
    left, right = np.bitwise_count(x & _LOW).astype(np.int64), np.bitwise_count(x >> np.uint64(32)).astype(np.int64)
    return FUNCTIONS - np.minimum(left, right), 2 * FUNCTIONS - left - right


class _Runs:
    """Runs of whole keys: those that are alone with their key, those that stand for others, and the links of the rest to these; of those that share a key and a half's sketch, `alike` stand for all."""

    def __init__(self, key: np.ndarray, sketch: np.ndarray, doc: np.ndarray, place: np.ndarray, alike: int | None = None):
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        many = np.zeros(len(key), bool)
        many[1:] |= same
        many[:-1] |= same
        self.alone, self.rows = (tuple(x[by[one]] for x in (key, sketch, doc, place)) for one in (~many, many))
        self.left: list[tuple] = []
        self.linked: list[tuple] = []
        self._leave(self.rows[1], 1)
        for shift in (0, 32) if alike else ():
            self._leave(self.rows[1] >> np.uint64(shift) & _LOW, alike)

    def _leave(self, part: np.ndarray, most: int) -> None:
        key, _, doc, place = self.rows
        if not len(key):
            return
        by = np.lexsort((place, doc, part, key))
        (key, sketch, doc, place), part = (x[by] for x in self.rows), part[by]
        start = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        start = np.repeat(start, np.diff(np.append(start, len(key))))
        stays = np.arange(len(key)) - start < most
        rest = np.flatnonzero(~stays)
        to = start[rest]
        if most > 1:
            alike = [_agreement(sketch[rest] ^ sketch[to + d])[1] for d in range(most)]
            alike = np.stack(alike)
            to = to + np.argmax(alike >= alike.max(axis=0) - ABOUT, axis=0)
        self.left.append((key[rest], doc[rest], place[rest]))
        self.linked.append((doc[rest], place[rest], doc[to], place[to]))
        self.rows = key[stays], sketch[stays], doc[stays], place[stays]

    def heads(self) -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(self.alone, self.rows)]

    def links(self) -> list[np.ndarray]:
        """(doc, place, doc, place) of runs and those that stand for them."""
        return [np.concatenate(x) for x in zip(*self.linked)] or [np.empty(0, np.int64)] * 4

    def others(self) -> list[np.ndarray]:
        """(key, doc, place) of the runs that others stand for."""
        return [np.concatenate(x) for x in zip(*self.left)] or [np.empty(0, np.int64)] * 3


def _compare(group: np.ndarray, sketch: np.ndarray, doc: np.ndarray, who: np.ndarray, best: np.ndarray, first: np.ndarray | None) -> None:
    """Each with each in runs of equal `group`: how alike the most alike one before it is, in `best`, or the first one of about that, in `first`."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    rank = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
    i = np.flatnonzero(rank > 0)
    for d in range(1, int(rank.max(initial=0)) + 1):
        i = i[rank[i] >= d]
        j = i - d
        agree, alike = _agreement(sketch[i] ^ sketch[j])
        good = (agree >= AGREE) & (doc[i] != doc[j])
        to = who[i]  # each once
        if first is None:
            best[to] = np.maximum(best[to], np.where(good, alike, -1))
        else:
            good &= alike >= best[to] - ABOUT
            first[to[good]] = np.minimum(first[to[good]], who[j[good]])


def _groups(key: np.ndarray, sketch: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group, run) of rows sorted by key and then document: the groups in which each is compared with each."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    size = np.repeat(size, size)
    some = np.flatnonzero((size > 1) & (size <= DENSE))
    yield key[some], some
    many = np.flatnonzero(size > DENSE)
    if not len(many):
        return
    for side in (0, 32):
        for functions in combinations(range(FUNCTIONS), AGREE):
            part = sketch[many] & np.uint64(sum(15 << side + 4 * k for k in functions))
            by = np.lexsort((many, part, key[many]))
            at, part = many[by], part[by]
            change = np.append(True, (key[at][1:] != key[at][:-1]) | (part[1:] != part[:-1]))
            group = np.cumsum(change)
            n = np.bincount(group)[group]
            if (n > DENSE).any():
                by = np.lexsort((sketch[at], group))
                inner = np.arange(len(at)) - np.flatnonzero(change)[group - 1]
                block = np.zeros(len(at), np.int64)
                block[by] = np.where(n[by] > DENSE, inner // DENSE, 0)
                by = np.lexsort((at, block, group))
                at, group = at[by], (group * (1 << 32) + block)[by]
            yield group, at


def nearest(key: np.ndarray, sketch: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, run) of rows sorted by key and then document: each with the first one before it in its key that is about as alike as any."""
    if not len(key):
        return key, key
    none = len(key)
    best, first = np.full(none, -1, np.int64), np.full(none, none, np.int64)
    for to in (None, first):
        for group, at in _groups(key, sketch):
            _compare(group, sketch[at], doc[at], at, best, to)
    found = np.flatnonzero(first < none)
    return found, first[found]


def runs(texts: DataFrame) -> DataFrame:
    """Runs that stand for others in their block, and the others and their links, which travel under a key of their own."""

    def combined(parts: list[tuple]) -> pa.RecordBatch:
        found = _Runs(*map(np.concatenate, zip(*parts)), ALIKE)
        key, sketch, doc, place = found.heads()
        left, its, where = found.others()
        names, n = np.unique(left, return_counts=True)
        known, first = np.unique(found.rows[0], return_index=True)
        many = np.zeros(len(key), np.int64)
        many[len(found.alone[0]) + first[np.searchsorted(known, names)]] = n
        a, at, b, to = _hulls(*_turned(*found.links()))
        spread = lambda x: _mix(x.view(np.uint64)).view(np.int64)
        zeros = lambda x, value=0: np.full(len(x), value)
        columns = [
            (key.view(np.int64), spread(its), spread(a)),
            (sketch.view(np.int64), left.view(np.int64), zeros(a)),
            (doc, its, a),
            (place, where, at),
            (many, zeros(its), b),
            (zeros(key, _RUN), zeros(its, _LEFT), to),
        ]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], [x.split()[0] for x in _RUNS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for ids, places, docs in _laid_out(batches):
            w, own, at = Windows(docs), np.array(ids, np.int64), np.array(places, np.int64)
            for key, sketch, start, end in w.runs():
                doc = np.searchsorted(w.starts, start, side="right") - 1
                shift = at[doc] - w.starts[doc]
                parts.append((key, sketch, own[doc], _place(start + shift, end + shift)))
                n += len(key)
            if n >= COMBINE:
                yield combined(parts)
                parts, n = [], 0
        if parts:
            yield combined(parts)

    return texts.mapInArrow(run, _RUNS)


def _counts(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of n over the rows of each row's key, in rows sorted by it."""
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(key)))) if len(key) else n


def links(found: DataFrame) -> DataFrame:
    """(a, b, la, ra, lb, rb) from runs, a above b; and all runs of the keys that more than two have."""
    found = found.repartition(partitions(found.sparkSession), "key").sortWithinPartitions("key")

    def solve(key, sketch, doc, place, b, to) -> tuple[pa.RecordBatch, tuple]:
        own, left = to == _RUN, to == _LEFT
        link = ~own & ~left
        some = _counts(key[own], 1 + b[own]) > 2
        shared = [np.concatenate((x[own][some], y[left])) for x, y in ((key, sketch), (doc, doc), (place, place))]
        here = _Runs(key[own], sketch[own].view(np.uint64), doc[own], place[own], ALIKE)
        by = np.lexsort((here.rows[3], here.rows[2], here.rows[0]))
        k, s, d, p = (x[by] for x in here.rows)
        i, j = nearest(k, s, d)
        a, at, b, to = _turned(*map(np.concatenate, zip(here.links(), (d[i], p[i], d[j], p[j]), (doc[link], place[link], b[link], to[link]))))
        none = np.full(len(shared[0]), -1, np.int32)
        columns = zip((a, b, *_ends(at, to)), (*shared[:2], *_ends(shared[2], shared[2])[:2], none, none))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], [x.split()[0] for x in _LINKS.split(", ")]), here.heads()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n < COMBINE:
                continue
            columns = [np.concatenate(x) for x in zip(*held)]
            change = int(np.searchsorted(columns[0], columns[0][-1]))
            if change:
                out, _ = solve(*[c[:change] for c in columns])
                held = [[c[change:] for c in columns]]
            else:  # one key alone: the runs that stand for others go on with it
                out, heads = solve(*columns)
                key, sketch, doc, place = heads
                held = [[key, sketch.view(np.int64), doc, place, np.full(len(key), 2), np.full(len(key), _RUN)]]
            n = len(held[0][0])
            yield out
        if held:
            yield solve(*[np.concatenate(x) for x in zip(*held)])[0]

    return found.mapInArrow(run, _LINKS)


def _best_segment(hit: np.ndarray, share: float, width: int) -> tuple[int, int] | None:
    """Start and end of the segment of `width` places or more with the largest score, or None if that is below 0.

    A hit scores 1 and any other share / (share - 1), so that a segment's score
    is 0 or more from that share of hits on. Without the least length the best
    segment could be a short part of a passage that has a changed word.
    """
    if len(hit) < width:
        return None
    score = np.where(hit, 1.0, -share / (1 - share))
    total = np.concatenate(([0.0], np.cumsum(score)))
    low = np.minimum.accumulate(total[: len(total) - width])
    gain = total[width:] - low
    end = int(np.argmax(gain))
    if gain[end] < -1e-9:
        return None
    return int(np.argmin(total[: end + 1])), end + width


def _among(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Which of the numbers x, below n, are in y."""
    return _marks(y, n)[x]


def _marks(x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[x] = True
    return out


def _jaccard(a: np.ndarray, b: np.ndarray, n: int) -> float:
    x, y = _marks(a, n), _marks(b, n)
    both = int(np.count_nonzero(x & y))
    return both / max(1, int(np.count_nonzero(x)) + int(np.count_nonzero(y)) - both)


def _proposed(a: np.ndarray, b: np.ndarray, n: int, hit: np.ndarray, similarity: float, width: int) -> Iterator[tuple[int, int, tuple[int, int] | None]]:
    """Segments of a and b, numbers below n, that may be similar, the purest first.

    A similarity s means a share of 2 s / (1 + s) of each side if they are
    equally long, and of s at least whatever their lengths.
    """
    pure = 2 * similarity / (1 + similarity)
    shares = (pure, (pure + similarity) / 2, similarity)
    for one in shares:
        if (mine := _best_segment(hit, one, width)) is None:
            continue
        there = _among(b, a[slice(*mine)], n)
        for two in shares:
            if (other := _best_segment(there, two, width)) is None:
                yield *mine, None
                continue
            yield *mine, other
            if (less := _best_segment(_among(a, b[slice(*other)], n), one, width)) and less != mine:
                yield *less, _best_segment(_among(b, a[slice(*less)], n), two, width)


def verify(a: np.ndarray, b: np.ndarray, width: int = WIDTH, similarity: float = SIMILARITY) -> list[tuple[int, int, int, int, float]]:
    """The near-duplicate segments (start, end, start, end, similarity) of two stretches of shingle hashes, disjoint in the first.

    The share of hits only proposes segments; their similarity decides. A
    segment of one side may hold several passages that stand apart on the
    other; it is then narrowed to the one that was found there, and the rest is
    looked at again. One that fails is cut at its longest gap and its parts are
    looked at.
    """
    names, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    a, b, n = both[: len(a)], both[len(a) :], len(names)
    hit, out, todo = _among(a, b, n), [], [(0, len(a))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < width or np.count_nonzero(hit[lo:hi]) < similarity * width - 1e-6:  # no segment has such a share
            continue
        i = j = -1
        for i, j, other in _proposed(a[lo:hi], b, n, hit[lo:hi], similarity, width):
            if other and (x := _jaccard(a[lo + i : lo + j], b[slice(*other)], n)) >= similarity:
                out.append((lo + i, lo + j, *other, x))
                todo += [(lo, lo + i), (lo + j, hi)]
                break
        else:
            if j < 0:
                continue
            todo += [(lo, lo + i), (lo + j, hi)]
            edge = np.concatenate(([-1], np.flatnonzero(hit[lo + i : lo + j]), [j - i]))
            gap = int(np.argmax(np.diff(edge)))
            if edge[gap + 1] - edge[gap] > 1:
                todo += [(lo + i, lo + i + int(edge[gap]) + 1), (lo + i + int(edge[gap + 1]), lo + j)]
    return out


_PASSAGES = "doc_id long, start_word long, end_word long, other_id long, other_start long, other_end long, similarity double"


def _passages(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [x.split()[0] for x in _PASSAGES.split(", ")])


def stretches(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, side, at, h, doc_id): the shingles of each stretch (doc_id, side, a, b, lo, hi). A text is read once, before what is asked of it."""
    none = F.lit(None)
    both = texts.select("doc_id", F.lit(-1).alias("side"), none.cast("long").alias("a"), none.cast("long").alias("b"), none.cast("int").alias("lo"), none.cast("int").alias("hi"), "text")
    both = both.unionByName(asked.withColumn("text", none.cast("string")))
    both = both.repartition(partitions(texts.sparkSession), "doc_id").sortWithinPartitions("doc_id", "side")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known, held = None, set(), []
        for b in batches:
            rows, sides = [], b.column(1).to_numpy()
            ids, texts = b.column(0).to_pylist(), b.column(6)
            asked = [b.column(k).to_pylist() for k in (2, 3, 4, 5)]
            for i, (doc, side) in enumerate(zip(ids, sides.tolist())):
                if doc != last:
                    last, known, held = doc, set(), []
                if side < 0:
                    text = texts[i].as_py()
                    if (mark := xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))) not in known:
                        known.add(mark)
                        held.append(text)
                    continue
                if held and isinstance(held[0], str):  # only texts that something is asked of are hashed
                    held = [_short(t) for t in held]
                x, y, lo, hi = (c[i] for c in asked)
                rows += [(x, y, side, lo, s[lo : hi + 1].tobytes(), doc) for s in held]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["a", "b", "side", "at", "h", "doc_id"])

    return both.mapInArrow(cut, "a long, b long, side int, at int, h binary, doc_id long")


def of_documents(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """The texts that something is asked of."""
    return texts.join(materialise(asked.select("doc_id").distinct(), "asked"), "doc_id", "left_semi")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, start_word, end_word, other_id, other_start, other_end, similarity): passages of 50 words or more, ends exclusive, doc_id above other_id."""
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).filter("doc_id is not null and text is not null")
    found = materialise(links(runs(texts)), "links")
    passages = materialise(verified(texts, _pairs(found.filter("lb >= 0")), similarity), "passages")
    rest = materialise(_pairs(unlinked(texts, found.filter("lb < 0"), passages, similarity)), "rest")
    more = materialise(verified(of_documents(texts, _sides(rest)), rest, similarity), "more")
    return needed(passages.unionByName(more).distinct())


def _pairs(links: DataFrame) -> DataFrame:
    return links.groupBy("a", "b").agg(F.min("la").alias("la"), F.max("ra").alias("ra"), F.min("lb").alias("lb"), F.max("rb").alias("rb"))


def _sides(pairs: DataFrame) -> DataFrame:
    """(doc_id, side, a, b, lo, hi) of both sides."""
    one, other = (pairs.select(F.col(x).alias("doc_id"), F.lit(k).alias("side"), "a", "b", F.col(f"l{x}").alias("lo"), F.col(f"r{x}").alias("hi")) for k, x in enumerate("ab"))
    return one.unionByName(other)


def verified(texts: DataFrame, pairs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The passages of pairs (a, b, la, ra, lb, rb)."""
    side = lambda k: F.collect_list(F.when(F.col("side") == k, F.struct("at", "h")))
    sides = stretches(texts, _sides(pairs)).groupBy("a", "b").agg(side(0).alias("x"), side(1).alias("y"))
    sides = sides.select("a", "b", F.explode("x").alias("x"), "y").select("a", "b", "x", F.explode("y").alias("y")).select("a", "b", F.col("x.at").alias("la"), F.col("y.at").alias("lb"), F.col("x.h").alias("x"), F.col("y.h").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for a, other, la, lb, x, y in zip(*(c.to_pylist() for c in b.columns)):
                for i, j, k, m, s in verify(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity=similarity):
                    out.append((a, la + i, la + j + SHINGLE - 1, other, lb + k, lb + m + SHINGLE - 1, s))
            yield _passages(out)

    return sides.mapInArrow(check, _PASSAGES)


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by their first column as tables of about `least` rows that cut no group of it."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < least or b.column(0)[0] == b.column(0)[-1]:
            continue
        first = b.column(0).to_numpy()
        change = int(np.searchsorted(first, first[-1]))
        held[-1] = b.slice(0, change)
        yield pa.concat_batches(held)
        held, n = [b.slice(change)], b.num_rows - change
    if held:
        yield pa.concat_batches(held)


def _same(*columns: np.ndarray) -> np.ndarray:
    """One number for each different row, in the order of the rows."""
    by = np.lexsort(columns[::-1])
    change = np.zeros(len(by), bool)
    for c in columns:
        change[1:] |= c[by][1:] != c[by][:-1]
    out = np.empty(len(by), np.int64)
    out[by] = np.cumsum(change)
    return out


def _spans(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) for n places from `first` on in each row."""
    row = np.repeat(np.arange(len(n)), n)
    return row, first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least node that each of n nodes reaches by the edges (x, y)."""
    least = np.arange(n)
    while len(x):
        low, high = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        np.minimum.at(least, high, low)
        while (least != (up := least[least])).any():
            least = up
        apart = least[x] != least[y]
        x, y = x[apart], y[apart]
    return least


def apart(key: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, *labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, component, doc, lo, hi) of the runs of keys that verified passages leave in several components.

    A row is a run with up to `LABELS` labels of its place (0: none). Runs of
    one key with a label in common are in one component.
    """
    by = np.lexsort((hi, lo, doc, key))
    by = by[np.diff(_same(*(x[by] for x in (key, doc, lo, hi))), prepend=-1) > 0]
    key, doc, lo, hi, *labels = (x[by] for x in (key, doc, lo, hi, *labels))
    node = np.tile(np.arange(len(key)), len(labels))
    label = np.concatenate(labels)
    node, label = node[label != 0], label[label != 0]
    _, first, group = np.unique(_same(key[node], label), return_index=True, return_inverse=True)
    component = _components(len(key), node, node[first][group])
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    differ = [np.minimum.reduceat(x, start) != np.maximum.reduceat(x, start) for x in (component, doc)]
    stays = np.repeat(differ[0] & differ[1], np.diff(np.append(start, len(key))))
    return tuple(x[stays] for x in (key, component, doc, lo, hi))


def _dealt(key: np.ndarray, component: np.ndarray, *rest: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """The same under keys of at most 2 `TOGETHER` rows: of a larger group each two blocks meet, but for those of one component."""
    by = np.lexsort((component, key))
    columns = [x[by] for x in (key, component, *rest)]
    key, component = columns[:2]
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    few = np.repeat(size <= 2 * TOGETHER, size)
    yield tuple(x[few] for x in columns)
    for at, n in zip(start[size > 2 * TOGETHER].tolist(), size[size > 2 * TOGETHER].tolist()):
        blocks = [slice(k, min(k + TOGETHER, at + n)) for k in range(at, at + n, TOGETHER)]
        for i, j in combinations(range(len(blocks)), 2):
            if component[blocks[i].start] == component[blocks[j].stop - 1]:
                continue
            part = [np.concatenate((x[blocks[i]], x[blocks[j]])) for x in columns]
            name = _mix(part[0][:1].view(np.uint64) + np.uint64((i << 32 | j) + 1)).view(np.int64)
            yield np.repeat(name, len(part[0])), *part[1:]


def _fewest(h: np.ndarray, width: int = WIDTH) -> int:
    """At least so many different shingles has each stretch of `width`."""
    by = np.argsort(h, kind="stable")
    again = np.zeros(len(h) + 1, np.int64)
    near = (h[by][1:] == h[by][:-1]) & (by[1:] - by[:-1] < width)
    again[1:][by[1:][near]] = 1
    again = np.cumsum(again)
    return max(1, width - int((again[width:] - again[:-width]).max(initial=0)))


def _one_diagonal(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether the shared shingles at the commonest distance alone make a similar passage."""
    _, p, q = np.intersect1d(x, y, return_indices=True)
    if not len(p):
        return False
    distance, n = np.unique(p - q, return_counts=True)
    p = p[p - q == distance[np.argmax(n)]]
    length = int(p.max() - p.min()) + 1
    return length >= WIDTH and len(p) >= similarity * (2 * length - len(p))


def _sharing(group: np.ndarray, component: np.ndarray, doc: np.ndarray, h: list[np.ndarray], similarity: float) -> np.ndarray:
    """The stretches, of groups one after another, that share as many shingles with other components of their group as a similar passage takes; all others are in no pair."""
    size = np.array([len(x) for x in h])
    both = np.sort(np.repeat(np.arange(len(h)) << 32, size) | np.concatenate(h))
    both = both[np.diff(both, prepend=-1) != 0]
    row = both >> 32
    least = np.full(len(h), WIDTH)
    for k in np.flatnonzero((np.bincount(row, minlength=len(h)) < size) | (size < WIDTH)).tolist():
        least[k] = _fewest(h[k])
    stays = np.arange(len(h))
    while len(stays):
        value = group[row] << 32 | both & (1 << 32) - 1
        by = np.argsort(value)
        value, of = value[by], component[row[by]]
        start = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
        differ = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)
        shared = np.bincount(row[by][np.repeat(differ, np.diff(np.append(start, len(value))))], minlength=len(h))[stays]
        first = np.flatnonzero(np.diff(group[stays], prepend=-1))
        fewest = np.repeat(np.minimum.reduceat(least[stays], first), np.diff(np.append(first, len(stays))))
        left = stays[shared >= similarity / (1 + similarity) * (least[stays] + fewest) - 1e-9]
        if not len(left):
            return left
        first = np.flatnonzero(np.diff(group[left], prepend=-1))
        several = [np.minimum.reduceat(x[left], first) != np.maximum.reduceat(x[left], first) for x in (component, doc)]
        left = left[np.repeat(several[0] & several[1], np.diff(np.append(first, len(left))))]
        if len(left) > 0.9 * len(stays):
            return left
        stays = left
        held = np.zeros(len(h), bool)
        held[stays] = True
        both, row = both[held[row]], row[held[row]]
    return stays


class _Alike:
    """Stretches of shingles, and which of them share as many as similar passages in them must.

    Two sets of a Jaccard similarity s share s / (1 + s) of the sum of their
    sizes. Stretches that share so many share one of the rarest that the rest
    can't make up for; only by those they are joined.
    """

    def __init__(self, doc: np.ndarray, h: list[np.ndarray], similarity: float):
        self.doc, self.h, self.similarity, self.share = doc, h, similarity, similarity / (1 + similarity)
        pure = 2 * self.share
        self.levels = np.array([similarity, (similarity + pure) / 2, pure - 1e-3, (pure + 1) / 2])
        self.length = np.array([len(x) for x in h])
        values, each = np.unique(np.concatenate(h), return_inverse=True)
        self.none, at = len(values), np.repeat(np.arange(len(h)), self.length)
        both = np.sort(at * self.none + each)
        row, shingle = np.divmod(both[np.diff(both, prepend=-1) != 0], self.none)
        self.size, count = np.bincount(row, minlength=len(h)), np.bincount(shingle)
        self.least = np.full(len(h), WIDTH)
        for k in np.flatnonzero((self.size < self.length) | (self.length < WIDTH)).tolist():
            self.least[k] = _fewest(h[k])
        self.begin = np.cumsum(self.size) - self.size
        self.shingle = shingle[np.lexsort((shingle, count[shingle], row))]
        self.places = np.full((len(h), max(WIDTH, min(LONGEST, int(self.length.max())))), self.none)  # the shingles in their order
        short = self.length[at] <= LONGEST
        self.places[at[short], _spans(np.zeros(len(h), np.int64), self.length)[1][short]] = each[short]
        need = np.ceil(self.share * (self.least + self.least.min()) - 1e-9).astype(np.int64)
        rare = (np.arange(len(row)) - self.begin[row] <= self.size[row] - need[row]) & (count[self.shingle] > 1)
        self.rows, self.by = row[rare], self.shingle[rare]

    def may_link(self, numbers: np.ndarray) -> np.ndarray:
        """The pairs of those that share enough, in some segment of either one.

        Shares a and b of the two segments make a similarity s where
        1 / a + 1 / b = 1 + 1 / s; they are known to lie below the next of `levels`.
        """
        n, bound = len(self.h), 1 / np.append(self.levels, 1.0)
        below = self._level(numbers // n, numbers % n)
        numbers, below = numbers[below > 0], below[below > 0]
        by = np.lexsort((numbers // n, numbers % n))
        above = self._level(numbers[by] % n, numbers[by] // n)
        return np.sort(numbers[by][(above > 0) & (bound[above] + bound[below[by]] <= 1 + 1 / self.similarity + 1e-9)])

    def _segment(self, hit: np.ndarray, share: float) -> np.ndarray:
        """Whether rows of hits have a segment of `WIDTH` places or more with that share."""
        loss = int(SCORE * share / (1 - share))
        if len(hit) < 2 * WIDTH:
            total = np.zeros((len(hit), hit.shape[1] + 1), np.int32)
            np.cumsum(np.where(hit, np.int32(SCORE), np.int32(-loss)), axis=1, out=total[:, 1:])
            return (total[:, WIDTH:] - np.minimum.accumulate(total[:, : total.shape[1] - WIDTH], axis=1)).max(axis=1) >= 0
        score = np.where(hit.T, np.int32(SCORE), np.int32(-loss))  # place by place, for all rows together
        total = np.zeros((len(score) + 1, len(hit)), np.int32)
        low, best = np.zeros(len(hit), np.int32), np.full(len(hit), -1, np.int32)
        for k in range(len(score)):
            np.add(total[k], score[k], out=total[k + 1])
            if k + 1 >= WIDTH:
                np.minimum(low, total[k + 1 - WIDTH], out=low)
                np.maximum(best, total[k + 1] - low, out=best)
        return best >= 0

    def _level(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many of `levels` a segment of j reaches; none if the pair, of pairs sorted by i, doesn't share enough in all."""
        level, lo = np.zeros(len(i), np.int64), 0
        most, rows = max(1, MARKS // 4 // int(self.size.max())), max(1, MARKS // (self.none + 1))
        of_i = np.cumsum(np.diff(i, prepend=-1) != 0)
        while lo < len(i):
            hi = min(lo + most, int(np.searchsorted(of_i, of_i[lo] + rows)))
            known, its = np.unique(i[lo:hi], return_inverse=True)
            x, y = i[lo:hi], j[lo:hi]
            of, where = _spans(self.begin[known], self.size[known])
            mine = np.zeros((len(known), self.none + 1), bool)
            mine[of, self.shingle[where]] = True
            need, some = self.share * (self.least[x] + self.least[y]) - 1e-9, np.arange(len(y))
            if (long := np.flatnonzero(self.length[y] > LONGEST)).size:
                of, where = _spans(self.begin[y[long]], self.size[y[long]])
                both = np.bincount(of[mine[its[long][of], self.shingle[where]]], minlength=len(long))
                level[lo + long[both >= need[long]]] = len(self.levels)
                some = np.flatnonzero(self.length[y] <= LONGEST)
            hit = mine[its[some, None], self.places[y[some], : int(self.length[y[some]].max(initial=WIDTH))]]
            enough = hit.sum(axis=1) >= need[some]  # repeated shingles count again here
            some, hit = some[enough], hit[enough]
            for share in self.levels:
                if len(some):
                    reached = self._segment(hit, share)
                    some, hit = some[reached], hit[reached]
                    level[lo + some] += 1
            lo = hi
        return level

    def numbers(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.unique(np.minimum(i, j) * len(self.h) + np.maximum(i, j))

    def apart(self, numbers: np.ndarray) -> np.ndarray:
        return self.doc[numbers // len(self.h)] != self.doc[numbers % len(self.h)]

    def pairs(self, component: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that link components, and all pairs of what can't be linked so that may be similar.

        First each component is held against the next one of each shingle, and
        those that turn out similar are one from there on, until there are no
        more. Then each is held against each, and what turns out similar makes
        one of two again: its other pairs link nothing more.
        """
        n, tried, linked = len(self.h), np.empty(0, np.int64), []
        while True:
            order = np.lexsort((component[self.rows], self.by))
            r, w = self.rows[order], self.by[order]
            c = component[r]
            if not len(r) or not (component != component[0]).any():
                return self._out(linked, tried[:0])
            next_to = np.flatnonzero((w[1:] == w[:-1]) & (c[1:] != c[:-1]))
            new = np.setdiff1d(self.numbers(r[next_to], r[next_to + 1]), tried)
            tried = np.union1d(tried, new)
            new = self.may_link(new)
            more = []
            for k in new[np.argsort(self.apart(new), kind="stable")].tolist():  # a passage twice in one document first
                i, j = divmod(k, n)
                if component[i] != component[j] and self._similar(i, j):
                    more.append(k)
                    component = self._one(component, i, j)
            linked += more
            if not more:
                break
        after = np.append(np.flatnonzero((w[1:] != w[:-1]) | (c[1:] != c[:-1])) + 1, len(r))
        ends = np.append(np.flatnonzero(w[1:] != w[:-1]) + 1, len(r))
        at = np.arange(len(r))
        after, ends = after[np.searchsorted(after, at, side="right")], ends[np.searchsorted(ends, at, side="right")]
        made, seen, rest, tried_of, most = np.cumsum(ends - after), np.empty(0, np.int64), [], {}, min(FIRST, PAIRS)
        while len(at):
            cut = max(1, int(np.searchsorted(made, made[0] - (ends - after)[0] + most, side="right")))
            row, to = _spans(after[:cut], (ends - after)[:cut])
            row = at[:cut][row]
            differ = component[r[row]] != component[r[to]]
            new = np.setdiff1d(self.numbers(r[row[differ]], r[to[differ]]), seen)
            new = new[self.apart(new)]
            if len(seen) < PAIRS:
                seen = np.union1d(seen, new)
            new = self.may_link(new)
            for k in new.tolist():
                i, j = divmod(k, n)
                if component[i] == component[j]:
                    continue
                two = int(min(component[i], component[j])), int(max(component[i], component[j]))
                failed = tried_of.get(two, 0)
                if self._similar(i, j) if failed < TRIES and self.length[i] + self.length[j] < LONG else _one_diagonal(self.h[i], self.h[j], self.similarity):
                    linked.append(k)
                    component = self._one(component, i, j)
                else:
                    rest.append(k)
                    tried_of[two] = failed + 1
            at, after, ends, made, most = at[cut:], after[cut:], ends[cut:], made[cut:], min(4 * most, PAIRS)
        rest = np.array(rest, np.int64)  # they are verified with all that their documents share
        return self._out(linked, rest[component[rest // n] != component[rest % n]])

    def _similar(self, i: int, j: int) -> bool:
        return _one_diagonal(self.h[i], self.h[j], self.similarity) or bool(verify(self.h[i], self.h[j], similarity=self.similarity))

    @staticmethod
    def _one(component: np.ndarray, i: int, j: int) -> np.ndarray:
        """The components with those of i and j as one."""
        low, high = sorted((component[i], component[j]))
        return np.where(component == high, low, component)

    def _out(self, linked: list[int], rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = np.union1d(np.array(linked, np.int64), rest)
        found = found[self.apart(found)]
        return found // len(self.h), found % len(self.h)


def places(passages: DataFrame) -> DataFrame:
    """(doc_id, cell, label): a label for each stretch of `CELL` shingles of a document whose middle is in a passage, the same for those that verified passages link at about one place."""
    shift = SHINGLE - 1
    cells = F.sequence(F.ceil((F.col("start_word") - CELL // 2) / CELL).cast("int"), F.floor((F.col("end_word") - shift - 1 - CELL // 2) / CELL).cast("int"))
    met = passages.select("*", F.explode(cells).alias("cell"))
    there = F.least(F.col("other_start") + F.col("cell") * CELL + CELL // 2 - F.col("start_word"), F.col("other_end") - shift - 1)
    met = met.select("doc_id", "cell", "other_id", F.floor(there / CELL).cast("int").alias("other_cell"))
    met = materialise(met.select("*", F.xxhash64("doc_id", "cell").alias("u"), F.xxhash64("other_id", "other_cell").alias("v")), "places")
    roots = connected_components(met.select("u", "v"))
    cells = met.select("doc_id", "cell", F.col("u").alias("node")).union(met.select("other_id", "other_cell", "v")).distinct()
    label = F.hash(F.coalesce("root", "node"))
    return cells.join(roots, "node", "left").select("doc_id", "cell", F.when(label == 0, 1).otherwise(label).alias("label"))


def labelled(runs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, doc_id, lo, hi, l0, l1, ..): runs with the first labels of their places, 0 if there are no more."""
    both = runs.select("doc_id", F.lit(0).alias("label"), "key", "lo", "hi").unionByName(places.select("doc_id", "label", F.lit(0).cast("long").alias("key"), F.col("cell").alias("lo"), F.lit(-1).alias("hi")))
    both = both.repartition(partitions(runs.sparkSession), "doc_id").sortWithinPartitions("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches, BATCH):
            doc, label, key, lo, hi = (c.to_numpy() for c in b.columns)
            name = _same(doc) << 32
            has = np.flatnonzero(hi < 0)
            has = has[np.argsort(name[has] + lo[has])]
            known, its = np.append(name[has] + lo[has], -1), np.append(label[has], 0)
            at = np.flatnonzero(hi >= 0)
            low, high = (lo[at] + EDGE) // CELL, (hi[at] - EDGE) // CELL
            out = []
            for k in range(LABELS):
                cell = name[at] + np.minimum(low + k, high)
                place = np.searchsorted(known[:-1], cell)
                out.append(np.where(known[place] == cell, its[place], 0).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key[at], doc[at], lo[at], hi[at], *out)], ["key", "doc_id", "lo", "hi", *(f"l{k}" for k in range(LABELS))])

    return both.mapInArrow(run, "key long, doc_id long, lo int, hi int, " + ", ".join(f"l{k} int" for k in range(LABELS)))


def unlinked(texts: DataFrame, runs: DataFrame, passages: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, la, ra, lb, rb): of each key all pairs of runs that may be similar and that no chain of verified passages links there."""
    met = labelled(runs.select(F.col("a").alias("key"), F.col("b").alias("doc_id"), F.col("la").alias("lo"), F.col("ra").alias("hi")), places(passages))
    met = met.repartition(partitions(texts.sparkSession), "key").sortWithinPartitions("key")

    def separate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _whole_groups(batches, COMBINE):
            for key, component, doc, lo, hi in _dealt(*apart(*(c.to_numpy() for c in b.columns))):
                columns = doc, np.zeros(len(key), np.int32), key, component, np.maximum(lo - HALF, 0).astype(np.int32), (hi + HALF).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "side", "a", "b", "lo", "hi"])

    asked = materialise(met.mapInArrow(separate, "doc_id long, side int, a long, b long, lo int, hi int"), "unlinked")
    held = stretches(of_documents(texts, asked), asked).select("a", "b", "doc_id", "at", "h")
    held = held.repartition(partitions(texts.sparkSession), "a").sortWithinPartitions("a")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole_groups(batches, ROWS):
            key, component, doc, at = (batch.column(k).to_numpy() for k in range(4))
            h = [np.frombuffer(x, np.uint32) for x in batch.column(4).to_pylist()]
            end = at + np.array([len(x) for x in h]) - 1
            group = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
            some = _sharing(group, component, doc, h, similarity)
            start = np.flatnonzero(np.diff(group[some], prepend=-1))
            found = [(some[:0], some[:0])]
            for one in np.split(some, start[1:]) if len(some) else ():
                i, j = _Alike(doc[one], [h[k] for k in one], similarity).pairs(component[one])
                found.append((one[i], one[j]))
            i, j = map(np.concatenate, zip(*found))
            place = _place(at, end)
            a, x, b, y = _hulls(*_turned(doc[i], place[i], doc[j], place[j]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (a, b, *_ends(x, y))], [c.split()[0] for c in _LINKS.split(", ")])

    return held.mapInArrow(join, _LINKS)


def needed(found: DataFrame) -> DataFrame:
    """The passages without those that two documents both share with the first partner of each: both are linked to that one by them."""
    longest = F.struct(-F.col("other_id"), F.col("end_word") - F.col("start_word"), -F.col("start_word"))
    hubs = materialise(found.groupBy("doc_id").agg(F.max_by(F.struct("other_id", "start_word", "end_word"), longest).alias("hub")), "hubs")
    mine, its = (hubs.select(F.col("doc_id").alias(f"{x}_id"), F.col("hub").alias(x)) for x in ("mine", "its"))
    both = found.join(mine, F.col("doc_id") == F.col("mine_id")).join(its, F.col("other_id") == F.col("its_id"), "left")
    within = (F.col("start_word") >= F.col("mine.start_word")) & (F.col("end_word") <= F.col("mine.end_word")) & (F.col("other_start") >= F.col("its.start_word")) & (F.col("other_end") <= F.col("its.end_word"))
    return both.filter(~F.coalesce((F.col("mine.other_id") == F.col("its.other_id")) & within, F.lit(False))).select(*found.columns)


def _short(text: str | None) -> np.ndarray:
    """32 bits of the hashes of the text's shingles."""
    return (shingles(text) >> np.uint64(32)).astype(np.uint32)
