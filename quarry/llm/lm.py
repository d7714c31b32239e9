"""Language-model scoring by a hierarchical Pitman-Yor model over words.

Events are the words learned from and one unknown word, as in the add-one base. Restaurants, from the root down:

* classes: the SYMBOLS - 1 most frequent words, each a class, and one class of all others; the root
  restaurant seats them over a uniform base, and a restaurant for each class as context shares the root as its parent;
* words of the last class: one restaurant over a uniform base;
* a restaurant for every context of training, over all words. Its parent is the root (contexts that are classes of their
  own) or the last class's context restaurant (all others), with the words' restaurant below it.

The upper restaurants have a fixed size and are seated on the driver. Gibbs sampling is over tables: a step draws the number of
tables of a dish from its conditional distribution given all other dishes' tables, with the seatings of its customers summed out
(generalised Stirling numbers). A sweep takes all dishes so; predictive probabilities are averaged over the sweeps after
burn-in. A hot context (over one part in HOT of a bucket) has its number of tables found beforehand, from distinct (context, word)
counts; given that, its dishes are independent. So the PAIRS most frequent dishes of hot contexts are scored once and broadcast, and
their tokens never travel. All other tokens meet in buckets, by context or, of hot contexts, by context and word, as packed arrays that
name a document by its number in a part (some millions of tokens of one task); a bucket sends back one number for each
document of a part, and each part adds them up.

Every training text is counted; the base is exact. Counts of the FREQUENT most frequent words are broadcast,
other words meet their counts in a join.
"""

from __future__ import annotations

import pickle
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.tokens import caches, claim

SYMBOLS, FREQUENT, PAIRS = 512, 524_288, 500_000
#: Sweeps over contexts, and those that are not averaged; sweeps over the upper restaurants, of which a third is not.
SWEEPS, BURN_IN, CLASS_SWEEPS, STRENGTH = 6, 2, 15, 0.5
#: Discounts of class contexts, of the words' restaurant and of contexts.
D_CLASS, D_WORDS, D_CONTEXT = 0.5, 0.6, 0.6
#: Bytes of text, and about how many tokens of a part and of a bucket, that a task handles at once; points at which a hot context's tables are tried.
BATCH, PART, BUCKET, POINTS = 1_000_000, 700_000, 300_000, 12
#: A context is hot over one part in HOT of a bucket.
HOT = 8

_rng = np.random.default_rng(33)
_TABLE = _rng.integers(0, 1 << 64, (8, 256), dtype=np.uint64)
_STEP = np.uint64(int(_rng.integers(0, 1 << 63)) * 2 + 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: The end token: no word hashes to it but by chance.
END = np.uint64(0x9E3779B97F4A7C15)
_LIVE: dict = {}
caches("lm", _LIVE.clear)


def hashed(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of UTF-8 texts that lie one behind the other in data, and each text's count of words.

    starts: where each text begins, and the end. Bytes are hashed by tables for their place in the word modulo
    8 and combined with powers of an odd number for the place div 8."""
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    at = starts[:-1]
    at = at[at < len(data)]
    first[at] |= word[at]
    begin = np.flatnonzero(first)
    inside = np.flatnonzero(word)
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(len(starts) - 1, np.int64)
    low = np.searchsorted(inside, begin)
    place = np.arange(len(inside)) - np.repeat(low, np.diff(np.append(low, len(inside))))
    value = _TABLE.reshape(-1)[((place & 7) << 8) | _LOWER[data[inside]]]
    far = place >= 8
    if far.any():
        power = np.cumprod(np.full(int(place.max()) // 8 + 1, _STEP))
        value[far] *= power[place[far] >> 3]
    h = np.add.reduceat(value, low)
    return h ^ (h >> np.uint64(32)), np.diff(np.searchsorted(begin, starts))


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of an Arrow string column (null: empty): word hashes, an end after each text; and the row of each."""
    column = column.cast(pa.large_string()).fill_null("")
    starts = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[starts[0] : starts[-1]] if raw else np.zeros(0, np.uint8)
    h, n = hashed(data, starts - starts[0])
    return np.insert(h, np.cumsum(n), END), np.repeat(np.arange(len(n)), n + 1)


def _parts(batches):
    """Batches cut so that each holds about BATCH bytes of text at most (one text at least)."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
        cut = np.flatnonzero(np.diff(np.cumsum(size) // BATCH)) + 1
        for a, b in zip(np.append(0, cut).tolist(), np.append(cut, len(size)).tolist()):
            if b > a:
                yield batch.slice(a, b - a)


def _held(ids: pa.Array, modulus: int, held_out: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == held_out for i in ids.to_pylist()], bool)


def _counter(modulus: int, held_out: int):
    def run(batches):
        held: list = []  # sorted words and their counts

        def merged():
            keys, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            by = np.argsort(keys, kind="stable")
            keys, n = keys[by], n[by]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            return keys[first], np.add.reduceat(n, first)

        def out():
            keys, n = merged()
            for at in range(0, len(keys), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + 50_000].view(np.int64)), pa.array(n[at : at + 50_000])], ["key", "n"])

        for part in _parts(batches):
            h, row = tokens(part.column(1))
            learn = ~_held(part.column(0), modulus, held_out)[row]
            if learn.any():
                held.append(np.unique(h[learn], return_counts=True))
            if sum(len(x[0]) for x in held) > 600_000:
                held = [merged()]
                if len(held[0][0]) > 400_000:
                    yield from out()
                    held = []
        if held:
            yield from out()
        pa.default_memory_pool().release_unused()

    return run


class Hashed:
    """An open-addressing hash table from 64-bit integers to places, looked up for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.given = keys
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2.5))))
        self.keys, self.place = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            free = self.place[slot] < 0
            self.keys[slot[free]], self.place[slot[free]] = keys[at[free]], at[free]  # of several keys for a slot the last stays
            lost = self.place[slot] != at
            at, slot = at[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def __reduce__(self):
        return Hashed, (self.given,)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key among those given, or -1."""
        slot = self._slot(keys)
        place = self.place[slot]
        at = np.flatnonzero((place >= 0) & (self.keys[slot] != keys))
        while len(at):
            slot[at] = (slot[at] + 1) & ((1 << self.bits) - 1)
            place[at] = self.place[slot[at]]
            at = at[(place[at] >= 0) & (self.keys[slot[at]] != keys[at])]
        return place


# --- seating -----------------------------------------------------------------------------------------------

#: Customers up to which the tables of a dish are drawn from their exact conditional distribution.
EXACT = 64
_STIRLING: dict[float, np.ndarray] = {}


def stirling(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: in how many weighted ways n customers sit at t tables, for n and t up to EXACT."""
    if discount not in _STIRLING:
        out = np.full((EXACT + 1, EXACT + 1), -np.inf)
        out[1, 1] = 0.0
        with np.errstate(divide="ignore"):
            for n in range(1, EXACT):
                t = np.arange(1, EXACT + 1)
                out[n + 1, 1:] = np.logaddexp(out[n, :-1], out[n, 1:] + np.log(np.maximum(n - discount * t, 0)))
        _STIRLING[discount] = out
    return _STIRLING[discount]


def drawn(customers: np.ndarray, rest: np.ndarray, base: np.ndarray, discount: float, rng) -> np.ndarray:
    """One Gibbs step: tables of each dish, given all other dishes of its restaurant. rest: strength plus discount times the others' tables;
    base: the parent's probability of the dish. t tables weigh stirling(n, t) times, for each of them, (rest + discount for each table before
    it) times base. Beyond EXACT customers t is one and a Poisson number, with the mean of that law by its saddle point."""
    tables = np.minimum(customers, 1)
    rest, base = np.broadcast_to(rest, customers.shape), np.broadcast_to(base, customers.shape)
    few = np.flatnonzero((customers > 1) & (customers <= EXACT))
    few = few[np.argsort(customers[few], kind="stable")]
    size, first = np.unique(customers[few], return_index=True)
    for n, a, b in zip(size.tolist(), first.tolist(), np.append(first[1:], len(few)).tolist()):
        ways = stirling(discount)[n, 1 : n + 1]
        for at in range(a, b, max(1, 500_000 // n)):
            rows = few[at : min(b, at + max(1, 500_000 // n))]
            weight = np.cumsum(np.log((rest[rows, None] + discount * np.arange(n)) * base[rows, None]), axis=1) + ways
            share = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), axis=1)
            tables[rows] = 1 + (share < (rng.random(len(rows)) * share[:, -1])[:, None]).sum(1)
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        n, mean = customers[many].astype(float), np.zeros(len(many))
        for _ in range(4):  # at the mode the weight of one table more counts all tables of the dish
            c = (rest[many] + discount * mean) * base[many]
            low, high = np.full(len(many), -80.0), np.zeros(len(many))  # of the logarithm of y in c (1 - y) y ** (discount - 1) = n
            for _ in range(40):
                mid = (low + high) / 2
                over = np.log(c) + np.log1p(-np.exp(np.minimum(mid, -1e-12))) + (discount - 1) * mid > np.log(n)
                low, high = np.where(over, mid, low), np.where(over, high, mid)
            mean = c / discount * -np.expm1(discount * low)
        tables[many] = np.minimum(1 + rng.poisson(np.minimum(mean, n)), customers[many])
    return tables


def contexts(at: np.ndarray, customers: np.ndarray, base: np.ndarray, total: np.ndarray, held: np.ndarray, rng) -> np.ndarray:
    """Predictive probability of each dish: dish i is served in restaurant at[i] to customers[i], with base[i] the parent's
    probability. total: customers of each restaurant; held: its tables where they are known, or NaN where all its dishes are here."""
    known, own = ~np.isnan(held), np.minimum(customers, 1)
    tables = np.where(known, held, np.bincount(at, own, len(total)))
    out = np.zeros(len(at))
    for sweep in range(SWEEPS):
        own = drawn(customers, STRENGTH + D_CONTEXT * np.maximum(tables[at] - own, 0), base, D_CONTEXT, rng)
        tables = np.where(known, held, np.bincount(at, own, len(total)))
        if sweep >= BURN_IN:
            out += customers - D_CONTEXT * own + (STRENGTH + D_CONTEXT * tables[at]) * base
    return out / (SWEEPS - BURN_IN) / (STRENGTH + total[at])


def classes(counts: np.ndarray, seed: int = 3) -> np.ndarray:
    """Predictive probabilities (context class, class) from a square matrix of counts."""
    return class_restaurants(counts, seed)[0]


def class_restaurants(counts: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """classes(), and the root's probability of each class: each sweep draws the contexts' tables, sends them to the root as
    customers, and draws the root's tables; the probabilities of whole sweeps are averaged."""
    rng, k = np.random.default_rng(seed), len(counts)
    context, dish = np.nonzero(counts)
    n, flat = counts[context, dish], 1 / k
    low, parent = np.minimum(n, 1), np.full(k, flat)
    top = np.zeros(k, np.int64)
    size = np.bincount(context, n, k)
    out, above = np.zeros((k, k)), np.zeros(k)
    for sweep in range(CLASS_SWEEPS):
        low = drawn(n, STRENGTH + D_CLASS * (np.bincount(context, low, k)[context] - low), parent[dish], D_CLASS, rng)
        sent = np.bincount(dish, low, k).astype(np.int64)
        top = np.minimum(np.maximum(top, 1), sent)
        top = drawn(sent, STRENGTH + D_CLASS * (top.sum() - top), flat, D_CLASS, rng)
        parent = (sent - D_CLASS * top + (STRENGTH + D_CLASS * top.sum()) * flat) / (STRENGTH + sent.sum())
        if sweep >= CLASS_SWEEPS // 3:
            out += ((STRENGTH + D_CLASS * np.bincount(context, low, k)) / (STRENGTH + size))[:, None] * parent
            out[context, dish] += (n - D_CLASS * low) / (STRENGTH + size[context])
            above += parent
    done = CLASS_SWEEPS - CLASS_SWEEPS // 3
    return out / done, above / done


class Words:
    """The restaurant of the last class's words: probability as a function of a word's count (0: unknown).

    Over a uniform base words of one count are alike, so tables are drawn for each count (on a grid: counts
    apart by an eighth), and those between are interpolated."""

    def __init__(self, histogram: list[tuple[int, int]], seed: int = 4):
        """histogram: (count, words with it)."""
        self.types = sum(n for _, n in histogram)
        self.customers = sum(c * n for c, n in histogram)
        most = max([c for c, _ in histogram], default=1)
        grid = np.array(sorted({g for i in range(250) if (g := int(round(1.125**i))) <= most}), np.int64)
        base = 1 / (self.types + 1)
        rng = np.random.default_rng(seed)
        n = np.zeros(len(grid))
        for c, k in histogram:
            n[np.searchsorted(grid, c, "right") - 1] += k
        tables, mean, done = float(self.types), np.zeros(len(grid)), 0
        for sweep in range(CLASS_SWEEPS):
            # the mean of several draws stands for the many words of a count
            own = np.mean([drawn(grid, np.full(len(grid), STRENGTH + D_WORDS * max(tables - 1, 0)), np.full(len(grid), base), D_WORDS, rng) for _ in range(8)], axis=0)
            tables = float((own * n).sum())
            if sweep >= CLASS_SWEEPS // 3:
                mean, done = mean + own, done + 1
        self.grid, self.tables = grid, mean / max(done, 1)
        total = sum(n * (c - D_WORDS * float(self.seated(np.array([c]))[0])) for c, n in histogram)
        self.scale = STRENGTH + self.customers
        self.rest = (self.scale - total) / self.scale * base  # what is left is spread over all events

    def seated(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, np.interp(c, self.grid, self.tables), 0.0)

    def probability(self, c: np.ndarray) -> np.ndarray:
        return (c - D_WORDS * self.seated(c)) / self.scale + self.rest


# --- the operator ------------------------------------------------------------------------------------------


def _pair(context: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (context.astype(np.uint64) << np.uint64(32)) | place.astype(np.uint64)


class Model:
    """What is broadcast: the frequent words with their counts and classes, the upper restaurants, the hot contexts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, tokens_: int, types: int, buckets: int):
        self.index, self.counts, self.total, self.buckets = Hashed(keys), counts, float(tokens_ + types + 1), buckets
        self.symbol = np.minimum(np.arange(len(keys)), SYMBOLS - 1)
        #: Places of hot contexts are those below this one, since places go by count.
        self.hot = int((counts * HOT > tokens_ / buckets).sum())
        self.tables = np.zeros(self.hot)
        self.classes, self.root, self.words = np.zeros((0, 0)), None, None
        self.pairs, self.pair_score = Hashed(np.zeros(0, np.uint64)), np.zeros(0, np.float32)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each token, and of the token before it (the first of a text follows an end); -1: not frequent."""
        place = self.index.get(h)
        return place, np.concatenate([self.index.get(np.array([END])), place[:-1]])

    def finish(self, histogram: list[tuple[int, int]], matrix: np.ndarray) -> None:
        self.classes, self.root = class_restaurants(matrix)
        self.words = Words(histogram)
        self.inner = np.where(self.symbol == SYMBOLS - 1, self.words.probability(self.counts), 1.0)

    def base(self, context: np.ndarray, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The parent's probability of words: their places, or for -1 their counts; contexts by place (-1: not frequent)."""
        known = place >= 0
        symbol = np.where(known, np.minimum(place, SYMBOLS - 1), SYMBOLS - 1)
        own = (context >= 0) & (context < SYMBOLS - 1)
        inner = np.where(known, self.inner[np.maximum(place, 0)] if len(self.inner) else 1.0, self.words.probability(count))
        return np.where(own, self.root[symbol], self.classes[SYMBOLS - 1][symbol]) * inner

    def score_pairs(self, context: np.ndarray, place: np.ndarray, customers: np.ndarray) -> None:
        """Keep the scores of dishes (places of hot contexts and of words), as contexts() has them for known tables."""
        base = self.base(context, place, np.zeros(len(place), np.int64))
        p = contexts(context, customers, base, self.counts[: self.hot], self.tables, np.random.default_rng(len(place)))
        self.pairs, self.pair_score = Hashed(_pair(context, place)), np.log10(p).astype(np.float32)

    def scored(self, place0: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Scores of tokens by pairs that are broadcast; NaN for others."""
        out = np.full(len(place), np.nan, np.float32)
        at = np.flatnonzero((place0 >= 0) & (place0 < self.hot) & (place >= 0))
        found = self.pairs.get(_pair(place0[at], place[at]))
        out[at[found >= 0]] = self.pair_score[found[found >= 0]]
        return out

    def bucket(self, context: np.ndarray, place: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Buckets of tokens: by context, of hot contexts by context and word."""
        x = context * np.uint64(0x9E3779B97F4A7C15)
        x = np.where((place >= 0) & (place < self.hot), x ^ (word * np.uint64(0xC2B2AE3D27D4EB4F)), x)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)


def _live(sent, stamp: str):
    claim("lm")
    if stamp not in _LIVE:
        _LIVE.clear()
        _LIVE[stamp] = pickle.loads(sent.value)
    return _LIVE[stamp]


def _transitions(sent, stamp: str, modulus: int, held_out: int):
    """Training counts: (-1, class pair), and (place, word) of hot contexts, summed as far as memory goes."""

    def run(batches):
        model, sums = _live(sent, stamp), np.zeros(SYMBOLS * SYMBOLS, np.int64)
        held: list = []  # pairs of places, sorted, and their counts
        odd: list = []  # places of contexts, and words without a place

        def merged():
            keys, n = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            by = np.argsort(keys, kind="stable")
            first = np.flatnonzero(np.append(True, keys[by][1:] != keys[by][:-1]))
            return keys[by][first], np.add.reduceat(n[by], first)

        def rows(context, word, n):
            for at in range(0, len(n), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(context[at : at + 50_000].astype(np.int64)), pa.array(word[at : at + 50_000].view(np.int64)), pa.array(n[at : at + 50_000])], ["context", "word", "n"])

        def out():
            if held:
                keys, n = merged()
                yield from rows(keys >> 32, model.index.given[keys & 0xFFFFFFFF], n)
            if odd:
                context, word = (np.concatenate([x[i] for x in odd]) for i in (0, 1))
                by = np.lexsort((word, context))
                context, word = context[by], word[by]
                first = np.flatnonzero(np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1])))
                yield from rows(context[first], word[first], np.diff(np.append(first, len(context))))

        for part in _parts(batches):
            h, row = tokens(part.column(1))
            place, place0 = model.places(h)
            learn = ~_held(part.column(0), modulus, held_out)[row]
            classed = lambda p: np.where(p >= 0, np.minimum(p, SYMBOLS - 1), SYMBOLS - 1)
            sums += np.bincount((classed(place0).astype(np.int64) * SYMBOLS + classed(place))[learn], minlength=len(sums))
            hot = np.flatnonzero(learn & (place0 >= 0) & (place0 < model.hot))
            known = hot[place[hot] >= 0]
            if len(known):
                held.append(np.unique((place0[known].astype(np.int64) << 32) | place[known], return_counts=True))
            lone = hot[place[hot] < 0]
            if len(lone):
                odd.append((place0[lone], h[lone]))
            if sum(len(x[0]) for x in held) > 800_000:
                held = [merged()]
            if sum(len(x[0]) for x in held) > 600_000 or sum(len(x[0]) for x in odd) > 300_000:
                yield from out()
                held, odd = [], []
        yield from out()
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), -1)), pa.array(at), pa.array(sums[at])], ["context", "word", "n"])

    return run


def _tried(sent, stamp: str, count: int):
    """Tables of the given dishes of hot contexts, if the context has n ** (k / (POINTS - 1)) tables in all; words that are not
    broadcast count as their mean."""

    def run(batches):
        model = _live(sent, stamp)
        rng, sums = np.random.default_rng(7), np.zeros((model.hot, POINTS))
        for batch in batches:
            context, word, n = (c.to_numpy() for c in batch.columns)
            base = model.base(context, model.index.get(word.view(np.uint64)), np.full(len(n), count))
            for k in range(POINTS):
                all_ = model.counts[context] ** (k / (POINTS - 1))
                sums[:, k] += np.bincount(context, drawn(n, STRENGTH + D_CONTEXT * all_, base, D_CONTEXT, rng), model.hot)
        context, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(k), pa.array(sums[context, k])], ["context", "k", "tables"])

    return run


def settled(counts: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """For contexts of so many customers, the number of tables at which as many come out as go in; tried: see _tried()."""
    y, top, row = np.log(np.maximum(tried, 1)), np.maximum(np.log(np.maximum(counts, 1).astype(float)), 1e-9), np.arange(len(counts))
    x = top * (POINTS // 2) / (POINTS - 1)
    for _ in range(200):  # a straight line between the points on either side
        at = np.clip(x / top * (POINTS - 1), 0, POINTS - 1)
        low = np.minimum(at.astype(int), POINTS - 2)
        x = y[row, low] + (at - low) * (y[row, low + 1] - y[row, low])
    return np.exp(x)


#: To the buckets: packed tokens of a part; or a token whose word is not broadcast (doc is its document's code), then with its word's
#: count; or the table of a part's documents (doc is -1).
SENT = "bucket long, part long, data binary, doc long, word long, context long"
#: From the buckets: tables of documents (kind 0), and sums to be added to them (kind 1).
ADDED = "part long, kind long, data binary"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def _rows(schema: str, n: int, **columns) -> pa.RecordBatch:
    kinds = dict(x.split() for x in schema.split(", "))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], _KINDS[k]) if c in columns else pa.nulls(n, _KINDS[k]) for c, k in kinds.items()], list(kinds))


def _identity(part: pa.RecordBatch) -> np.ndarray:
    """A number for each row by id and text: the same wherever the row is read again, and the same for repeated rows."""
    return np.array([xxhash.xxh3_64_intdigest(f"{i}\0{t or ''}") >> 1 for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())], np.int64)


def _planes(x: np.ndarray, k: int) -> bytes:
    """The k low bytes of numbers, byte by byte: high bytes compress to almost nothing."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :k].T.tobytes()


def _plane_sum(data: bytes, at: int, n: int, k: int) -> np.ndarray:
    return sum((np.frombuffer(data, np.uint8, n, at + i * n).astype(np.int64) << (8 * i) for i in range(k)), np.zeros(n, np.int64))


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)


def packed(doc: np.ndarray, context: np.ndarray, place0: np.ndarray, place: np.ndarray) -> bytes:
    """Tokens: code of the document, places of context and word (under 2 ** 24), and contexts without a place."""
    k = _width(doc)
    return b"".join([np.array([len(doc), k], np.int64).tobytes(), _planes(doc, k), _planes(place0 + 1, 3), _planes(place, 3), context[place0 < 0].tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code of the document, place of the context (-1: none), place of the word; contexts without a place."""
    n, k = np.frombuffer(data, np.int64, 2).tolist()
    return _plane_sum(data, 16, n, k), _plane_sum(data, 16 + k * n, n, 3) - 1, _plane_sum(data, 16 + (k + 3) * n, n, 3), np.frombuffer(data[16 + (k + 6) * n :], np.uint64)


#: Columns of a part's table of documents.
TABLE = (("doc_id", np.int64), ("known_id", np.uint8), ("held", np.uint8), ("n_tokens", np.int64), ("n_known", np.int64), ("base", np.float64), ("score", np.float64))


def _dealt(sent, stamp: str, modulus: int, held_out: int, rest: bool):
    """For each part the table of its documents, with what the map side knows, and packed tokens for each bucket; or (rest) the tokens
    whose word is not broadcast. A part is named by its rows, so both passes give it one name."""

    def run(batches):
        model = _live(sent, stamp)
        log_base = np.log10((model.counts + 1) / model.total)
        held: list = []

        def flush():
            names, tables, arrays = (list(x) for x in zip(*held))
            part = xxhash.xxh3_64_intdigest(np.concatenate(names).tobytes()) - (1 << 63)
            first = np.cumsum([0, *map(len, names)])
            code, context, place0, place, word = (np.concatenate([a[i] + (2 * at if i == 0 else 0) for a, at in zip(arrays, first.tolist())]) for i in range(5))
            bucket = model.bucket(context, place0, word)
            if rest:
                if len(code):
                    yield _rows(SENT, len(code), bucket=bucket, part=np.full(len(code), part), doc=code, word=word.view(np.int64), context=context.view(np.int64))
                return
            data = np.array([first[-1]], np.int64).tobytes() + b"".join(np.concatenate([t[i] for t in tables]).astype(k).tobytes() for i, (_, k) in enumerate(TABLE))
            yield _rows(SENT, 1, bucket=np.array([part % model.buckets]), part=np.array([part]), doc=np.array([-1]), data=[data])
            by = np.argsort(bucket, kind="stable")
            cut = np.flatnonzero(np.diff(bucket[by])) + 1
            runs = np.split(by, cut) if len(by) else []
            for at in range(0, len(runs), 256):
                some = runs[at : at + 256]
                yield _rows(SENT, len(some), bucket=np.array([bucket[x[0]] for x in some]), part=np.full(len(some), part), data=[packed(code[x], context[x], place0[x], place[x]) for x in some])

        size = 0
        for batch in _parts(batches):
            n = batch.num_rows
            h, of = tokens(batch.column(1))
            out, names = _held(batch.column(0), modulus, held_out), _identity(batch)
            place, place0 = model.places(h)
            before = np.concatenate([[END], h[:-1]])
            seen = place >= 0
            if rest:
                at, table = np.flatnonzero(~seen), None
            else:
                known = model.scored(place0, place)
                at = np.flatnonzero(seen & np.isnan(known))
                ids = batch.column(0).cast(pa.int64())
                base = np.bincount(of, np.where(seen, log_base[place] if len(log_base) else 0.0, 0.0), n)
                table = (ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), out, np.bincount(of, minlength=n), np.bincount(of, seen, n), base, np.bincount(of, np.nan_to_num(known), n))
            held.append((names, table, (of[at] * 2 + ~out[of[at]], before[at], place0[at].astype(np.int32), place[at].astype(np.int32), h[at])))
            size += len(h)
            if size >= PART:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


def _scored(sent, stamp: str):
    """Rows sorted by bucket: tables of documents as they come, and sums for the documents of each part. After SENT comes the count of the
    row's word."""

    def run(batches):
        model, names = _live(sent, stamp), [x.split()[0] for x in SENT.split(", ")] + ["count"]
        number: dict[int, int] = {}  # of the parts seen
        zero = lambda: [np.zeros(0, np.int64), *np.zeros((3, 0))]
        sums = zero()

        def out():
            keys = list(number)
            which = sums[0] >> 32
            cut = np.flatnonzero(np.diff(which)) + 1
            runs = np.split(np.arange(len(which)), cut) if len(which) else []
            for at in range(0, len(runs), 256):
                some = runs[at : at + 256]
                yield _rows(ADDED, len(some), part=np.array([keys[which[x[0]]] for x in some]), kind=np.ones(len(some), np.int64), data=[_summed(sums[0][x] & 0xFFFFFFFF, *(v[x] for v in sums[1:])) for x in some])

        def finish(held):
            parts = [(number.setdefault(p, len(number)), unpacked(x)) for p, x in held[0]]
            held[0].clear()
            one = lambda i, kind: np.concatenate([x[i] for _, x in parts] or [np.zeros(0, kind)])
            code, place0, place, far = one(0, np.int64), one(1, np.int64), one(2, np.int64), one(3, np.uint64)
            code |= np.repeat([p for p, _ in parts], [len(x[0]) for _, x in parts]).astype(np.int64) << 33
            parts.clear()
            context, word = np.zeros(len(code), np.uint64), np.zeros(len(code), np.uint64)
            context[place0 < 0] = far
            count = np.zeros(len(code), np.int64)
            lone = len(code)
            if held[1]:
                col = lambda name: np.concatenate([b.column(names.index(name)).to_numpy(zero_copy_only=False) for b in held[1]])
                c = col("context").astype(np.int64).view(np.uint64)
                own = np.array([number.setdefault(p, len(number)) for p in col("part").astype(np.int64).tolist()], np.int64)
                code = np.append(code, col("doc").astype(np.int64) | (own << 33))
                context, word = np.append(context, c), np.append(word, col("word").astype(np.int64).view(np.uint64))
                place0, place = np.append(place0, model.index.get(c)), np.append(place, np.full(len(c), -1))
                count = np.append(count, np.nan_to_num(col("count").astype(float)).astype(np.int64))
            # contexts and words without a place are numbered after those with one
            size = len(model.counts)
            ids = []
            for p, h in ((place0, context), (place, word)):
                p, none = p.copy(), p < 0
                p[none] = size + np.unique(h[none], return_inverse=True)[1]
                ids.append(p)
            _, first, dish = np.unique(ids[0] << 32 | ids[1], return_index=True, return_inverse=True)
            customers = np.bincount(dish, code & 1, len(first)).astype(np.int64)
            c0 = ids[0][first]
            start = np.flatnonzero(np.append(True, c0[1:] != c0[:-1]))
            at = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(c0))))
            base = model.base(place0[first], place[first], count[first])
            total, tables = np.bincount(at, customers, len(start)), np.full(len(start), np.nan)
            hot = c0[start] < model.hot
            total[hot], tables[hot] = model.counts[c0[start][hot]], model.tables[c0[start][hot]]
            score_ = np.log10(contexts(at, customers, base, total, tables, np.random.default_rng(len(code))))[dish]
            known, flat = np.zeros(len(code)), np.zeros(len(code))
            known[lone:], flat[lone:] = count[lone:] > 0, np.log10((count[lone:] + 1) / model.total)
            u, to = np.unique(np.append(sums[0], code >> 1), return_inverse=True)
            return [u, *(np.bincount(to, np.append(s, x), len(u)) for s, x in zip(sums[1:], (known, flat, score_)))]

        bucket, held = None, ([], [])
        for batch in batches:
            get = {c: batch.column(i) for i, c in enumerate(names)}
            tables = pc.fill_null(pc.equal(get["doc"], -1), False)
            if tables.true_count:
                d = batch.filter(tables)
                yield _rows(ADDED, d.num_rows, part=d.column(1), kind=np.zeros(d.num_rows, np.int64), data=d.column(2))
                batch = batch.filter(pc.invert(tables))
            b = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(b)) + 1
            for a, z in zip(np.append(0, cut).tolist(), np.append(cut, len(b)).tolist()):
                if a == z:
                    continue
                if bucket is not None and b[a] != bucket:
                    sums = finish(held)
                    held = ([], [])
                    if len(sums[0]) > 400_000:
                        yield from out()
                        sums = zero()
                        number.clear()
                bucket, piece = b[a], batch.slice(a, z - a)
                blobs = piece.column(2).is_valid()
                some = piece.filter(blobs)
                held[0].extend(zip(some.column(1).to_pylist(), some.column(2).to_pylist()))
                if blobs.false_count:
                    held[1].append(piece.filter(pc.invert(blobs)))
        if held[0] or held[1]:
            sums = finish(held)
        yield from out()

    return run


def _summed(doc: np.ndarray, known: np.ndarray, base: np.ndarray, score_: np.ndarray) -> bytes:
    """Sums for documents of a part: scores of all; known words and base of those that have words that are not broadcast."""
    k, some = _width(doc), np.flatnonzero(base)
    return b"".join([np.array([len(doc), k, len(some)], np.int64).tobytes(), _planes(doc, k), score_.astype("<f4").tobytes(), doc[some].astype("<u4").tobytes(), known[some].astype("<u4").tobytes(), base[some].astype("<f8").tobytes()])


def _gathered(batches):
    """Rows sorted by part: the documents of each part with their sums."""

    def out(tables, sums):
        if not tables:
            raise RuntimeError("scores of documents that are not there: the input changed between two passes")
        n = int(np.frombuffer(tables[0], np.int64, 1)[0])
        col, at = {}, 8
        for name, kind in TABLE:
            col[name] = np.frombuffer(tables[0], kind, n, at)
            at += n * np.dtype(kind).itemsize
        added = np.zeros((3, n))
        for data in sums:
            m, k, some = np.frombuffer(data, np.int64, 3).tolist()
            doc = _plane_sum(data, 24, m, k)
            added[2] += np.bincount(doc, np.frombuffer(data, "<f4", m, 24 + k * m), n)
            at = 24 + (k + 4) * m
            who = np.frombuffer(data, "<u4", some, at)
            added[0] += np.bincount(who, np.frombuffer(data, "<u4", some, at + 4 * some), n)
            added[1] += np.bincount(who, np.frombuffer(data, "<f8", some, at + 8 * some), n)
        added /= len(tables)  # parts of the same rows have one name, and as many sums
        ids = pa.array(col["doc_id"], mask=col["known_id"] == 0)
        columns = [ids, pa.array(col["held"].astype(bool)), pa.array(col["n_tokens"]), pa.array((col["n_known"] + added[0]).astype(np.int64)), pa.array(col["base"] + added[1]), pa.array(col["score"] + added[2])]
        for _ in tables:
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in RESULT.split(", ")])

    part, tables, sums = None, [], []
    for batch in batches:
        for p, kind, data in zip(*(c.to_pylist() for c in batch.columns)):
            if p != part:
                if part is not None:
                    yield from out(tables, sums)
                part, tables, sums = p, [], []
            (sums if kind else tables).append(data)
    if part is not None:
        yield from out(tables, sums)


def _grid() -> Column:
    """The count in column n, on a grid above 4096 so that there are few different ones."""
    return F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.floor(F.exp(F.floor(F.log("n") * 64) / 64)).cast("long"))


def _counts_of_counts(df: DataFrame) -> dict[int, int]:
    return {r.c: r.k for r in df.groupBy(_grid().alias("c")).agg(F.count("*").alias("k")).collect()}


def _most_frequent(df: DataFrame, most: int) -> DataFrame:
    """The rows with the greatest n, as many whole steps of the grid as have at most `most` rows: found by a filter, not by a sort of all rows
    or a limit that would bring them to one task."""
    least, rows = None, 0
    for c, k in sorted(_counts_of_counts(df).items(), reverse=True):
        rows += k
        if rows > most:
            break
        least = c
    return df.where("false") if least is None else df.where(_grid() >= least)


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Rows whose crc32(doc_id as text) mod `modulus` is `held_out` are scored only; the others are learned from too. A null text is
    empty (its end token only); a row without an id counts as one with an empty id. score is the log10 probability of the
    text's tokens under the model, perplexity 10 ** (-score / n_tokens). Repeated rows count each; an empty table gives an
    empty table; if all rows are held out every token is unknown; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    words = written(docs.mapInArrow(_counter(modulus, held_out), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    total = words.agg(F.count("*").alias("v"), F.sum("n").alias("n")).first()
    types, tokens_ = total.v, total.n or 0
    top = _most_frequent(words, FREQUENT).select("key", "n").toArrow()
    order = np.lexsort((top.column("key").to_numpy(), -top.column("n").to_numpy()))
    keys, counts = top.column("key").to_numpy()[order].view(np.uint64), top.column("n").to_numpy()[order]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens_ // BUCKET + 1)
    model = Model(keys, counts, tokens_, types, buckets)
    send = lambda: (spark.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex)
    matrix = np.zeros(SYMBOLS * SYMBOLS, np.int64)
    pairs = docs.mapInArrow(_transitions(*send(), modulus, held_out), "context long, word long, n long").groupBy("context", "word").agg(F.sum("n").alias("n"))
    pairs = written(pairs, "pairs")
    moved = pairs.where("context < 0").select("word", "n").toArrow()
    matrix[moved.column("word").to_numpy()] = moved.column("n").to_numpy()
    of = _counts_of_counts(words)
    for n in counts[: SYMBOLS - 1].tolist():  # classes of their own are not in this restaurant
        c = n if n <= 4096 else int(np.floor(np.exp(np.floor(np.log(n) * 64) / 64)))
        c = c if of.get(c) else min((x for x in of if of[x]), key=lambda x: abs(x - c))
        of[c] -= 1
    model.finish(sorted((c, k) for c, k in of.items() if k), matrix.reshape(SYMBOLS, SYMBOLS))
    if model.hot:
        mean = (tokens_ - int(counts.sum())) // max(types - len(counts), 1)
        tried = np.zeros((model.hot, POINTS))
        for r in pairs.where("context >= 0").mapInArrow(_tried(*send(), mean), "context long, k long, tables double").groupBy("context", "k").agg(F.sum("tables").alias("t")).collect():
            tried[r.context, r.k] = r.t
        model.tables = settled(counts[: model.hot], tried)
        words_at = model.index.get
        best = _most_frequent(pairs.where("context >= 0"), PAIRS).toArrow()
        context, place, n = best.column("context").to_numpy(), words_at(best.column("word").to_numpy().view(np.uint64)), best.column("n").to_numpy()
        model.score_pairs(context[place >= 0], place[place >= 0].astype(np.int64), n[place >= 0])
    sent, stamp = send()
    dealt = lambda rest: docs.mapInArrow(_dealt(sent, stamp, modulus, held_out, rest), SENT)
    found = words.select(F.col("key").alias("_w"), F.col("n").alias("count"))
    lone = dealt(True)
    lone = lone.join(found, F.col("word") == F.col("_w"), "left").select(*lone.columns, "count")
    met = dealt(False).withColumn("count", F.lit(None).cast("long")).unionByName(lone)
    put = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_scored(sent, stamp), ADDED)
    out = put.repartition("part").sortWithinPartitions("part").mapInArrow(_gathered, RESULT)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens_).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
