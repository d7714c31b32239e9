"""Near-duplicates by MinHash banding and sequential Bayesian verification.

Texts with equal shingle sets are one class, and only class representatives go on. Representatives
that share a band of their signatures are candidates. A candidate pair's signatures are compared batch by batch; after each
batch the posterior probability that the similarity reaches the threshold is bounded (uniform prior), and the pair is dropped
when it falls under the chosen miss probability. Survivors are verified on their full sets.

No bucket is expanded into all its pairs. First each member is paired with one centre of its bucket, drawn
anew in each band; verified links give components. Then only pairs across components are left to
look at: in buckets that still hold several components, the members outside the largest one are compared with all members
inside tasks, in blocks of bounded size.
Members with a survivor across components come out, meet their full sets, and are verified in the block, which gives
fewer links than it has members. Links inside a component are settled already.
"""

from __future__ import annotations

from math import lgamma, log, log1p, exp

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release, small, written
from quarry.llm.components import connected
from quarry.llm.tokens import claim, word_hash

SHINGLE, PERCENT = 5, 75
#: Banding: 24 bands of 3 miss a pair at 0.75 with probability (1 - 0.75 ** 3) ** 24, about 2e-6.
BANDS, ROWS, HASHES = 24, 3, 96
#: Signature batches after which a pair may be dropped, and the probability of losing a true link in all of them.
STEPS, MISS = (16, 32, 64, 96), 1e-6
#: Members of a bucket that meet in one block; rows of a list of ids that may be broadcast.
BLOCK, BROADCAST = 512, 200_000
BLOCK_ROWS = "key long, p int, q int, node long, component long, side int, band int, sig binary"
BLOCK_NAMES = [x.split()[0] for x in BLOCK_ROWS.split(", ")]

_rng = np.random.default_rng(20)
_MUL = (_rng.integers(1, 1 << 32, HASHES, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's 5-word shingles (ASCII letters lower-cased)."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(word_hash.__getitem__, words), np.uint64, n)
    width = min(n, SHINGLE)
    h = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        h = (h ^ w[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    low = (s ^ (s >> np.uint64(32))).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(out, ((low[at : at + 512, None] ^ _XOR) * _MUL).min(0), out=out)
    return out


def least_matches(percent: int = PERCENT, miss: float = MISS, steps: tuple[int, ...] = STEPS) -> list[int]:
    """For each batch end n, the fewest of n matches with which P(similarity >= threshold | matches) is still
    at least miss / len(steps). With a uniform prior that is the chance of at most so many hits in n + 1 draws."""
    t, out = percent / 100, []
    for n in steps:
        total = 0.0
        for m in range(n + 2):
            total += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(t) + (n + 1 - m) * log1p(-t))
            if total >= miss / len(steps):
                out.append(m)
                break
    return out


def _sketch(batches):
    claim("words")
    for batch in batches:
        ids, n, c1, c2, sig = batch.column(0).to_pylist(), [], [], [], []
        for i, text in zip(ids, batch.column(1).to_pylist()):
            s = shingles(text)
            n.append(len(s))
            if len(s) and i is not None:
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                c1.append((d >> 64) - (1 << 63))
                c2.append((d & ((1 << 64) - 1)) - (1 << 63))
                sig.append(signature(s).tobytes())
            else:
                for x in (c1, c2, sig):
                    x.append(None)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).cast(pa.int64()), "n": pa.array(n, pa.int64()), "c1": pa.array(c1, pa.int64()), "c2": pa.array(c2, pa.int64()), "sig": pa.array(sig, pa.binary())})


def _sets(batches):
    claim("words")
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], ["node", "set"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, HASHES)


def _banded(batches):
    for batch in batches:
        sig = _matrix(batch.column(1)).astype(np.uint64).reshape(-1, HASHES)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), sig.shape[:2]).copy()
        for r in range(ROWS):
            key = (key ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(sig))), pa.array(key.reshape(-1).view(np.int64))], ["node", "band", "key"])


def _alive(x: np.ndarray, y: np.ndarray, need: list[int]) -> np.ndarray:
    """Places of the row pairs of x and y that no batch of hashes drops."""
    at, hits, done = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for n, m in zip(STEPS, need):
        hits = hits + (x[at, done:n] == y[at, done:n]).sum(1)
        keep = hits >= m
        at, hits, done = at[keep], hits[keep], n
    return at


def _pruner(need: list[int]):
    def run(batches):
        for batch in batches:
            yield batch.take(pa.array(_alive(_matrix(batch.column(2)), _matrix(batch.column(3)), need))).select(["a", "b"])

    return run


def _verifier(percent: int):
    def run(batches):
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (2, 3))
            ok = []
            for x, y in zip(a, b):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    return run


def _candidates(key, rows, need: list[int]):
    """Pairs of places across components inside a block that no batch of hashes drops, each in its first band only."""
    comp, side, band = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    sig = np.frombuffer(b"".join(r[4] for r in rows), np.uint32).reshape(-1, HASHES)
    places, same = np.arange(len(rows)), key[1] == key[2]
    for i in range(len(rows)):
        # within a block each pair once; between two blocks, left side against right side
        j = np.flatnonzero((comp != comp[i]) & ((places > i) if same else ((side[i] == 0) & (side == 1))))
        if len(j):
            j = j[_alive(np.broadcast_to(sig[i], (len(j), HASHES)), sig[j], need)]
        if len(j):
            meets = (sig[j, : BANDS * ROWS] == sig[i, : BANDS * ROWS]).reshape(-1, BANDS, ROWS).all(2).argmax(1)
            j = j[meets == band[i]]
        if len(j):
            yield i, j


def _grouped(batches):
    """(key, p, q) and the rows behind them, from rows sorted by them."""
    held, last = [], None
    for batch in batches:
        for key, p, q, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if (key, p, q) != last:
                if len(held) > 1:
                    yield last, held
                held, last = [], (key, p, q)
            held.append(row)
    if len(held) > 1:
        yield last, held


def _suspects(need: list[int]):
    """The rows of each block that have a candidate across components: at most the block's members come out."""

    def run(batches):
        out = []
        for key, rows in _grouped(batches):
            met = set()
            for i, j in _candidates(key, rows, need):
                met.add(i)
                met.update(j.tolist())
            out += [(*key, *rows[i]) for i in sorted(met)]
            if len(out) > 20_000:
                yield _blocks(out)
                out = []
        yield _blocks(out)

    return run


def _blocks(out) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], BLOCK_NAMES)


def _linker(need: list[int], percent: int):
    """Candidates across components, verified on full sets inside the block; of the links only those that join what is
    apart come out, so a block gives fewer links than it has members."""

    def run(batches):
        out = []
        for key, rows in _grouped(batches):
            sets = [np.frombuffer(r[5], np.uint64) for r in rows]
            first: dict = {}
            root = [first.setdefault(r[1], i) for i, r in enumerate(rows)]

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            found = list(_candidates(key, rows, need))
            every = _overlaps(sets) if sum(len(j) for _, j in found) > 4 * len(rows) else None
            for i, js in found:
                for j in js.tolist():
                    a, b = find(i), find(j)
                    if a == b:
                        continue
                    both = int(every[i, j]) if every is not None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        root[max(a, b)] = min(a, b)
                        out.append((min(rows[i][0], rows[j][0]), max(rows[i][0], rows[j][0])))
            if len(out) > 20_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    return run


def _overlaps(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of a block's sets, by products of membership matrices `width` shingles wide."""
    flat = np.concatenate(sets)
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    u, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = n[at] > 1
    place = np.cumsum(n > 1) - 1
    col, who = place[at[shared]], who[shared]
    by = np.argsort(col, kind="stable")
    col, who = col[by], who[by]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, b = np.searchsorted(col, [lo, lo + width])
        m = np.zeros((len(sets), width), np.float32)
        m[who[a:b], col[a:b] - lo] = 1
        out += m @ m.T
    return out


def _pairs(out) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(x) for x, _ in out], pa.int64()), pa.array([int(y) for _, y in out], pa.int64())], ["a", "b"])


def _joined(pairs: DataFrame, values: DataFrame, name: str) -> DataFrame:
    left = values.select(F.col("node").alias("_l"), F.col(name).alias("x"))
    right = values.select(F.col("node").alias("_r"), F.col(name).alias("y"))
    return pairs.join(left, F.col("a") == F.col("_l")).join(right, F.col("b") == F.col("_r")).select("a", "b", "x", "y")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, set of the nodes (_node)."""
    texts = docs.select("doc_id", "text").join(small(nodes, nodes.count(), BROADCAST), F.col("doc_id") == F.col("_node"), "left_semi")
    return written(texts.mapInArrow(_sets, "node long, set binary"), "sets")


def _verified(docs: DataFrame, survivors: DataFrame, percent: int) -> DataFrame:
    """The survivors whose full sets reach the threshold."""
    nodes = written(survivors.select(F.col("a").alias("_node")).union(survivors.select("b")).distinct(), "nodes")
    sets = _full_sets(docs, nodes)
    links = written(_joined(survivors, sets, "set").mapInArrow(_verifier(percent), "a long, b long"), "links")
    release(sets)
    release(nodes)
    return links


def _across(docs: DataFrame, full: DataFrame, need: list[int], percent: int) -> DataFrame:
    """Links across components of what meets in the blocks (key, p, q) of full."""
    dealt = lambda df: df.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    suspects = written(dealt(full).mapInArrow(_suspects(need), BLOCK_ROWS), "suspects")
    nodes = written(suspects.select(F.col("node").alias("_node")).distinct(), "nodes")
    sets = _full_sets(docs, nodes)
    # rows with one id and different texts have several sets; each is tried
    whole = suspects.join(sets.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).select(*BLOCK_NAMES, "set")
    links = written(dealt(whole).mapInArrow(_linker(need, percent), "a long, b long").distinct(), "links")
    for t in (suspects, nodes, sets):
        release(t)
    return links


def near_duplicates(docs: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, n_class.

    Texts link when 100 * intersection >= percent * union of their shingle sets; component_id is the least id
    reachable, kept says that the row bears it. A null text, or one without words, has no
    shingles and no links. A row without an id is not linked (component_id null) and kept. Rows that share an id count as one
    document: what either links to is linked, and all rows of a kept id are kept. n_class: rows with an equal set.
    An empty table gives an empty table; other columns are ignored.
    """
    need = least_matches(percent, miss)
    sk = written(docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n long, c1 long, c2 long, sig binary"), "sketches")
    classes = sk.where("c1 is not null").groupBy("c1", "c2").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_class"), F.any_value("sig").alias("sig"))
    reps = written(classes, "classes")
    banded = written(reps.select("node", "sig").mapInArrow(_banded, "node long, band int, key long"), "banded")
    draw = F.struct(F.xxhash64("node", "band").alias("h"), "node")
    shared = banded.groupBy("key").agg(F.count("*").alias("size"), F.max(draw)["node"].alias("centre")).where("size > 1")
    members = written(banded.join(shared, "key"), "members")
    release(banded)
    busy = written(members.select(F.col("node").alias("_node")).distinct(), "busy")
    sigs = written(reps.select("node", "sig").join(small(busy, busy.count(), BROADCAST), F.col("node") == F.col("_node"), "left_semi"), "signatures")
    pairs = members.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    star = written(_joined(pairs, sigs, "sig").mapInArrow(_pruner(need), "a long, b long"), "survivors")
    links = _verified(docs, star, percent)
    first = connected(links)
    # buckets that still hold several components
    named = members.join(first.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select("key", "band", "node", "size", F.coalesce("component", "node").alias("component"))
    named = written(named, "named")
    mixed = written(named.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key"), "mixed")
    inside = written(named.join(small(mixed, mixed.count(), BROADCAST), "key", "left_semi"), "inside")
    # the members of a bucket's largest component meet the other members only, not each other
    parts = inside.groupBy("key", "component").agg(F.count("*").alias("n"))
    largest = written(parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all")).select("key", "top.n", F.col("top.component").alias("_top"), (F.col("all") - F.col("top.n")).alias("rest")), "largest")
    met = inside.join(small(largest, largest.count(), BROADCAST), "key").select("*", F.ceil(F.col("n") / BLOCK).cast("int").alias("_n"), F.ceil(F.col("rest") / BLOCK).cast("int").alias("_r"))
    big, h = F.col("component") == F.col("_top"), F.xxhash64("node")
    mine = F.when(big, F.pmod(h, "_n")).otherwise(F.col("_n") + F.pmod(h, "_r")).cast("int")
    dealt = met.select("*", mine.alias("mine"), F.explode(F.sequence(F.when(big, F.col("_n")).otherwise(0), F.col("_n") + F.col("_r") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), "node", "component", (F.col("mine") > F.col("other")).cast("int").alias("side"), "band")
    full = dealt.join(sigs.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node")).select(*BLOCK_NAMES)
    more = _across(docs, full, need, percent)
    final = connected(links.union(more))
    for t in (members, busy, sigs, star, named, mixed, inside, largest):
        release(t)
    put = reps.select("c1", "c2", "node", "n_class").join(final.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left").select(F.col("c1").alias("_c1"), F.col("c2").alias("_c2"), "n_class", F.coalesce("component", "node").alias("component"))
    put = written(put, "components")
    out = sk.select("doc_id", "n", "c1", "c2").join(put, (F.col("c1") == F.col("_c1")) & (F.col("c2") == F.col("_c2")), "left")
    comp = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.col("doc_id").eqNullSafe(comp).alias("kept"), F.coalesce("n_class", F.lit(1).cast("long")).alias("n_class"))
