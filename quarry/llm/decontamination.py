"""Benchmark decontamination by greedy string tiling.

Documents are scanned map-side against the benchmark's seeds (hashed windows of `least` words),
so no document text is shuffled. For each document and benchmark item that share seeds, the longest common stretches of
unmarked words are found by running Karp-Rabin: windows of a search length are hashed, equal ones extended,
the longest non-overlapping matches marked as tiles, the search length reduced, down to `least`. A document
holds an item when tiles cover enough of the item's words, in whatever order they come, so
reordered passages are caught.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import filtered, release, written
from quarry.llm.tokens import claim, word_hash

#: Words of the least tile, and the share of an item's words that must be tiled.
LEAST, COVERAGE = 5, 0.5
#: Bound of a broadcast block of the benchmark, in items and words; a larger one is handled in several blocks.
BLOCK_ITEMS, BLOCK_WORDS = 50_000, 2_000_000
RESULT = "doc_id long, item_id long, item_words int, covered int, tiles int, coverage double"

_LIVE: dict = {}
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of the text's words: ASCII lower case, without punctuation at either end."""
    found = (w.strip(b".,;:!?\"'()[]{}|") for w in (text or "").encode().lower().split())
    found = [w for w in found if w]
    return np.fromiter(map(word_hash.__getitem__, found), np.uint64, len(found))


def windows(w: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all windows of `size` words (polynomials modulo 2 ** 64)."""
    n = len(w) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * _BASE + w[i : i + n]
    return h ^ (h >> np.uint64(31))


@dataclass
class Index:
    seeds: np.ndarray  # sorted; owner[i] is the item (place) of seeds[i]
    owner: np.ndarray
    ids: list[int]
    items: list[np.ndarray]
    sizes: np.ndarray  # length of the items' seeds: least, or all of a shorter item
    need: np.ndarray  # words that tiles must cover


def index(rows: list[tuple[int, np.ndarray]], least: int, coverage: float) -> Index:
    """The index of items (id, word hashes), of which none is empty."""
    items = [w for _, w in rows]
    sizes = np.array([min(least, len(w)) for w in items], np.int64)
    seeds = [np.unique(windows(w, int(n))) for w, n in zip(items, sizes)]
    flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(items), dtype=np.int32), [len(s) for s in seeds]) if seeds else np.zeros(0, np.int32)
    by = np.argsort(flat, kind="stable")
    return Index(flat[by], owner[by], [i for i, _ in rows], items, sizes, np.array([coverage * len(w) for w in items]))


def tiles(doc: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in doc, place in item, length) of the tiles."""
    free_d, free_i = np.ones(len(doc), bool), np.ones(len(item), bool)
    out: list[tuple[int, int, int]] = []
    size = max(least, len(item))
    while True:
        found, longest = _matches(doc, item, free_d, free_i, size)
        if longest > 2 * size:
            size = longest
            continue
        for n, i, j in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if free_d[i : i + n].all() and free_i[j : j + n].all():
                free_d[i : i + n] = free_i[j : j + n] = False
                out.append((i, j, n))
        # matches that a longer tile cut short are found again at a smaller length
        if size <= least:
            again, _ = _matches(doc, item, free_d, free_i, size)
            if not again:
                return out
        else:
            size = max(least, size // 2)


def _matches(doc, item, free_d, free_i, size):
    """Maximal matches of at least `size` unmarked words as (length, place in doc, place in item)."""
    places = defaultdict(list)
    for j, h in zip(*_open(item, free_i, size)):
        places[h].append(j)
    found, longest, ends = [], 0, {}
    for i, h in zip(*_open(doc, free_d, size)):
        for j in places.get(h, ()):
            if ends.get(i - j, -1) > i or (doc[i : i + size] != item[j : j + size]).any():
                continue
            n = size
            while i + n < len(doc) and j + n < len(item) and free_d[i + n] and free_i[j + n] and doc[i + n] == item[j + n]:
                n += 1
            ends[i - j] = i + n  # the rest of this stretch lies on the same diagonal
            found.append((n, i, j))
            longest = max(longest, n)
    return found, longest


def _open(w, free, size):
    """Places and hashes of the windows without a marked word."""
    h = windows(w, size)
    if not len(h):
        return [], []
    marked = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(marked[size:] == marked[: len(marked) - size])
    return at.tolist(), h[at].tolist()


def _near(doc: np.ndarray, hits: np.ndarray, reach: int) -> np.ndarray:
    """The parts of the document that a tile can lie in: seeds and the words they span; other words between parts
    are replaced by one word that nothing equals."""
    keep = np.zeros(len(doc), bool)
    for r in range(reach):
        keep[np.minimum(hits + r, len(doc) - 1)] = True
    cut = np.flatnonzero(keep)
    gaps = np.flatnonzero(np.diff(cut) > 1) + 1
    return np.insert(doc[cut], gaps, np.uint64(0))


def _spanned(at: np.ndarray, size: int, first: np.ndarray) -> np.ndarray:
    """Words under windows of `size` words at the sorted places at, for each run of places that begins at first."""
    step = np.minimum(np.diff(np.append(at, at[-1:] + size)), size)
    step[np.append(first[1:], len(at)) - 1] = size
    return np.add.reduceat(step, first)


def scan(ix: Index, text: str | None, least: int) -> list[tuple[int, int, int, int, float]]:
    """(item_id, item_words, covered, tiles, coverage) of the items that the text holds.

    Tiles consist of shared seeds, so an item whose shared seeds span too few words of the text, or of the item, is not tiled."""
    w, out = words(text), []
    for size in np.unique(ix.sizes).tolist():
        h = windows(w, size)
        lo, hi = np.searchsorted(ix.seeds, h, "left"), np.searchsorted(ix.seeds, h, "right")
        n = hi - lo
        at = np.repeat(np.arange(len(h)), n)
        if not len(at):
            continue
        owner = ix.owner[np.arange(len(at)) + np.repeat(lo - (np.cumsum(n) - n), n)]
        by = np.argsort(owner, kind="stable")
        owner, at = owner[by], at[by]
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        enough = (_spanned(at, size, first) >= ix.need[owner[first]]) & (ix.sizes[owner[first]] == size)
        for a, b in zip(first[enough].tolist(), np.append(first[1:], len(at))[enough].tolist()):
            k = int(owner[a])
            item = ix.items[k]
            mine = np.flatnonzero(np.isin(windows(item, size), h[at[a:b]]))
            if _spanned(mine, size, np.zeros(1, np.int64))[0] < ix.need[k]:
                continue
            found = tiles(_near(w, at[a:b], size), item, size)
            covered = sum(x for _, _, x in found)
            if covered >= ix.need[k]:
                out.append((k, covered, len(found)))
    return [(ix.ids[k], len(ix.items[k]), covered, many, covered / len(ix.items[k])) for k, covered, many in sorted(out)]


def _hashed(batches):
    claim("words")
    for batch in batches:
        found = [words(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(w) for w in found], pa.int64()), pa.array([w.tobytes() for w in found], pa.binary())], ["item_id", "n", "words"])


def _blocks(benchmark: DataFrame):
    """The benchmark's items (id, word hashes) in blocks of about the bounded size, each of which one job brings."""
    items = benchmark.select("item_id", "text").where("item_id is not null").mapInArrow(_hashed, "item_id long, n long, words binary").where("n > 0")
    items = written(items, "items")
    total = items.agg(F.count("*").alias("items"), F.sum("n").alias("words")).first()
    size = max(total["items"] / BLOCK_ITEMS, (total["words"] or 0) / BLOCK_WORDS)
    blocks = 1 if size <= 1 else int(1.2 * size) + 1
    for k in range(blocks if total["items"] else 0):
        found = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "words").collect()
        if found:
            yield sorted(((r.item_id, np.frombuffer(bytes(r.words), np.uint64)) for r in found), key=lambda x: (x[0], x[1].tobytes()))
    release(items)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, item_words, covered, tiles, coverage of each row of docs (doc_id, text) that holds an item
    (item_id, text) of the benchmark.

    Items of fewer than `least` words must occur whole. Null and empty texts, and items without an id, hold and match nothing;
    a null doc_id is reported as null; repeated rows and repeated items are reported each; of equally long matches the one that
    begins first becomes a tile; a text is searched whole, however long; empty tables give no rows; other columns
    are ignored. The benchmark is hashed by the workers and broadcast in blocks of bounded size, one pass over docs for each.
    """
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    out = None
    for block in _blocks(benchmark):
        found = _scanner(docs, block, least, coverage)

        def run(batches, found=found):
            for batch in batches:
                rows = [(d, *f) for d, fs in zip(batch.column(0).to_pylist(), found(batch)) for f in fs]
                cols = list(zip(*rows)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "item_words", "covered", "tiles", "coverage"])

        part = docs.select("doc_id", "text").mapInArrow(run, RESULT)
        out = part if out is None else out.union(part)
    return docs.sparkSession.createDataFrame([], RESULT) if out is None else out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no item of the benchmark, as contaminated() has it: rows with a null or
    empty text stay, repeated rows stay or go together, an empty benchmark or table changes nothing, and columns of any name pass through."""
    for block in _blocks(benchmark):
        found = _scanner(docs, block, least, coverage)
        docs = filtered(docs, lambda batch, found=found: [not f for f in found(batch)])
    return docs


def _scanner(docs: DataFrame, block, least: int, coverage: float):
    """A function from a batch (doc_id, text) to what scan() finds of the block in each text."""
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(index(block, least, coverage)))
    stamp = uuid.uuid4().hex

    def found(batch):
        claim("words")
        if stamp not in _LIVE:
            _LIVE.clear()
            _LIVE[stamp] = pickle.loads(sent.value)
        return [scan(_LIVE[stamp], t, least) for t in batch.column(1).to_pylist()]

    return found
