"""Harmonic packing of token streams into fixed-length sequences.

A length r belongs to class k = capacity // r: k pieces of the class fill a bin (k * r <= capacity),
so a bin of class k is filled by a fixed count of k pieces with no look at others. Documents are cut
so that pieces nearly reach capacity / k: while a piece would waste more than `slack` of its place, a
piece of exactly capacity // (k + 1) tokens is cut off first. Each worker fills the bins of each class on its own;
what is left of a class (at most k - 1 pieces of a worker) is filled the same way in rounds that each join
GROUP workers' leftovers, a bounded group. The last leftovers (at most k - 1 of a class, some thousand
pieces in all, whatever the corpus) are placed by first fit, longest first.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written
from quarry.llm.tokens import encoder

#: Workers whose leftovers meet in one round.
GROUP = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class_k int, task long, seq long"
FIELDS = [f.split()[0] for f in PIECES.split(", ")]
#: What a worker holds of a piece; known: whether doc_id is not null.
HELD = ["doc_id", "known", "start", "length", "ids_crc32", "doc_tokens", "class_k"]
LENGTH, CLASS = HELD.index("length"), HELD.index("class_k")


def cuts(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n tokens."""
    out = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        k = capacity // r
        if r * k >= (1 - slack) * capacity or k + 1 > capacity:
            out.append(r)
            break
        out.append(capacity // (k + 1))
        r -= out[-1]
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 1, slack: float = 0.03) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class_k.
    Sequences are short of the capacity only by what padding fills.

    A null text counts as empty: a document of its end id only. Null and repeated ids are packed like
    others; an empty table gives an empty table; other columns are ignored. sequence_id is unique over
    the result and depends only on how the input is dealt into tasks.
    """
    spark = docs.sparkSession

    def run(batches):
        from pyspark import TaskContext

        enc, task = encoder(path), TaskContext.get().partitionId()
        held, seq = np.zeros((0, len(HELD)), np.int64), task << 32
        for batch in batches:
            known, ids = batch.column(0).is_valid().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy()
            at = 0
            for tokens, n in enc.encoded(batch.column(1)):
                own = slice(at, at + len(n))
                at += len(n)
                held = np.concatenate([held, _pieces(ids[own], known[own], tokens, n, capacity, end_id, slack)])
                held = held[np.argsort(held[:, CLASS], kind="stable")]
                full, place, _ = _places(held[:, CLASS])
                done = held[full]
                first = place[full] == 0  # each starts a bin
                before = np.cumsum(done[:, LENGTH]) - done[:, LENGTH]
                bins = np.cumsum(first)
                yield _batch(done, seq + bins - 1, before - before[first][bins - 1], task, 0)
                held, seq = held[~full], seq + int(first.sum())
        yield _batch(held, -1, 0, task, _places(held[:, CLASS])[2])

    done = written(docs.select("doc_id", "text").mapInArrow(run, PIECES), "pieces")
    full, rest = done.where("sequence_id >= 0"), done.where("sequence_id < 0")
    tasks = (rest.agg(F.max("task")).first()[0] or 0) + 1
    parts, level = [full], 1
    while True:
        groups = -(-tasks // GROUP)
        last = groups == 1
        rest = written(rest.groupBy("class_k", F.expr(f"task div {GROUP}").alias("g")).applyInPandas(_merger(level, last), PIECES), "leftovers")
        parts.append(rest.where("sequence_id >= 0"))
        rest, tasks, level = rest.where("sequence_id < 0"), groups, level + 1
        if last:
            break
    # at most k - 1 pieces of each class: bounded by the capacity, so one task may see them all
    parts.append(rest.groupBy(F.lit(0).alias("g")).applyInPandas(_first_fit(level, capacity), PIECES))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.drop("task", "seq")


def _pieces(ids, known, tokens, n, capacity: int, end_id: int, slack: float) -> np.ndarray:
    """A row of HELD for each piece of the documents, of which tokens holds n ids each."""
    ends = np.cumsum(n)
    tokens = memoryview(np.insert(tokens, ends, end_id).astype("<u4")).cast("B")
    total = n + 1
    parts = [cuts(x, capacity, slack) for x in total.tolist()]
    who = np.repeat(np.arange(len(n)), list(map(len, parts)))
    length = np.array([x for p in parts for x in p], np.int64)
    to = np.cumsum(length)
    crc = [zlib.crc32(tokens[4 * a : 4 * b]) for a, b in zip((to - length).tolist(), to.tolist())]
    start = to - length - (np.cumsum(total) - total)[who]
    return np.stack([ids[who], known[who], start, length, crc, total[who], capacity // length], axis=1)


def _places(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces sorted by class: whether each is in a full bin, its place in the bin, its number in the class."""
    _, first, count = np.unique(classes, return_index=True, return_counts=True)
    number = np.arange(len(classes)) - np.repeat(first, count)
    return number < np.repeat(count, count) // np.maximum(classes, 1) * classes, number % np.maximum(classes, 1), number


def _batch(rows: np.ndarray, sequence, offset, task: int, seq) -> pa.RecordBatch:
    c = dict(zip(HELD, rows.T))
    even = lambda v, kind=np.int64: pa.array(np.broadcast_to(np.asarray(v, kind), len(rows)))
    columns = [pa.array(c["doc_id"], mask=c["known"] == 0), *(even(c[f]) for f in HELD[2:6]), even(sequence), even(offset), even(c["class_k"], np.int32), even(task), even(seq)]
    return pa.RecordBatch.from_arrays(columns, FIELDS)


def _merger(level: int, last: bool):
    """Fill bins from the leftovers of GROUP workers of one class. Ids of a level are apart from others'."""

    def run(key, pdf):
        k, g = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["task", "seq"], ignore_index=True)
        n = len(pdf) // k * k
        place = pd.Series(range(len(pdf)))
        done = place < n
        base = (level << 56) | (k << 44) | (g << 24)
        before = pdf["length"].groupby(place // k).cumsum() - pdf["length"]
        pdf["sequence_id"] = (base + place // k).where(done, -1)
        pdf["offset"] = before.where(done, 0)
        pdf["task"], pdf["seq"] = g, place - n
        return pdf[FIELDS]

    return run


def _first_fit(level: int, capacity: int):
    def run(key, pdf):
        pdf = pdf.sort_values(["length", "class_k", "seq"], ascending=[False, True, True], ignore_index=True)
        used: list[int] = []
        sequence, offset = [], []
        for n in pdf["length"]:
            i = next((j for j, u in enumerate(used) if u + n <= capacity), len(used))
            if i == len(used):
                used.append(0)
            sequence.append((level << 56) | i)
            offset.append(used[i])
            used[i] += n
        pdf["sequence_id"], pdf["offset"] = sequence, offset
        return pdf[FIELDS]

    return run
