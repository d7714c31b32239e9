"""Connected components of a table of links, without gathering them anywhere.

Each task first reduces its links to a forest. Then, round by round, each component hooks onto its
least neighbour, pointers are followed to their end, and links are drawn between what is left; a hub's links are
split by adaptive joins, and its minimum is a partial aggregate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release, written

#: Links that a task reduces at once.
BLOCK = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its tree) for the graph of the links, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = list(range(len(nodes)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    top = np.array([find(x) for x in range(len(nodes))], np.int64)
    keep = top != np.arange(len(nodes))
    return nodes[keep], nodes[top[keep]]


def _reduced(batches):
    held, n = [], 0

    def out():
        x, y = forest(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(y), pa.array(x)], ["a", "b"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        n += batch.num_rows
        if n >= BLOCK:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def connected(links: DataFrame) -> DataFrame:
    """links (a long, b long, neither null) -> node, component: the least node reachable. One row for each
    node of a link. Loops and repeated links do no harm; no links give no rows."""
    start = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = written(start.mapInArrow(_reduced, "a long, b long").distinct(), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("component"))
    labels = written(labels, "labels")
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).union(edges.select("b", "a"))
        hook = written(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("up")), "hooks")
        while True:
            far = hook.select(F.col("node").alias("_n"), F.col("up").alias("_u"))
            jumped = written(hook.join(far, F.col("up") == F.col("_n")).select("node", F.col("_u").alias("up"), (F.col("_u") < F.col("up")).alias("moved")), "hooks")
            moved = not jumped.where("moved").isEmpty()
            release(hook)
            hook = jumped
            if not moved:
                break
        up = lambda c: hook.select(F.col("node").alias(f"_{c}"), F.col("up").alias(f"_{c}up"))
        done = labels.join(up("c"), F.col("component") == F.col("_c"), "left").select("node", F.coalesce("_cup", "component").alias("component"))
        rest = edges.join(up("a"), F.col("a") == F.col("_a")).join(up("b"), F.col("b") == F.col("_b")).where("_aup <> _bup")
        rest = rest.select(F.least("_aup", "_bup").alias("a"), F.greatest("_aup", "_bup").alias("b")).distinct()
        old = (labels, edges, hook)
        labels, edges = written(done, "labels"), written(rest, "edges")
        for t in old:
            release(t)
    return labels
