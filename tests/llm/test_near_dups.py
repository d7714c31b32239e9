"""Near-duplicates and components against brute force; the pipeline against its stages by brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import near_dups
from quarry.llm.components import connected, forest

from .conftest import prose


def sets(rows):
    out = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    return out


def brute(rows):
    s = [(i, x) for i, x in sets(rows) if i is not None]
    root = {i: i for i, _ in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(s):
        for j, y in s[:a]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in root}


def check(spark, rows, df):
    want, size = brute(rows), Counter(map(lambda x: (x[0], len(x[1])), sets(rows)))
    got = near_dups.near_duplicates(df).collect()
    assert Counter((r.doc_id, r.n_shingles) for r in got) == size
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


def test_fixture(spark, docs, none, rows):
    check(spark, rows, docs)
    assert near_dups.near_duplicates(none).collect() == []


@pytest.mark.parametrize("block", [256, 7])
def test_trees_of_copies(spark, monkeypatch, block):
    """Copies of copies, of which many pairs are just under or over the threshold, in one large bucket."""
    rng = random.Random(block)
    texts = [prose(rng, 120)]
    for i in range(150):
        w = rng.choice(texts[-40:]).split(" ")
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(9999)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 30) for _ in range(20)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    monkeypatch.setattr(near_dups, "BLOCK", block)
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(4))


def test_pruning_bounds_are_safe():
    need = near_dups.least_matches()
    rng = np.random.default_rng(0)
    hits = rng.random((20000, near_dups.HASHES)) < 0.75
    lost = np.zeros(20000, bool)
    for n, m in zip(near_dups.STEPS, need):
        lost |= hits[:, :n].sum(1) < m
    assert lost.mean() < 1e-3 and need[-1] > 0.5 * near_dups.HASHES


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    err = []
    for _ in range(60):
        both, a, b = (rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (300, 50, 50))
        x, y = near_dups.signature(np.concatenate([both, a])), near_dups.signature(np.concatenate([both, b]))
        err.append((x == y).mean() - 0.75)
    assert abs(np.mean(err)) < 0.03


def test_components(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(200)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(60)] + [(5000, 6000 + i) for i in range(300)] + [(7, 7)]
    got = {r.node: r.component for r in connected(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert got == want
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []
    x, y = forest(np.array([3, 2]), np.array([2, 1]))
    assert dict(zip(x.tolist(), y.tolist())) == {2: 1, 3: 1}


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as cp
    from quarry.llm.common import table

    rng = random.Random(8)
    texts = [prose(rng, rng.randint(40, 160)) for _ in range(200)]
    item = prose(rng, 40)
    texts += texts[:10] + [" ".join([*t.split(" ")[:-1], "changed"]) for t in texts[10:15]] + [texts[20] + " " + item, item, "too short", None, "junk### " * 60]
    rows = [(i, t, "en" if i % 2 else "fr", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = table(spark, str(tmp_path), "documents"), []
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.toPandas(), out.schema)
        left.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert set(range(200)) <= left[0] and not {217, 218, 219} & left[0]
    # languages here are noise, so what the second stage keeps is its own affair
    members = [r for r in rows if r[0] in left[1]]
    groups = brute(members)
    assert left[2] == {i for i, c in groups.items() if i == c}
    assert left[3] == left[2] - {215, 216}
    pieces = cp.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == left[3]
