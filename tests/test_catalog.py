"""Maintenance, history, sources and streams; and every registered query against its SQL."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog, history, store
from quarry.sources import listings
from quarry.streaming import events

SNAP = "id long, path string, is_dir boolean, mtime long, size long, identity string"
SCAN = SNAP.removeprefix("id long, ")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_random_scans_end_as_a_rebuild(spark):
    rng = random.Random(5)
    snap, names = spark.createDataFrame([], SNAP), [f"/r/{a}" for a in "abcd"] + [f"/r/{a}/{b}" for a in "abcd" for b in "xyz"]
    for turn in range(4):
        seen = {p: (p.count("/") == 2, rng.randrange(5), rng.randrange(5), f"o{rng.randrange(3)}" if rng.random() < 0.7 else None) for p in names if rng.random() < 0.7}
        scan = spark.createDataFrame([(p, *v) for p, v in seen.items()], SCAN)
        before = {r.path: r for r in snap.collect()}
        after = store.pruned(store.upserted(snap, scan), scan, "/r", scan.where("false"), scan.where("false"))
        got = {r.path: r for r in after.collect()}
        assert {p: (r.is_dir, r.mtime, r.size) for p, r in got.items()} == {p: v[:3] for p, v in seen.items()}
        assert len({r.id for r in got.values()}) == len(got)
        swapped = [p for p, v in seen.items() if p in before and v[3] and before[p].identity and v[3] != before[p].identity]
        for p, r in got.items():
            if p in before:
                fresh = any(p == s or p.startswith(s + "/") for s in swapped)
                assert (r.id != before[p].id) == fresh
        snap = spark.createDataFrame(list(got.values()), SNAP)


def test_delta_view_equals_rebuild(spark):
    base = spark.createDataFrame([(i, f"/a/{i}") for i in range(20)], "entry_id long, path string")
    delta, gone = spark.createDataFrame([(3, "/a/new3"), (99, "/a/99")], "entry_id long, path string"), spark.createDataFrame([(4,), (3,)], "entry_id long")
    assert rows(catalog.live(base, delta, gone)) == sorted([(i, f"/a/{i}") for i in range(20) if i not in (3, 4)] + [(3, "/a/new3"), (99, "/a/99")])
    assert catalog.must_compact(0, 4097) and not catalog.must_compact(1_000_000, 31_250)
    assert [catalog.delta_verdict(0, n) for n in (4096, 4097, 16_384, 16_385)] == ["publish", "compact later", "compact later", "rebuild"] and catalog.delta_verdict(0, 1, False) == "rebuild"


def test_move(spark):
    snap = spark.createDataFrame([(1, "/a", True, 0, 0, None), (2, "/a/x", False, 0, 0, None), (3, "/b", True, 0, 0, None), (4, "/b/y", False, 0, 0, None), (5, "/ab", False, 0, 0, None)], SNAP)
    assert [(r.id, r.path) for r in store.moved(snap, "/a", "/b").orderBy("id").collect()] == [(1, "/b"), (2, "/b/x"), (5, "/ab")]
    assert store.moved(snap, "/none", "/b").count() == 5


def test_exact_prune_and_pending(spark):
    snap = spark.createDataFrame([(i, f"/r/{i % 2}/{i}", False, 0, 0, None) for i in range(6)], SNAP)
    got = store.pruned_exactly(snap, snap.where("id < 4"), snap.where("id = 0"), spark.createDataFrame([("/r/1",)], "path string"))
    assert sorted(r.id for r in got.collect()) == [0, 1, 3, 4, 5]
    kept = snap.where("id < 3").select("id", "path")
    assert rows(store.pending(kept, spark.createDataFrame([(2,), (5,)], "id long"), snap.select("id", "path"))) == [(0, "/r/0/0"), (1, "/r/1/1"), (2, "/r/0/2"), (5, "/r/1/5")]


def test_counters_go_by_as_rows_are_written(spark):
    snap = spark.createDataFrame([(i, f"/r/{i}", False, 0, 0, None) for i in range(6)], SNAP)
    after = snap.where("id > 1").withColumn("mtime", F.when(F.col("id") == 2, 9).otherwise(0).cast("long"))
    rows_, seen = store.observed(store.changes(snap, after))
    rows_.write.format("noop").mode("overwrite").save()
    assert seen.get == {"inserted": 0, "updated": 0, "metadata": 1, "deleted": 2}


def test_usage_of_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, 100), (1, 200), (2, 50)], "target_id long, ts long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("target_id long, ts long").parquet(f"{tmp_path}/in")
    q = events.usage_stream(stream, 200).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.target_id, r.last_open) for r in spark.table("usage").collect()} == {(1, 200), (2, 50)}


def test_history(spark):
    opens = spark.createDataFrame([("a", 1, 10)], "event_id string, target_id long, ts long")
    added = spark.createDataFrame([("a", 1, 10), ("b", 1, 11), ("b", 2, 12), ("c", 9, 13)], "event_id string, target_id long, ts long")
    items = spark.createDataFrame([(1,), (2,)], "entry_id long")
    assert {r.event_id: (r.target_id, r.verdict) for r in history.recorded(opens, added, items).collect()} == {"a": (1, "repeated"), "b": (1, "accepted"), "c": (9, "missing")}
    assert history.recorded(opens, spark.createDataFrame([("a", 2, 10)], added.schema), items).first().verdict == "conflict"


def test_root_relations(spark):
    roots = spark.createDataFrame([("/",), ("/a",), ("/a/b",), ("/ab",)], "path string")
    assert [r.path for r in catalog.cover(roots).collect()] == ["/"]
    items = catalog.entries(spark.createDataFrame([(1, "/a/b/c/d.txt"), (2, "/abc"), (3, "/ab")], "i long, p string"), F.col("i"), F.col("p"))
    got = {r.entry_id: (r.root, r.c) for r in catalog.with_root(items, roots).withColumn("c", catalog.context_path(F.col("path"), F.col("root"))).collect()}
    assert got == {1: ("/a/b", "b/c/d.txt"), 2: ("/", "/abc"), 3: ("/ab", "ab")}


def test_walk(spark, tmp_path):
    (tmp_path / "d/e").mkdir(parents=True)
    (tmp_path / "d/e/f.txt").write_text("abc")
    (tmp_path / "top.txt").write_text("x")
    os.symlink(tmp_path / "d", tmp_path / "link")
    listings.register(spark)
    got = {r.path.removeprefix(str(tmp_path)): (r.is_dir, r.size if not r.is_dir else None, r.unreadable) for r in spark.read.format("walk").option("root", str(tmp_path)).load().collect()}
    assert set(got) == {"", "/d", "/d/e", "/d/e/f.txt", "/top.txt", "/link"} and got["/d/e/f.txt"] == (False, 3, False) and not got["/link"][0]
    kids = spark.read.format("walk").option("root", str(tmp_path)).option("scope", "children").load()
    assert {r.path.removeprefix(str(tmp_path)) for r in kids.collect()} == {"", "/d", "/top.txt", "/link"}


def test_text_sources(spark):
    files = [("a.desktop", 0, "[Desktop Entry]\nName=A\nHidden=true\n"), ("a.desktop", 1, "[Desktop Entry]\nName=Shown\n"), ("b.desktop", 1, "[Desktop Entry]\nName=B\nOnlyShowIn=GNOME;\nKeywords=x;y;\n"), ("c.desktop", 1, "[Desktop Entry]\nName=C\nNotShowIn=KDE;\n")]
    apps = listings.desktop_entries(spark.createDataFrame(files, "desktop_id string, precedence int, content string"))
    assert {r.name for r in apps.collect()} == {"B", "C"}
    assert {r.name for r in listings.visible(apps, ["KDE"]).collect()} == set() and {r.name for r in listings.visible(apps, ["GNOME", "KDE"]).collect()} == {"B"}
    old = listings.mounts(spark.createDataFrame([("1 0 8:1 / / rw - ext4 /dev/a rw",), ("2 1 0:5 / /home/u\\040x rw shared:1 - nfs4 s rw",), ("bad",)], "value string"))
    assert {(r.mount_point, r.reliable) for r in old.collect()} == {("/", True), ("/home/u x", False)}
    roots = spark.createDataFrame([("/home",)], "path string")
    assert [r.mount_point for r in listings.mounts_changed(old, old.where("mount_id = 1"), roots).collect()] == ["/home/u x"]
    lines = spark.createDataFrame([('{"op": "query", "request_id": 1, "query": "x"}',), ('{"op": "query", "op": "x"}',), ('{"what": 1}',), ("not json",), ('{"op": "q", "query": "%s"}' % ("y" * 257),)], "value string")
    assert [r.valid for r in listings.requests(lines).collect()] == [True, False, False, False, False]
    res = spark.createDataFrame([(1, 1, 5, "/a", 9), (1, 2, 4, "/b", 8)], "query_id int, rank int, entry_id long, path string, score int")
    assert listings.responses(res).first().value == '{"request_id":"1","count":2,"results":[{"id":"5","path":"/a","score":9},{"id":"4","path":"/b","score":8}]}'


def test_model_files(spark, tmp_path):
    import hashlib
    import struct

    import numpy as np

    from quarry.sources import models

    words = b"a\0bc\0"
    payload = struct.pack("<3I", 0, 2, 5) + words + np.arange(6, dtype="<f4").tobytes()
    head = (b"MAGIC_01" + struct.pack("<3I", 2, 3, len(words))).ljust(models.DIGEST, b"\0") + hashlib.sha256(payload).digest()
    (tmp_path / "m.bin").write_bytes(head + payload)
    got = models.vocabulary(spark, f"file://{tmp_path}/m.bin", b"MAGIC_01").orderBy("token_id").collect()
    assert [(r.token, r.v) for r in got] == [("a", [0, 1, 2]), ("bc", [3, 4, 5])]
    for bad in (head[:-1] + b"x" + payload, b"x" + head[1:] + payload, head + payload + b"0"):
        with pytest.raises(ValueError):
            models.parsed(bad, b"MAGIC_01")


def test_roots_generations_and_embeddings(spark):
    snap = spark.createDataFrame([(1, "/a", True, 0, 0, None), (2, "/a/x", False, 0, 0, None), (3, "/b", True, 0, 0, None)], SNAP)
    roots = spark.createDataFrame([("/a",), ("/b",)], "path string")
    left, still = store.forgotten(snap, roots, snap.where("false").select("path"), "/a")
    assert [r.id for r in left.collect()] == [3] and [r.path for r in still.collect()] == ["/b"]
    assert store.published(snap, snap, 7) == (7, False, False)
    assert store.published(snap, snap.withColumn("mtime", F.lit(9).cast("long")), 7) == (8, True, False)
    assert store.published(snap, left, 7) == (8, True, True)
    models, cache = spark.createDataFrame([(1,), (2,)], "emb_gen int"), spark.createDataFrame([(1, "a"), (2, "a"), (2, "b")], "emb_gen int, text string")
    m, c = store.activated(models, cache, spark.createDataFrame([("a",), ("a",)], "text string"), 2)
    assert rows(m) == [(2,)] and [(r.emb_gen, r.text) for r in c.collect()] == [(2, "a")]


EVENTS = [(1, "2024-01-01 00:00:00.000", "moved_from", "/r/a", 7, False), (2, "2024-01-01 00:00:00.010", "moved_to", "/r/b", 7, False), (3, "2024-01-01 00:00:00.050", "create", "/r/d", None, True), (4, "2024-01-01 00:00:01.000", "attrib", "/r/d/f", None, False)]


def frame(spark):
    return spark.createDataFrame(EVENTS, events.SCHEMA.replace("ts timestamp", "ts string")).withColumn("ts", F.to_timestamp("ts"))


def test_scopes(spark):
    ev = frame(spark)
    assert rows(events.renames(ev)) == [(7, "/r/a", "/r/b", False)]
    found = events.scopes(ev)
    assert rows(found) == [("/r", False), ("/r/d", True)]
    nested = found.union(spark.createDataFrame([("/r/d/deep", False)], "scope string, recursive boolean"))
    assert rows(events.outermost(nested)) == [("/r", False), ("/r/d", True)]
    assert not events.full_pass(ev, found).first()["full"] and events.full_pass(ev.withColumn("kind", F.lit("overflow")), found).first()["full"]


def test_streams(spark, tmp_path):
    frame(spark).withColumn("root", F.lit("/r")).write.parquet(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = events.renames(read()).writeStream.format("memory").queryName("renames").trigger(availableNow=True).start()
    q.awaitTermination()
    assert rows(spark.table("renames")) == [(7, "/r/a", "/r/b", False)]
    out = []
    events.reconciled(read(), lambda r, s, w, i: out.append((rows(r), rows(s), w)), f"{tmp_path}/c").awaitTermination()
    assert out == [([(7, "/r/a", "/r/b", False)], [("/r", False), ("/r/d", True)], False)]
    assert [r.n_events for r in events.debounced(frame(spark).withColumn("root", F.lit("/r"))).orderBy("batch_start").collect()] == [3, 1]


def test_debounce_cuts_long_batches_and_lets_go_of_the_last(spark, tmp_path):
    import time

    rows_ = [("/r", 60 * i, f"/r/{i % 3}") for i in range(40)] + [("/r", 9000, "/r/x")] + [("/many", i // 100, f"/many/{i}") for i in range(600)]
    spark.createDataFrame(rows_, "root string, ms long, scope string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("root string, ms long, scope string").parquet(f"{tmp_path}/in")
    q = events.debounce_stream(stream).writeStream.format("memory").queryName("batches").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="100 milliseconds").start()
    try:
        for _ in range(120):
            got = spark.table("batches").orderBy("root", "batch_start").collect()
            if sum(r.n_events for r in got) == 641:
                break
            time.sleep(0.5)
    finally:
        q.stop()
    assert sum(r.n_events for r in got if r.root == "/r") == 41 and all(r.batch_end - r.batch_start <= events.LONGEST_MS for r in got)
    assert [r.n_scopes for r in got if r.root == "/r"] == [3, 3, 3, 1]
    assert [r.n_scopes for r in got if r.root == "/many"] == [events.SCOPES_NOW, 600 - events.SCOPES_NOW]


def test_passes():
    p = events.Passes(100, 1000, 100, 1000)
    assert p.at(50)[0] == "none"
    kind, after = p.at(120)
    assert kind == "repair" and after.at(150)[0] == "none" and after.at(1000)[0] == "full"
    assert p.request().at(1)[0] == "full" and p.request().at(1)[1].at(2)[0] == "none"


def test_generations(spark, tmp_path):
    path = f"file://{tmp_path}/catalog"
    with pytest.raises(ValueError):
        store.load(spark, path, ["files"])
    for g in (1, 2, 3):
        store.commit({"files": spark.range(g), "roots": spark.range(1)}, path, g)
    os.makedirs(f"{tmp_path}/catalog/gen={4:020d}/files")  # half written: not there
    assert store.generations(spark, path) == [1, 2, 3]
    g, tables = store.load(spark, path, ["files", "roots"])
    held = store.load(spark, path, ["files"], 1)[1]["files"]
    assert (g, tables["files"].count(), tables["roots"].count()) == (3, 3, 1)
    assert store.vacuum(spark, path, {1}) == [2] and held.count() == 1 and store.generations(spark, path) == [1, 3]


def test_newer_requests_end_older_ones(spark):
    import threading
    import time

    from quarry.plans.control import Requests

    r, out = Requests(spark), {}

    def slow():
        try:
            out["old"] = r.run("c", 1, lambda: spark.range(4).mapInPandas(lambda it: (time.sleep(60) or p for p in it), "id long").count())
        except Exception as e:
            out["old"] = type(e).__name__

    t = threading.Thread(target=slow)
    t.start()
    time.sleep(5)
    assert r.run("c", 2, lambda: spark.range(5).count()) == 5 and r.run("c", 1, lambda: 1 / 0) is None
    t.join(40)
    assert not t.is_alive() and isinstance(out["old"], str)


def test_walk_leaves_out_what_it_should(spark, tmp_path):
    for p in ("keep/a", ".hidden/x/y", "node_modules/z", "venv/lib", "build/sub/deep", "cached", "gone/b"):
        (tmp_path / p).mkdir(parents=True)
    for p in ("keep/a/f.txt", ".hidden/x/y/f", ".hidden/x/g", "node_modules/z/f", "venv/pyvenv.cfg", "venv/lib/f", "build/sub/deep/f", "build/f", "gone/b/f"):
        (tmp_path / p).write_text("x")
    (tmp_path / "cached/CACHEDIR.TAG").write_text("Signature: 8a477f597d28d172789f06886806bc55\n")
    listings.register(spark)
    import json

    top = str(tmp_path)
    walk = lambda **o: {r.path.removeprefix(top) for r in spark.read.format("walk").options(root=top, **o).load().collect()}
    assert walk() == {"", "/keep", "/keep/a", "/keep/a/f.txt", "/gone", "/gone/b", "/gone/b/f"}
    assert walk(exclude=json.dumps([f"{top}/gone"]), allow=json.dumps([f"{top}/.hidden/x/y", f"{top}/build"])) == {"", "/keep", "/keep/a", "/keep/a/f.txt", "/.hidden/x/y", "/.hidden/x/y/f", "/build", "/build/f", "/build/sub", "/build/sub/deep", "/build/sub/deep/f"}
    row = spark.read.format("walk").option("root", top).load().where("path LIKE '%/f.txt'").select(store.identity_parts(F.col("identity")).alias("p")).first().p
    s = os.lstat(tmp_path / "keep/a/f.txt")
    assert (row.kind, row.device, row.inode, row.sec, row.nsec) == (0, s.st_dev, s.st_ino, s.st_ctime_ns // 10**9, s.st_ctime_ns % 10**9)
    lost = spark.read.format("walk").option("root", f"{top}/nothing").load().collect()
    assert [r.unreadable for r in lost] == [True]


def test_desktop_folders_and_sinks(spark, tmp_path):
    (tmp_path / "u/kde").mkdir(parents=True)
    (tmp_path / "s").mkdir()
    (tmp_path / "u/a.desktop").write_text("[Desktop Entry]\nName=User\n")
    (tmp_path / "u/kde/b.desktop").write_text("[Desktop Entry]\nName=B\n")
    (tmp_path / "s/a.desktop").write_text("[Desktop Entry]\nName=System\n")
    (tmp_path / "s/big.desktop").write_text("[Desktop Entry]\nName=Big\n" + "x" * (64 << 10))
    found = listings.desktop_files(spark, [f"file://{tmp_path}/u", f"file://{tmp_path}/s"])
    assert {(r.desktop_id, r.name) for r in listings.desktop_entries(found).collect()} == {("a.desktop", "User"), ("kde-b.desktop", "B")}
    res = spark.createDataFrame([(1, 2, 7, "/b\n", 5), (1, 1, 8, "/a", 6)], "query_id int, rank int, entry_id long, path string, score int")
    listings.write_lines(res, f"file://{tmp_path}/lines")
    listings.write_raw(res, f"file://{tmp_path}/raw")
    listings.write_json(res, f"file://{tmp_path}/json")
    text = lambda d: "".join(p.read_text() for p in sorted((tmp_path / d).glob("part-*")))
    assert text("lines") == "/a\n/b\\x0A\n" and text("raw") == "/a\0/b\n\0" and text("json").startswith('{"request_id":"1","count":2')


def test_watch_logs_as_a_stream(spark, tmp_path):
    from quarry.sources import watch

    (tmp_path / "log").mkdir()
    (tmp_path / "log/1").write_text('{"seq":1,"ms":5,"mask":1073742080,"path":"/r/d","cookie":0}\n{"seq":2,"ms":6,"mask":16384}\nbad\n')
    q = watch.stream(spark, f"file://{tmp_path}/log").writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.seq, r.kind, r.is_dir) for r in spark.table("watched").orderBy("seq").collect()] == [(1, "create", True), (2, "overflow", False)]


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_queries_equal_their_sql(spark):
    import duckdb
    import pandas as pd

    from quarry import service_queries as cq

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")

    def cell(x):
        return "" if x is None or pd.isna(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) else f"{float(x):.6g}" if type(x).__module__ == "numpy" and x.dtype.kind in "iufb" else str(x)

    for name, sql in cq.ORACLE_SQL.items():
        a, b = cq.QUERIES[name](spark, SF).toPandas(), con.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns), name
        left, right = (sorted(tuple(map(cell, r)) for r in x[sorted(x.columns)].astype(object).itertuples(index=False)) for x in (a, b))
        assert left == right, name


@pytest.fixture(scope="module")
def asked_path(spark, tmp_path_factory):
    """Tables in which two parts lie at the path that is asked, and others near it; their folder."""
    d = str(tmp_path_factory.mktemp("parts"))
    rows = [(0, "red rod", 7, 7), (1, "red rod", 7, 7), *[(i, "red rod", 7 + 10 * (i % 2), 17 - 10 * (i % 2)) for i in range(2, 9)], *[(i, "blue widget", i, i) for i in range(9, 14)]]
    spark.createDataFrame([(i, n, f"Brand#{b}", "PROMO", s) for i, n, b, s in rows], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{d}/part.parquet")
    spark.range(40).selectExpr("id AS event_id", "timestamp_seconds(1706600000 + id) AS ts", "if(id % 2 = 0, 'click', 'buy') AS event_type").write.parquet(f"{d}/events.parquet")
    return d


@pytest.mark.parametrize("name", ["lex_search_full", "search_boosted", "lex_search_staged"])
def test_searches_equal_their_sql_where_a_path_is_asked(spark, asked_path, name):
    import duckdb

    from quarry import service_queries as cq

    con = duckdb.connect()
    for t in ("part", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{asked_path}/{t}.parquet/*.parquet'")
    found = cq.QUERIES[name](spark, asked_path)
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({cq.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert sum(r[0] == 13 and r[3] >= 20_000_000 for r in want) == 4


def test_entry_without_the_corpus_operators(spark, monkeypatch):
    import builtins
    import sys

    import __spark_entry__ as entry

    real = builtins.__import__

    def hidden(name, *args, **kw):
        if name == "corpus_pipeline" or name.startswith("quarry.llm"):
            raise ImportError(name)
        return real(name, *args, **kw)

    for m in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("quarry.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.setattr(builtins, "__import__", hidden)
    assert not any(n.startswith("op") and n[2].isdigit() for n in entry.queries()) and entry.entry(spark).columns
