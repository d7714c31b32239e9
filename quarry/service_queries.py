"""Registered queries of what stands around retrieval: segments, boosts, software, the semantic stage, versions of a catalog, sources and
control; and the SQL that each must equal. Tables as in catalog_queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.catalog_queries import (
    ASKED, EV, FILES, FULL, GRAMS, ITEMS, KEYS, MIXED, NEED, NOW, OPENS, PARTS, PLAIN, PREFIX, RES, SAVED, TERMS, TOKENS, TOTALS, TYPO, UPS,
    _aligned, _asked, _boosts, _events, _final, _mixed, _results, _roots, _saved, _symbols, _t, _tok, _values, _words, ROOTS, files, opens, parts, placed, query, ORACLE_SQL, QUERIES,  # noqa: F401
)
from quarry.functions import scalars, sqlext
from quarry.functions import text as T
from quarry.operators import catalog, channels, evaluation, history, merge, search, segments, semantic, software, store, usage
from quarry.sources import listings, watch
from quarry.streaming import events as stream

# --- segments and boosts -----------------------------------------------------------------------------------

#: The live view: a delta renames each tenth part, another tenth is gone; frequent grams are the base's.
LIVE = PARTS.replace("parts AS", "base AS") + """, parts AS (SELECT entry_id, regexp_replace(path, '/([^/]*)$', '/New\\1') AS path, 'New' || name AS name, 'new' || norm AS norm FROM base WHERE entry_id % 10 = 5
  UNION ALL SELECT entry_id, path, name, norm FROM base WHERE entry_id % 10 NOT IN (3, 5))"""
BASE_GRAMS = GRAMS.replace("freq AS (SELECT gram FROM grams GROUP BY ALL HAVING count(*) > greatest(64, (SELECT count(*) FROM parts) // 8))", "freq AS (SELECT gram FROM (SELECT DISTINCT entry_id, unnest(list_transform(range(1, length(norm) - 1), lambda i: substr(norm, i, 3))) AS gram FROM base WHERE length(norm) >= 3) GROUP BY ALL HAVING count(*) > greatest(64, (SELECT count(*) FROM base) // 8))")
SUB = "sub AS (SELECT query_id, pos, entry_id, s + 1500 AS score FROM plain JOIN al USING (word) JOIN parts USING (norm))"
SYM = _symbols("sym", "parts", "name", "norm")


def _plain_search(asked) -> str:
    """The CTEs of a search by all channels of names, but for paths; hits not yet united."""
    longest = max(len(w) for _, t in asked for w in t.split())
    return f"{TOKENS}, {KEYS}, {TERMS}, {_words(asked)}, {PLAIN}, {PREFIX.replace('hits AS', 'pre AS')}, {TYPO}, {GRAMS}, {SYM}, {_aligned('al', 'plain', 'sym', longest)}, {SUB}"


SHORT = [a for a in ASKED if "/" not in a[1]]


@query(f"WITH {LIVE}, {_plain_search(SHORT).replace(GRAMS, BASE_GRAMS)}, hits AS (SELECT * FROM pre UNION ALL SELECT * FROM typos UNION ALL SELECT * FROM tri UNION ALL SELECT * FROM sub), {NEED}, {TOTALS} {_final(10).replace(_values(ASKED), _values(SHORT))}")
def search_segments(spark, d):
    p = parts(spark, d).select("entry_id", "path")
    entries = lambda df: catalog.entries(df, F.col("entry_id"), F.col("path"))
    base = segments.build(entries(p))
    delta = segments.build(entries(p.where("entry_id % 10 = 5").withColumn("path", F.regexp_replace("path", "/([^/]*)$", "/New$1"))), frequent=base.frequent)
    return search.search(_asked(spark, SHORT), segments.merged(base, delta, p.where("entry_id % 10 = 3")))


BOOSTED = _final(10).replace("END AS BIGINT) AS score\n", "END AS BIGINT) + CAST(coalesce(b, 0) AS BIGINT) AS score, CAST(coalesce(b, 0) AS BIGINT) AS boost\n").replace("SELECT query_id, entry_id, path, score, row_number()", "SELECT query_id, entry_id, path, score, boost, row_number()").replace(
    "JOIN parts USING (entry_id) JOIN", "JOIN parts USING (entry_id) LEFT JOIN (SELECT q.query_id, x.entry_id, sum(x.boost) AS b FROM " + _values(ASKED) + " JOIN boosts x ON x.query_id IS NULL OR x.query_id = q.query_id GROUP BY ALL) USING (query_id, entry_id) JOIN")


@query(f"WITH {OPENS}, {ITEMS}, {_boosts(ASKED)}, {FULL} {BOOSTED}")
def search_boosted(spark, d):
    items, roots = placed(spark, d)
    asked = _asked(spark)
    return search.search(asked, items, True, boosts=usage.boosts(asked, opens(spark, d), NOW), roots=roots, apart=True)  # as lex_search_full


@query(f"WITH {FILES}, roots AS (SELECT path FROM files WHERE entry_id % 25 = 0) SELECT * FROM (SELECT query_id, entry_id, path, 1::BIGINT AS score, row_number() OVER (PARTITION BY query_id ORDER BY path, entry_id) AS rank FROM (SELECT unnest([1, 2]) AS query_id), files WHERE path IN (SELECT path FROM roots)) WHERE rank <= 1000")
def search_empty(spark, d):
    f = files(spark, d)
    return search.search(_asked(spark, [(1, ""), (2, " \t")]), f, roots=f.where("entry_id % 25 = 0").select("path"), limit=1000)


@query(f"WITH {FILES}, {UPS}, {ROOTS}, f AS (SELECT DISTINCT folder FROM ups) SELECT folder FROM f WHERE NOT EXISTS (SELECT 1 FROM roots r WHERE starts_with(r.path, f.folder || '/')) OR EXISTS (SELECT 1 FROM roots r WHERE f.folder = r.path OR starts_with(f.folder, r.path || '/'))")
def usable_folders(spark, d):
    return catalog.usable_folders(catalog.folders(files(spark, d)).select("folder"), _roots(spark, d))


@query(f"WITH {FILES}, {ROOTS} SELECT f.entry_id, count(r.path) AS n_roots FROM files f LEFT JOIN roots r ON f.path = r.path OR starts_with(f.path, r.path || '/') GROUP BY ALL")
def path_within(spark, d):
    met = files(spark, d).select("entry_id", "path").join(F.broadcast(_roots(spark, d).withColumnRenamed("path", "r")), catalog.within(F.col("path"), F.col("r")), "left")
    return met.groupBy("entry_id").agg(F.count("r").alias("n_roots"))


@query(f"WITH {FILES} SELECT entry_id, CASE WHEN len(p) <= 2 THEN '/' || array_to_string(p, '/') ELSE '…/' || array_to_string(p[-2:], '/') END AS shown FROM (SELECT entry_id, list_filter(string_split(regexp_replace(path, '/[^/]*$', ''), '/'), lambda x: x <> '') AS p FROM files)")
def path_short_parent(spark, d):
    return files(spark, d).select("entry_id", scalars.short_parent(F.col("path")).alias("shown"))


# --- software ----------------------------------------------------------------------------------------------


def _software(spark, d):
    """Parts as software: name, app_id and summary from their names, brands and types."""
    ref = F.struct(F.lit("system").alias("installation"), F.concat(F.lit("r"), (F.col("p_partkey") % 3).cast("string")).alias("remote"), F.concat(F.lit("org."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit(".App"), F.col("p_partkey").cast("string")).alias("app_id"), F.lit("x86_64").alias("arch"), F.lit("stable").alias("branch"))
    p = _t(spark, d, "part")
    return p.select(F.col("p_partkey").alias("entry_id"), ref.alias("ref"), F.col("p_name").alias("name"), F.col("p_type").alias("summary"), (F.col("p_partkey") * 3).cast("long").alias("source_revision"), (F.col("p_partkey") * 7).cast("long").alias("revision"))


SOFTWARE = "soft AS (SELECT p_partkey AS entry_id, 'r' || p_partkey % 3 AS remote, 'org.' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '.App' || p_partkey AS app_id, p_name AS name, p_type AS summary FROM part)"
SOFT_ASKED = [(1, "red wid"), (2, "promo"), (3, "org app12"), (4, "gizmo"), (5, "blu hot"), (6, "widgte")]
SOFT_FIELDS = f"""f AS (SELECT entry_id, 2800 AS w, app_id AS text FROM soft UNION ALL SELECT entry_id, 2600, summary FROM soft WHERE summary <> ''),
  ft AS (SELECT entry_id, w, lower(text) AS norm, list_transform({_tok('text')}, lambda t: lower(t)) AS t FROM f),
  k AS (SELECT entry_id, w, norm AS key, 0 AS complete FROM ft UNION ALL SELECT entry_id, w, unnest(t), 128 FROM ft UNION ALL SELECT entry_id, w, array_to_string(list_transform(t, lambda x: x[1]), ''), 0 FROM ft),
  {_symbols('fsym', 'f', 'text', 'lower(text)')}, {_aligned('fal', 'words', 'fsym', 6)},
  field AS (SELECT query_id, pos, entry_id, w + CASE WHEN key = word THEN complete ELSE 0 END AS score FROM words JOIN k ON starts_with(key, word) UNION ALL SELECT query_id, pos, entry_id, s FROM words JOIN fal USING (word) JOIN ft USING (norm))"""


@query(f"WITH {SOFTWARE}, parts AS (SELECT entry_id, '/software/' || name AS path, name, lower(name) AS norm FROM soft), {_plain_search(SOFT_ASKED)}, {SOFT_FIELDS}, hits AS (SELECT * FROM pre UNION ALL SELECT * FROM typos UNION ALL SELECT * FROM tri UNION ALL SELECT * FROM sub UNION ALL SELECT * FROM field), {NEED}, {TOTALS} {_final(10).replace(_values(ASKED), _values(SOFT_ASKED))}")
def software_search(spark, d):
    return software.searched(_asked(spark, SOFT_ASKED), _software(spark, d).withColumn("ref", F.col("ref")))


GATED = [a for a in ASKED if not set(a[1]) & set("/\\:.@")]


@query(f"""WITH {PARTS}, {TOKENS}, {KEYS}, {_words(GATED)}, {PREFIX}, {NEED}, {TOTALS}, top AS (SELECT * FROM ({_final(64).replace(_values(ASKED), _values(GATED))})), p AS (SELECT top.*, 'org.parts.' || split_part(norm, '_', 1) AS app_id FROM top JOIN parts USING (entry_id)),
  o AS (SELECT query_id, app_id, entry_id, path, score, row_number() OVER (PARTITION BY query_id, app_id ORDER BY score DESC, path, entry_id) AS n FROM p WHERE app_id NOT IN (SELECT 'org.parts.' || split_part(norm, '_', 1) FROM parts WHERE entry_id % 900 = 0))
  SELECT * FROM (SELECT query_id, app_id, entry_id, path, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, entry_id) AS rank FROM o WHERE n = 1) WHERE rank <= 3""")
def software_suggest(spark, d):
    p = parts(spark, d).withColumn("app_id", F.concat(F.lit("org.parts."), F.split("norm", "_")[0]))
    return software.suggestions(_asked(spark), p, p.where("entry_id % 900 = 0"))


@query(f"WITH {SOFTWARE}, i AS (SELECT remote, app_id FROM soft WHERE entry_id % 4 = 1 AND entry_id % 3 <> 2) SELECT entry_id, (remote, app_id) IN (SELECT (remote, app_id) FROM i) AS installed FROM soft")
def software_installed(spark, d):
    s = _software(spark, d)
    lines = s.where("entry_id % 4 = 1").select(F.concat(F.when(F.col("entry_id") % 3 == 2, "elsewhere").otherwise(F.col("ref.remote")), F.lit("\tapp/"), "ref.app_id", F.lit("/x86_64/stable")).alias("value"))
    return software.with_installed(s, software.installed_list(lines)).select("entry_id", "installed")


@query(f"""WITH {SOFTWARE}, t AS (SELECT entry_id, '{{"kind":"software","backend":"flatpak","installation":"system","remote":"' || remote || '","app_id":"' || app_id || '","arch":"x86_64","branch":"stable","revision":"' || entry_id * 7 || '","source_revision":"' || entry_id * 3 || '"}}' AS target FROM soft)
  SELECT entry_id, target, app_id, CASE WHEN entry_id % 5 > 1 THEN entry_id * 7 END AS revision, CASE WHEN entry_id % 5 > 1 THEN 'live' WHEN entry_id % 5 = 1 THEN 'bad' ELSE 'stale' END AS state FROM t JOIN soft USING (entry_id)""")
def software_target(spark, d):
    s = _software(spark, d)
    t = s.select("entry_id", "ref", software.target(F.col("ref"), F.col("revision"), F.col("source_revision")).alias("target"))
    # of each five: one names a member that no target has, one an older revision
    sent = F.when(F.col("entry_id") % 5 == 1, F.replace("target", F.lit('"arch"'), F.lit('"other"'))).when(F.col("entry_id") % 5 == 0, F.regexp_replace("target", '"revision":"[0-9]+"', '"revision":"1"')).otherwise(F.col("target"))
    got = t.select("entry_id", "target", F.col("ref.app_id").alias("app_id"), software.target_parts(sent).alias("p"))
    state = software.resolved(got.where("p IS NOT NULL").select("entry_id", "p.*"), s.select("ref", "revision", "source_revision")).select("entry_id", "state", F.when(F.col("state") == "live", F.col("revision")).alias("revision"))
    return got.join(state, "entry_id", "left").select("entry_id", "target", "app_id", "revision", F.coalesce("state", F.lit("bad")).alias("state"))


@query(f"""WITH {MIXED}, o AS (SELECT query_id, entry_id, score FROM m WHERE entry_id % 53 = 0 OR entry_id % 10 = 4), l AS (SELECT DISTINCT query_id FROM m WHERE entry_id % 10 = 7 AND (score >= 9999744 OR (kind = 'app' AND evidence >= 2)))
  SELECT query_id, entry_id, (max(score) OVER (PARTITION BY query_id) >= 9999744) AND query_id NOT IN (SELECT query_id FROM l) AS preferred FROM o""")
def software_preferred(spark, d):
    m = _mixed(spark, d)
    local = merge.tiered(m.where("entry_id % 10 = 7"), 1 << 30)
    return software.with_preferred(m.where("entry_id % 53 = 0 OR entry_id % 10 = 4"), local).select("query_id", "entry_id", "preferred")


APP_ASKED = [(1, "red"), (2, "widget promo"), (3, "br hot"), (4, "brand 7"), (5, "rw"), (6, "promo")]
APP_FIELDS = SOFT_FIELDS.replace("app_id AS text FROM soft UNION ALL SELECT entry_id, 2600, summary FROM soft WHERE summary <> ''", "p_brand AS text FROM parts UNION ALL SELECT entry_id, 2600, p_type FROM parts")


@query(f"""WITH parts AS (SELECT p_partkey AS entry_id, '/apps/' || p_name AS path, p_name AS name, lower(p_name) AS norm, p_brand, p_type FROM part), {_plain_search(APP_ASKED)}, {APP_FIELDS},
  hits AS (SELECT query_id, pos, entry_id, score + 2000 AS score FROM pre UNION ALL SELECT * FROM typos UNION ALL SELECT * FROM tri UNION ALL SELECT * FROM sub UNION ALL SELECT * FROM field), {NEED}, {TOTALS} {_final(20).replace(_values(ASKED), _values(APP_ASKED))}""")
def app_search(spark, d):
    p = _t(spark, d, "part")
    apps = catalog.entries(p, F.col("p_partkey"), scalars.label_key(F.col("p_name")))
    fields = p.select(F.col("p_partkey").alias("entry_id"), F.lit("generic").alias("kind"), F.col("p_brand").alias("text")).union(p.select("p_partkey", F.lit("keyword"), "p_type"))
    return merge.searched_apps(_asked(spark, APP_ASKED), apps, fields, limit=20).drop("evidence")


@query("SELECT p_partkey AS entry_id, p_partkey % 7 AS revision, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN p_name END AS path, CASE WHEN p_partkey % 3 > 0 AND p_partkey % 5 > 0 THEN 'live' ELSE 'stale' END AS state FROM part")
def app_resolve(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), (F.col("p_partkey") % 7).alias("revision"), F.col("p_name").alias("path"))
    now = p.where("entry_id % 5 > 0").withColumn("revision", F.col("revision") + F.when(F.col("entry_id") % 3 == 0, 1).otherwise(0))
    return catalog.resolved_revision(p.select("entry_id", "revision"), now)


# --- the semantic stage ------------------------------------------------------------------------------------


@query("SELECT page_id, octet_length(encode(t)) >= 3 AND NOT contains(t, '/') AS eligible FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'ab' WHEN 1 THEN url WHEN 2 THEN 'é!' ELSE 'three words here' END AS t FROM pages)")
def semantic_eligible(spark, d):
    t = F.when(F.col("page_id") % 4 == 0, "ab").when(F.col("page_id") % 4 == 1, F.col("url")).when(F.col("page_id") % 4 == 2, "é!").otherwise("three words here")
    return _t(spark, d, "pages").select("page_id", semantic.eligible(t).alias("eligible"))


@query("SELECT p_partkey AS id, p_name || ' ' || p_brand || ' ' || p_type || ' more' AS text FROM part")
def semantic_desktop_text(spark, d):
    apps = _t(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), F.lit("").alias("path"), F.col("p_name").alias("name"), F.col("p_brand").alias("generic_name"), F.array("p_type", F.lit("more")).alias("keywords"), F.lit(0).cast("long").alias("revision"))
    return semantic.desktop_rows(apps).select("id", "text")


@query("""WITH v AS (SELECT vec_id AS id, vec_id % 3 = 0 AS owned, label AS h FROM embeddings WHERE vec_id % 7 > 0), t AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 2 = 0), f AS (SELECT vec_id AS id, CASE WHEN vec_id % 4 = 0 THEN label ELSE label + 100 END AS h, CASE WHEN vec_id % 8 = 0 THEN 'new' ELSE 'p' END AS path FROM embeddings WHERE vec_id % 11 > 0)
  SELECT * FROM (SELECT coalesce(v.id, t.id) AS id, CASE WHEN t.id IS NULL THEN CASE WHEN owned THEN 'carry' END WHEN f.id IS NULL THEN 'hide' WHEN NOT coalesce(owned, false) AND v.h = f.h AND f.path = 'p' THEN 'keep' WHEN v.h = f.h THEN 'copy' ELSE 'embed' END AS action
    FROM v FULL JOIN t USING (id) LEFT JOIN f ON f.id = coalesce(v.id, t.id)) WHERE action IS NOT NULL""")
def semantic_stage(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("text_hash"), F.lit("p").alias("path"), F.lit(False).alias("is_dir"), F.lit(0).alias("revision"))
    view = e.where("id % 7 > 0").withColumn("owned", F.col("id") % 3 == 0)
    fresh = e.where("id % 11 > 0").withColumn("text_hash", F.when(F.col("id") % 4 == 0, F.col("text_hash")).otherwise(F.col("text_hash") + 100)).withColumn("path", F.when(F.col("id") % 8 == 0, "new").otherwise("p"))
    return semantic.staged(view, e.where("id % 2 = 0"), fresh)


@query("""WITH e AS (SELECT vec_id AS id, label AS h, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT h, arg_min(v, id) AS v FROM e WHERE h < 5 GROUP BY ALL),
  m AS (SELECT s.h, (a.v[1] + b.v[1]) / 2 AS x FROM (SELECT DISTINCT h FROM e WHERE h >= 5) s JOIN e a ON a.id = s.h JOIN e b ON b.id = s.h + 1)
  SELECT e.id, round(coalesce(c.v[1], m.x), 6) AS x FROM e LEFT JOIN c USING (h) LEFT JOIN m USING (h)""")
def semantic_vectors(spark, d):
    e = _t(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("text_hash"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    cache = e.where("text_hash < 5").groupBy("text_hash").agg(F.min_by("v", "id").alias("v"))
    rows = e.select("id", "text_hash", F.concat(F.col("text_hash").cast("string"), F.lit(" "), (F.col("text_hash") + 1).cast("string")).alias("text"))
    found = semantic.with_vectors(rows, cache, e.select(F.col("id").cast("string").alias("token"), "v"), lambda t: F.split(t, " "))
    return found.select("id", F.round(F.element_at("v", 1), 6).alias("x"))


@query("""WITH q AS (SELECT DISTINCT o_custkey AS query_id FROM orders), s AS (SELECT query_id, CASE WHEN query_id % 5 = 0 THEN 'lexical' WHEN query_id % 3 = 0 THEN 'semantic_deadline' ELSE 'fused' END AS answer FROM q WHERE query_id % 7 > 0),
  a AS (SELECT o_custkey AS query_id, o_orderkey AS id, 'p' || o_orderkey AS path, 0 AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders), b AS (SELECT o_custkey AS query_id, o_orderkey AS id, 'p' || o_orderkey AS path, 0 AS priority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rank FROM orders WHERE o_orderkey % 2 = 0),
  f AS (SELECT a.query_id, a.id, a.path, a.rank AS lr, b.rank AS sr, answer, 1.0 / (60 + a.rank) + coalesce(1.0 / (60 + b.rank), 0) AS score FROM a JOIN s USING (query_id) LEFT JOIN b ON b.query_id = a.query_id AND b.id = a.id AND answer = 'fused'), l AS (SELECT *, max(sr) OVER (PARTITION BY query_id) IS NULL AS lone FROM f)
  SELECT query_id, id, answer, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN lone THEN 0 ELSE round(score, 12) END DESC, lr, path, id) AS rank FROM l""")
def semantic_answer(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(0).alias("priority"))
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by)))
    q = o.select("query_id").distinct().select("query_id", F.when(F.col("query_id") % 5 == 0, "ab").otherwise("some words").alias("text"), F.when(F.col("query_id") % 3 == 0, 900).otherwise(20).alias("took_ms"), (F.col("query_id") % 7 == 0).alias("superseded"))
    return semantic.answered(ranked(o, "id"), ranked(o.where("id % 2 = 0"), F.desc("id")), q).select("query_id", "id", "answer", "rank")


# --- maintenance -------------------------------------------------------------------------------------------


def _hex(number: str, size: int) -> str:
    """SQL of a number's least `size` bytes, least first, as hexadecimal digits."""
    return f"array_to_string(list_reverse(regexp_extract_all(right(printf('%016X', CAST({number} AS BIGINT)), {2 * size}), '..')), '')"


def _identity(kind: int, inode: str, sec: str) -> str:
    return f"('0{kind}' || {_hex('1', 8)} || {_hex(inode, 8)} || {_hex(sec, 8)} || {_hex('5', 4)})"


def _id(inode, sec):
    return store.identity(F.lit(False), F.lit(1), inode, sec, F.lit(5))


@query(f"WITH {SAVED} SELECT id, {_identity(0, 'id', 'mtime')} AS identity, 0 AS kind, 1::BIGINT AS device, id AS inode, mtime AS sec, 5::BIGINT AS nsec FROM saved")
def store_identity(spark, d):
    c = _saved(spark, d)[0].select("id", _id(F.col("id"), F.col("mtime")).alias("b"))
    return c.select("id", F.hex("b").alias("identity"), store.identity_parts(F.col("b")).alias("p")).select("id", "identity", "p.*")


@query(f"WITH {SAVED} SELECT id, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS replaced FROM saved")
def store_replaced(spark, d):
    s = _saved(spark, d)[0]
    # of each four rows: another object, another stamp, another stamp after a rename, none saved
    old = F.when(F.col("id") % 4 == 2, F.concat(F.unhex(F.lit("02")), F.substring(_id(F.col("id"), F.lit(0)), 2, 28))).when(F.col("id") % 4 < 3, _id(F.col("id"), F.lit(0)))
    new = _id(F.when(F.col("id") % 4 == 0, F.col("id") + 1).otherwise(F.col("id")), F.lit(9))
    return s.select("id", store.replaced(old, new).alias("replaced"))


#: A scan that finds another object at each folder whose number divides by 7, and at files whose id divides by 17.
OBJECTS = f"""tree AS (SELECT id, path, false AS is_dir, mtime, id AS inode FROM saved UNION ALL SELECT 100000000 + k, '/o/' || k, true, 0, k FROM range(0, 50) r(k)),
  scan AS (SELECT path, is_dir, mtime + 1 AS mtime, CASE WHEN (is_dir AND inode % 7 = 0) OR (NOT is_dir AND id % 17 = 0) THEN inode + 1000000 ELSE inode END AS inode, id FROM tree WHERE is_dir OR id % 13 > 0),
  other AS (SELECT s.path FROM scan s JOIN tree USING (path) WHERE s.inode <> tree.inode), under AS (SELECT t.path FROM tree t WHERE path IN (SELECT path FROM other) OR regexp_extract(path, '^/o/[0-9]+') IN (SELECT path FROM other)),
  next AS (SELECT tree.path, CASE WHEN u.path IS NULL THEN tree.id END AS id, coalesce(s.mtime, tree.mtime) AS mtime FROM tree LEFT JOIN scan s USING (path) LEFT JOIN (SELECT DISTINCT path FROM under) u ON u.path = tree.path WHERE NOT (u.path IS NOT NULL AND s.path IS NULL))"""


@query(f"WITH {SAVED}, {OBJECTS} SELECT path, mtime, coalesce(id, (SELECT max(id) FROM tree) + row_number() OVER (PARTITION BY id IS NULL ORDER BY path)) AS id FROM next")
def store_upsert_replaced(spark, d):
    saved, _ = _saved(spark, d)
    folders = spark.range(50).selectExpr("100000000 + id AS id", "concat('/o/', id) AS path", "true AS is_dir", "0L AS mtime", "0L AS size", "id AS inode")
    tree = saved.select("id", "path", "is_dir", "mtime", "size", F.col("id").alias("inode")).unionByName(folders)
    inode = F.when((F.col("is_dir") & (F.col("inode") % 7 == 0)) | (~F.col("is_dir") & (F.col("id") % 17 == 0)), F.col("inode") + 1000000).otherwise(F.col("inode"))
    scan = tree.where("is_dir OR id % 13 > 0").select("path", "is_dir", (F.col("mtime") + 1).alias("mtime"), "size", _id(inode, F.lit(1)).alias("identity"))
    # saved stamps are those of a rename, so only another device or inode is another object
    kept = tree.select("id", "path", "is_dir", "mtime", "size", F.concat(F.unhex(F.lit("02")), F.substring(_id(F.col("inode"), F.lit(0)), 2, 28)).alias("identity"))
    return store.upserted(kept, scan).select("path", "mtime", "id")


@query(f"""WITH {SAVED}, rows AS (SELECT id, path, is_dir, regexp_extract(path, '[^/]*$') AS name, CAST(NULL AS VARCHAR) AS ext, {_identity(0, 'id', 'mtime')} AS identity, 1 AS emb_version FROM saved UNION ALL SELECT 0, '/o/3', true, '3', NULL, {_identity(1, '7', '7')}, 1)
  SELECT id, CASE WHEN m THEN '/o/9.x' || substr(path, 5) ELSE path END AS path, CASE WHEN path = '/o/3' THEN '9.x' ELSE name END AS name, ext, CASE WHEN m AND identity[1:2] = '00' THEN '02' || identity[3:34] || repeat('00', 12) ELSE identity END AS identity, CASE WHEN NOT m THEN emb_version END AS emb_version
  FROM (SELECT *, path = '/o/3' OR starts_with(path, '/o/3/') AS m FROM rows)""")
def store_move_identity(spark, d):
    saved, _ = _saved(spark, d)
    rows = saved.select("id", "path", "is_dir", T.basename(F.col("path")).alias("name"), F.lit(None).cast("string").alias("ext"), _id(F.col("id"), F.col("mtime")).alias("identity"), F.lit(1).alias("emb_version"))
    folder = spark.range(1).select("id", F.lit("/o/3").alias("path"), F.lit(True).alias("is_dir"), F.lit("3").alias("name"), F.lit(None).cast("string").alias("ext"), store.identity(F.lit(True), F.lit(1), F.lit(7), F.lit(7), F.lit(5)).alias("identity"), F.lit(1).alias("emb_version"))
    return store.moved(rows.unionByName(folder), "/o/3", "/o/9.x").select("id", "path", "name", "ext", F.hex("identity").alias("identity"), "emb_version")


@query(f"WITH {SAVED}, g AS (SELECT id FROM saved WHERE id % 3 = 0), s AS (SELECT path FROM saved WHERE id % 2 = 0) SELECT id, path FROM saved WHERE id NOT IN (SELECT id FROM g) OR path IN (SELECT path FROM s) OR split_part(path, '/', 3) = '11'")
def store_prune_exact(spark, d):
    saved, _ = _saved(spark, d)
    kept = spark.createDataFrame([("/o/11",)], "path string")
    return store.pruned_exactly(saved, saved.where("id % 3 = 0"), saved.where("id % 2 = 0"), kept).select("id", "path")


@query(f"WITH {SAVED} SELECT id, path FROM saved WHERE NOT starts_with(path, '/o/4/') OR id % 2 = 0")
def store_forget_root(spark, d):
    saved, _ = _saved(spark, d)
    roots = spark.createDataFrame([("/o",), ("/o/4",)], "path string")
    return store.forgotten(saved, roots, saved.where("id % 2 = 0"), "/o/4")[0].select("id", "path")


@query(f"WITH {SAVED} SELECT id, split_part(path, '/', 4) = '100' AND id % 10 = 1 AS is_root FROM saved")
def store_root_flag(spark, d):
    saved, _ = _saved(spark, d)
    roots = saved.where("split_part(path, '/', 4) = '100' AND id % 10 = 1").select("path")
    return store.with_root_flag(saved, roots).select("id", "is_root")


@query(f"WITH {SAVED} SELECT id, size, false AS fresh FROM saved WHERE id % 6 = 0 AND id % 4 > 0 UNION ALL SELECT id, size + 1, true FROM saved WHERE id % 4 = 0 AND id % 5 > 0")
def store_pending(spark, d):
    saved, _ = _saved(spark, d)
    rows = lambda df, fresh: df.select("id", "size", F.lit(fresh).alias("fresh"))
    return store.pending(rows(saved.where("id % 6 = 0"), False), saved.where("id % 4 = 0"), rows(saved.where("id % 5 > 0").withColumn("size", F.col("size") + 1), True))


@query(f"WITH {SAVED}, c AS (SELECT id, 'metadata' AS kind FROM saved WHERE id % 2 = 1) SELECT id, kind, true AS overflow FROM c ORDER BY id LIMIT 300")
def store_capture(spark, d):
    saved, _ = _saved(spark, d)
    return store.captured(store.changes(saved, saved.withColumn("mtime", F.col("mtime") + F.col("id") % 2)), 300)


@query("SELECT vec_id AS id, CAST(label AS VARCHAR) AS text FROM embeddings WHERE vec_id % 3 = 2 AND label % 2 = 0")
def store_activate(spark, d):
    cache = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 3).alias("emb_gen"), F.col("label").cast("string").alias("text"))
    used = cache.where(F.col("text").cast("int") % 2 == 0)
    return store.activated(cache.select("emb_gen").distinct(), cache, used, 2)[1].select("id", "text")


@query(f"WITH {SAVED}, x AS (SELECT CASE WHEN id % 50 = 1 THEN id + 10 ELSE id END AS id, CASE WHEN id % 40 = 1 THEN '/o/same' WHEN id % 41 = 0 THEN substr(path, 2) ELSE path END AS path FROM saved) SELECT CAST(0 AS BIGINT) AS empty, (SELECT count(*) FROM x WHERE path[1] <> '/') AS relative, (SELECT count(*) - count(DISTINCT id) FROM x) AS repeated_ids, (SELECT count(*) - count(DISTINCT path) FROM x) AS repeated_paths")
def store_integrity(spark, d):
    x = _saved(spark, d)[0].select(F.when(F.col("id") % 50 == 1, F.col("id") + 10).otherwise(F.col("id")).alias("id"), F.when(F.col("id") % 40 == 1, "/o/same").when(F.col("id") % 41 == 0, F.substring("path", 2, 1000)).otherwise(F.col("path")).alias("path"))
    return store.integrity(x)


@query(ORACLE_SQL["store_diff"].replace("SELECT coalesce(s.path, n.path) AS path, s.id, CASE", "SELECT (SELECT count(*) FROM scan) AS scanned, CAST(0 AS BIGINT) AS unreadable, " + ", ".join(f"count(*) FILTER (verdict = '{v}') AS {v if v != 'new' else 'new'}" for v in store.COUNTERS[2:]).replace(" AS new", ' AS "new"') + " FROM (SELECT CASE", 1) + ")")
def store_counters(spark, d):
    saved, scan = _saved(spark, d)
    return store.counted(store.diff(saved, scan), scan)


@query(f"WITH {LIVE} SELECT entry_id, path FROM parts")
def store_compact(spark, d):
    p = parts(spark, d).select("entry_id", "path")
    delta = p.where("entry_id % 10 = 5").withColumn("path", F.regexp_replace("path", "/([^/]*)$", "/New$1"))
    return catalog.compacted(p, delta, p.where("entry_id % 10 = 3"))


@query(f"WITH {SAVED} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, max(CASE WHEN id % 100 = 1 THEN 1 ELSE 0 END) = 0 AS same FROM saved GROUP BY ALL")
def folder_stamp(spark, d):
    f = _saved(spark, d)[0].select("id", T.parent(F.col("path")).alias("folder"), "path", "mtime", "size")
    after = f.withColumn("mtime", F.col("mtime") + F.when(F.col("id") % 100 == 1, 1).otherwise(0)).repartition("id")
    return catalog.folder_stamp(f).join(catalog.folder_stamp(after).withColumnRenamed("stamp", "_s"), "folder").select("folder", (F.col("stamp") == F.col("_s")).alias("same"))


@query(f"WITH {FILES} SELECT entry_id, CASE WHEN entry_id % 3 > 0 THEN true END AS is_dir FROM files")
def is_dir_by_id(spark, d):
    f = files(spark, d)
    return catalog.resolved(f.select("entry_id"), f.where("entry_id % 3 > 0").withColumn("is_dir", F.lit(True))).select("entry_id", "is_dir")


@query("SELECT true AS same, false AS other")
def same_snapshot(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("fingerprint"))
    return spark.createDataFrame([(catalog.same_snapshot(p, p.repartition(3)), catalog.same_snapshot(p, p.withColumn("fingerprint", F.col("fingerprint") + 1)))], "same boolean, other boolean")


# --- history and streams in their batch form ---------------------------------------------------------------


@query("SELECT event_id, event_id % 100 AS target_id FROM events WHERE event_id % 100 < 60")
def hist_cascade(spark, d):
    e = _t(spark, d, "events").select("event_id", (F.col("event_id") % 100).alias("target_id"))
    return history.cascaded(e, spark.range(60).withColumnRenamed("id", "entry_id"))


@query("SELECT event_id, count(*) AS n FROM events GROUP BY ALL")
def hist_recorded_once(spark, d):
    e = _t(spark, d, "events").select("event_id", "ts")
    return stream.recorded_once(e.unionByName(e.where("event_id % 3 = 0"))).groupBy("event_id").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT user_id AS search_id, arg_max('q' || event_id, event_id) AS query, max(event_id) AS seq FROM events GROUP BY ALL ORDER BY seq DESC, search_id LIMIT 50) SELECT event_id, query FROM events LEFT JOIN s ON user_id = search_id""")
def hist_recent_search(spark, d):
    e = _t(spark, d, "events").select("event_id", F.col("user_id").alias("search_id"))
    searches = e.select("search_id", F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query"), F.col("event_id").alias("seq"))
    return stream.with_query(e, stream.remembered(searches, 50)).select("event_id", "query")


@query("SELECT 0::BIGINT AS opens, 0::BIGINT AS searches")
def hist_clear(spark, d):
    e = _t(spark, d, "events")
    a, b = history.cleared(e, e.select("user_id"))
    return a.agg(F.count("*").alias("opens")).join(b.agg(F.count("*").alias("searches")))


@query(f"WITH {EV}, s AS (SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS scope FROM ev), r AS (SELECT DISTINCT '/u/' || user_id AS scope FROM ev WHERE user_id % 3 = 0), x AS (SELECT scope, false AS recursive FROM s UNION ALL SELECT scope, true FROM r) SELECT scope, recursive FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE starts_with(x.scope, r.scope || '/'))")
def stream_outermost(spark, d):
    e = _events(spark, d)
    own = e.select(T.parent(F.col("path")).alias("scope"), F.lit(False).alias("recursive")).distinct()
    deep = e.where("CAST(root AS INT) % 3 = 0").select(F.concat(F.lit("/u/"), "root").alias("scope"), F.lit(True).alias("recursive")).distinct()
    return stream.outermost(own.unionByName(deep))


@query("SELECT 'quiet' AS name, false AS full UNION ALL SELECT 'lost', true UNION ALL SELECT 'many', true")
def stream_loss(spark, d):
    e = _events(spark, d)
    found = stream.scopes(e)
    lost = e.withColumn("kind", F.when(F.col("seq") == 7, "overflow").otherwise(F.col("kind")))
    many = lambda name, ev, most: stream.full_pass(ev, found, most).select(F.lit(name).alias("name"), "full")
    return many("quiet", e, 1 << 30).union(many("lost", lost, 1 << 30)).union(many("many", e, 5))


@query("""SELECT event_id AS seq, ['overflow', 'moved_from', 'moved_to', 'create', 'delete', 'attrib'][1 + event_id % 6] AS kind, CASE WHEN event_id % 6 > 0 THEN '/u/' || event_id END AS path, event_id % 9 = 0 AND event_id % 10 > 0 AS is_dir, epoch_us(ts) // 1000 AS ms FROM events WHERE event_id % 10 > 0 OR event_id % 6 = 0""")
def watch_events(spark, d):
    bits = F.element_at(F.array(*[F.lit(b) for b in (0x4000, 0x40, 0x80, 0x100, 0x400, 0x4)]), (F.col("event_id") % 6 + 1).cast("int")).cast("long")
    mask = F.when(F.col("event_id") % 10 == 0, F.lit(0x1).cast("long")).otherwise(bits.bitwiseOR(F.when(F.col("event_id") % 9 == 0, F.lit(watch.IS_DIR)).otherwise(F.lit(0)).cast("long")))
    line = F.to_json(F.struct(F.col("event_id").alias("seq"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), mask.alias("mask"), F.when(F.col("event_id") % 6 > 0, F.concat(F.lit("/u/"), F.col("event_id").cast("string"))).alias("path"), F.lit(0).alias("cookie")))
    got = watch.events(_t(spark, d, "events").select(line.alias("value")).union(spark.createDataFrame([("no json",), ("{}",)], "value string")))
    return got.select("seq", "kind", "path", "is_dir", F.unix_millis("ts").alias("ms"))


@query(f"""WITH w AS (SELECT user_id AS window_id, 'App' || user_id % 30 AS app_id, 'Class' || user_id % 17 AS class FROM (SELECT DISTINCT user_id FROM events)), a AS (SELECT p_partkey AS entry_id, 'app' || p_partkey AS desktop_id, CASE WHEN p_partkey % 2 = 0 THEN 'class' || p_partkey % 40 END AS wm_class, p_partkey AS rank FROM part WHERE p_partkey <= 100 AND p_partkey % 5 > 0),
  k AS (SELECT entry_id, rank, desktop_id AS k, 3 AS e FROM a UNION ALL SELECT entry_id, rank, wm_class, 2 FROM a WHERE wm_class IS NOT NULL UNION ALL SELECT entry_id, rank, 'name-' || entry_id || '.desktop', 1 FROM a)
  SELECT window_id, arg_max(entry_id, e * 1000000 - rank) AS entry_id FROM w JOIN k ON k.k IN (lower(app_id), lower(class), lower(app_id) || '.desktop') GROUP BY ALL""")
def window_owners(spark, d):
    w = _t(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("window_id"), F.concat(F.lit("App"), (F.col("user_id") % 30).cast("string")).alias("app_id"), F.concat(F.lit("Class"), (F.col("user_id") % 17).cast("string")).alias("class"))
    k = F.col("p_partkey")
    a = _t(spark, d, "part").where("p_partkey <= 100").select(k.alias("entry_id"), F.concat(F.lit("app"), k.cast("string")).alias("desktop_id"), F.when(k % 2 == 0, F.concat(F.lit("class"), (k % 40).cast("string"))).alias("wm_class"), F.concat(F.lit("Name "), k.cast("string")).alias("name"), k.alias("rank"), (k % 5 == 0).alias("settings"))
    return merge.window_owners(w, a)


# --- sources and scalars -----------------------------------------------------------------------------------


@query("""WITH a AS (SELECT s_suppkey AS id, '/mnt/' || s_nationkey || '/' || s_suppkey AS p FROM supplier), r AS (SELECT '/mnt/' || k AS path FROM range(0, 5) t(k) UNION ALL SELECT '/mnt/7/3/deep'), odd AS (SELECT DISTINCT p FROM a WHERE id % 3 = 0)
  SELECT p AS mount_point FROM odd WHERE EXISTS (SELECT 1 FROM r WHERE r.path = p OR starts_with(p, r.path || '/') OR starts_with(r.path, p || '/'))""")
def mount_changes(spark, d):
    m = _t(spark, d, "supplier").select(F.col("s_suppkey").cast("int").alias("mount_id"), F.lit("1").alias("device"), F.lit("/").alias("root"), F.concat(F.lit("/mnt/"), F.col("s_nationkey").cast("string"), F.lit("/"), F.col("s_suppkey").cast("string")).alias("mount_point"))
    roots = spark.range(5).select(F.concat(F.lit("/mnt/"), F.col("id").cast("string")).alias("path")).union(spark.createDataFrame([("/mnt/7/3/deep",)], "path string"))
    return listings.mounts_changed(m, m.where("mount_id % 3 > 0"), roots)


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS shown FROM part")
def desktop_visible(spark, d):
    k = F.col("p_partkey") % 4
    apps = _t(spark, d, "part").select("p_partkey", F.when(k == 0, F.array(F.lit("X-Two"), F.lit("One"))).when(k == 3, F.array(F.lit("Other"))).otherwise(F.array().cast("array<string>")).alias("only_show_in"), F.when(k == 1, F.array(F.lit("Two"))).otherwise(F.array().cast("array<string>")).alias("not_show_in"))
    shown = listings.visible(apps, ["One", "Two"]).select("p_partkey", F.lit(True).alias("shown"))
    return apps.select("p_partkey").join(shown, "p_partkey", "left").select("p_partkey", F.coalesce("shown", F.lit(False)).alias("shown"))


@query(f"""WITH {RES}, r AS (SELECT * FROM res WHERE rank <= 5) SELECT '{{"request_id":"' || query_id || '","count":' || count(*) || ',"results":[' || string_agg('{{"id":"' || entry_id || '","path":"/p/' || entry_id || '","score":' || 100 - rank || '}}', ',' ORDER BY rank) || ']}}' AS value FROM r GROUP BY query_id""")
def response_encode(spark, d):
    res = _results(spark, d)[0].where("rank <= 5")
    return listings.responses(res.select("query_id", "rank", "entry_id", F.concat(F.lit("/p/"), F.col("entry_id").cast("string")).alias("path"), (100 - F.col("rank")).alias("score")))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"path":"/f' || event_id || '"}' ELSE '{"path_b64":"' || base64(encode('/f' || event_id) || '\\xFF'::BLOB) || '"}' END AS member, true AS back FROM events""")
def path_members(spark, d):
    raw = F.encode(F.concat(F.lit("/f"), F.col("event_id").cast("string")), "utf-8")
    path = F.when(F.col("event_id") % 2 == 0, raw).otherwise(F.concat(raw, F.unhex(F.lit("FF"))))
    rows = _t(spark, d, "events").select("event_id", path.alias("p")).withColumn("member", scalars.path_member(F.col("p")))
    return rows.select("event_id", "member", (scalars.path_of_member(F.col("member")) == F.col("p")).alias("back"))


@query("""SELECT p_partkey, 'a\\\\b' || '\\x09' || p_name AS shown FROM part""")
def display_escape(spark, d):
    return _t(spark, d, "part").select("p_partkey", scalars.display_escaped(F.concat(F.lit("a\\b\t"), "p_name")).alias("shown"))


@query("SELECT p_partkey, lower(replace(p_name, ' ', '-')) || '.desktop' AS desktop, '/apps/' || replace(p_brand || '/' || p_type, '/', ' ') AS label, p_name || ' ' || p_type AS line, p_partkey % 3 > 0 AS may_suggest, p_partkey % 2 = 0 AS valid_ref FROM part")
def scalar_labels(spark, d):
    k = F.col("p_partkey")
    asked = F.when(k % 3 == 0, F.concat(F.col("p_name"), F.lit("@x"))).otherwise(F.col("p_name"))
    ref = F.when(k % 2 == 0, "org.some.App").otherwise("org.app")
    return _t(spark, d, "part").select("p_partkey", scalars.desktop_name(F.col("p_name")).alias("desktop"), scalars.label_key(F.concat("p_brand", F.lit("/"), "p_type")).alias("label"), scalars.single_line(F.concat("p_name", F.lit("\x01"), "p_type")).alias("line"), scalars.suggestion_gate(asked).alias("may_suggest"), scalars.software_ref_valid(F.lit("system"), ref).alias("valid_ref"))


@query("SELECT p_partkey, 'a b' || chr(9) || 'é' AS text, p_brand || ' ' || p_type AS keywords, repeat('k', 100) || ' ' || repeat('k', 100) AS cut FROM part")
def scalar_texts(spark, d):
    long_ = F.array_repeat(F.repeat(F.lit("k"), 100), 3)
    return _t(spark, d, "part").select("p_partkey", scalars.octal_unescaped(F.lit("a\\040b\\011\\303\\251")).alias("text"), scalars.keyword_text(F.array("p_brand", "p_type")).alias("keywords"), scalars.keyword_text(long_, 250).alias("cut"))


@query("SELECT a AS address, v AS valid FROM (VALUES ('http://[::1]/', true), ('http://[::1]:8080/x', true), ('https://[2001:db8::a:b]', true), ('[::1]', false), ('http://[1:2:3]/', false), ('http://[::ffff:10.0.0.1]/', true), ('http://[12345::]/', false), ('http://[::1]:99999/', false), ('10.0.0.1:80/x', true), ('notes.txt', false), ('example.ORG/a?b', true), ('http://a b', false)) t(a, v)")
def scalar_ipv6_address(spark, d):
    rows = ["http://[::1]/", "http://[::1]:8080/x", "https://[2001:db8::a:b]", "[::1]", "http://[1:2:3]/", "http://[::ffff:10.0.0.1]/", "http://[12345::]/", "http://[::1]:99999/", "10.0.0.1:80/x", "notes.txt", "example.ORG/a?b", "http://a b"]
    return spark.createDataFrame([(r,) for r in rows], "address string").select("address", scalars.web_address(F.col("address")).alias("valid"))


@query("SELECT p_type, count(DISTINCT (p_name, p_size)) AS revisions, count(DISTINCT sha256(p_name)) AS digests, min(sha256(p_name)) AS least FROM part GROUP BY ALL")
def scalar_hashes(spark, d):
    return _t(spark, d, "part").groupBy("p_type").agg(F.count_distinct(F.xxhash64("p_name", "p_size")).alias("revisions"), F.count_distinct(F.sha2("p_name", 256)).alias("digests"), F.min(F.sha2("p_name", 256)).alias("least"))


@query(f"WITH {PARTS}, {TOKENS} SELECT entry_id, folder, pos, token, round(boost, 6) AS boost FROM (SELECT entry_id, regexp_replace(path, '/[^/]*$', '') AS folder, unnest(t) AS token, unnest(range(0, len(t))) AS pos, round(400 * entry_id / (entry_id + 2.0)) AS boost FROM toks)")
def sql_surface(spark, d):
    sqlext.register(spark)
    parts(spark, d).select("entry_id", "path", "name").createOrReplaceTempView("quarry_parts")
    return spark.sql("SELECT entry_id, path_parent(path) AS folder, t.pos, t.token, CAST(usage_boost(CAST(entry_id AS DOUBLE), 400D, 2D) AS DOUBLE) AS boost FROM quarry_parts, LATERAL tokenize(name) t")


# --- evaluation --------------------------------------------------------------------------------------------


@query(f"""WITH {FILES}, r AS (SELECT entry_id % 40 AS query_id, path FROM files), q AS (SELECT entry_id AS query_id, CASE WHEN entry_id % 2 = 0 THEN 'parent' ELSE 'exact' END AS kind, path AS target FROM files WHERE entry_id < 40)
  SELECT query_id, r.path, regexp_extract(r.path, '[^/]*$') = regexp_extract(target, '[^/]*$') AND (kind <> 'parent' OR regexp_extract(r.path, '([^/]*)/[^/]*$', 1) = regexp_extract(target, '([^/]*)/[^/]*$', 1)) AS relevant FROM r JOIN q USING (query_id)""")
def eval_relevance(spark, d):
    f = files(spark, d)
    asked = f.where("entry_id < 40").select(F.col("entry_id").alias("query_id"), F.when(F.col("entry_id") % 2 == 0, "parent").otherwise("exact").alias("kind"), F.col("path").alias("target"))
    return evaluation.relevant(f.select((F.col("entry_id") % 40).alias("query_id"), "path"), asked)


@query(f"""WITH {RES}, g AS (SELECT query_id, entry_id, rank, min(rank) OVER (PARTITION BY query_id, entry_id % 3) AS f FROM (SELECT * FROM res WHERE rank <= 20)), p AS (SELECT query_id, entry_id, row_number() OVER (PARTITION BY query_id ORDER BY f, rank) AS rank FROM g), b AS (SELECT t.query_id, min(rank) AS rank FROM tgt t LEFT JOIN p ON p.query_id = t.query_id AND p.entry_id = t.entry_id GROUP BY ALL)
  SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM b""")
def eval_popup(spark, d):
    res, tgt, _ = _results(spark, d)
    out = evaluation.popup(res.where("rank <= 20").withColumn("section", F.col("entry_id") % 3), tgt, "section")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("recall_at_1", "recall_at_5", "mrr")])


def _unit(salt: int) -> str:
    return f"CAST('0x' || substr(md5(id || '/3/{salt}'), 1, 10) AS BIGINT) / 1099511627776.0"


@query(f"""WITH {PARTS}, h AS (SELECT entry_id, norm, md5(entry_id || '/3') AS h FROM parts ORDER BY h, entry_id LIMIT 200), k AS (SELECT *, row_number() OVER (ORDER BY h, entry_id) AS k FROM h),
  u AS (SELECT *, sum(1.0::DOUBLE / k) OVER (ORDER BY k) AS upto, sum(1.0::DOUBLE / k) OVER () AS total FROM k), dr AS (SELECT id, {_unit(1)} AS u, {_unit(2)} AS t, {_unit(3)} AS c FROM range(0, 1500) r(id))
  SELECT id AS event_id, entry_id AS target_id, left(norm, CAST(greatest(1, ceil(c * least(length(norm), 8))) AS INT)) AS query, CAST({NOW} - floor(t * 30 * 86400) AS BIGINT) AS ts FROM dr JOIN u ON dr.u * total >= upto - 1.0::DOUBLE / k AND dr.u * total < upto""")
def eval_habits(spark, d):
    return evaluation.habits(parts(spark, d), NOW)


@query("""WITH r AS (SELECT o_custkey AS intent, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, CASE WHEN o_orderkey % 3 > 0 THEN 1 + o_orderkey % 4 END AS rank FROM orders), e AS (SELECT intent, min(CASE WHEN rank = 1 THEN n END) AS f, max(n) AS a, max(CASE WHEN n = 3 AND rank <= 10 THEN 1.0 / rank END) AS rr FROM r GROUP BY ALL)
  SELECT count(*) AS intents, round(avg(coalesce(f, a + 1)), 6) AS to_first, round(avg(coalesce(rr, 0)), 6) AS mrr_at_probe FROM e""")
def eval_keystrokes(spark, d):
    r = _t(spark, d, "orders").select(F.col("o_custkey").alias("intent"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("n"), F.when(F.col("o_orderkey") % 3 > 0, 1 + F.col("o_orderkey") % 4).alias("rank"))
    return evaluation.keystrokes(r).select("intents", F.round("to_first", 6).alias("to_first"), F.round("mrr_at_probe", 6).alias("mrr_at_probe"))


@query()
def eval_scenario(spark, d):
    """A person's habits: how many keystrokes until the wanted part is first, with and without its history. Ten intents, typed up to six symbols."""
    items = parts(spark, d)
    history_ = evaluation.habits(items, NOW)
    wanted = items.join(history_.select(F.col("target_id").alias("entry_id")).distinct(), "entry_id", "left_semi").orderBy(F.md5(F.col("entry_id").cast("string"))).limit(10)
    typed = evaluation.typed(wanted.select(F.col("entry_id").alias("intent"), F.col("norm").alias("text")), 6).withColumn("query_id", (F.col("intent") * 100 + F.col("n")).cast("int"))
    segment = segments.build(items)

    def measured(name, boosts):
        found = search.search(typed.select("query_id", "text"), segment, boosts=boosts)
        ranks = typed.join(found.select("query_id", F.col("entry_id").alias("intent"), "rank"), ["query_id", "intent"], "left")
        return evaluation.keystrokes(ranks.select("intent", "n", "rank")).withColumn("ranking", F.lit(name))

    return measured("plain", None).unionByName(measured("personal", usage.boosts(typed.select("query_id", "text"), history_, NOW)))
