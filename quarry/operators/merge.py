"""Merging applications with files: evidence classes, the cut of fuzzy padding, tiers and groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import channels, search

#: Evidence of an application for a query.
FUZZY, STARTED, DESCRIBED, NAMED = 0, 1, 2, 3
#: Fixed value: what a key of an application's name scores more than a file's.
APP_BONUS = 2000


def searched_apps(queries: DataFrame, apps: DataFrame, fields: DataFrame, boosts: DataFrame | None = None, limit: int = search.LIMIT_MAX) -> DataFrame:
    """The applications of each query with their evidence: apps are names (entry_id, path, name, ...), fields their generic names and
    keywords. Keys of the name score APP_BONUS more."""
    found = search.search(queries, apps, fields=fields, boosts=boosts, limit=limit, bonus=APP_BONUS)
    return found.join(app_evidence(queries, apps, fields), ["query_id", "entry_id"], "left").withColumn("evidence", F.coalesce("evidence", F.lit(FUZZY)))


def app_evidence(queries: DataFrame, apps: DataFrame, fields: DataFrame) -> DataFrame:
    """query_id, entry_id, evidence of every application that some word of the query names or describes.

    NAMED: each word starts a key of the name (its initials too). DESCRIBED: each other word is a whole token of the
    generic name or keywords. STARTED: each starts a token there. Otherwise FUZZY."""
    words = channels.query_words(queries)
    by_name = channels.prefix_hits(words, channels.prefix_keys(apps)).select("query_id", "pos", "entry_id", F.lit(3).alias("_e"))
    as_items = fields.select("entry_id", F.col("text").alias("name"))
    keys = channels.prefix_keys(as_items).where(F.col("score") >= channels.TOKEN)
    by_field = channels.prefix_hits(words, keys)
    whole = (F.col("score") % 1000) == channels.COMPLETE
    by_field = by_field.select("query_id", "pos", "entry_id", F.when(whole, 2).otherwise(1).alias("_e"))
    best = by_name.unionByName(by_field).groupBy("query_id", "pos", "entry_id").agg(F.max("_e").alias("_e"))
    need = words.groupBy("query_id").agg(F.max("n_words").alias("_need"))
    rows = best.groupBy("query_id", "entry_id").agg(F.min("_e").alias("_least"), F.count("*").alias("_met")).join(need, "query_id")
    return rows.select("query_id", "entry_id", F.when(F.col("_met") < F.col("_need"), FUZZY).otherwise(F.col("_least")).cast("int").alias("evidence"))


def without_padding(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """rows (query_id, kind 'file' or 'app', score, boost, evidence) without fuzzy matches of one-word queries that have
    a word start: a file's score counts without its boost for that. What was opened before stays."""
    plain = queries.select("query_id", ((F.size(F.filter(F.split("text", "[ \\t\\n\\r]+"), lambda w: w != "")) == 1) & ~F.col("text").contains("/")).alias("_one"))
    own = F.col("score") >= search.WORD_START
    bare = F.col("score") - F.col("boost") >= search.WORD_START
    file = F.col("kind") == "file"
    starts = F.when(file, own & bare).otherwise(F.col("evidence") > FUZZY)
    any_start = F.max(starts.cast("int")).over(W.partitionBy("query_id")) == 1
    keep = F.when(file, own | (F.col("boost") > 0)).otherwise((F.col("evidence") > FUZZY) | (F.col("boost") > 0))
    met = rows.join(plain, "query_id", "left").withColumn("_any", any_start)
    return met.where(~(F.coalesce("_one", F.lit(False)) & F.col("_any")) | keep).drop("_one", "_any")


def tiered(rows: DataFrame, limit: int = search.LIMIT) -> DataFrame:
    """One list of files and applications: exact paths, named applications, exact names, described applications, then all
    others by score, applications first among equals. rows: query_id, kind, entry_id, path, score, evidence."""
    exact = search.exactness(F.col("score"))
    file = F.col("kind") == "file"
    tier = F.when(file & (exact == "path"), 0).when(~file & (F.col("evidence") == NAMED), 1).when(file & (exact == "name"), 2).when(~file & (F.col("evidence") == DESCRIBED), 3).otherwise(4)
    order = W.partitionBy("query_id").orderBy("tier", F.desc("score"), F.when(file, 1).otherwise(0), "path", "entry_id")
    return rows.withColumn("tier", tier).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def grouped(rows: DataFrame, group: str) -> DataFrame:
    """rows (query_id, rank) with `position`: groups in the order of their best rank, ranks inside."""
    first = F.min("rank").over(W.partitionBy("query_id", group))
    placed = rows.withColumn("_first", first)
    return placed.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("_first", "rank"))).drop("_first")


def window_owners(windows: DataFrame, apps: DataFrame) -> DataFrame:
    """window_id, entry_id: the application of each open window. Evidence: its id or class equals the application's id (3),
    wm_class (2), or canonical name (1); equal evidence goes to the better rank; settings panels own none."""
    from quarry.functions.scalars import desktop_name

    keys = apps.where(~F.col("settings")).select("entry_id", "rank", F.explode(F.array(
        F.struct(F.lower("desktop_id").alias("k"), F.lit(3).alias("e")), F.struct(F.lower("wm_class").alias("k"), F.lit(2).alias("e")), F.struct(desktop_name(F.col("name")).alias("k"), F.lit(1).alias("e")))).alias("x")).select("entry_id", "rank", "x.k", "x.e").where("k IS NOT NULL")
    asked = windows.select("window_id", F.explode(F.array_distinct(F.array(F.lower("app_id"), F.lower("class"), F.concat(F.lower("app_id"), F.lit(".desktop"))))).alias("k")).where("k IS NOT NULL")
    return asked.join(keys, "k").groupBy("window_id").agg(F.max_by("entry_id", F.struct("e", -F.col("rank"))).alias("entry_id"))
