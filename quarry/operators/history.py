"""History: searches (search_id, query, ts), opens of files and applications, and their upkeep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def all_opens(files: DataFrame, apps: DataFrame, searches: DataFrame) -> DataFrame:
    """Opens of both kinds (event_id, target_id, search_id, ts) in one shape, with the text of the search that led there."""
    both = files.select("event_id", "target_id", "search_id", "ts", F.lit("file").alias("kind")).unionByName(apps.select("event_id", "target_id", "search_id", "ts", F.lit("app").alias("kind")))
    return both.join(searches.select("search_id", "query"), "search_id", "left").select("event_id", "kind", "target_id", "query", "ts")


def recorded(opens: DataFrame, added: DataFrame, items: DataFrame) -> DataFrame:
    """added with `verdict`: accepted, repeated (an equal event is there), conflict (another with its id), missing (no such target).

    Of added events with one id the first (by ts) counts."""
    first = added.withColumn("_n", F.row_number().over(W.partitionBy("event_id").orderBy("ts", "target_id"))).where("_n = 1").drop("_n")
    old = opens.select("event_id", F.struct("target_id", "ts").alias("_old"))
    known = items.select(F.col("entry_id").alias("target_id"), F.lit(True).alias("_known"))
    met = first.join(old, "event_id", "left").join(known, "target_id", "left")
    same = F.col("_old") == F.struct("target_id", "ts")
    verdict = F.when(F.col("_old").isNotNull() & same, "repeated").when(F.col("_old").isNotNull(), "conflict").when(F.col("_known").isNull(), "missing").otherwise("accepted")
    return met.withColumn("verdict", verdict).drop("_old", "_known")


def pruned(table: DataFrame, cutoff: int) -> DataFrame:
    return table.where(F.col("ts") >= cutoff)


def cascaded(opens: DataFrame, items: DataFrame) -> DataFrame:
    """opens of targets that are still there."""
    return opens.join(items.select(F.col("entry_id").alias("target_id")), "target_id", "left_semi")


def cleared(*tables: DataFrame) -> list[DataFrame]:
    """The tables without rows."""
    return [t.where("false") for t in tables]
