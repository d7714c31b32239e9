"""Personalisation: decayed opens, query pairs, boosts, retention and eviction. Times are Unix seconds.

All sums are over events (target_id long, query string or null, ts long), so late events need no care."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scalars import query_key
from quarry.functions.text import with_norm

#: Half-life; boosts and the weights that give half of them; how much is kept.
HALF_LIFE = 14 * 86_400
ITEM_BOOST, ITEM_HALF, QUERY_BOOST, QUERY_HALF = 400, 2, 1200, 1
ITEMS_MAX, PAIRS_MAX, RETENTION_DAYS, QUERY_SYMBOLS = 2048, 4096, 90, 32


def decay(ts: Column, now: int, value: Column | float = 1.0) -> Column:
    """What is left at `now` of a weight given at ts; the future does not grow."""
    value = value if isinstance(value, Column) else F.lit(value)
    return value * F.pow(F.lit(2.0), -F.greatest(F.lit(now) - ts, F.lit(0)) / F.lit(float(HALF_LIFE)))


def boost(weight: Column, most: int, half: float) -> Column:
    return F.when(weight <= 0, 0).otherwise(F.round(most * weight / (weight + half))).cast("int")


def items(events: DataFrame, now: int, days: int | None = None) -> DataFrame:
    """target_id, weight, last_open, strength (the order of eviction, the same at any time). days: what was last opened before goes
    with all its opens; an item still in use keeps its old ones."""
    sums = events.groupBy("target_id").agg(F.sum(decay(F.col("ts"), now)).alias("weight"), F.max("ts").alias("last_open"))
    return _retained(sums, now, days).withColumn("strength", F.log2("weight") + F.lit(now) / F.lit(float(HALF_LIFE)))


def pairs(events: DataFrame, now: int, days: int | None = None) -> DataFrame:
    """query, target_id, weight, last_open of opens that a retained query led to."""
    key = query_key(F.col("_q"), QUERY_SYMBOLS)[0]
    keyed = with_norm(events.where("query IS NOT NULL"), "query", "_q").withColumn("query", key).where("query <> ''")
    return _retained(keyed.groupBy("query", "target_id").agg(F.sum(decay(F.col("ts"), now)).alias("weight"), F.max("ts").alias("last_open")), now, days)


def _retained(summary: DataFrame, now: int, days: int | None) -> DataFrame:
    return summary if days is None else summary.where(F.col("last_open") >= now - days * 86_400)


def strongest(summary: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The `most` strongest rows; a limit, not a window, so each task keeps only its own best."""
    return summary.orderBy(F.desc("weight"), *keys).limit(most)


def boosts(queries: DataFrame, events: DataFrame, now: int) -> DataFrame:
    """query_id, entry_id, boost: what earlier opens add to an entry's score, in rows that hold for every query (query_id null), and
    more, in rows of their own, where the typed text begins a query that led there. Texts of more than QUERY_SYMBOLS symbols, and empty ones, get
    the first part only. Both summaries are capped, so a batch of queries meets a bounded number of rows."""
    own = strongest(items(events, now, RETENTION_DAYS), ["target_id"], ITEMS_MAX)
    every = own.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), F.col("target_id").alias("entry_id"), boost(F.col("weight"), ITEM_BOOST, ITEM_HALF).alias("boost"))
    key, whole = query_key(F.col("_t"), QUERY_SYMBOLS)
    typed = with_norm(queries.select("query_id", "text"), "text", "_t").select("query_id", key.alias("_typed"), whole.alias("_whole")).where("_whole AND _typed <> ''")
    # the beginnings of a stored query meet typed texts in an equi-join
    heads = F.transform(F.sequence(F.lit(1), F.length("query")), lambda n: F.substring(F.col("query"), F.lit(1), n))
    led = strongest(pairs(events, now, RETENTION_DAYS), ["query", "target_id"], PAIRS_MAX).select("target_id", "weight", F.explode(heads).alias("_typed")).join(typed, "_typed")
    by_query = led.join(own.select("target_id"), "target_id", "left_semi").groupBy("query_id", "target_id").agg(F.sum("weight").alias("_v"))
    return every.unionByName(by_query.select("query_id", F.col("target_id").alias("entry_id"), boost(F.col("_v"), QUERY_BOOST, QUERY_HALF).alias("boost")).where("boost > 0"))


def applications(summary: DataFrame, apps: DataFrame) -> DataFrame:
    """summary (desktop_id, ...) with the position of each application in the current catalog (desktop_id, position): the first, if
    an id occurs twice; those that are gone are left out."""
    first = apps.groupBy("desktop_id").agg(F.min("position").alias("position"))
    return summary.join(first, "desktop_id")


def merged(a: DataFrame, b: DataFrame, now: int) -> DataFrame:
    """Two summaries (target_id, weight, at) as one at the later of their times."""
    both = a.unionByName(b)
    w = W.partitionBy("target_id")
    shifted = both.withColumn("_at", F.max("at").over(w)).withColumn("_w", F.col("weight") * F.pow(F.lit(2.0), -(F.col("_at") - F.col("at")) / F.lit(float(HALF_LIFE))))
    return shifted.groupBy("target_id").agg(F.sum("_w").alias("weight"), F.max("_at").alias("at"))
