"""Ranking quality: recall, reciprocal rank, gain, percentiles, and known-item queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def known_item(results: DataFrame, targets: DataFrame, ks: tuple[int, ...] = (1, 5, 10), candidates: int = 1000) -> DataFrame:
    """recall_at_k, mrr, candidate recall and found over targets (query_id, entry_id): one row. results: query_id, entry_id, rank."""
    met = targets.join(results.select("query_id", "entry_id", "rank"), ["query_id", "entry_id"], "left")
    best = met.groupBy("query_id").agg(F.min("rank").alias("rank"))
    share = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0))
    return best.agg(F.count("*").alias("n"), *[share(k).alias(f"recall_at_{k}") for k in ks], share(candidates).alias("candidate_recall"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), F.count("rank").alias("found"))


def popup(results: DataFrame, targets: DataFrame, group: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """known_item() by where a row stands on the screen: sections in the order of their best rank, ranks inside. results: query_id, entry_id, rank
    and the column named by group."""
    from quarry.operators.merge import grouped

    return known_item(grouped(results, group).select("query_id", "entry_id", F.col("position").alias("rank")), targets, ks)


def relevant(results: DataFrame, queries: DataFrame) -> DataFrame:
    """results (query_id, path) with `relevant`, by queries (query_id, kind, target): a path with the target's own name, and, if the query asked by
    the folder, with its folder's name too."""
    name, above = lambda c: F.element_at(F.split(c, "/"), -1), lambda c: F.coalesce(F.try_element_at(F.split(c, "/"), F.lit(-2)), F.lit(""))
    met = results.join(queries.select("query_id", "kind", "target"), "query_id")
    same = (name(F.col("path")) == name(F.col("target"))) & ((F.col("kind") != "parent") | (above(F.col("path")) == above(F.col("target"))))
    return met.withColumn("relevant", same).drop("kind", "target")


def typed(targets: DataFrame, longest: int = 32) -> DataFrame:
    """Every keystroke of typing a text: intent, n, text (its first n symbols)."""
    n = F.least(F.length("text"), F.lit(longest))
    return targets.select("intent", F.posexplode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(F.col("text"), F.lit(1), i))).alias("n", "text")).withColumn("n", F.col("n") + 1)


def keystrokes(ranks: DataFrame, probe: int = 3) -> DataFrame:
    """One row over ranks (intent, n, rank of the target or null): intents, the mean number of keystrokes until the target is first (those that never get
    there count one more than they have), and the mean reciprocal rank among ten after `probe` keystrokes."""
    each = ranks.groupBy("intent").agg(F.min(F.when(F.col("rank") == 1, F.col("n"))).alias("_first"), F.max("n").alias("_all"), F.max(F.when((F.col("n") == probe) & (F.col("rank") <= 10), 1.0 / F.col("rank"))).alias("_rr"))
    return each.agg(F.count("*").alias("intents"), F.avg(F.coalesce("_first", F.col("_all") + 1)).alias("to_first"), F.avg(F.coalesce("_rr", F.lit(0.0))).alias("mrr_at_probe"))


def habits(items: DataFrame, now: int, count: int = 200, opens: int = 1500, days: int = 30, seed: int = 3) -> DataFrame:
    """Opens of habitual entries, event_id, target_id, query, ts: `count` entries by a hash, opened with Zipf frequencies over the last days, each from
    a typed beginning of its name. All draws are hashes, so the same catalog gives the same history."""
    drawn = F.md5(F.concat_ws("/", F.col("entry_id").cast("string"), F.lit(str(seed))))
    picked = items.select("entry_id", "norm", drawn.alias("_h")).orderBy("_h", "entry_id").limit(count)
    ranks = picked.withColumn("_k", F.row_number().over(W.orderBy("_h", "entry_id")))  # at most `count` rows
    share = F.lit(1.0) / F.col("_k")
    upto = ranks.withColumn("_to", F.sum(share).over(W.orderBy("_k"))).withColumn("_all", F.sum(share).over(W.partitionBy())).withColumn("_from", F.col("_to") - share)
    unit = lambda salt: F.conv(F.substring(F.md5(F.concat_ws("/", F.col("id").cast("string"), F.lit(str(seed)), F.lit(str(salt)))), 1, 10), 16, 10).cast("long") / float(1 << 40)
    draws = items.sparkSession.range(opens).select("id", unit(1).alias("_u"), unit(2).alias("_t"), unit(3).alias("_c"))
    met = draws.join(F.broadcast(upto), (F.col("_u") * F.col("_all") >= F.col("_from")) & (F.col("_u") * F.col("_all") < F.col("_to")))
    n = F.greatest(F.lit(1), F.ceil(F.col("_c") * F.least(F.length("norm"), F.lit(8)))).cast("int")
    return met.select(F.col("id").alias("event_id"), F.col("entry_id").alias("target_id"), F.left("norm", n).alias("query"), (F.lit(now) - F.floor(F.col("_t") * days * 86_400)).cast("long").alias("ts"))


def ndcg(results: DataFrame, grades: DataFrame, k: int = 10) -> DataFrame:
    """query_id, ndcg of results against grades (query_id, entry_id, grade)."""
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    got = results.where(F.col("rank") <= k).join(grades, ["query_id", "entry_id"]).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("rank"))).alias("_dcg"))
    order = W.partitionBy("query_id").orderBy(F.desc("grade"), "entry_id")
    best = grades.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("_r"))).alias("_ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.coalesce(F.col("_dcg") / F.col("_ideal"), F.lit(0.0)).alias("ndcg"))


def percentiles(rows: DataFrame, value: str, by: list[str], ps: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """Nearest-rank percentiles of a column in each group: p50, p95, p99."""
    return rows.groupBy(*by).agg(*[F.expr(f"percentile_disc({p / 100}) WITHIN GROUP (ORDER BY `{value}`)").alias(f"p{p}") for p in ps])


def bm25(queries: DataFrame, fields: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, entry_id, score of the BM25 baseline over weighted fields (entry_id, text, weight)."""
    from quarry.functions import text as T
    from quarry.operators.channels import query_words

    each = T.layered(fields, "text").select("entry_id", "weight", F.explode("toks").alias("word"))
    tf = each.groupBy("entry_id", "word").agg(F.sum("weight").alias("tf"))
    sizes = tf.groupBy("entry_id").agg(F.sum("tf").alias("size"))
    stats = F.broadcast(sizes.agg(F.count("*").alias("_docs"), F.avg("size").alias("_mean")))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    met = query_words(queries).select("query_id", "word").join(df, "word").join(tf, "word").join(sizes, "entry_id").join(stats)
    idf = F.log(1 + (F.col("_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("_mean")))
    return met.groupBy("query_id", "entry_id").agg(F.sum(part).alias("score"))


def generated(items: DataFrame) -> DataFrame:
    """Known-item queries: target entry_id, kind, text. exact: the name; prefix: its first 60 percent; abbreviation: the first
    letter and the consonants after it; typo: two neighbours swapped; partial_typo: 70 percent of that; parent: the folder's
    name and four letters. Where a swap falls is set by the id."""
    n = F.length("norm")
    at = F.pmod(F.col("entry_id") * 7919 + 13, F.greatest(n - 1, F.lit(1))).cast("int") + 1
    swapped = F.concat(F.substring("norm", F.lit(1), at - 1), F.substring("norm", at + 1, F.lit(1)), F.substring("norm", at, F.lit(1)), F.substring("norm", at + 2, n))
    up = F.element_at(F.split("folder", "/"), -1)
    kinds = [("exact", F.col("norm")), ("prefix", F.left("norm", F.ceil(n * 0.6).cast("int"))), ("abbreviation", F.concat(F.left("norm", F.lit(1)), F.regexp_replace(F.substring("norm", F.lit(2), n), "[^b-df-hj-np-tv-z]", ""))), ("typo", swapped), ("partial_typo", F.left(swapped, F.ceil(n * 0.7).cast("int"))), ("parent", F.concat_ws(" ", F.lower(up), F.left("norm", F.lit(4))))]
    return items.where(n >= 4).select("entry_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), t.alias("text")) for k, t in kinds])).alias("q")).select("entry_id", "q.kind", "q.text")
