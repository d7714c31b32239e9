"""Plans decided while a DataFrame is built: what the optimizer cannot know by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fuzzy
from quarry.operators import channels, search
from quarry.operators.segments import Segment
from quarry.plans.shared import dealt, sent


def pending_words(words: DataFrame, cheap: DataFrame, limit: int) -> DataFrame:
    """Words of one-word queries whose answer the cheap channels cannot settle: the limit-th hit does not beat the greatest
    possible subsequence score, or there are fewer hits. Words of longer queries always stay."""
    order = W.partitionBy("query_id", "pos").orderBy(F.desc("score"))
    kth = cheap.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == limit).select("query_id", "pos", F.col("score").alias("_kth"))
    met = words.join(kth, ["query_id", "pos"], "left")
    most = fuzzy.bound(F.col("word")) + channels.SUBSEQUENCE + search.LENGTH_BONUS + 256
    return met.where((F.col("n_words") > 1) | F.col("_kth").isNull() | (F.col("_kth") <= most)).drop("_kth")


def rare_grams(grams: DataFrame, frequency: DataFrame) -> DataFrame:
    """grams (query_id, pos, gram) that must be looked up: of n informative grams of which half must be shared, the n - need + 1
    rarest are enough to find every candidate; the others only verify."""
    order = W.partitionBy("query_id", "pos").orderBy(F.coalesce("df", F.lit(0)), "gram")
    n = F.count("*").over(W.partitionBy("query_id", "pos"))
    met = grams.join(dealt(frequency), "gram", "left").withColumn("_r", F.row_number().over(order)).withColumn("_n", n)
    return met.where(F.col("_r") <= F.col("_n") - F.ceil(F.col("_n") / 2) + 1).select("query_id", "pos", "gram")


def trigram_hits_by_rare(words: DataFrame, index: DataFrame, frequent: DataFrame) -> DataFrame:
    """channels.trigram_hits() with candidates from rare grams only: the same hits, from a smaller join."""
    from quarry.functions import text as T

    grams = words.where(~F.col("word").contains("/")).select("query_id", "pos", T.trigrams(F.col("word")).alias("g")).where(F.size("g") >= 3)
    each = grams.select("query_id", "pos", F.explode("g").alias("gram"))
    df = index.groupBy("gram").agg(F.count("*").alias("df"))
    told = sent(each.join(frequent.select("gram"), "gram", "left_anti"), words)
    index = dealt(index)
    few = sent(rare_grams(told, df), words)
    candidates = few.join(index, "gram").select("query_id", "pos", "entry_id").distinct()
    totals = told.groupBy("query_id", "pos").agg(F.count("*").alias("total"))
    shared = candidates.join(told, ["query_id", "pos"]).join(index, ["entry_id", "gram"]).groupBy("query_id", "pos", "entry_id").agg(F.count("*").alias("shared"))
    found = shared.join(totals, ["query_id", "pos"]).where(2 * F.col("shared") >= F.col("total"))
    return found.select("query_id", "pos", "entry_id", F.expr("1000 + (1000 * shared) div total").cast("int").alias("score"))


def one_word_topk(queries: DataFrame, segment: Segment, limit: int = 10, apart: bool = False) -> DataFrame:
    """search.search() without folders for batches of mostly short queries: subsequences are aligned only where they can matter. apart: as in
    search.scored()."""
    words = channels.query_words(queries)
    cheap = channels.prefix_hits(words, segment.keys).unionByName(channels.typo_hits(words, segment.terms))
    cheap = cheap.unionByName(channels.trigram_hits(words, segment.grams, segment.frequent)).unionByName(channels.path_hits(words, segment.entries))
    cheap = cheap.groupBy("query_id", "pos", "entry_id").agg(F.max("score").alias("score"))
    slow = channels.subsequence_hits(sent(pending_words(words, cheap, limit), words), segment.entries)
    return search.ranked(search.scored(search.combined(words, cheap, slow), queries, segment.entries, apart=apart), limit)
