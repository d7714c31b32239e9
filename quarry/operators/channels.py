"""Evidence channels: each gives hits (query_id, pos, entry_id, score) for query words (query_id, pos, word)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import fuzzy
from quarry.functions import text as T
from quarry.plans.shared import dealt, sent

#: Scores of prefix keys, of a complete token, of typos, trigrams, folders and fields.
BASENAME, TOKEN, COMPLETE, INITIALS = 6000, 5000, 128, 4500
TYPO, TRIGRAM_BASE, TRIGRAM_RANGE, SUBSEQUENCE, PARENT, GENERIC, KEYWORD = 3500, 1000, 1000, 1500, 2500, 2800, 2600
PREFIX_BONUS_MAX, EDGE = 4096, 3


def query_words(queries: DataFrame) -> DataFrame:
    """query_id, pos, word, n_words of queries (query_id, text); a word with '/' is a path word. The words of a batch are broadcast within a
    bound, and the catalog never is."""
    w = T.words(F.col("_norm"))
    return sent(T.with_norm(queries.select("query_id", "text"), "text", "_norm").select("query_id", F.posexplode(w).alias("pos", "word"), F.size(w).alias("n_words")))


def prefix_keys(items: DataFrame) -> DataFrame:
    """entry_id, key, score, complete: every key by which a name may be typed.

    complete: what is added when a word is the whole key."""
    raw, items = F.col("name"), named(items)
    toks = F.transform("toks", lambda t, i: F.struct(t.alias("key"), F.when((i == 0) & ~raw.rlike(f"^[{T.SEPARATORS}]"), BASENAME).otherwise(TOKEN).alias("score"), F.lit(COMPLETE).alias("complete")))
    runs = F.transform("cased", lambda r: F.struct(r.alias("key"), F.lit(TOKEN).alias("score"), F.lit(COMPLETE).alias("complete")))
    whole = F.array(F.struct(F.col("norm").alias("key"), F.lit(BASENAME).alias("score"), F.lit(0).alias("complete")), F.struct(F.col("inits").alias("key"), F.lit(INITIALS).alias("score"), F.lit(0).alias("complete")))
    every = F.array_distinct(F.concat(whole, toks, runs))
    return items.select("entry_id", F.explode(every).alias("k")).select("entry_id", "k.key", "k.score", "k.complete").where("key <> ''")


def edged(keys: DataFrame) -> DataFrame:
    """keys once for each of their edges: their first one, two and EDGE symbols."""
    edges = F.transform(F.sequence(F.lit(1), F.least(F.length("key"), F.lit(EDGE))), lambda n: F.substring(F.col("key"), F.lit(1), n))
    return keys.select("*", F.explode(edges).alias("edge"))


def best(hits: DataFrame) -> DataFrame:
    """The greatest score of each (query_id, pos, entry_id)."""
    return hits.groupBy("query_id", "pos", "entry_id").agg(F.max("score").alias("score"))


def prefix_hits(words: DataFrame, keys: DataFrame, bonus: int = 0) -> DataFrame:
    """The best() of prefix_matches()."""
    return best(prefix_matches(words, keys, bonus))


def prefix_matches(words: DataFrame, keys: DataFrame, bonus: int = 0) -> DataFrame:
    """Keys (edged or not) that start with a word. The join is on the first symbols, so it is an equi-join at any size."""
    keys = keys if "edge" in keys.columns else edged(keys)
    asked = words.where(~F.col("word").contains("/")).withColumn("edge", F.substring("word", 1, EDGE))
    found = asked.join(dealt(keys), "edge").where(F.col("key").startswith(F.col("word")))
    score = F.col("score") + F.when(F.col("key") == F.col("word"), F.col("complete")).otherwise(0) + min(bonus, PREFIX_BONUS_MAX)
    return found.select("query_id", "pos", "entry_id", score.alias("score"))


def prefix_score(name_layer: Column, word: Column) -> Column:
    """(score, complete) of one word in one name (a struct of name and its text layer), without an index; score 0 if no key starts
    with it."""
    n = name_layer
    toks = F.transform(n["toks"], lambda t, i: F.struct(t.alias("key"), F.when((i == 0) & ~n["name"].rlike(f"^[{T.SEPARATORS}]"), BASENAME).otherwise(TOKEN).alias("score"), F.lit(True).alias("token")))
    rest = F.transform(n["cased"], lambda r: F.struct(r.alias("key"), F.lit(TOKEN).alias("score"), F.lit(True).alias("token")))
    whole = F.array(F.struct(n["norm"].alias("key"), F.lit(BASENAME).alias("score"), F.lit(False).alias("token")), F.struct(n["inits"].alias("key"), F.lit(INITIALS).alias("score"), F.lit(False).alias("token")))
    met = F.filter(F.concat(whole, toks, rest), lambda k: k["key"].startswith(word) & (word != ""))
    best = F.array_max(F.transform(met, lambda k: F.struct((k["score"] + F.when(k["token"] & (k["key"] == word), COMPLETE).otherwise(0)).alias("score"), (k["token"] & (k["key"] == word)).alias("complete"))))
    return F.coalesce(best, F.struct(F.lit(0).alias("score"), F.lit(False).alias("complete")))


def _deletions(c: Column) -> Column:
    """The text and all texts with one symbol less."""
    n = F.length(c)
    return F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, n)))))


def one_edit(a: Column, b: Column) -> Column:
    """Whether one insertion, deletion, change or swap of neighbours makes a into b."""
    swap = F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a))) == b)
    return (a != b) & ((F.levenshtein(a, b) == 1) | ((F.length(a) == F.length(b)) & (F.length(a) >= 2) & swap))


def typo_eligible(c: Column) -> Column:
    return F.length(c).between(3, 32) & ~c.rlike("^[0-9]+$")


def typo_terms(items: DataFrame) -> DataFrame:
    """entry_id, term: distinct tokens that may be mistyped."""
    return named(items).select("entry_id", F.explode(F.array_distinct("toks")).alias("term")).where(typo_eligible(F.col("term")))


def typo_hits(words: DataFrame, terms: DataFrame) -> DataFrame:
    """typo_matches(), each once."""
    return typo_matches(words, terms).distinct()


def typo_matches(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Tokens one edit away from a word, found where their deletion neighbourhoods meet, and, for words of five symbols
    and more, tokens with a prefix one edit away that do not start with the word."""
    asked = words.where(typo_eligible(F.col("word")) & ~F.col("word").contains("/"))
    distinct = terms.select("term").distinct()
    forms = distinct.select("term", F.explode(_deletions(F.col("term"))).alias("_form"))
    w = asked.select("word").distinct()
    near = w.select("word", F.explode(_deletions(F.col("word"))).alias("_form")).join(dealt(forms), "_form").select("word", "term").where(one_edit(F.col("word"), F.col("term")))
    # prefixes of one symbol less, as many, and one more than the word
    heads = distinct.select("term", F.explode(F.transform(F.sequence(F.lit(4), F.least(F.length("term"), F.lit(33))), lambda n: F.substring(F.col("term"), F.lit(1), n))).alias("_head")).where(F.length("term") >= 4)
    heads = heads.select("term", "_head", F.explode(_deletions(F.col("_head"))).alias("_form"))
    long_ = w.where(F.length("word") >= 5)
    partial = long_.select("word", F.explode(_deletions(F.col("word"))).alias("_form")).join(dealt(heads), "_form").where(F.abs(F.length("_head") - F.length("word")) <= 1)
    partial = partial.where(one_edit(F.col("word"), F.col("_head")) & ~F.col("term").startswith(F.col("word"))).select("word", "term")
    found = near.union(partial).distinct().join(dealt(terms), "term")
    return asked.select("query_id", "pos", "word").join(found, "word").select("query_id", "pos", "entry_id", F.lit(TYPO).alias("score"))


def gram_index(items: DataFrame) -> DataFrame:
    """entry_id, gram: distinct trigrams of normalised names."""
    return named(items).select("entry_id", F.explode(T.trigrams(F.col("norm"))).alias("gram"))


def frequent_grams(index: DataFrame, items: DataFrame) -> DataFrame:
    """gram: those in more than max(64, names / 8) names, which say nothing. A delta is judged by its base's."""
    total = items.agg(F.greatest(F.lit(64), F.expr("count(*) div 8")).alias("_most"))  # one row
    return index.groupBy("gram").agg(F.count("*").alias("_df")).join(F.broadcast(total)).where("_df > _most").select("gram")


def trigram_hits(words: DataFrame, index: DataFrame, frequent: DataFrame) -> DataFrame:
    """Names that share at least half of a word's informative trigrams (at least three distinct ones in the word).

    Frequent grams say nothing; one in no name counts among the informative."""
    grams = words.where(~F.col("word").contains("/")).select("query_id", "pos", T.trigrams(F.col("word")).alias("g")).where(F.size("g") >= 3)
    grams = grams.select("query_id", "pos", F.explode("g").alias("gram"))
    told = grams.join(frequent.select("gram"), "gram", "left_anti")
    told = sent(told.withColumn("total", F.count("*").over(W.partitionBy("query_id", "pos"))), words)  # of the words, a batch
    shared = told.join(dealt(index), "gram").groupBy("query_id", "pos", "entry_id").agg(F.count("*").alias("shared"), F.first("total").alias("total"))
    found = shared.where(2 * F.col("shared") >= F.col("total"))
    return found.select("query_id", "pos", "entry_id", (F.lit(TRIGRAM_BASE) + F.expr(f"({TRIGRAM_RANGE} * shared) div total")).cast("int").alias("score"))


#: Symbols from common to rare in names; all others count as rarer. Any order gives the same hits, a good one fewer candidates.
COMMON_FIRST = "etaoinsrhldcumfpgwybvkxjqz0123456789._-"


def rarest(word: Column) -> Column:
    """The symbol of a word that fewest names are likely to hold."""
    rank = lambda c: F.when(F.instr(F.lit(COMMON_FIRST), c) > 0, F.instr(F.lit(COMMON_FIRST), c)).otherwise(99)
    return F.array_max(F.transform(T.symbols(word), lambda c: F.struct(rank(c).alias("r"), c.alias("c"))))["c"]


def _ordered(words: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of words and texts (text, starts) that hold the word's symbols in order. Texts and words meet in an equi-join on the word's
    rarest symbol; masks and the order test run before any Python."""
    asked = words.select("query_id", "pos", "word", rarest(F.col("word")).alias("_c"), T.mask(F.col("word")).alias("_wm"), T.repeat_mask(F.col("word")).alias("_wr"))
    each = texts.select("*", F.explode(F.array_distinct(T.symbols(F.col("text")))).alias("_c"))
    inside = lambda m, need: (need == 0) | (m.bitwiseAND(need) == need)
    mask, repeats = (F.col("mask"), F.col("repeats")) if {"mask", "repeats"} <= set(texts.columns) else (T.mask(F.col("text")), T.repeat_mask(F.col("text")))
    met = dealt(each).join(asked, "_c").where(inside(mask, F.col("_wm")) & (F.length("text") >= F.length("word")))
    return met.where(inside(repeats, F.col("_wr"))).where(T.holds(F.col("text"), F.col("word")))


def subsequence_hits(words: DataFrame, items: DataFrame) -> DataFrame:
    """Names that hold a word's symbols in order, by their best alignment."""
    items = named(items)
    extra = [c for c in ("mask", "repeats") if c in items.columns]
    met = _ordered(words.where(~F.col("word").contains("/")), items.select("entry_id", F.col("norm").alias("text"), "starts", *extra))
    score = fuzzy.optimal(F.col("text"), F.col("starts"), F.col("word"))
    return met.select("query_id", "pos", "entry_id", (score + SUBSEQUENCE).cast("int").alias("score"))


def path_hits(words: DataFrame, items: DataFrame) -> DataFrame:
    """Whole paths that hold a path word (one with '/') in order; no other channel speaks for such words. Where tokens start is worked out for the
    paths that do, by Python only beyond ASCII."""
    met = _ordered(words.where(F.col("word").contains("/")), T.with_norm(items.select("entry_id", "path"), "path", "text"))
    odd = T.beyond_ascii(F.col("path"))
    starts = F.when(odd, T.analysed(F.when(odd, F.col("path")))["starts"]).otherwise(T.boundaries(F.col("path")))
    return met.select("query_id", "pos", "entry_id", fuzzy.optimal(F.col("text"), starts, F.col("word")).cast("int").alias("score"))


def folder_evidence(words: DataFrame, dirs: DataFrame) -> DataFrame:
    """query_id, pos, folder, score: folders whose own name speaks for a word, in one or more rows. Each folder is scored once, not once
    an entry."""
    as_items = named(dirs).withColumn("entry_id", F.xxhash64("folder"))
    sub = subsequence_hits(words, as_items).withColumn("score", F.col("score") - SUBSEQUENCE)
    pre = prefix_matches(words, prefix_keys(as_items)).withColumn("score", F.lit(PARENT))
    return sub.unionByName(pre).join(dealt(as_items.select("entry_id", "folder")), "entry_id").select("query_id", "pos", "folder", "score")


def parent_hits(evidence: DataFrame, items: DataFrame) -> DataFrame:
    """The evidence of the nearest folder above each entry that has any."""
    from quarry.operators.catalog import ancestors

    ups = items.select("entry_id", F.posexplode(ancestors(F.col("path"))).alias("distance", "folder"))
    nearest = F.max(F.struct((-F.col("distance")).alias("near"), "score"))
    return evidence.join(dealt(ups), "folder").groupBy("query_id", "pos", "entry_id").agg(nearest["score"].alias("score"))


def field_items(fields: DataFrame) -> DataFrame:
    """Auxiliary texts (entry_id, kind 'generic' or 'keyword', text) as names of their own: entry_id, owner, weight and the text layer."""
    weight = F.when(F.col("kind") == "generic", GENERIC).otherwise(KEYWORD)
    each = fields.select(F.xxhash64("entry_id", "kind", "text").alias("_f"), F.col("entry_id").alias("owner"), weight.alias("weight"), F.col("text").alias("name")).distinct()
    return named(each.withColumnRenamed("_f", "entry_id"))


def field_hits(words: DataFrame, fields: DataFrame) -> DataFrame:
    """Auxiliary texts whose keys start with a word, or that hold it in order; fields: field_items() or what it takes."""
    items = fields if "owner" in fields.columns else field_items(fields)
    keys = prefix_keys(items).select("entry_id", "key", F.lit(0).alias("score"), "complete")
    by_key = prefix_matches(words, keys).join(dealt(items.select("entry_id", "owner", "weight")), "entry_id").select("query_id", "pos", "owner", (F.col("weight") + F.col("score")).alias("score"))
    sub = subsequence_hits(words, items).join(dealt(items.select("entry_id", "owner")), "entry_id").select("query_id", "pos", "owner", (F.col("score") - SUBSEQUENCE).alias("score"))
    return by_key.unionByName(sub).groupBy("query_id", "pos", F.col("owner").alias("entry_id")).agg(F.max("score").cast("int").alias("score"))


def named(items: DataFrame) -> DataFrame:
    from quarry.operators.catalog import named as layer

    return layer(items)
