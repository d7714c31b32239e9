"""The semantic stage: which queries it takes, what text stands for an entry, which rows a change touches, and the two answers.

rows: id, path, is_dir, revision, text_hash; vectors lie beside them by text_hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scalars import desktop_embedding_text, embedding_text
from quarry.operators import vectors

#: Fixed value: queries of fewer bytes stay lexical.
LEAST_BYTES = 3


def eligible(query: Column) -> Column:
    """Whether a query goes to the semantic stage: valid text of LEAST_BYTES bytes and more, without a path in it."""
    return (F.octet_length(query) >= LEAST_BYTES) & F.is_valid_utf8(query) & ~F.contains(query, F.lit("/"))


def file_rows(entries: DataFrame) -> DataFrame:
    text = embedding_text(F.col("path"))
    return entries.select(F.col("entry_id").alias("id"), "path", "is_dir", F.lit(0).cast("long").alias("revision"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def desktop_rows(apps: DataFrame) -> DataFrame:
    """Rows of applications (entry_id, path, name, generic_name, keywords array, revision)."""
    text = desktop_embedding_text(F.col("name"), F.col("generic_name"), F.array_join("keywords", ";"))
    return apps.select(F.col("entry_id").alias("id"), "path", F.lit(False).alias("is_dir"), "revision", text.alias("text"), F.xxhash64(text).alias("text_hash"))


def staged(view: DataFrame, touched: DataFrame, fresh: DataFrame) -> DataFrame:
    """What a stage does with each id that may have changed (touched), and with the rows it owns already (view with owned: true): id,
    action. carry: an own row that was not touched; hide: gone; keep: equal to the shared base row; copy: another row with the same text, so its
    vector is copied; embed: a new text."""
    cols = ("path", "is_dir", "revision", "text_hash")
    old = view.select("id", "owned", F.struct(*cols).alias("_was"))
    ids = touched.select("id", F.lit(True).alias("_touched")).distinct()
    new = fresh.select("id", F.struct(*cols).alias("_is"))
    met = old.join(ids, "id", "full_outer").join(new, "id", "left")
    action = (
        F.when(F.col("_touched").isNull(), F.when(F.col("owned"), "carry"))
        .when(F.col("_is").isNull(), "hide")
        .when(~F.coalesce("owned", F.lit(False)) & F.col("_was").eqNullSafe(F.col("_is")), "keep")
        .when(F.col("_was.text_hash") == F.col("_is.text_hash"), "copy")
        .otherwise("embed")
    )
    return met.select("id", action.alias("action")).where("action IS NOT NULL")


def with_vectors(rows: DataFrame, cache: DataFrame, vocabulary: DataFrame, tokens) -> DataFrame:
    """rows (id, text, text_hash) with v: the cached vector of the text, or, where there is none, the mean of its tokens' vectors. Each missing
    text is embedded once. tokens: a function from the text column to its tokens."""
    held = cache.select("text_hash", "v").dropDuplicates(["text_hash"])
    missing = rows.select("text_hash", "text").dropDuplicates(["text_hash"]).join(held, "text_hash", "left_anti")
    made = vectors.pooled(missing.select(F.col("text_hash").alias("id"), tokens(F.col("text")).alias("tokens")), vocabulary)
    return rows.join(held.unionByName(made.withColumnRenamed("id", "text_hash")), "text_hash", "left")


def answered(lexical: DataFrame, semantic: DataFrame, queries: DataFrame, deadline_ms: int = 200) -> DataFrame:
    """The final answer of each query: fused where the semantic list came in time, else the lexical one. queries: query_id, text,
    took_ms (null: never came), superseded. Output: the fused rows and `answer` (fused, semantic_deadline, lexical); superseded queries have none."""
    state = F.when(~eligible(F.col("text")), "lexical").when(F.coalesce(F.col("took_ms") < deadline_ms, F.lit(False)), "fused").otherwise("semantic_deadline")
    asked = queries.where(~F.coalesce("superseded", F.lit(False))).select("query_id", state.alias("answer"))
    late = semantic.join(asked.where("answer = 'fused'").select("query_id"), "query_id", "left_semi")
    return vectors.fused(lexical.join(asked.select("query_id"), "query_id", "left_semi"), late).join(asked, "query_id")
