"""Vector retrieval: cosine by floats and by bytes, two-pass shortlists, fusion of ranked lists.

vectors: id long, v array<float>, stored at unit length (prepared()); asked: query_id, v: a batch of queries, which is broadcast within a
bound, in blocks beyond it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.text import bound

#: The least cosine of a hit, first-pass dimensions and rows, the constant of rank fusion.
THRESHOLD, HEAD, SHORTLIST, RRF_K = 0.2, 128, 8000, 60
#: Decimal places in which cosines are compared.
PLACES = 9
#: Bytes of queries that are broadcast at once, and cells of a product that a worker holds.
QUERY_BYTES, CELLS = 32 << 20, 4_000_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null if it is zero or not finite. The vector and its norm are worked out once, not for each coordinate."""
    scaled = lambda v, n: F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.transform(v, lambda x: x / n))
    return bound(a, lambda v: bound(norm(v), lambda n: scaled(v, n)))


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def quantised(a: Column) -> Column:
    """Bytes: 127 times the unit vector, rounded half away from zero."""
    return F.transform(unit(a), lambda x: F.round(x * 127).cast("tinyint"))


def sign_bits(a: Column) -> Column:
    """One bit for each coordinate (set where it is negative), 32 in a long."""
    words = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 32).cast("int"))
    return F.transform(words, lambda w: F.aggregate(F.slice(a, w * 32 + 1, F.lit(32)), F.struct(F.lit(0).cast("long").alias("m"), F.lit(1).cast("long").alias("b")), lambda s, x: F.struct((s["m"] + F.when(x < 0, s["b"]).otherwise(0)).alias("m"), (s["b"] * 2).alias("b")), lambda s: s["m"]))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def settled(cosine: Column) -> Column:
    """The cosine in units of its last place that counts: sums in another order differ beyond it, so equal vectors would be ranked by chance."""
    return F.floor(cosine * 10.0**PLACES + 0.5)


def top(rows: DataFrame, score: str, k: int) -> DataFrame:
    """The k rows with the greatest score of each query, ids ascending among equals."""
    order = W.partitionBy("query_id").orderBy(F.desc(score), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(rows: DataFrame, k: int) -> DataFrame:
    """top() of rows with a cosine, as far as it counts."""
    return top(rows.withColumn("_near", settled(F.col("cosine"))), "_near", k).drop("_near")


def _met(vectors: DataFrame, asked: DataFrame, threshold: float | None, head: int | None = None) -> DataFrame:
    """query_id, id, cosine of asked (query_id, v) against vectors (id, v), both of unit length. The queries are one matrix, broadcast within a
    bound on its bytes, or in blocks of them; each Arrow batch of vectors meets it in one product. No row leaves the worker that
    is below the threshold."""
    spark = vectors.sparkSession
    found = asked.where("v IS NOT NULL").select("query_id", F.transform("v", lambda x: x.cast("double")).alias("v")).collect()  # a batch of queries
    out = spark.createDataFrame([], f"query_id {asked.schema['query_id'].dataType.simpleString()}, id long, cosine double")
    kind = to_arrow_type(asked.schema["query_id"].dataType)
    step = max(1, QUERY_BYTES // max(8 * len(found[0].v), 1)) if found else 1
    for at in range(0, len(found), step):
        block = found[at : at + step]
        sent = spark.sparkContext.broadcast((np.array([r.query_id for r in block]), np.array([r.v for r in block], np.float64)))

        def run(batches, sent=sent):
            ids, matrix = sent.value
            for batch in batches:
                batch = batch.filter(batch.column(1).is_valid())
                if not batch.num_rows:
                    continue
                # as many rows at a time as give a bounded product
                for part in (batch.slice(i, CELLS // len(ids) + 1) for i in range(0, batch.num_rows, CELLS // len(ids) + 1)):
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                    if head is None:
                        cos = np.clip(v @ matrix.T, -1, 1)
                    else:
                        length = np.sqrt((v[:, :head] ** 2).sum(1))
                        cos = np.divide(v[:, :head] @ matrix[:, :head].T, length[:, None], out=np.zeros((len(v), len(ids))), where=length[:, None] > 0)
                    row, query = np.nonzero(cos >= threshold) if threshold is not None else np.nonzero(np.ones_like(cos, bool))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[query], kind), part.column(0).cast(pa.int64()).take(pa.array(row)), pa.array(cos[row, query])], ["query_id", "id", "cosine"])

        out = out.unionByName(vectors.select("id", "v").mapInArrow(run, out.schema))
    return out


def prepared(vectors: DataFrame) -> DataFrame:
    """vectors (id, v) at length 1, to be stored once: no query works out a norm again. Zero and non-finite ones are null."""
    return vectors.withColumn("v", unit(F.col("v")))


def nearest(vectors: DataFrame, asked: DataFrame, k: int, threshold: float | None = THRESHOLD) -> DataFrame:
    """query_id, id, cosine, rank by float cosine over all rows, ids ascending where cosines are equal in PLACES places. Both sides prepared()."""
    return _best(_met(vectors, asked, threshold), k)


def ranked_all(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, id, rank of all rows by float cosine, each query's list whole. Cosines come from matrix products. Both sides prepared()."""
    rows = _met(vectors, asked, None).select("query_id", "id", settled(F.col("cosine")).alias("_near"))
    return rows.select("query_id", "id", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("_near"), "id")).alias("rank"))


def as_bytes(vectors: DataFrame) -> DataFrame:
    """vectors (v: unit length) as bytes, brought to length 1 again, so that products are cosines of the bytes."""
    return vectors.withColumn("v", unit(F.transform("v", lambda x: F.round(x * 127).cast("tinyint"))))


def nearest_bytes(vectors: DataFrame, asked: DataFrame, k: int, threshold: float | None = THRESHOLD) -> DataFrame:
    return nearest(as_bytes(vectors), as_bytes(asked), k, threshold)


def nearest_two_pass(vectors: DataFrame, asked: DataFrame, k: int, head: int = HEAD, shortlist: int = SHORTLIST) -> DataFrame:
    """A shortlist by the first `head` dimensions of the byte vectors, then all dimensions of its rows."""
    rows, q = as_bytes(vectors), as_bytes(asked)
    kept = top(_met(rows, q, None, head), "cosine", shortlist).select("query_id", "id")
    return _rescored(kept, rows, q, k)


def nearest_bits(vectors: DataFrame, asked: DataFrame, k: int, shortlist: int) -> DataFrame:
    """A shortlist by sign-bit distance, then float cosines of its rows."""
    q = F.broadcast(asked.select("query_id", sign_bits(F.col("v")).alias("_b")))  # a batch of queries
    rows = q.join(vectors.select("id", sign_bits(F.col("v")).alias("b"))).withColumn("_near", -hamming(F.col("b"), F.col("_b")))
    return _rescored(top(rows, "_near", shortlist).select("query_id", "id"), vectors, asked, k)


def _rescored(kept: DataFrame, vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of the kept (query_id, id) by all dimensions."""
    met = kept.join(vectors.select("id", "v"), "id").join(asked.select("query_id", F.col("v").alias("_q")), "query_id")
    return _best(met.select("query_id", "id", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("v"), F.col("_q")))).alias("cosine")), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row, recall: the share of the exact answers (query_id, id) that were found."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("_hit")), ["query_id", "id"], "left")
    return hits.agg((F.count("_hit") / F.count("*")).alias("recall"))


def pooled(texts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """id, v: the mean of the vectors (token, v) of a text's tokens (id, tokens); unknown tokens are left out."""
    each = texts.select("id", F.explode("tokens").alias("token")).join(vocabulary, "token").select("id", F.posexplode("v").alias("_d", "_x"))
    means = each.groupBy("id", "_d").agg(F.avg("_x").alias("_x"))
    return means.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("v"))


def reusable(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (id, text_hash) with the cached vector of that text, or null where it must be computed."""
    return wanted.join(cached.select("text_hash", "v").dropDuplicates(["text_hash"]), "text_hash", "left")


def fused(lexical: DataFrame, semantic: DataFrame, k: int = RRF_K, limit: int = 2000) -> DataFrame:
    """Reciprocal rank fusion of two lists (query_id, id, path, priority, rank).

    An id in both must have one path. Order: priority, fused score, lexical rank, path, id; where no semantic list exists,
    the lexical order stays."""
    a = lexical.select("query_id", "id", F.col("path").alias("_pa"), F.col("priority").alias("_ra"), F.col("rank").alias("lexical_rank"))
    b = semantic.select("query_id", "id", F.col("path").alias("_pb"), F.col("priority").alias("_rb"), F.col("rank").alias("semantic_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer").withColumn("_same", F.when(F.col("_pa").isNotNull() & F.col("_pb").isNotNull(), F.assert_true(F.col("_pa") == F.col("_pb"))))
    part = lambda r: F.when(F.col(r).isNotNull(), 1.0 / (F.lit(float(k)) + F.col(r))).otherwise(0.0)
    rows = both.where("_same IS NULL").select("query_id", "id", F.coalesce("_pa", "_pb").alias("path"), F.greatest("_ra", "_rb").alias("priority"), (part("lexical_rank") + part("semantic_rank")).alias("score"), "lexical_rank", "semantic_rank")
    lone = F.max(F.col("semantic_rank")).over(W.partitionBy("query_id")).isNull()
    keyed = rows.withColumn("_lone", lone)
    order = [F.desc(F.when(F.col("_lone"), 0).otherwise(F.col("priority"))), F.desc(F.when(F.col("_lone"), 0.0).otherwise(F.col("score"))), F.asc_nulls_last("lexical_rank"), F.asc("path"), F.asc("id")]
    return keyed.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= limit).drop("_lone")
