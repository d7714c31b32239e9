"""Token-id files: Parquet with a list column, in ascending document order.

Row groups are bounded in rows and bytes; pages are bounded in rows, so the page index lets a reader fetch the
tokens of few documents. Columns are dictionary-encoded while the dictionary stays small, and
delta-encoded (format version 2) beyond it. Metadata columns (part, doc_id, n_tokens, start_in_part) stand beside the
list and can be read without it.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import shared_dir, small
from quarry.llm.tokens import encoder

SCHEMA = "part int, row long, doc_id long, n_tokens long, start_in_part long, tokens array<int>"
#: Parquet writer settings: size of row groups and pages in bytes, rows of a page, size of a dictionary.
LAYOUT = {
    "parquet.block.size": str(32 << 20), "parquet.page.size": str(256 << 10), "parquet.page.row.count.limit": "256",
    "parquet.block.row.count.limit": "16384", "parquet.enable.dictionary": "true", "parquet.dictionary.page.size": str(256 << 10),
    "parquet.writer.version": "v2", "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, out: str | None = None, end_id: int = 2, partitions: int | None = None, layout: dict[str, str] = LAYOUT) -> str:
    """Encode docs (doc_id, text) and write the ids, with end_id after each document; gives the path.

    A null text counts as empty (its end id only). Null ids come first; rows with one id stand
    together in the order of their texts' hashes; an empty table writes an empty file; other columns are ignored.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"

    def run(batches):
        from pyspark import TaskContext

        enc, part, row, start = encoder(path), TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            at = 0
            for ids, n in enc.encoded(batch.column(1)):
                who = batch.column(0).slice(at, len(n)).cast(pa.int64())
                ids, n, at = np.insert(ids, np.cumsum(n), end_id), n + 1, at + len(n)
                ends = np.cumsum(n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), part, np.int32)), pa.array(np.arange(row, row + len(n))), who, pa.array(n), pa.array(start + ends - n),
                    pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32))),
                ], ["part", "row", "doc_id", "n_tokens", "start_in_part", "tokens"])
                row, start = row + len(n), start + int(ends[-1])

    order = [F.col("doc_id"), F.xxhash64("text")]
    sorted_ = docs.select("doc_id", "text")
    sorted_ = sorted_.repartitionByRange(partitions, *order) if partitions else sorted_.repartitionByRange(*order)
    sorted_.sortWithinPartitions(*order).mapInArrow(run, SCHEMA).write.options(**layout).parquet(out)
    return out


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Everything but the tokens, with each document's start in the whole corpus."""
    return _started(spark, path).drop("tokens", "part", "row", "start_in_part")


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, tokens; of the given documents only (pushed down to pages), or of all."""
    found = _started(spark, path)
    if doc_ids is not None:
        found = found.where(F.col("doc_id").isin(doc_ids))
    return found.select("doc_id", "start", "n_tokens", "tokens")


def _started(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(SCHEMA).parquet(path)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n"))  # metadata pages only
    # one row for each file: few thousand for terabytes; the running sum is over those alone
    base = sums.select("part", (F.sum("_n").over(W.orderBy("part")) - F.col("_n")).alias("_base"))
    return rows.join(small(base, 0, 1), "part").withColumn("start", F.col("_base") + F.col("start_in_part"))


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens() gives, from its tokens."""

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            flat, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
