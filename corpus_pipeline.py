"""A corpus pipeline of five operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns documents with the
columns they came with (the last: packed pieces). run() writes each stage's result to the shared folder and reads
it back for the next, so no stage is worked out twice and a lost executor costs one stage's tasks at most; what a stage has
written on the way is deleted when its result stands.

All stages take any further columns of docs, whatever their names, and hand them on as they are (the last drops them); an empty
table gives an empty table with the same columns; texts are read whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontamination, langid, near_dups, packing, quality
from quarry.llm.common import settled, small, table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    A null or empty text goes. A null language or source is a value like any other. A null id stays if its text does. Repeated rows
    are judged each, alike; rows with one id and different texts may part."""
    return quality.kept_only(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised and not rejected.

    A null text, or one without a letter, goes. Rows without a label are not learned from, and are judged like others; without any
    label no language is known and every document goes. A null id counts as an empty one in the choice of rows to learn from.
    Repeated rows stay or go together."""
    training = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 != 2
    return langid.accepted_only(docs, langid.fit(docs, training))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id.

    Documents without words are in no group and stay, and so do those without an id. Rows that share an id are one document: all
    stay or all go."""
    gone = written(near_dups.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct(), "gone")
    return docs.join(small(gone, gone.count(), near_dups.BROADCAST), docs["doc_id"] == gone["_gone"], "left_anti")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item.

    A null or empty text holds none and stays, whatever its id. Items without an id or text match nothing. Repeated rows stay or go
    together."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of what is left: one row for each piece of a document.

    A null or empty text is its end token only. Null and repeated ids are packed like others."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Stages 2 to 5 cannot be expressed in SQL; tests/llm holds each stage against a brute-force version or the operator's own results.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
