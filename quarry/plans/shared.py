"""Tables that a plan reads more than once and must see the same each time: written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a batch of queries, or of their words, is broadcast.
BATCH = 10_000


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder for a local session, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        if not re.match(r"local(\[.*)?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return context.getCheckpointDir().get()


def fixed(df: DataFrame) -> DataFrame:
    """df, written as Parquet and read back."""
    path = f"{folder(df.sparkSession)}/fixed-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows: looks no further than that."""
    return len(df.select("*").limit(most + 1).take(most + 1)) <= most


def sent(df: DataFrame, of: DataFrame | None = None, most: int = BATCH) -> DataFrame:
    """df, to be broadcast in its next join if it is made from at most `most` rows of a batch (of: df itself if absent)."""
    of = df if of is None else of
    return F.broadcast(df) if not of.isStreaming and few(of, most) else df


def dealt(df: DataFrame) -> DataFrame:
    """df, never to be broadcast in its next join (unless the other side is): Spark takes the bytes of compressed files for its size, and rows
    of a catalog, exploded, are many times that in the driver."""
    return df.hint("merge")
