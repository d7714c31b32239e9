"""Change events from watcher logs: folders of JSON lines that grow, read as a stream or a batch.

A line: seq, ms (milliseconds), mask (the kernel's event bits), path, cookie. A watcher that lost events writes the overflow bit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LINE = "seq long, ms long, mask long, path string, cookie long"
#: Event bits, in the order in which the first that is set decides.
BITS = (("overflow", 0x4000), ("moved_from", 0x40), ("moved_to", 0x80), ("create", 0x100), ("delete", 0x200 | 0x400 | 0x800), ("attrib", 0x2 | 0x4 | 0x8))
IS_DIR = 0x40000000


def kind(mask: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, bits in reversed(BITS):
        out = F.when(mask.bitwiseAND(F.lit(bits)) != 0, name).otherwise(out)
    return out


def events(lines: DataFrame) -> DataFrame:
    """Lines (value) as events: seq, ts, kind, path, cookie, is_dir. Lines that are no events give nothing; events without a path
    other than overflows count as lost ones."""
    got = lines.select(F.from_json("value", LINE).alias("e")).select("e.*").where("mask IS NOT NULL AND ms IS NOT NULL")
    found = F.when(F.col("path").isNull(), "overflow").otherwise(kind(F.col("mask")))
    rows = got.select("seq", F.timestamp_millis("ms").alias("ts"), found.alias("kind"), "path", "cookie", (F.col("mask").bitwiseAND(F.lit(IS_DIR)) != 0).alias("is_dir"))
    return rows.where("kind IS NOT NULL")


def stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events of a folder of logs, as a stream: new files are read as they come."""
    return events(spark.readStream.text(folder))
