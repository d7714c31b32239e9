"""Helpers shared by the corpus operators: table access, shared-folder tables, hashing, words.

Every operator selects the columns it needs by name and gives its own names to all others, so
extra input columns, whatever they are called, neither clash nor travel through a shuffle.
"""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: what separates words in every operator here.
WS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session (as in tests) gets a
    temporary folder, which is then set on the context; on a cluster that is an error, since no other machine would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    master = spark.sparkContext.master
    if not re.match(r"local(\[.*)?$", master):
        raise ValueError(f"spark.checkpoint.dir is not set; under {master} it must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
    return jsc.getCheckpointDir().get()


#: Paths of written() tables that are not yet released, while scratch() is open.
_OPEN: list[list[str]] = []


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read back: cuts the lineage, survives lost
    executors, and makes what follows see one fixed set of rows."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quarry_path = path
    if _OPEN:
        _OPEN[-1].append(path)
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a written() table that nothing reads any more."""
    _delete(df.sparkSession, df._quarry_path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settled(spark: SparkSession, make, name: str) -> DataFrame:
    """make(), written; all tables that were written on the way are deleted afterwards."""
    _OPEN.append([])
    try:
        out = written(make(), name)
        for path in _OPEN[-1]:
            if path != out._quarry_path:
                _delete(spark, path)
        return out
    finally:
        _OPEN.pop()


def small(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its known row count is within the bound; else as it is (the
    planner then shuffles, and adaptive execution splits the skewed partitions)."""
    return F.broadcast(df) if rows <= most else df


def u32(c: Column) -> Column:
    return c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def quoted(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def filtered(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs, all columns as they are, that judge (from Arrow batches of two columns, doc_id and text, to a list of booleans each)
    keeps. Columns travel under plain names, since a column's own may be one that Python functions don't take."""
    names = docs.columns
    at = [names.index(c) for c in ("doc_id", "text")]
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.select(at)), pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)


#: Bytes of text that a worker looks at together, and symbols of a longer text.
BATCH, PIECE = 4 << 20, 1 << 20
_GAP = re.compile(r"[ \t-\r]")


def by_bytes(batch: pa.RecordBatch, most: int = BATCH):
    """The batch (doc_id, text) in slices of at most so many bytes of text, or one row."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def pieces(text: str, most: int = PIECE):
    """A text cut at white space into pieces of about so many symbols, so that a very long one never lies in a worker as a list of words."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + most) if len(text) - at > most else None
        to = gap.start() if gap else len(text)
        yield text[at:to] if at or gap else text
        at = to
