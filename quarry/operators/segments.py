"""Index tables of a catalog: built once, written as Parquet, searched many times; and a base with a delta on top of it."""

from __future__ import annotations

from dataclasses import dataclass, fields as members

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import catalog, channels
from quarry.plans.shared import fixed


@dataclass
class Segment:
    """The tables that search reads; those that a catalog has no use for are None."""

    entries: DataFrame  # with the text layer, mask and repeats
    keys: DataFrame  # prefix keys by edge
    terms: DataFrame
    grams: DataFrame
    frequent: DataFrame  # grams that say nothing
    folders: DataFrame | None = None
    fields: DataFrame | None = None

    def tables(self) -> dict[str, DataFrame]:
        return {m.name: getattr(self, m.name) for m in members(self) if getattr(self, m.name) is not None}


def build(items: DataFrame, dirs: DataFrame | bool | None = None, fields: DataFrame | None = None, roots: DataFrame | None = None, frequent: DataFrame | None = None) -> Segment:
    """The segment of entries, which are written once (every other table is made from them). dirs: folders whose names count (True: those above the
    entries), but for those above all roots. frequent: the base's, for a delta."""
    entries = fixed(catalog.named(items).withColumn("mask", T.mask(F.col("norm"))).withColumn("repeats", T.repeat_mask(F.col("norm"))))
    grams = channels.gram_index(entries)
    if dirs is True:
        dirs = catalog.folders(entries)
    if dirs is None or dirs is False:
        dirs = None
    else:
        dirs = fixed(catalog.named(dirs if roots is None else catalog.usable_folders(dirs, roots)))
    return Segment(entries, channels.edged(channels.prefix_keys(entries)), channels.typo_terms(entries), grams, channels.frequent_grams(grams, entries) if frequent is None else frequent, dirs, None if fields is None else fixed(channels.field_items(fields)))


#: By what the rows of a table lie together, so that a batch of words reads few row groups.
LIES_BY = {"entries": "entry_id", "keys": "edge", "terms": "term", "grams": "gram", "frequent": "gram", "folders": "folder", "fields": "owner"}


def write(segment: Segment, path: str) -> None:
    """Write the tables, each sorted by what it is joined on."""
    for name, table in segment.tables().items():
        table.repartitionByRange(LIES_BY[name]).sortWithinPartitions(LIES_BY[name]).write.parquet(f"{path}/{name}")


def read(spark: SparkSession, path: str, names: list[str] | None = None) -> Segment:
    """The tables that write() left at path (names: which; those of a catalog without folders or fields by default)."""
    names = names or [m.name for m in members(Segment) if m.name not in ("folders", "fields")]
    return Segment(**{n: spark.read.parquet(f"{path}/{n}") for n in names})


def merged(base: Segment, delta: Segment, gone: DataFrame) -> Segment:
    """Base and delta as one view: the delta's entries replace the base's of the same id, gone (entry_id) are hidden. What
    grams say nothing is the base's affair, so a delta does not change its own scores."""
    hidden = gone.select("entry_id").union(delta.entries.select("entry_id")).distinct()

    def both(a: DataFrame, b: DataFrame, key: str = "entry_id") -> DataFrame:
        return a.join(hidden.withColumnRenamed("entry_id", key), key, "left_anti").select(*a.columns).unionByName(b.select(*a.columns))

    folders = base.folders if delta.folders is None else delta.folders if base.folders is None else base.folders.unionByName(delta.folders).dropDuplicates(["folder"])
    extra = base.fields if delta.fields is None else delta.fields if base.fields is None else both(base.fields, delta.fields, "owner")
    return Segment(both(base.entries, delta.entries), both(base.keys, delta.keys), both(base.terms, delta.terms), both(base.grams, delta.grams), base.frequent, folders, extra)
