"""Catalog maintenance as snapshot transforms: each gives the next snapshot, or what changes, as a DataFrame.

saved: id long, path, is_dir, mtime, size, identity. scan: the same without id. Nothing is updated in place: the caller
writes what it gets as a new version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import extension
from quarry.operators.catalog import self_and_ancestors
from quarry.plans.shared import fixed

SIGNATURE = ("is_dir", "mtime", "size", "identity")


def _signature(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in SIGNATURE])


def diff(saved: DataFrame, scan: DataFrame) -> DataFrame:
    """path, id, verdict: new, names (kind or identity changed), metadata (time or size only), same, unseen."""
    old = saved.select("path", "id", *[F.col(c).alias(f"_o_{c}") for c in SIGNATURE], F.lit(True).alias("_old"))
    met = old.join(scan.select("path", *SIGNATURE, F.lit(True).alias("_new")), "path", "full_outer")
    same = lambda c: F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    other = replaced(F.col("_o_identity"), F.col("identity"))
    stamped = F.col("identity").isNotNull() & ~same("identity")
    verdict = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "unseen").when(~same("is_dir") | other, "names").when(~same("mtime") | ~same("size") | stamped, "metadata").otherwise("same")
    return met.select("path", "id", verdict.alias("verdict"))


def upserted(saved: DataFrame, scan: DataFrame) -> DataFrame:
    """The snapshot after a scan's rows went in. A row whose object was replaced (another identity) goes with all below
    it and comes back under a new id; new ids follow the greatest one in path order."""
    old = saved.select("path", "id", *[F.col(c).alias(f"_o_{c}") for c in SIGNATURE])
    met = scan.select("path", *SIGNATURE, F.lit(True).alias("_new")).join(old, "path", "full_outer")
    others = met.where(F.col("_new") & replaced(F.col("_o_identity"), F.col("identity"))).select(F.col("path").alias("_up"))
    under = met.select("path", F.explode(self_and_ancestors(F.col("path"))).alias("_up")).join(others, "_up", "left_semi").select("path").distinct().withColumn("_gone", F.lit(True))
    met = met.join(under, "path", "left")
    # an unseen row below a replaced folder is gone; a seen one gets a new id
    met = met.where(~(F.coalesce("_gone", F.lit(False)) & F.col("_new").isNull())).withColumn("id", F.when(F.col("_gone"), None).otherwise(F.col("id")))
    new = lambda c: F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_o_{c}"))
    rows = met.select("id", "path", new("is_dir").alias("is_dir"), new("mtime").alias("mtime"), new("size").alias("size"), F.when(F.col("_gone"), F.col("identity")).otherwise(F.coalesce("identity", "_o_identity")).alias("identity"))
    return numbered(rows, saved)


def numbered(rows: DataFrame, saved: DataFrame) -> DataFrame:
    """rows with ids where they are null: after the greatest saved one, in path order. New rows are dealt out by ranges of the path, each
    range is counted and numbered by itself, and starts where the ranges before it end: no task sees them all."""
    top = saved.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    fresh = fixed(rows.where("id IS NULL").drop("id").repartitionByRange("path").withColumn("_b", F.spark_partition_id()))
    # one row for each range: some thousands for terabytes
    before = fresh.groupBy("_b").agg(F.min("path").alias("_from"), F.count("*").alias("_n")).withColumn("_base", F.sum("_n").over(W.orderBy("_from")) - F.col("_n"))
    given = fresh.join(F.broadcast(before.select("_b", "_base")), "_b").withColumn("_r", F.row_number().over(W.partitionBy("_b").orderBy("path")))
    given = given.join(F.broadcast(top)).select((F.col("_top") + F.col("_base") + F.col("_r")).alias("id"), *[c for c in rows.columns if c != "id"])
    return rows.where("id IS NOT NULL").unionByName(given)


#: Kinds of a stored identity: of a change time, of a birth time, and what a rename leaves (device and inode only).
CHANGED, BORN, RENAMED = 0, 1, 2
#: Bytes of kind, and of device and inode, in a stored identity.
KIND_BYTES, OBJECT_BYTES, IDENTITY_BYTES = 1, 16, 29


def _little(c: Column, size: int) -> Column:
    """The least `size` bytes of a number, least first."""
    digits = F.lpad(F.hex(c.cast("long")), 16, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.substring(digits, 17 - 2 * i, F.lit(2))), ""))


def identity(birth: Column, device: Column, inode: Column, sec: Column, nsec: Column) -> Column:
    """29 bytes that name a file system object: kind, device, inode, seconds and nanoseconds of its birth or change."""
    return F.concat(F.when(birth, F.unhex(F.lit("01"))).otherwise(F.unhex(F.lit("00"))), _little(device, 8), _little(inode, 8), _little(sec, 8), _little(nsec, 4))


def identity_parts(c: Column) -> Column:
    """kind, device, inode, sec, nsec of an identity."""

    def number(at: int, size: int) -> Column:
        digits = F.hex(F.substring(c, at, size))
        turned = F.array_join(F.transform(F.sequence(F.lit(size), F.lit(1), F.lit(-1)), lambda i: F.substring(digits, 2 * i - 1, F.lit(2))), "")
        return F.conv(turned, 16, -10).cast("long")

    return F.when(F.length(c) == IDENTITY_BYTES, F.struct(number(1, 1).cast("int").alias("kind"), number(2, 8).alias("device"), number(10, 8).alias("inode"), number(18, 8).alias("sec"), number(26, 4).alias("nsec")))


def replaced(saved: Column, incoming: Column) -> Column:
    """Whether another object has a path now: device and inode differ, or all bytes do unless a rename took the rest. Unknown identities
    are adopted."""
    saved, incoming = saved.cast("binary"), incoming.cast("binary")
    of_object = lambda c: F.substring(c, KIND_BYTES + 1, OBJECT_BYTES)
    renamed = F.substring(saved, 1, KIND_BYTES) == F.unhex(F.lit("02"))
    return F.coalesce((of_object(saved) != of_object(incoming)) | (~renamed & (saved != incoming)), F.lit(False))


def pruned(saved: DataFrame, seen: DataFrame, scope: str, kept: DataFrame, roots: DataFrame) -> DataFrame:
    """The snapshot without rows of the scope that were not seen, but for kept subtrees and roots nested in the scope.

    Ancestors are exploded, so every test is an equi-join; no NOT IN, no theta join."""
    inside = saved.where(_in_scope(F.col("path"), scope))
    lost = inside.join(seen.select("path"), "path", "left_anti")
    shields = kept.select("path").unionByName(roots.select("path").where(F.col("path").startswith(scope.rstrip("/") + "/"))).distinct()
    safe = lost.select("path", F.explode(self_and_ancestors(F.col("path"))).alias("_up")).join(shields.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return saved.join(lost.join(safe, "path", "left_anti").select("path"), "path", "left_anti").select(*saved.columns)


def pruned_children(saved: DataFrame, seen: DataFrame, folder: str) -> DataFrame:
    """The snapshot without what lies under children of a folder that were not seen."""
    depth = len([p for p in folder.split("/") if p]) + 1
    child = F.concat(F.lit("/"), F.array_join(F.slice(F.filter(F.split("path", "/"), lambda p: p != ""), 1, depth), "/"))
    below = saved.where(F.col("path").startswith(folder.rstrip("/") + "/")).select("path", child.alias("_child"))
    lost = below.join(seen.select(F.col("path").alias("_child")), "_child", "left_anti").select("path")
    return saved.join(lost, "path", "left_anti").select(*saved.columns)


def pruned_exactly(saved: DataFrame, gone: DataFrame, seen: DataFrame, kept: DataFrame) -> DataFrame:
    """The snapshot without the ids declared gone, unless seen after all or below a kept folder."""
    lost = saved.join(gone.select("id"), "id", "left_semi").join(seen.select("path"), "path", "left_anti")
    safe = lost.select("path", F.explode(self_and_ancestors(F.col("path"))).alias("_up")).join(kept.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return saved.join(lost.join(safe, "path", "left_anti").select("path"), "path", "left_anti").select(*saved.columns)


def moved(saved: DataFrame, old: str, new: str) -> DataFrame:
    """The snapshot after a folder or file moved: what was at the new place goes, and paths get the new prefix. Where the table has them, the moved
    row's name and ext are its new ones, embeddings (columns emb_*) of all that moved are dropped, and identities of a change time keep
    device and inode only, so that the next scan adopts the new one. Nothing happens if nothing was at the old place."""
    if old == new or old.startswith(new + "/") or new.startswith(old + "/"):
        raise ValueError("a path cannot be moved into itself")
    at = lambda p: (F.col("path") == p) | F.col("path").startswith(p + "/")
    found = saved.agg((F.count(F.when(F.col("path") == old, 1)) > 0).alias("_there"))  # one row
    rows = saved.join(F.broadcast(found))
    rows = rows.where(~(F.col("_there") & at(new)))
    goes, itself = F.col("_there") & at(old), F.col("_there") & (F.col("path") == old)
    name = new.rsplit("/", 1)[1]
    to = {"path": F.when(goes, F.concat(F.lit(new), F.substring(F.col("path"), len(old) + 1, 1 << 20))).otherwise(F.col("path"))}
    if "name" in saved.columns:
        to["name"] = F.when(itself, F.lit(name)).otherwise(F.col("name"))
    if "ext" in saved.columns:
        to["ext"] = F.when(itself, extension(F.lit(name), F.col("is_dir"))).otherwise(F.col("ext"))
    if dict(saved.dtypes).get("identity") == "binary":
        stripped = F.concat(F.unhex(F.lit("02")), F.substring("identity", KIND_BYTES + 1, OBJECT_BYTES), F.unhex(F.lit("00" * 12)))
        to["identity"] = F.when(goes & (F.substring("identity", 1, KIND_BYTES) == F.unhex(F.lit("00"))), stripped).otherwise(F.col("identity"))
    to |= {c: F.when(~goes, F.col(c)) for c in saved.columns if c.startswith("emb_")}
    return rows.withColumns(to).select(*saved.columns)


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, kind: inserted, updated (path or kind: what an index must know), metadata, deleted."""
    a = before.select("id", *[F.col(c).alias(f"_b_{c}") for c in ("path", *SIGNATURE)], F.lit(True).alias("_was"))
    met = a.join(after.select("id", "path", *SIGNATURE, F.lit(True).alias("_is")), "id", "full_outer")
    same = lambda *cs: F.struct(*cs).eqNullSafe(F.struct(*[F.col(f"_b_{c}").alias(c) for c in cs]))
    kind = F.when(F.col("_was").isNull(), "inserted").when(F.col("_is").isNull(), "deleted").when(~same("path", "is_dir"), "updated").when(~same(*SIGNATURE), "metadata")
    return met.select("id", kind.alias("kind")).where("kind IS NOT NULL")


def captured(changed: DataFrame, most: int) -> DataFrame:
    """changed (id, kind), up to `most` rows by id, each with `overflow`: whether there were more. A reader that sees it must look at
    everything again. The limit runs in each task first."""
    over = changed.agg((F.count("*") > most).alias("overflow"))
    return changed.orderBy("id").limit(most).join(F.broadcast(over))


#: What a pass counts.
COUNTERS = ("scanned", "unreadable", "new", "names", "metadata", "same", "unseen")


def counted(verdicts: DataFrame, scan: DataFrame) -> DataFrame:
    """One row of counters of a pass: rows scanned and unreadable, and rows of each verdict of diff()."""
    each = verdicts.agg(*[F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in COUNTERS[2:]])
    unreadable = F.count(F.when(F.col("unreadable"), 1)) if "unreadable" in scan.columns else F.lit(0).cast("long")
    return scan.agg(F.count("*").alias("scanned"), unreadable.alias("unreadable")).join(F.broadcast(each))


def observed(changed: DataFrame, name: str = "pass"):
    """(changed, an observation of how many rows of each kind go by when it is written): counters without a second job."""
    seen = Observation(name)
    kinds = ("inserted", "updated", "metadata", "deleted")
    return changed.observe(seen, *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds]), seen


def pending(kept: DataFrame, touched: DataFrame, committed: DataFrame) -> DataFrame:
    """The delta's next rows: kept rows that were not touched, and the touched ids' committed rows."""
    return kept.join(touched.select("id"), "id", "left_anti").unionByName(committed.join(touched.select("id"), "id", "left_semi"))


def with_root_flag(saved: DataFrame, roots: DataFrame) -> DataFrame:
    marks = roots.select("path", F.lit(True).alias("_root")).distinct()
    return saved.join(marks, "path", "left").withColumn("is_root", F.coalesce("_root", F.lit(False))).drop("_root")


def statistics(saved: DataFrame) -> DataFrame:
    return saved.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col("is_dir"), 1)).alias("n_dirs"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max(F.length("path")).alias("longest_path"))


def _in_scope(path: Column, scope: str) -> Column:
    return F.lit(True) if scope == "/" else (path == scope) | path.startswith(scope.rstrip("/") + "/")



def forgotten(saved: DataFrame, roots: DataFrame, seen: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The snapshot and the roots after a root was unregistered: what of it no scan has seen goes."""
    left = roots.where(F.col("path") != root)
    return pruned(saved, seen, root, seen.where("false"), left), left


def activated(models: DataFrame, cache: DataFrame, used: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """The model registry (emb_gen) and embedding cache (emb_gen, text, ...) with only the active generation, and of its cache
    only the texts that are used."""
    return models.where(F.col("emb_gen") == generation), cache.where(F.col("emb_gen") == generation).join(used.select("text").distinct(), "text", "left_semi")


def published(before: DataFrame, after: DataFrame, generation: int) -> tuple[int, bool, bool]:
    """The generation after a commit, whether anything changed, and whether an index must be published: times and sizes
    alone are committed but not published."""
    kinds = {r.kind for r in changes(before, after).select("kind").distinct().collect()}  # four values at most
    return generation + bool(kinds), bool(kinds), bool(kinds - {"metadata"})


def status(saved: DataFrame, opens: DataFrame) -> DataFrame:
    """One JSON line of counters."""
    a = statistics(saved)
    b = opens.agg(F.count("*").alias("n_opens"), F.max("ts").alias("last_open"))
    return a.join(F.broadcast(b)).select(F.to_json(F.struct("n_rows", "n_dirs", "bytes", "n_opens", "last_open")).alias("value"))


# --- versions ----------------------------------------------------------------------------------------------


def commit(tables: dict[str, DataFrame], path: str, generation: int) -> None:
    """Write tables as one generation. A generation is a folder of its own that is never changed: readers of another one go on undisturbed. Its
    marker is written last, so a generation is there whole or not at all."""
    for name, df in tables.items():
        df.write.parquet(f"{path}/gen={generation:020d}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(generation, sorted(tables))], "generation long, tables array<string>").coalesce(1).write.json(f"{path}/gen={generation:020d}/_marker")


def generations(spark: SparkSession, path: str) -> list[int]:
    """The generations at path that are whole, in order."""
    fs, base = _fs(spark, path)
    if not fs.exists(base):
        return []
    found = [s.getPath() for s in fs.listStatus(base)]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(int(p.getName()[4:]) for p in found if p.getName().startswith("gen=") and fs.exists(hadoop(p, "_marker/_SUCCESS")))


def load(spark: SparkSession, path: str, names: list[str], generation: int | None = None) -> tuple[int, dict[str, DataFrame]]:
    """The tables of one generation (the latest), all of the same: (generation, tables)."""
    found = generations(spark, path)
    if generation is None and not found or generation is not None and generation not in found:
        raise ValueError(f"no generation {generation if generation is not None else ''} at {path}")
    generation = found[-1] if generation is None else generation
    return generation, {n: spark.read.parquet(f"{path}/gen={generation:020d}/{n}") for n in names}


def vacuum(spark: SparkSession, path: str, keep: set[int]) -> list[int]:
    """Delete all generations but the latest and those that readers hold; gives the deleted ones."""
    fs, base = _fs(spark, path)
    gone = [g for g in generations(spark, path)[:-1] if g not in keep]
    for g in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(base, f"gen={g:020d}"), True)
    return gone


def integrity(saved: DataFrame) -> DataFrame:
    """One row of counts that must be 0: rows without an id or path, repeated ids, repeated paths, paths that do not begin with /."""
    ids = saved.groupBy("id").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_ids"))
    paths = saved.groupBy("path").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_paths"))
    empty = saved.agg(F.count(F.when(F.col("id").isNull() | F.col("path").isNull(), 1)).alias("empty"), F.count(F.when(~F.col("path").startswith("/"), 1)).alias("relative"))
    return empty.join(F.broadcast(ids)).join(F.broadcast(paths))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
