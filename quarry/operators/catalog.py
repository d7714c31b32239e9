"""Catalog entries, folders and what follows from where an entry lies.

entries: entry_id long, path string, is_dir boolean, name string, folder string, and the text layer of the name.
Ancestors are exploded from paths, so every prefix relation between paths becomes an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans.shared import dealt

#: Folder names that mark installed or vendored trees; levels without penalty; penalties and their cap.
DEPENDENCY_NAMES = ("node_modules", "bower_components", "site-packages", "dist-packages", "vendor", "third_party", "third-party", "thirdparty", "sysroot", "sdk")
FREE_DEPTH, DEPTH_PENALTY, DEPENDENCY_PENALTY, PENALTY_MAX = 3, 24, 128, 256
#: Folders that scans leave out, beside hidden ones.
IGNORED_NAMES = ("node_modules", "bower_components", "site-packages", "dist-packages", "target", "build", "CMakeFiles", "__pycache__")


def entries(df: DataFrame, entry_id: Column, path: Column, is_dir: Column | None = None) -> DataFrame:
    """entry_id, path, is_dir, name, folder, and the text layer of the name (text.LAYER)."""
    base = df.select(entry_id.cast("long").alias("entry_id"), path.alias("path"), F.coalesce(is_dir, F.lit(False)).alias("is_dir") if is_dir is not None else F.lit(False).alias("is_dir"))
    # a compressed file of many short rows is read by one task: the text layer is worked out by all
    base = base if base.isStreaming else base.hint("rebalance")
    return named(base.select("*", T.basename(F.col("path")).alias("name"), T.parent(F.col("path")).alias("folder")))


def named(items: DataFrame) -> DataFrame:
    """items with the text layer of their `name`, if they have none yet."""
    return items if set(T.LAYER.names) <= set(items.columns) else T.layered(items)


def context_mask(path_norm: Column) -> Column:
    """The symbols of a name and of all folders above it: a word with another symbol finds nothing in them, in whatever order."""
    return T.mask(F.replace(path_norm, F.lit("/"), F.lit("")))


def ancestors(path: Column) -> Column:
    """Every folder above a path, nearest first, without the root of the file system."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    n = F.size(parts) - 1
    ups = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, k), "/")))
    return F.when(n >= 1, ups).otherwise(F.array().cast("array<string>"))


def self_and_ancestors(path: Column) -> Column:
    return F.concat(F.array(path), ancestors(path))


def within(path: Column, root: Column) -> Column:
    """Whether a path is a root or below it."""
    return (root == "/") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def folders(items: DataFrame) -> DataFrame:
    """folder, name and the text layer of every folder above an entry, each once."""
    each = items.select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    return named(each.select("folder", T.basename(F.col("folder")).alias("name")))


def descendants(items: DataFrame) -> DataFrame:
    """How many entries lie below each folder."""
    return items.select(F.explode(ancestors(F.col("path"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("n_entries"))


def with_root(items: DataFrame, roots: DataFrame) -> DataFrame:
    """items with `root`: the longest root at or above each path (null: none), by an equi-join on exploded ancestors."""
    ups = items.select("entry_id", F.explode(F.concat(self_and_ancestors(F.col("path")), F.array(F.lit("/")))).alias("_up"))
    found = dealt(ups).join(roots.select(F.col("path").alias("_up")), "_up").groupBy("entry_id").agg(F.max_by("_up", F.length("_up")).alias("root"))
    return items.join(found, "entry_id", "left")


def context_path(path: Column, root: Column) -> Column:
    """A path from its root's own name on."""
    return F.when(root == "/", path).otherwise(F.substring(path, F.length(root) - F.length(T.basename(root)) + 1, F.length(path)))


def dependency_name(norm: Column) -> Column:
    """Whether a folder's name marks installed or vendored software: a known name, a module with a version, a version."""
    return norm.isin(*DEPENDENCY_NAMES) | (norm == "@v") | norm.rlike("@v[0-9]") | norm.rlike("^v?[0-9]{1,3}(\\.[0-9]+)+$")


def place_penalty(path: Column, root: Column) -> Column:
    """What an entry's score loses for lying deep below its root, or in a dependency tree."""
    rel = F.filter(F.split(F.substring(path, F.when(root == "/", 1).otherwise(F.length(root) + 1), F.length(path)), "/"), lambda p: p != "")
    above = F.slice(rel, 1, F.greatest(F.size(rel) - 1, F.lit(0)))
    extra = F.greatest(F.size(above) - FREE_DEPTH, F.lit(0))
    dependency = F.exists(F.concat(above, F.array(T.basename(root))), lambda p: dependency_name(F.lower(p)))
    return F.least(extra * DEPTH_PENALTY + F.when(dependency, DEPENDENCY_PENALTY).otherwise(0), F.lit(PENALTY_MAX))


def ignored(path: Column) -> Column:
    """Whether a component of the path is hidden or names a generated tree."""
    return F.exists(F.split(path, "/"), lambda p: p.startswith(".") | p.isin(*IGNORED_NAMES))


def tool_managed(items: DataFrame) -> DataFrame:
    """folder of every tree that a tool manages: it holds a file pyvenv.cfg or .knownPackages, a folder conda-meta, or a
    file CACHEDIR.TAG that is signed (column signed; absent: no), or it is a module cache (mod with cache/download below)."""
    signed = F.col("signed") if "signed" in items.columns else F.lit(False)
    mark = (~F.col("is_dir") & F.col("name").isin("pyvenv.cfg", ".knownPackages")) | (F.col("is_dir") & (F.col("name") == "conda-meta")) | (~F.col("is_dir") & (F.col("name") == "CACHEDIR.TAG") & F.coalesce(signed, F.lit(False)))
    cache = items.where(F.col("is_dir") & F.col("path").endswith("/mod/cache/download")).select(F.regexp_replace("path", "/cache/download$", "").alias("folder"))
    return items.where(mark).select("folder").union(cache).distinct()


def outside(items: DataFrame, trees: DataFrame) -> DataFrame:
    """items that lie in none of the trees (folder)."""
    ups = items.select("path", F.explode(self_and_ancestors(F.col("path"))).alias("folder"))
    inside = ups.join(trees.select("folder"), "folder", "left_semi").select("path").distinct()
    return items.join(inside, "path", "left_anti").select(*items.columns)


def cover(roots: DataFrame) -> DataFrame:
    """roots without those that another root covers."""
    ups = roots.select(F.col("path"), F.explode(F.concat(ancestors(F.col("path")), F.array(F.lit("/")))).alias("_up")).where("_up <> path")
    covered = ups.join(roots.select(F.col("path").alias("_up")), "_up", "left_semi").select("path").distinct()
    return roots.distinct().join(covered, "path", "left_anti")


def classified(items: DataFrame, excluded: DataFrame, allowed: DataFrame) -> DataFrame:
    """items with `scope`: excluded, allowed, transit (above an allowed folder), ignored or index, the first that holds."""
    up = items.select("entry_id", F.explode(self_and_ancestors(F.col("path"))).alias("_up"))
    out = up.join(excluded.select(F.col("path").alias("_up")), "_up", "left_semi").select("entry_id", F.lit(True).alias("_out")).distinct()
    exact = allowed.select(F.col("path"), F.lit(True).alias("_allowed")).distinct()
    above = allowed.select(F.explode(ancestors(F.col("path"))).alias("path"), F.lit(True).alias("_transit")).distinct()
    found = items.join(out, "entry_id", "left").join(exact, "path", "left").join(above, "path", "left")
    scope = F.when(F.col("_out"), "excluded").when(F.col("_allowed"), "allowed").when(F.col("_transit"), "transit").when(ignored(F.col("path")), "ignored").otherwise("index")
    return found.withColumn("scope", scope).drop("_out", "_allowed", "_transit")


def usable_folders(dirs: DataFrame, roots: DataFrame) -> DataFrame:
    """Folders that carry evidence: not strictly above all roots, unless inside another root."""
    inside = dirs.select("folder", F.explode(self_and_ancestors(F.col("folder"))).alias("_up")).join(roots.select(F.col("path").alias("_up")), "_up", "left_semi").select("folder").distinct()
    above = roots.select(F.explode(ancestors(F.col("path"))).alias("folder")).distinct()
    return dirs.join(above.join(dealt(inside), "folder", "left_anti"), "folder", "left_anti")


def live(base: DataFrame, delta: DataFrame, gone: DataFrame) -> DataFrame:
    """The current rows: base without tombstones and without rows that the delta replaces, and the delta."""
    hidden = gone.select("entry_id").union(delta.select("entry_id")).distinct()
    return base.join(hidden, "entry_id", "left_anti").unionByName(delta)


#: Least bound of a delta, the part of the base that bounds it, and times the bound up to which it is still published.
DELTA_MIN, DELTA_PART, DELTA_SLACK = 4096, 32, 4


def delta_verdict(base_rows: int, pending: int, tracked: bool = True) -> str:
    """What a commit calls for: publish the delta; publish it and compact when nothing is going on (past its bound); or rebuild (past its slack, or
    the changes are not all known)."""
    bound = max(DELTA_MIN, base_rows // DELTA_PART)
    return "rebuild" if not tracked or pending > DELTA_SLACK * bound else "compact later" if pending > bound else "publish"


def must_compact(base_rows: int, pending: int) -> bool:
    """Whether so many pending rows call for a rewritten base."""
    return delta_verdict(base_rows, pending) != "publish"


def compacted(base: DataFrame, delta: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of a base that takes the delta in, in the order of ids: what the next generation begins with."""
    return live(base, delta, gone).repartitionByRange("entry_id").sortWithinPartitions("entry_id")


def stable_ids(previous: DataFrame, fresh: DataFrame, first_id: int = 1 << 62) -> DataFrame:
    """fresh (desktop_id, fingerprint, ...) with entry_id: that of the previous snapshot where id and fingerprint are the same,
    else a new one after the greatest. An application catalog is small; its new rows are numbered in one window."""
    from pyspark.sql import Window as W

    old = previous.select("desktop_id", F.col("fingerprint").alias("_f"), F.col("entry_id").alias("_id"))
    met = fresh.join(old, "desktop_id", "left").withColumn("_id", F.when(F.col("_f") == F.col("fingerprint"), F.col("_id")))
    top = F.broadcast(previous.agg(F.coalesce(F.max("entry_id") + 1, F.lit(first_id)).alias("_top")))
    new = met.where("_id IS NULL").join(top).withColumn("_id", F.col("_top") + F.row_number().over(W.orderBy("desktop_id")) - 1).drop("_top")
    return met.where("_id IS NOT NULL").unionByName(new).drop("_f").withColumnRenamed("_id", "entry_id")


def same_snapshot(a: DataFrame, b: DataFrame, key: str = "fingerprint") -> bool:
    """Whether two snapshots have equally many rows and every row of one is known in the other."""
    return a.count() == b.count() and b.join(a.select(key), key, "left_anti").isEmpty()


def resolved(asked: DataFrame, current: DataFrame) -> DataFrame:
    """asked (entry_id) with the current path, is_dir and `state`: live or stale."""
    met = asked.join(current.select("entry_id", "path", "is_dir"), "entry_id", "left")
    return met.withColumn("state", F.when(F.col("path").isNull(), "stale").otherwise("live"))


def folder_stamp(files: DataFrame) -> DataFrame:
    """folder, stamp: a hash of a folder's files (path, mtime, size) whatever their order."""
    return files.groupBy("folder").agg(F.bit_xor(F.xxhash64("path", "mtime", "size")).alias("stamp"))


def resolved_revision(asked: DataFrame, current: DataFrame) -> DataFrame:
    """asked (entry_id, revision) with path and `state`: live if the current catalog has that id with that revision, else stale."""
    now = current.select("entry_id", F.col("revision").alias("_r"), "path")
    met = asked.join(now, "entry_id", "left").withColumn("_live", F.coalesce(F.col("_r") == F.col("revision"), F.lit(False)))
    return met.select("entry_id", "revision", F.when(F.col("_live"), F.col("path")).alias("path"), F.when(F.col("_live"), "live").otherwise("stale").alias("state"))
