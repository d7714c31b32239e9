"""Text sources: path listings of a file system, mount tables, desktop entries, package listings, request lines."""

from __future__ import annotations

import contextlib
import json
import os
import re
import stat
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.scalars import display_escaped, octal_unescaped, software_ref_valid
from quarry.operators.catalog import IGNORED_NAMES

#: File systems whose change events cannot be relied on.
UNRELIABLE = ("nfs", "nfs4", "smb", "smb2", "smb3", "cifs", "fuse", "9p", "ceph", "afs", "coda")
REQUEST = "version int, op string, request_id long, query string, limit int, client string"


class Walk(DataSource):
    """spark.read.format("walk").option("root", dir): path, is_dir, mtime, size, identity, unreadable. One task for each folder
    directly below the root. Links are not followed, and what cannot be read is flagged, not dropped.

    Options: scope, children for the root's own children only; exclude and allow, JSON lists of folders: excluded ones are left out, and so are
    hidden, generated and tool-managed folders unless they are allowed or lead to an allowed one (then only
    the way is followed); defaults, false to take these too. Executors must see the folder."""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return "path string, is_dir boolean, mtime long, size long, identity binary, unreadable boolean"

    def reader(self, schema):
        return WalkReader(self.options)


class WalkReader(DataSourceReader):
    #: Files and folders that mark a folder as kept by a tool, and how a cache's tag begins.
    MARKS, TAG = ("pyvenv.cfg", "conda-meta", ".knownPackages"), b"Signature: 8a477f597d28d172789f06886806bc55"

    def __init__(self, options):
        self.root, self.deep = options["root"].rstrip("/") or "/", options.get("scope", "tree") == "tree"
        self.exclude, self.allow = (set(json.loads(options.get(k, "[]"))) for k in ("exclude", "allow"))
        self.defaults = options.get("defaults", "true").lower() != "false"

    def partitions(self):
        found = [InputPartition((self.root, False, False))]
        if self.deep:
            with contextlib.suppress(OSError), os.scandir(self.root) as it:
                below = [(e.path, self._scope(e, False)) for e in it if e.is_dir(follow_symlinks=False)]
                found += [InputPartition((p, True, kind == "transit")) for p, kind in sorted(below) if kind != "skip"]
        return found

    def read(self, partition):
        top, deep, transit = partition.value
        if not deep:
            row, below = self._row(top), self._children(top)
            yield row if below is not None or not row[1] else (*row[:5], True)
            for e in below or ():
                if not (self.deep and e.is_dir(follow_symlinks=False)) and self._scope(e, False) == "index":
                    yield self._row(e.path)
            return
        stack = [(top, transit)]
        while stack:
            path, transit = stack.pop()
            row = self._row(path)
            if row[1]:
                below = self._children(path)
                if below is None:
                    row = (*row[:5], True)
                kinds = [(e.path, self._scope(e, transit)) for e in below or ()]
                stack += [(p, kind == "transit") for p, kind in reversed(kinds) if kind != "skip"]
            if not transit:
                yield row

    def _children(self, path):
        try:
            with os.scandir(path) as it:
                return sorted(it, key=lambda e: e.path)
        except OSError:
            return None

    def _scope(self, entry, transit: bool) -> str:
        """index, transit (followed, but not given) or skip."""
        path, is_dir = entry.path, entry.is_dir(follow_symlinks=False)
        if path in self.exclude:
            return "skip"
        if is_dir and path in self.allow:
            return "index"
        leads = is_dir and any(a.startswith(path + "/") for a in self.allow)
        if transit or (is_dir and self.defaults and (entry.name.startswith(".") or entry.name in IGNORED_NAMES or self._managed(entry))):
            return "transit" if leads else "skip"
        return "index"

    def _managed(self, entry) -> bool:
        names = {e.name: e for e in self._children(entry.path) or ()}
        if "CACHEDIR.TAG" in names:
            with contextlib.suppress(OSError), open(names["CACHEDIR.TAG"].path, "rb") as f:
                if f.read(len(self.TAG)) == self.TAG:
                    return True
        marked = [m for m in self.MARKS if m in names and names[m].is_dir(follow_symlinks=False) == (m == "conda-meta")]
        return bool(marked) or (entry.name == "mod" and os.path.isdir(os.path.join(entry.path, "cache", "download")))

    def _row(self, path):
        try:
            s = os.lstat(path)
            identity = struct.pack("<BQQqI", 0, s.st_dev, s.st_ino, s.st_ctime_ns // 10**9, s.st_ctime_ns % 10**9)
            return (path, stat.S_ISDIR(s.st_mode), int(s.st_mtime), s.st_size, identity, False)
        except OSError:
            return (path, False, None, None, None, True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Walk)


def mounts(lines: DataFrame) -> DataFrame:
    """Lines (value) of a mountinfo table -> mount_id, parent_id, device, root, mount_point, fs_type, reliable."""
    both = F.split("value", " - ", 2)
    left, right = F.split(both[0], " "), F.split(both[1], " ")
    rows = lines.where(F.col("value").contains(" - ")).select(left[0].cast("int").alias("mount_id"), left[1].cast("int").alias("parent_id"), left[2].alias("device"), octal_unescaped(left[3]).alias("root"), octal_unescaped(left[4]).alias("mount_point"), right[0].alias("fs_type"))
    return rows.where("mount_id IS NOT NULL").withColumn("reliable", ~F.split(F.lower("fs_type"), "\\.")[0].isin(*UNRELIABLE))


def mounts_changed(before: DataFrame, after: DataFrame, roots: DataFrame) -> DataFrame:
    """mount_point of mounts in only one of the tables that lie at, below or above a root."""
    from quarry.operators.catalog import self_and_ancestors

    keys = ["mount_id", "device", "root", "mount_point"]
    a, b = before.select(*keys, F.lit(1).alias("_a")), after.select(*keys, F.lit(1).alias("_b"))
    odd = a.join(b, keys, "full_outer").where("_a IS NULL OR _b IS NULL").select("mount_point").distinct()
    below = odd.select("mount_point", F.explode(F.concat(self_and_ancestors(F.col("mount_point")), F.array(F.lit("/")))).alias("_up")).join(roots.select(F.col("path").alias("_up")), "_up", "left_semi").select("mount_point")
    above = odd.join(roots.select(F.explode(F.concat(self_and_ancestors(F.col("path")), F.array(F.lit("/")))).alias("mount_point")), "mount_point", "left_semi")
    return below.union(above).distinct()


#: Bounds of desktop entries: levels of folders, bytes of a file.
DEPTH_MAX, ENTRY_BYTES = 16, 64 << 10


def desktop_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """desktop_id, precedence, content of the .desktop files below folders (the user's first), which Spark reads from any store. An id is the
    path below the folder with slashes as dashes; files too large or too deep are left out."""
    out = spark.createDataFrame([], "desktop_id string, precedence int, content string")
    for k, top in enumerate(folders):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.desktop").load(top)
        # stores spell scheme and host in more than one way: paths are compared without
        plain = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"
        below = F.substring_index(F.regexp_replace("path", plain, ""), re.sub(plain, "", top).rstrip("/") + "/", -1)
        rows = files.where(F.col("length") <= ENTRY_BYTES).select(below.alias("_p"), F.lit(k).alias("precedence"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))
        out = out.unionByName(rows.where(F.size(F.split("_p", "/")) <= DEPTH_MAX).select(F.replace("_p", F.lit("/"), F.lit("-")).alias("desktop_id"), "precedence", "content"))
    return out


def desktop_entries(files: DataFrame) -> DataFrame:
    """files (desktop_id, precedence, content) -> desktop_id, name, generic_name, keywords, categories, wm_class, settings,
    only_show_in, not_show_in of entries that show. The first file of an id counts (the least precedence), even if it is hidden:
    it masks the others."""
    first = files.withColumn("_n", F.row_number().over(W.partitionBy("desktop_id").orderBy("precedence"))).where("_n = 1")
    body = F.regexp_extract("content", "(?s)\\[Desktop Entry\\]\\s*?\\n(.*?)(?:\\n\\[|$)", 1)
    get = lambda k: F.nullif(F.trim(F.regexp_extract(F.concat(F.lit("\n"), body), f"\\n{k}[ \\t]*=[ \\t]*([^\\n]*)", 1)), F.lit(""))
    listed = lambda k: F.filter(F.split(F.coalesce(get(k), F.lit("")), ";"), lambda x: x != "")
    rows = first.select("desktop_id", get("Name").alias("name"), get("GenericName").alias("generic_name"), listed("Keywords").alias("keywords"), listed("Categories").alias("categories"), get("StartupWMClass").alias("wm_class"), listed("OnlyShowIn").alias("only_show_in"), listed("NotShowIn").alias("not_show_in"), get("Type").alias("_type"), F.coalesce(F.lower(get("NoDisplay")), F.lit("")).alias("_no"), F.coalesce(F.lower(get("Hidden")), F.lit("")).alias("_hidden"))
    shown = rows.where("name IS NOT NULL AND (_type IS NULL OR _type = 'Application') AND _no <> 'true' AND _hidden <> 'true'")
    return shown.withColumn("settings", F.array_contains("categories", "Settings")).drop("_type", "_no", "_hidden")


def visible(apps: DataFrame, desktops: list[str]) -> DataFrame:
    """apps that the current desktops show: the first of them that either list names decides; if none, an entry shows unless
    it is for named desktops only."""
    verdict = F.lit(None).cast("boolean")
    for d in reversed(desktops):
        verdict = F.when(F.array_contains("only_show_in", d), True).when(F.array_contains("not_show_in", d), False).otherwise(verdict)
    return apps.where(F.coalesce(verdict, F.size("only_show_in") == 0))


def packages(lines: DataFrame, scope: str) -> DataFrame:
    """Tab-separated lines (value) `ref name summary`, ref being app/id/arch/branch -> software rows with a valid reference."""
    part = F.split("value", "\t")
    ref = F.split(part[0], "/")
    rows = lines.select(F.struct(F.lit(scope).alias("installation"), F.try_element_at(ref, F.lit(2)).alias("app_id"), F.try_element_at(ref, F.lit(3)).alias("arch"), F.try_element_at(ref, F.lit(4)).alias("branch")).alias("ref"), F.try_element_at(part, F.lit(2)).alias("name"), F.coalesce(F.try_element_at(part, F.lit(3)), F.lit("")).alias("summary"))
    rows = rows.where(F.col("ref.branch").isNotNull() & F.col("name").isNotNull() & software_ref_valid(F.col("ref.installation"), F.col("ref.app_id")))
    return rows.withColumn("revision", F.xxhash64("ref", "name", "summary"))


def requests(lines: DataFrame) -> DataFrame:
    """JSON request lines (value) -> the fields, and `valid`: known keys only, each once, and a query within bounds."""
    got = F.from_json("value", REQUEST, {"mode": "PERMISSIVE"})
    known = [f.split()[0] for f in REQUEST.split(", ")]
    keys = F.json_object_keys("value")
    ok = keys.isNotNull() & F.forall(keys, lambda k: k.isin(*known)) & (F.size(keys) == F.size(F.array_distinct(keys)))
    return lines.select("value", got.alias("r")).select("r.*", F.coalesce(ok & (F.octet_length(F.coalesce(F.col("r.query"), F.lit(""))) <= 256) & F.col("r.op").isNotNull(), F.lit(False)).alias("valid"))


def responses(results: DataFrame) -> DataFrame:
    """results (query_id, rank, entry_id, path, score) -> one JSON line for each query; ids are decimal strings."""
    row = F.struct(F.col("entry_id").cast("string").alias("id"), F.col("path"), F.col("score"))
    lines = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", row.alias("r")))), lambda x: x["r"]).alias("results"))  # at most 1000 results a query
    return lines.select(F.to_json(F.struct(F.col("query_id").cast("string").alias("request_id"), F.size("results").alias("count"), "results")).alias("value"))


def config(lines: DataFrame, home: str) -> DataFrame:
    """Lines (value) `key = value` -> key, value, valid. Blank lines and comments give nothing; keys are small letters and `_`;
    a value that begins with ~/ lies below home."""
    text = F.trim(F.regexp_replace("value", "[\\t\\r\\n]+$|^[\\t]+", ""))
    key, value = F.regexp_extract(text, "^([^=]*?)[ \\t]*=", 1), F.regexp_extract(text, "^[^=]*=[ \\t]*(.*)$", 1)
    rows = lines.select(text.alias("_t"), key.alias("key"), F.when(value.startswith("~/"), F.concat(F.lit(home), F.substring(value, 2, 1 << 20))).otherwise(value).alias("value"))
    return rows.where("_t <> '' AND NOT startswith(_t, '#')").select("key", "value", (F.col("key").rlike("^[a-z_]+$") & (F.col("value") != "")).alias("valid"))


# --- sinks -------------------------------------------------------------------------------------------------


def write_lines(results: DataFrame, out: str) -> None:
    """Paths of results (query_id, rank, path) as lines to read, escaped; in order inside each file."""
    _ordered(results).select(display_escaped(F.col("path"))).write.text(out)


def write_raw(results: DataFrame, out: str) -> None:
    """Paths as they are, a zero byte after each."""
    _ordered(results).select("path").write.option("lineSep", "\0").text(out)


def write_json(results: DataFrame, out: str) -> None:
    """One JSON response a line."""
    responses(results).write.text(out)


def _ordered(results: DataFrame) -> DataFrame:
    return results.repartition("query_id").sortWithinPartitions("query_id", "rank")
