"""Software that can be installed: a small catalog searched like names, suggestions, and what its keepers decide.

software: entry_id, ref (struct of installation, remote, app_id, arch, branch), name, summary, source_revision, revision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.scalars import label_key, software_ref_valid, suggestion_gate
from quarry.operators import catalog, channels, search, segments
from quarry.plans.shared import dealt

#: Suggestions of a query, and candidates they are picked from.
SUGGESTIONS, CANDIDATES = 3, 64
REF = "struct<installation:string,remote:string,app_id:string,arch:string,branch:string>"
#: Milliseconds between checks of a stamp, until a rebuild without a change, and until metadata is fetched again.
CHECK_MS, BACKSTOP_MS, DOWNLOAD_MS = 15_000, 600_000, 6 * 3_600_000


def entries(software: DataFrame) -> DataFrame:
    """software as names: its label is the last part of a path, with slashes as blanks."""
    rows = catalog.entries(software, F.col("entry_id"), label_key(F.col("name"), "/software/"))
    return rows.join(dealt(software.select("entry_id", F.col("ref.app_id").alias("app_id"))), "entry_id")


def segment(software: DataFrame) -> segments.Segment:
    """Index tables: the name, the app_id as generic name, the summary as keywords."""
    field = lambda kind, text: software.select("entry_id", F.lit(kind).alias("kind"), text.alias("text"))
    return segments.build(entries(software), fields=field("generic", F.col("ref.app_id")).unionByName(field("keyword", F.col("summary"))).where("text <> ''"))


def searched(queries: DataFrame, software: DataFrame, limit: int = search.LIMIT) -> DataFrame:
    """The best software of each query: query_id, entry_id, path, score, rank."""
    return search.search(queries, segment(software), limit=limit)


def with_installed(software: DataFrame, installed: DataFrame) -> DataFrame:
    """software with `installed`: whether origin, app_id, arch and branch are in the list of what is installed."""
    keys = installed.select(F.struct("origin", "app_id", "arch", "branch").alias("_k"), F.lit(True).alias("_in")).distinct()
    key = F.struct(F.col("ref.remote").alias("origin"), "ref.app_id", "ref.arch", "ref.branch")
    return software.withColumn("_k", key).join(keys, "_k", "left").withColumn("installed", F.coalesce("_in", F.lit(False))).drop("_k", "_in")


def suggestions(queries: DataFrame, software: DataFrame, installed: DataFrame) -> DataFrame:
    """Software worth offering: every word of two symbols and more starts the name, exact names first, one row for each
    app_id, none that is installed, SUGGESTIONS of each query. software: entry_id, app_id, path and the text layer of the name."""
    asked = queries.where(suggestion_gate(F.col("text")) & (F.length(F.trim("text")) >= 2))
    words = channels.query_words(asked)
    hits = channels.prefix_hits(words, channels.prefix_keys(software)).where(F.col("score") >= channels.INITIALS)
    rows = search.scored(search.combined(words, hits), asked, software.select("entry_id", "path", "norm"))
    pool = search.ranked(rows, CANDIDATES).join(software.select("entry_id", "app_id"), "entry_id")
    pool = pool.join(installed.select("app_id").distinct(), "app_id", "left_anti")
    best = W.partitionBy("query_id", "app_id").orderBy(F.desc("score"), "path", "entry_id")
    one = pool.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("query_id", "app_id", "entry_id", "path", "score")
    return search.ranked(one, SUGGESTIONS)


def with_preferred(offered: DataFrame, local: DataFrame) -> DataFrame:
    """offered (query_id, score) with `preferred`: the query has an exact suggestion, and nothing local is exact. local:
    query_id, score, tier (of merge.tiered())."""
    taken = local.where((F.col("tier") < 4) | (search.exactness(F.col("score")) != "ordinary")).select("query_id").distinct().withColumn("_taken", F.lit(True))
    exact = F.max((F.col("score") >= search.EXACT_NAME - catalog.PENALTY_MAX).cast("int")).over(W.partitionBy("query_id")) == 1
    return offered.withColumn("_exact", exact).join(taken, "query_id", "left").withColumn("preferred", F.col("_exact") & F.col("_taken").isNull()).drop("_exact", "_taken")


def resolved(asked: DataFrame, software: DataFrame) -> DataFrame:
    """asked (ref, revision, source_revision) with `state`: live if that very reference has those revisions, else stale."""
    now = software.select("ref", F.col("revision").alias("_r"), F.col("source_revision").alias("_s"))
    met = asked.join(now, "ref", "left")
    same = (F.col("_r") == F.col("revision")) & (F.col("_s") == F.col("source_revision"))
    return met.withColumn("state", F.when(F.coalesce(same, F.lit(False)), "live").otherwise("stale")).drop("_r", "_s")


def target(ref: Column, revision: Column, source_revision: Column) -> Column:
    """The JSON object that names one piece of software; revisions are decimal strings."""
    r = [ref[f].alias(f) for f in ("installation", "remote", "app_id", "arch", "branch")]
    return F.to_json(F.struct(F.lit("software").alias("kind"), F.lit("flatpak").alias("backend"), *r, revision.cast("string").alias("revision"), source_revision.cast("string").alias("source_revision")))


def target_parts(line: Column) -> Column:
    """The struct (ref, revision, source_revision) of target(), or null if a member is missing, unknown, repeated, or not valid."""
    names = ["kind", "backend", "installation", "remote", "app_id", "arch", "branch", "revision", "source_revision"]
    got = F.from_json(line, ", ".join(f"{n} string" for n in names))
    keys = F.json_object_keys(line)
    number = lambda c: F.when(c.rlike("^(0|[1-9][0-9]{0,18})$"), c.cast("long"))
    known = (F.size(keys) == len(names)) & (F.size(F.array_intersect(keys, F.array(*map(F.lit, names)))) == len(names))
    right = (got["kind"] == "software") & (got["backend"] == "flatpak") & software_ref_valid(got["installation"], got["app_id"])
    ref = F.struct(*[got[f].alias(f) for f in names[2:7]])
    whole = F.struct(ref.alias("ref"), number(got["revision"]).alias("revision"), number(got["source_revision"]).alias("source_revision"))
    return F.when(known & right & whole["revision"].isNotNull() & whole["source_revision"].isNotNull(), whole)


def installed_list(lines: DataFrame) -> DataFrame:
    """Tab-separated lines (value) `origin ref`, ref being app/id/arch/branch -> origin, app_id, arch, branch."""
    part = F.split("value", "\t")
    ref = F.split(F.try_element_at(part, F.lit(2)), "/")
    at = lambda k: F.try_element_at(ref, F.lit(k))
    rows = lines.select(part[0].alias("origin"), at(2).alias("app_id"), at(3).alias("arch"), at(4).alias("branch"))
    return rows.where((F.col("origin") != "") & F.col("branch").isNotNull())


@dataclass(frozen=True)
class Keeper:
    """What the keeper of a catalog knows, in milliseconds. state: ready, stale (the last good catalog stays), failed (there is none),
    unavailable (there is no backend)."""

    state: str = "failed"
    stamp: int | None = None
    checked: int = 0
    downloaded: int = 0
    built: bool = False
    asked_first: bool = True

    def due(self, now: int, stamp: int, requested: bool = False) -> tuple[bool, bool]:
        """(rebuild, download): rebuild at first, on request, on another stamp, after BACKSTOP_MS, or to download; download on
        request, after the first build, and every DOWNLOAD_MS."""
        first = self.stamp is None
        download = not first and (requested or self.asked_first or now - self.downloaded >= DOWNLOAD_MS)
        return first or requested or stamp != self.stamp or now - self.checked >= BACKSTOP_MS or download, download

    def after(self, now: int, stamp: int, download: bool, outcome: str) -> Keeper:
        """What it knows after a build that was `ok`, `unavailable` or `failed`."""
        good = outcome in ("ok", "unavailable")
        state = {"ok": "ready", "unavailable": "unavailable"}.get(outcome, "stale" if self.built else "failed")
        return Keeper(state, stamp, now, now if download else self.downloaded, self.built or good, self.asked_first and not download)
