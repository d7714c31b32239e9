"""File events as streams: rename pairing, scope coalescing, debounced batches, history. Each operator has a batch form that the
stream applies to its micro-batches, so one definition serves both.

events: seq long, ts timestamp, kind ('create', 'delete', 'moved_from', 'moved_to', 'attrib', 'overflow'), path string,
cookie long, is_dir boolean."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.functions.text import parent
from quarry.operators.catalog import ancestors

#: Quiet time and longest wait of a batch in milliseconds; scopes that start one at once, or call for a full pass.
QUIET_MS, LONGEST_MS, SCOPES_NOW, SCOPES_FULL = 100, 1000, 512, 1024
SCHEMA = "seq long, ts timestamp, kind string, path string, cookie long, is_dir boolean"


def renames(events: DataFrame, within: str = "1 second") -> DataFrame:
    """cookie, old_path, new_path, is_dir of moves whose halves meet. On a stream the watermark bounds what is held."""
    if events.isStreaming:
        events = events.withWatermark("ts", within)
    a = events.where("kind = 'moved_from'").select("cookie", F.col("path").alias("old_path"), F.col("ts").alias("_from"))
    b = events.where("kind = 'moved_to'").select(F.col("cookie").alias("_c"), F.col("path").alias("new_path"), "is_dir", F.col("ts").alias("_to"))
    near = F.expr(f"_to BETWEEN _from - INTERVAL {within} AND _from + INTERVAL {within}")
    return a.join(b, (F.col("cookie") == F.col("_c")) & near).select("cookie", "old_path", "new_path", "is_dir")


def scopes(events: DataFrame) -> DataFrame:
    """scope, recursive: the folders to look at again. An event asks for its folder; a folder that appeared for all below it."""
    own = F.struct(F.when(parent(F.col("path")) == "", "/").otherwise(parent(F.col("path"))).alias("scope"), F.lit(False).alias("recursive"))
    deep = F.struct(F.col("path").alias("scope"), F.lit(True).alias("recursive"))
    each = events.where("kind <> 'overflow'").select(F.explode(F.when(F.col("kind").isin("create", "moved_to") & F.col("is_dir"), F.array(own, deep)).otherwise(F.array(own))).alias("s"))
    return each.groupBy("s.scope").agg(F.max("s.recursive").alias("recursive"))


def outermost(found: DataFrame) -> DataFrame:
    """scopes without those inside a recursive one."""
    ups = found.select("scope", F.explode(ancestors(F.col("scope"))).alias("_up"))
    inside = ups.join(found.where("recursive").select(F.col("scope").alias("_up")), "_up", "left_semi").select("scope").distinct()
    return found.join(inside, "scope", "left_anti")


def full_pass(events: DataFrame, found: DataFrame, most: int = SCOPES_FULL) -> DataFrame:
    """One row, `full`: whether events were lost or scopes are too many."""
    lost = events.agg(F.coalesce(F.max(F.col("kind") == "overflow"), F.lit(False)).alias("_lost"))
    return lost.join(found.agg(F.count("*").alias("_n"))).select((F.col("_lost") | (F.col("_n") > most)).alias("full"))


def debounced(events: DataFrame, root: str = "root") -> DataFrame:
    """root, batch_start, batch_end, n_events: gaps of QUIET_MS end a batch. events has the column named by root.
    On a stream the session window gives the same batches (see Debounce for the longest wait)."""
    if events.isStreaming:
        grouped = events.withWatermark("ts", f"{LONGEST_MS} milliseconds").groupBy(root, F.session_window("ts", f"{QUIET_MS} milliseconds").alias("w"))
        return grouped.agg(F.count("*").alias("n_events")).select(root, F.col("w.start").alias("batch_start"), F.col("w.end").alias("batch_end"), "n_events")
    w = W.partitionBy(root).orderBy("ts", "seq")
    gap = F.col("ts") >= F.lag("ts").over(w) + F.expr(f"INTERVAL {QUIET_MS} MILLISECONDS")
    marked = events.withColumn("_batch", F.sum(F.coalesce(gap, F.lit(True)).cast("int")).over(w))
    return marked.groupBy(root, "_batch").agg(F.min("ts").alias("batch_start"), (F.max("ts") + F.expr(f"INTERVAL {QUIET_MS} MILLISECONDS")).alias("batch_end"), F.count("*").alias("n_events")).drop("_batch")


class Debounce(StatefulProcessor):
    """Batches as debounced(), cut LONGEST_MS after their first event, and as soon as SCOPES_NOW scopes are pending. What is held goes
    when its time is up, by a timer, though no event follows. Output: root, batch_start, batch_end (milliseconds), n_events, n_scopes. Input: root, ms, scope.
    Needs the RocksDB state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("batch", "first long, last long, n long, scopes array<string>")

    def handleInputRows(self, key, rows, timerValues):
        held = self._held()
        out = []
        for ms, scope in sorted((int(m), str(s)) for pdf in rows for m, s in zip(pdf["ms"], pdf["scope"])):
            if held and (ms - held[1] >= QUIET_MS or ms - held[0] >= LONGEST_MS):
                out.append(self._row(key, held))
                held = None
            held = (held[0], ms, held[2] + 1, held[3] | {scope}) if held else (ms, ms, 1, {scope})
            if len(held[3]) >= SCOPES_NOW:
                out.append(self._row(key, held))
                held = None
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.state.update((held[0], held[1], held[2], sorted(held[3])))
            left = min(held[1] + QUIET_MS, held[0] + LONGEST_MS) - held[1]
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + left)
        else:
            self.state.clear()
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        self.state.clear()
        yield self._frame([self._row(key, held)] if held else [])

    def _held(self):
        found = self.state.get() if self.state.exists() else None
        return (found[0], found[1], found[2], set(found[3])) if found else None

    def _row(self, key, held):
        return (key[0], held[0], min(held[1] + QUIET_MS, held[0] + LONGEST_MS), held[2], len(held[3]))

    def _frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["root", "batch_start", "batch_end", "n_events", "n_scopes"])

    def close(self) -> None:
        pass


def debounce_stream(events: DataFrame) -> DataFrame:
    """events (root string, ms long, scope string), streaming, through Debounce."""
    return events.groupBy("root").transformWithStateInPandas(Debounce(), "root string, batch_start long, batch_end long, n_events long, n_scopes long", "Append", "ProcessingTime")


@dataclass(frozen=True)
class Passes:
    """When the next passes over a tree are due, in milliseconds: folders that events do not cover are looked at every rescan_ms,
    everything every repair_ms (0: never) without a full pass; at once when a full pass is asked for."""

    rescan_ms: int
    repair_ms: int
    rescan_due: int = 0
    repair_due: int = 0
    requested: bool = False

    def request(self) -> Passes:
        return replace(self, requested=True)

    def at(self, now: int) -> tuple[str, Passes]:
        """(full, repair or none, what holds after it)."""
        full = self.requested or (self.repair_ms > 0 and now >= self.repair_due)
        repair = now >= self.rescan_due
        after = replace(self, requested=False, rescan_due=now + self.rescan_ms if repair or full else self.rescan_due, repair_due=now + self.repair_ms if full else self.repair_due)
        return "full" if full else "repair" if repair else "none", after


def reconciled(stream: DataFrame, apply: Callable[[DataFrame, DataFrame, bool, int], None], checkpoint: str, full: Callable[[], bool] = lambda: False):
    """Start a query that hands each micro-batch's renames and outermost scopes to apply(renames, scopes, full, batch_id). full: whether the
    whole tree must be looked at, because events were lost, scopes are too many, or full() asks for it."""

    def one(batch: DataFrame, batch_id: int) -> None:
        found = scopes(batch)
        whole = full() or full_pass(batch, found).first()["full"]
        apply(renames(batch), outermost(found), whole, batch_id)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Fixed value: searches that are remembered for the opens that follow them.
RECENT_SEARCHES = 256


def remembered(searches: DataFrame, most: int = RECENT_SEARCHES) -> DataFrame:
    """The latest `most` searches (search_id, query, seq), of a repeated id the latest."""
    last = searches.groupBy("search_id").agg(F.max_by("query", "seq").alias("query"), F.max("seq").alias("seq"))
    return last.orderBy(F.desc("seq"), "search_id").limit(most)


def with_query(opens: DataFrame, recent: DataFrame) -> DataFrame:
    """opens (search_id, ...), batch or stream, with the query that led to each, if it is remembered."""
    return opens.join(F.broadcast(recent.select("search_id", "query")), "search_id", "left")


def recorded_once(opens: DataFrame, late: str = "10 minutes") -> DataFrame:
    """A stream of opens (event_id, ts timestamp, ...) without repeated events."""
    return opens.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if opens.isStreaming else opens.dropDuplicates(["event_id"])


def last_active(windows: DataFrame) -> DataFrame:
    """window events (window_id, seq, event, title) -> window_id, activated, title of windows that are open, the most recently
    active first."""
    last = windows.groupBy("window_id").agg(F.max(F.when(F.col("event") == "activate", F.col("seq"))).alias("activated"), F.max_by("title", "seq").alias("title"), F.max_by("event", "seq").alias("_last"))
    return last.where("_last <> 'close'").drop("_last").orderBy(F.desc_nulls_last("activated"), "window_id")


def newest_requests(requests: DataFrame) -> DataFrame:
    """requests (client, seq, ...) that no newer one of their client supersedes."""
    return requests.groupBy("client").agg(F.max_by(F.struct(*[c for c in requests.columns if c != "client"]), "seq").alias("r")).select("client", "r.*")


def usage_stream(opens: DataFrame, now: int):
    """Per item the decayed weight and last open of a stream of opens (target_id, ts long): sums are commutative, so late events
    need no watermark. Output mode: update or complete."""
    from quarry.operators.usage import items

    return items(opens, now)
