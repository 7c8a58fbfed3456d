"""Incremental maintenance: staleness, eviction, replacement of files and pruning of what they leave behind."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import under
from codeloom.plans.store import GraphStore


def stale(cached: DataFrame, current: DataFrame) -> DataFrame:
    """Paths whose time differs, or that only one side has; both have (path, mtime)."""
    pair = cached.select("path", F.col("mtime").alias("a")).join(current.select("path", F.col("mtime").alias("b")), "path", "full_outer")
    return pair.where(~F.col("a").eqNullSafe(F.col("b"))).select("path")


def prune(graph: GraphStore, removed: DataFrame) -> GraphStore:
    """Without edges that touch removed ids, at either end."""
    edges = graph.edges.join(removed.select(F.col("id").alias("src")), "src", "left_anti").join(removed.select(F.col("id").alias("dst")), "dst", "left_anti")
    return GraphStore(graph.occurrences, edges.select(*graph.edges.columns), graph.includes, graph.files)


def _without(graph: GraphStore, paths: DataFrame) -> tuple[GraphStore, DataFrame]:
    gone = graph.occurrences.join(paths.select(F.col("path").alias("file")), "file", "left_semi").select("id").distinct()
    kept = GraphStore(
        graph.occurrences.join(paths.select(F.col("path").alias("file")), "file", "left_anti").select(*graph.occurrences.columns),
        graph.edges.join(paths.select(F.col("path").alias("file")), "file", "left_anti").select(*graph.edges.columns),
        graph.includes.join(paths.select(F.col("path").alias("src_file")), "src_file", "left_anti").select(*graph.includes.columns),
        graph.files.join(paths, "path", "left_anti").select(*graph.files.columns),
    )
    return kept, gone


def remove_files(graph: GraphStore, paths: DataFrame) -> GraphStore:
    kept, gone = _without(graph, paths.select("path").distinct())
    return prune(kept, gone)


def remove_subtree(graph: GraphStore, prefix: str) -> GraphStore:
    return remove_files(graph, graph.files.where(under(F.col("path"), prefix)).select("path"))


def remove_below(graph: GraphStore, paths: DataFrame) -> GraphStore:
    """Without the files of some paths and all files in folders of these paths, by an equi-join on each file's ancestors."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = graph.files.select("path", F.explode(ups).alias("above"))
    return remove_files(graph, above.join(paths.select(F.col("path").alias("above")).distinct(), "above", "left_semi").select("path"))


def merge(graph: GraphStore, fresh: GraphStore) -> GraphStore:
    """``fresh`` in place of its files; ids that vanish take their edges with them. Merging twice changes nothing."""
    kept, gone = _without(graph, fresh.files.select("path"))
    gone = gone.join(fresh.occurrences.select("id"), "id", "left_anti")
    kept = prune(kept, gone)
    return GraphStore(kept.occurrences.unionByName(fresh.occurrences), kept.edges.unionByName(fresh.edges), kept.includes.unionByName(fresh.includes), kept.files.unionByName(fresh.files))


def evict_missing(graph: GraphStore, listing: DataFrame, prefix: str = "") -> DataFrame:
    """Indexed files under ``prefix`` that the listing does not have."""
    return graph.files.where(under(F.col("path"), prefix)).join(listing, "path", "left_anti").select("path")


def last_events(events: DataFrame) -> DataFrame:
    """(path, is_remove, events): the last event of each path decides."""
    return events.groupBy("path").agg(F.max_by("is_remove", F.struct("ts", "event_id")).alias("is_remove"), F.count(F.lit(1)).alias("events"))


def debounced(events: DataFrame, gap: str = "250 milliseconds") -> DataFrame:
    """(path, start, events): bursts of a path's events, each less than ``gap`` after the one before; events without a time are bursts of their own.

    A path's events are ordered day by day, so that a busy path does not meet in one task; a day goes on with the burst that was open before it.
    """
    day = F.to_date("ts") if dict(events.dtypes)["ts"] == "timestamp_ntz" else F.floor(F.unix_micros("ts") / 86_400_000_000)
    timed = events.where("ts IS NOT NULL").select("path", day.alias("day"), "ts")
    before = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    ends = timed.groupBy("path", "day").agg(F.max("ts").alias("last")).withColumn("last", F.max("last").over(before))
    same = [F.col("l.path").eqNullSafe(F.col("r.path")), F.col("l.day") == F.col("r.day")]
    within = Window.partitionBy("path", "day")
    held = timed.alias("l").join(ends.alias("r"), same).select("l.path", "l.day", "ts", "last")
    held = held.withColumn("prior", F.coalesce(F.lag("ts").over(within.orderBy("ts")), "last"))
    opens = F.col("prior").isNull() | (F.col("ts") >= F.col("prior") + F.expr(f"INTERVAL {gap}"))
    held = held.withColumn("opened", F.when(opens, F.col("ts")))
    # The open burst's start; null: it began on an earlier day. Of events at one time the one that opens a burst comes first.
    held = held.withColumn("start", F.max("opened").over(within.orderBy("ts", F.col("opened").isNull()).rowsBetween(Window.unboundedPreceding, 0)))
    parts = held.groupBy("path", "day", "start").agg(F.count(F.lit(1)).alias("events"))
    earlier = parts.groupBy("path", "day").agg(F.max("start").alias("carried")).withColumn("carried", F.max("carried").over(before))
    whole = parts.alias("l").join(earlier.alias("r"), same).select("l.path", F.coalesce("start", "carried").alias("start"), "events")
    untimed = events.where("ts IS NULL").select("path", F.col("ts").alias("start"), F.lit(1).cast("long").alias("events"))
    return whole.groupBy("path", "start").agg(F.sum("events").alias("events")).union(untimed)
