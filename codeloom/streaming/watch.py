"""The watch mode: file events in micro-batches, the last event of a path deciding, merged into the current graph."""

from __future__ import annotations

import datetime
import os
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from codeloom.functions.columns import EXTENSIONS
from codeloom.operators.incremental import last_events, merge, remove_below
from codeloom.plans.store import GraphStore
from codeloom.plans.tables import written

EVENTS = "path string, is_remove boolean, ts timestamp, event_id long"


class Watcher:
    """Holds the current graph and replaces it as a whole, so that readers see the graph before a batch or after it.

    ``parse`` makes a graph of the paths of a frame, resolved against the graph that it is given. A batch that comes while ``busy`` is held, as by a full index, is dropped.
    """

    def __init__(self, graph: GraphStore, parse: Callable[[DataFrame, GraphStore], GraphStore]):
        self.graph, self.parse, self.busy = graph, parse, threading.Lock()
        self.query: StreamingQuery | None = None
        self.ended = threading.Event()

    def apply(self, events: DataFrame, batch: int = 0) -> None:
        """Removes and replaces the files that a batch of events names; a removed folder takes all files below it."""
        if not self.busy.acquire(blocking=False):
            return
        try:
            last = written(last_events(events), "watch")
            graph = remove_below(self.graph, last.where("is_remove").select("path"))
            changed = last.where("NOT is_remove").select("path")
            if changed.limit(1).count():
                graph = merge(graph, self.parse(changed, graph))
            # Cuts the lineage, which would grow with each batch.
            self.graph = GraphStore(*[written(getattr(graph, n), f"watch-{n}") for n in ("occurrences", "edges", "includes", "files")])
        finally:
            self.busy.release()

    def start(self, spark: SparkSession, source: str, checkpoint: str, files_a_batch: int = 256) -> StreamingQuery:
        """Follows a folder of event files (Parquet)."""
        events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_a_batch).parquet(source)
        self.query = events.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).start()
        return self.query

    def poll(self, spark: SparkSession, root: str, source: str, every: float = 0.25, extensions: tuple[str, ...] = tuple(EXTENSIONS)) -> None:
        """Lists a folder again and again and adds what changed to the event files, until ``stop``; changes within ``every`` seconds are one."""
        _, seen = listing_events({}, root)
        self.ended.clear()

        def run() -> None:
            nonlocal seen
            while not self.ended.wait(every):
                changed, seen = listing_events(seen, root)
                changed = [(p, gone) for p, gone in changed if os.path.splitext(p)[1].lower() in extensions]
                if changed:
                    now = datetime.datetime.now(datetime.timezone.utc)
                    rows = [(p, gone, now, time.time_ns() + i) for i, (p, gone) in enumerate(changed)]
                    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(source)

        threading.Thread(target=run, daemon=True).start()

    def stop(self) -> None:
        self.ended.set()
        if self.query is not None:
            self.query.stop()
            self.query = None


def listing_events(before: dict[str, int], root: str) -> tuple[list[tuple[str, bool]], dict[str, int]]:
    """(path, is_remove) of what changed below a root since a listing {path: time}, and the new listing."""
    now = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.join(folder, name)
            try:
                now[path] = os.stat(path).st_mtime_ns
            except OSError:
                continue
    changed = [(p, False) for p, t in sorted(now.items()) if before.get(p) != t]
    return changed + [(p, True) for p in sorted(before.keys() - now.keys())], now
