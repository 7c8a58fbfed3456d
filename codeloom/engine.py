"""The query interface: one method for each query, with pages, defaults and error texts."""

from __future__ import annotations

import os
import threading
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import CLASS_LIKE, EXTENSIONS
from codeloom.operators import incremental, lookup, structure, traverse
from codeloom.plans.page import Page, both_sides, limit_or, page
from codeloom.plans.store import GraphStore
from codeloom.sources import scan
from codeloom.sources.config import Config, find_config
from codeloom.streaming.watch import Watcher

# Fixed values of the interface.
NON_CALLABLE = ("struct", "enum", "trait", "typedef", "interface")
_COLUMNS = ["id", "name", "kind", "file", "line", "column", "end_line", "signature", "namespace", "parent", "language"]


class QueryError(ValueError):
    pass


@dataclass
class Job:
    """One index run; at most one runs at a time."""

    path: str
    id: str = field(default_factory=lambda: uuid.uuid4().hex)
    phase: str = "queued"
    status: str = "running"
    error: str | None = None
    result: dict | None = None
    began: int = field(default_factory=time.time_ns)


class Engine:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.graph: GraphStore | None = None
        self.root: str | None = None
        self.config = Config()
        self.job: Job | None = None
        self.before: Job | None = None
        self.watcher: Watcher | None = None
        self._slot = threading.Lock()

    # Indexing

    def _take(self, path: str) -> Job | None:
        with self._slot:
            if self.job and self.job.status == "running":
                return None
            self.before, self.job = self.job, Job(path)
            return self.job

    def analyze_codebase(self, path: str, force: bool = False) -> dict:
        job = self._take(path)
        if job is None:
            raise QueryError(f"an index run is in flight: {self.job.id}")
        self._run(job, force)
        if job.error:
            raise QueryError(job.error)
        return job.result

    def analyze_codebase_async(self, path: str, force: bool = False) -> dict:
        job = self._take(path)
        if job is None:
            return {"job_id": self.job.id, "status": "running"}
        threading.Thread(target=self._run, args=(job, force), daemon=True).start()
        return {"job_id": job.id, "status": "running"}

    def _run(self, job: Job, force: bool) -> None:
        try:
            job.result, job.status = self._analyze(job, force), "completed"
        except Exception as error:  # noqa: BLE001  the job carries its error
            job.error, job.status = str(error), "failed"
        job.phase = "completed"

    def sources(self, paths: list[str]) -> DataFrame:
        """The files of a list that the driver has made by its ignore rules, read by the executors."""
        listed = self.spark.createDataFrame([(p, i, os.stat(p).st_mtime_ns) for i, p in enumerate(paths) if os.path.exists(p)], "path string, file_ord long, mtime long")
        if not paths:
            return listed.withColumn("content", F.lit(None).cast("binary"))
        held = self.spark.read.format("binaryFile").load([f"file://{p}" for p in paths]).select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "content")
        return held.join(listed, "path")

    def _analyze(self, job: Job, force: bool) -> dict:
        job.phase = "discovering"
        config, project = find_config(job.path)
        extensions = tuple(e for e in [*EXTENSIONS, *config.extensions] if e not in config.disabled)
        root = os.path.realpath(job.path)
        paths = scan.discover(root, config.extra_ignore, extensions)
        if not paths:
            raise QueryError(f"no source files below {root}")
        cache = os.path.join(project, scan.CACHE)
        job.phase = "loading_cache"
        old = None if force and root == project else GraphStore.load(self.spark, f"file://{cache}")
        listing = self.spark.createDataFrame([(p, os.stat(p).st_mtime_ns) for p in paths], "path string, mtime long")
        warnings: list[str] = []
        if old is not None and not force:
            in_scope = old.files.where((F.col("path") == root) | F.col("path").startswith(root + "/"))
            if not incremental.stale(in_scope, listing).limit(1).count():
                return self._publish(old, root, config, warnings)
        job.phase = "parsing"
        kept = None if old is None else incremental.remove_files(old, incremental.evict_missing(old, listing, root))
        fresh, failed = scan.index(self.sources(paths), config, kept, scan.manifests(paths))
        warnings += [f"not parsed: {r['path']}" for r in failed.limit(100).collect()]
        job.phase = "persisting"
        made = fresh if kept is None else incremental.merge(kept, fresh)
        made.save(f"file://{cache}")
        return self._publish(GraphStore.load(self.spark, f"file://{cache}"), root, config, warnings)

    def _publish(self, graph: GraphStore, root: str, config: Config, warnings: list[str]) -> dict:
        self.graph, self.root, self.config = graph, root, config
        found = lookup.stats(graph).first()
        return {"files": found["files"], "symbols": found["nodes"], "edges": found["edges"], "root_path": root, "warnings": warnings}

    def use(self, graph: GraphStore, root: str = "/") -> None:
        self.graph, self.root = graph, root

    def _need(self) -> GraphStore:
        if self.graph is None:
            raise QueryError("no codebase is indexed")
        return self.graph

    def _subtree(self, subtree: str) -> str:
        if not subtree:
            return ""
        if ".." in subtree.split("/"):
            raise QueryError("a subtree must not contain ..")
        whole = subtree if subtree.startswith("/") else os.path.join(self.root or "/", subtree)
        root = (self.root or "/").rstrip("/")
        if whole != root and not whole.startswith(root + "/"):
            raise QueryError(f"the subtree is outside {root}")
        return whole.rstrip("/")

    def _page(self, rows: DataFrame, offset: int, limit: int, default: int, count_only: bool = False) -> Page:
        return page(rows, offset, limit, default, count_only, self.config.max_bytes)

    # Symbols

    def get_file_symbols(self, file: str, top_level_only: bool = False, brief: bool = True, limit: int = 0, offset: int = 0, count_only: bool = False) -> Page:
        rows = lookup.file_symbols(self._need(), file, top_level_only)
        return self._page((lookup.brief(rows) if brief else rows).select(*_COLUMNS), offset, limit, 100, count_only)

    def search_symbols(self, query: str = "", kind: str = "", namespace: str = "", language: str = "", subtree: str = "", limit: int = 0, offset: int = 0, brief: bool = True, count_only: bool = False, near: bool = False, max_distance: int | None = None) -> dict:
        graph, subtree = self._need(), self._subtree(subtree)
        try:
            if near:
                if count_only:
                    raise QueryError("a near search has no count")
                found = lookup.near(graph, query, max_distance, kind, namespace, language, subtree)
            else:
                found = lookup.search(graph, query, kind, namespace, language, subtree).orderBy("id")
        except ValueError as error:
            raise QueryError(str(error)) from error
        made = self._page((lookup.brief(found) if brief else found).select(*_COLUMNS, *(["distance"] if near else [])), offset, limit, 20, count_only)
        anchored = query.startswith("^") and query.endswith("$") and not made.total
        return made.__dict__ | ({"suggestions": [r["id"] for r in lookup.suggestions(graph, query).collect()]} if anchored else {})

    def get_symbol_detail(self, symbol: str) -> dict:
        found = lookup.detail(self._need(), symbol).select(*_COLUMNS).first()
        if found is None:
            raise QueryError(self._unknown(symbol))
        return found.asDict()

    def _unknown(self, symbol: str) -> str:
        near = [r["id"] for r in lookup.suggestions(self._need(), symbol.rsplit(":", 1)[-1]).collect()]
        return f"unknown symbol: {symbol}" + (f"; did you mean {', '.join(near)}?" if near else "")

    def get_symbol_summary(self, file: str | None = None, limit: int = 0, offset: int = 0, count_only: bool = False) -> Page:
        return self._page(lookup.summary(self._need(), file), offset, limit, 100, count_only)

    # Calls and overrides

    def _chain(self, walk, symbol: str, depth: int, limit: int, offset: int, min_confidence: str) -> Page | str:
        if min_confidence not in ("any", "resolved", ""):
            raise QueryError(f"unknown confidence: {min_confidence}")
        graph = self._need()
        starts = self.spark.createDataFrame([(symbol,)], "start string")
        rows = walk(graph, starts, max(1, depth), min_confidence == "resolved").select(F.col("node").alias("symbol_id"), "file", "line", "depth").orderBy("depth", "symbol_id")
        made = self._page(rows, offset, limit, 100)
        if not made.total:
            found = lookup.detail(graph, symbol).first()
            if found is None:
                raise QueryError(self._unknown(symbol))
            if found["kind"] in NON_CALLABLE:
                return f"{symbol} is a {found['kind']}, which cannot be called"
        return made

    def get_callers(self, symbol: str, depth: int = 1, limit: int = 0, offset: int = 0, min_confidence: str = "any") -> Page | str:
        return self._chain(traverse.callers, symbol, depth, limit, offset, min_confidence)

    def get_callees(self, symbol: str, depth: int = 1, limit: int = 0, offset: int = 0, min_confidence: str = "any") -> Page | str:
        return self._chain(traverse.callees, symbol, depth, limit, offset, min_confidence)

    def find_overrides(self, symbol: str, limit: int = 0, offset: int = 0) -> Page:
        return self._page(structure.overriding(self._need(), symbol).select(F.col("src").alias("symbol_id")).orderBy("symbol_id"), offset, limit, 100)

    # Structure

    def get_dependencies(self, file: str, limit: int = 0, offset: int = 0) -> Page:
        return self._page(structure.dependencies(self._need(), file), offset, limit, 100)

    def detect_cycles(self, subtree: str = "", limit: int = 0, offset: int = 0, max_cycle_size: int = 50) -> Page:
        rows = traverse.cycles(self._need(), self._subtree(subtree), max_cycle_size)
        total, limit = rows.count(), limit_or(limit, 20)
        kept = [{"files": r["files"]} | ({"original_len": r["original_len"]} if r["original_len"] > len(r["files"]) else {}) for r in rows.offset(offset).limit(limit).collect()]
        more = offset + len(kept) < total
        return Page(kept, total, offset, limit, more, offset + len(kept) if more else None)

    def get_orphans(self, kind: str = "", subtree: str = "", limit: int = 0, offset: int = 0, brief: bool = True, count_only: bool = False, reliability: str = "all") -> Page:
        if reliability not in ("all", "high", "very_high"):
            raise QueryError(f"unknown reliability: {reliability}")
        rows = structure.orphans(self._need(), kind, self._subtree(subtree), reliability)
        return self._page((lookup.brief(rows) if brief else rows).select(*_COLUMNS), offset, limit, 20, count_only)

    def get_class_hierarchy(self, name: str, depth: int = 1, max_nodes: int = 250) -> dict:
        graph = self._need()
        found = graph.symbols.where((F.col("id") == name) | (F.col("name") == name)).where(F.col("kind").isin(*CLASS_LIKE)).select("id", "name").orderBy("id").limit(100).collect()
        if not found:
            raise QueryError(f"unknown class: {name}")
        if len(found) > 1 and all(r["id"] != name for r in found):
            raise QueryError(f"several classes have this name: {', '.join(r['id'] for r in found)}")
        bare = next((r["name"] for r in found if r["id"] == name), name)
        depth = max(1, depth)
        most = min(max_nodes or 250, 1000)
        return structure.hierarchy(structure.class_neighbourhood(graph, bare, depth, most), bare, depth, most)

    def find_class_candidates(self, name: str) -> list[dict]:
        return [r.asDict() for r in lookup.class_candidates(self._need(), name).select(*_COLUMNS).collect()]

    def get_coupling(self, file: str, direction: str = "outgoing", limit: int = 0, offset: int = 0) -> Page | dict[str, Page]:
        graph = self._need()
        if direction not in ("outgoing", "incoming", "both"):
            raise QueryError(f"unknown direction: {direction}")

        def side(way: str) -> DataFrame:
            return structure.coupling(graph, file, way).select(F.col("other").alias("file"), "count").orderBy(F.desc("count"), "file")

        if direction == "both":
            incoming, outgoing = both_sides(side("incoming"), side("outgoing"), offset, limit, self.config.max_bytes)
            return {"incoming": incoming, "outgoing": outgoing}
        return self._page(side(direction), offset, limit, 50)

    def generate_diagram(self, symbol: str = "", file: str = "", cls: str = "", depth: int = 1, max_nodes: int = 30, format: str = "edges", direction: str = "both", min_confidence: str = "any", styled: bool = False) -> dict | str:
        if sum(map(bool, (symbol, file, cls))) != 1:
            raise QueryError("exactly one of symbol, file and class is needed")
        graph, start, depth, most = self._need(), symbol or file or cls, max(1, depth), max_nodes or 30
        if symbol:
            edges = traverse.call_edges(graph, min_confidence == "resolved").select("src", "dst", "file", "line", "file_ord", "edge_ord")
            nodes = graph.symbols.select("id")
            edges = edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi")
            label = "calls"
        elif file:
            zero = F.lit(0).cast("long")
            edges = graph.includes.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), F.lit("").alias("file"), "line", zero.alias("file_ord"), F.col("seq").alias("edge_ord"))
            label = "includes"
        else:
            edges = graph.of_kind("inherits").select("src", "dst", "file", "line", "file_ord", "edge_ord")
            label = "inherits"
        rows = [(a, b, label) for a, b in structure.bounded_ball(edges, start, depth, most, direction)]
        found = structure.diagram(rows, start, depth, most, direction)

        def shown(x: str) -> str:
            return x.rsplit("/", 1)[-1] if file else x.rsplit(":", 1)[-1] if "::" not in x else ":".join(x.split(":")[1:]) if symbol else x

        made = list(dict.fromkeys((shown(a), shown(b), la) for a, b, la in found))
        if format == "mermaid":
            return structure.mermaid(made, shown(start), styled)
        return {"center": shown(start), "edges": [{"from": a, "to": b, "label": la} for a, b, la in made]}

    # Watching and status

    def watch_start(self, events: str, checkpoint: str, poll: bool = True) -> dict:
        """Follows a folder of event files; with ``poll`` the indexed tree is listed again and again to make them."""

        def parse(frame: DataFrame, graph: GraphStore) -> GraphStore:
            paths = [r["path"] for r in frame.collect()]
            return scan.index(self.sources(paths), self.config, graph, scan.manifests(paths))[0]

        self.watcher = Watcher(self._need(), parse)
        os.makedirs(events.removeprefix("file://"), exist_ok=True) if poll else None
        self.watcher.start(self.spark, events, checkpoint)
        if poll and self.root:
            self.watcher.poll(self.spark, self.root, events)
        return {"watching": True}

    def watch_stop(self) -> dict:
        if self.watcher is not None:
            self.watcher.stop()
            self.graph, self.watcher = self.watcher.graph, None
        return {"watching": False}

    def get_status(self) -> dict:
        made: dict = {"indexed": self.graph is not None, "root": self.root, "watching": self.watcher is not None}
        if self.graph is not None:
            made |= lookup.stats(self.graph).first().asDict()
        for name, job in (("job", self.job), ("previous_job", self.before)):
            if job is not None:
                made[name] = {"id": job.id, "path": job.path, "status": job.status, "phase": job.phase, "error": job.error, "result": job.result}
        return made
