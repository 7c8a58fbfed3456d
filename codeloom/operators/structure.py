"""Queries about structure: orphans, coupling, dependencies, overrides, hierarchies and diagrams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import CALLABLE, SYNTHETIC_PREFIX, TEMPLATE_PREFIX, is_virtual, under
from codeloom.operators.traverse import closure
from codeloom.plans.store import GraphStore


def orphans(graph: GraphStore, kind: str = "", subtree: str = "", reliability: str = "all") -> DataFrame:
    """Callables that no call edge targets, of any confidence and from any source, by id.

    ``high`` leaves out virtual and synthesized ones; ``very_high`` also templates, C++ operators and constructors.
    """
    rows = graph.symbols.where(F.col("kind") == kind if kind else F.col("kind").isin(*CALLABLE))
    if subtree:
        rows = rows.where(under(F.col("file"), subtree))
    if reliability in ("high", "very_high"):
        rows = rows.where(~is_virtual(F.col("signature")) & ~F.col("signature").startswith(SYNTHETIC_PREFIX))
    if reliability == "very_high":
        operator = (F.col("language") == "cpp") & F.col("name").rlike("^operator([^A-Za-z0-9_]|$)")
        built = F.col("language").isin("cpp", "java", "csharp") & (F.col("name") == F.col("parent")) & (F.col("parent") != "")
        rows = rows.where(~F.col("signature").startswith(TEMPLATE_PREFIX) & ~operator & ~built)
    called = graph.of_kind("calls").select(F.col("dst").alias("id"))
    return rows.join(called, "id", "left_anti").orderBy("id")


def _call_files(graph: GraphStore) -> DataFrame:
    nodes = graph.symbols
    sources = nodes.select(F.col("id").alias("src"), F.col("file").alias("src_file"))
    targets = nodes.select(F.col("id").alias("dst"), F.col("file").alias("dst_file"))
    return graph.of_kind("calls").select("src", "dst").join(sources, "src").join(targets, "dst").where("src_file <> dst_file").select("src_file", "dst_file")


def coupling(graph: GraphStore, file: str | None = None, direction: str = "outgoing") -> DataFrame:
    """(file, other, count) of calls to or from other files' symbols plus includes; all files at once, or one.

    A file's include of itself counts as outgoing, not as incoming.
    """
    out = direction == "outgoing"
    includes = graph.includes.select("src_file", "dst_file")
    pairs = _call_files(graph).unionAll(includes if out else includes.where("src_file <> dst_file"))
    a, b = ("src_file", "dst_file") if out else ("dst_file", "src_file")
    if file is not None:
        pairs = pairs.where(F.col(a) == file)
    return pairs.groupBy(F.col(a).alias("file"), F.col(b).alias("other")).agg(F.count(F.lit(1)).alias("count")).orderBy("file", F.desc("count"), "other")


def dependencies(graph: GraphStore, file: str) -> DataFrame:
    return graph.includes.where(F.col("src_file") == file).select(F.col("dst_file").alias("file"), "line").orderBy("file", "line")


def overriding(graph: GraphStore, symbol: str | None = None) -> DataFrame:
    """Override edges whose source is a node, to one symbol or to all; duplicates stay."""
    edges = graph.of_kind("overrides")
    if symbol is not None:
        edges = edges.where(F.col("dst") == symbol)
    return edges.join(graph.symbols.select(F.col("id").alias("src")), "src", "left_semi").select("src", "dst").orderBy("src", "dst")


def relatives(graph: GraphStore, names: DataFrame, up: bool = True, most: int = 1000) -> DataFrame:
    """(start, node, depth): the bases, or the derived classes, of class names at any depth."""
    edges = graph.of_kind("inherits").select("src", "dst")
    if not up:
        edges = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return closure(edges, names, most)


def inferred_overrides(graph: GraphStore) -> DataFrame:
    """(src, dst): methods of a name that a class and one of its bases both have."""
    methods = graph.symbols.where("kind = 'method' AND parent <> ''")
    derived = methods.select(F.col("parent").alias("start")).distinct()
    above = relatives(graph, derived).where("start <> node").select(F.col("start").alias("parent"), F.col("node").alias("base"))
    own = methods.select("parent", "name", F.col("id").alias("src"))
    theirs = methods.select(F.col("parent").alias("base"), "name", F.col("id").alias("dst"))
    return own.join(above, "parent").join(theirs, ["base", "name"]).select("src", "dst").distinct()


def first_arms(edges: DataFrame, nodes: list[str], most: int) -> DataFrame:
    """(node, other, out) of the first ``most`` different neighbours, each way, of a bounded list of nodes, by the edges' order (file_ord, edge_ord)."""
    held = F.broadcast(edges.sparkSession.createDataFrame([(n,) for n in nodes], "node string"))  # the caller bounds the list
    order = F.struct("file_ord", "edge_ord", "src", "dst").alias("o")
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(True).alias("out"), order).join(held, "node", "left_semi")
    into = edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(False).alias("out"), order).join(held, "node", "left_semi")
    once = out.unionByName(into).groupBy("node", "other", "out").agg(F.min("o").alias("o"))
    ranked = once.withColumn("n", F.row_number().over(Window.partitionBy("node", "out").orderBy("o")))
    return ranked.where(F.col("n") <= most).select("node", "other", "out", "o")


def bounded_ball(edges: DataFrame, start: str, depth: int, most: int, direction: str = "both") -> list[tuple[str, str]]:
    """The edges (src, dst), in their order, that a walk from ``start`` over ``most`` nodes and ``depth`` hops can show.

    A hop looks at ``most`` nodes at most, and at twice as many neighbours of each: more cannot be taken. Edges between the nodes found
    this way are all there, each once. The driver holds no more than these.
    """
    met, frontier = {start: None}, [start]
    for _ in range(depth):
        rows = first_arms(edges, frontier, 2 * most + 1).orderBy("o").collect()
        arms: dict[str, list] = {}
        for r in rows:
            if direction == "both" or r["out"] == (direction == "outgoing"):
                arms.setdefault(r["node"], []).append(r)
        found: dict[str, None] = {}
        for node in frontier:
            for r in sorted(arms.get(node, []), key=lambda r: not r["out"]):
                if r["other"] not in met:
                    found[r["other"]] = None
        frontier = list(found)[:most]
        met |= dict.fromkeys(frontier)
        if not frontier or len(met) > most:
            break
    held = edges.sparkSession.createDataFrame([(n,) for n in met], "node string")
    inner = edges.join(F.broadcast(held.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(held.withColumnRenamed("node", "dst")), "dst", "left_semi")  # 2 * most names at most
    once = inner.groupBy("src", "dst").agg(F.min(F.struct("file_ord", "edge_ord")).alias("o"))
    return [(r["src"], r["dst"]) for r in once.orderBy("o", "src", "dst").collect()]


def class_neighbourhood(graph: GraphStore, name: str, depth: int, most: int = 250, held: int = 20_000) -> list[tuple[str, str, int]]:
    """Inherits edges (derived, base, order) within ``depth`` + 1 hops of a name, either way, as far as a tree of ``most`` classes can show them.

    A class needs no more than ``most`` + 1 bases or heirs; beyond ``held`` names no further hop is made.
    """
    edges = graph.of_kind("inherits").select("src", "dst", "file_ord", "edge_ord")
    near, frontier = {name: None}, [name]
    for _ in range(depth + 1):
        found = [r["other"] for r in first_arms(edges, frontier, most + 1).orderBy("o").collect()]
        frontier = [n for n in dict.fromkeys(found) if n not in near][:held]
        near |= dict.fromkeys(frontier)
        if not frontier or len(near) > held:
            break
    names = edges.sparkSession.createDataFrame([(n,) for n in near], "node string")
    kept = edges.join(F.broadcast(names.withColumnRenamed("node", "src")), "src", "left_semi").join(F.broadcast(names.withColumnRenamed("node", "dst")), "dst", "left_semi")  # 2 * held names at most
    return [(r[0], r[1], r[2]) for r in kept.groupBy("src", "dst").agg(F.min("edge_ord").alias("o")).orderBy("o", "src", "dst").collect()]


def hierarchy(edges: list[tuple[str, str, int]], name: str, depth: int = 1, most: int = 250) -> dict:
    """The tree around a class: bases before derived, depth first.

    A class on the path to itself is a bare leaf; one met before is a stub with ``ref``; at most ``most`` classes are new.
    """
    bases: dict[str, list[str]] = {}
    derived: dict[str, list[str]] = {}
    for d, b, _ in edges:
        if b not in bases.setdefault(d, []):
            bases[d].append(b)
        if d not in derived.setdefault(b, []):
            derived[b].append(d)
    met = {name}
    full = False

    def visit(node: str, left: int, path: frozenset[str]) -> dict:
        nonlocal full
        made: dict = {"name": node, "bases": [], "derived": []}
        if not left:
            return made
        for key, table in (("bases", bases), ("derived", derived)):
            for other in table.get(node, []):
                if other in path:
                    made[key].append({"name": other, "bases": [], "derived": []})
                elif other in met:
                    made[key].append({"name": other, "bases": [], "derived": [], "ref": True})
                elif len(met) >= most:
                    full = True
                else:
                    met.add(other)
                    made[key].append(visit(other, left - 1, path | {other}))
        return made

    tree = visit(name, depth, frozenset([name]))
    return {"tree": tree, "truncated": full}


def diagram(edges: list[tuple[str, str, str]], start: str, depth: int = 1, most: int = 30, direction: str = "both") -> list[tuple[str, str, str]]:
    """(from, to, label) of a budgeted breadth-first walk over (src, dst, label): arms out before arms in.

    The walk stops taking nodes once ``most`` have been met; edges whose ends were not both met go, and so do repeats.
    """
    out: dict[str, list[tuple[str, str]]] = {}
    into: dict[str, list[tuple[str, str]]] = {}
    for a, b, label in edges:
        out.setdefault(a, []).append((b, label))
        into.setdefault(b, []).append((a, label))
    met, queue, found = {start: 0}, [start], []
    while queue and len(met) < most:
        node = queue.pop(0)
        if met[node] >= depth:
            continue
        arms = [(node, o, la, o) for o, la in out.get(node, [])] * (direction != "incoming") + [(o, node, la, o) for o, la in into.get(node, [])] * (direction != "outgoing")
        for a, b, label, other in arms:
            found.append((a, b, label))
            if other not in met and len(met) < most:
                met[other] = met[node] + 1
                queue.append(other)
    return list(dict.fromkeys(e for e in found if e[0] in met and e[1] in met))


def mermaid(edges: list[tuple[str, str, str]], centre: str = "", styled: bool = False) -> str:
    """A Mermaid graph of the edges; empty for none."""
    if not edges:
        return ""
    number: dict[str, str] = {}
    lines = ["graph TD"]
    for a, b, _ in edges:
        for x in (a, b):
            if x not in number:
                number[x] = f"n{len(number)}"
                lines.append(f'    {number[x]}["{x}"]')
    for a, b, label in edges:
        arrow = "-.->" if label == "called by" else "-->"
        lines.append(f"    {number[a]} {arrow}|{label}| {number[b]}")
    if styled and centre in number:
        lines.append(f"    style {number[centre]} fill:#f9f,stroke:#333")
    return "\n".join(lines)
