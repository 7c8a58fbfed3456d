"""Graph operators on a small hand-made graph, and on random graphs against plain Python."""

import random

import pytest

from codeloom.operators import incremental, lookup, resolve, structure, traverse
from codeloom.plans import page
from codeloom.plans.store import EDGES, FILES, INCLUDES, SYMBOLS, GraphStore

ENGINE, UTILS, MAIN = "/p/engine.cpp", "/p/utils.cpp", "/p/main.cpp"


def sym(file, name, kind, line, order, parent="", namespace="", signature=""):
    return (f"{file}:{parent + '::' if parent else ''}{name}", name, kind, file, line, 0, line, signature, namespace, parent, "cpp", 0, order)


def edge(src, dst, kind, file, line, order, confidence="resolved"):
    return (src, dst, kind, file, line, confidence, 0, order)


@pytest.fixture(scope="module")
def graph(spark):
    symbols = [
        sym(UTILS, "clamp", "function", 5, 0, namespace="utils"), sym(UTILS, "lerp", "function", 11, 1, namespace="utils"), sym(UTILS, "formatString", "function", 15, 2, namespace="utils"),
        sym("/p/engine.h", "Engine", "class", 10, 3), sym("/p/engine.h", "DebugEngine", "class", 23, 4),
        sym(ENGINE, "Engine", "method", 4, 5, "Engine"), sym(ENGINE, "update", "method", 6, 6, "Engine"), sym(ENGINE, "render", "method", 12, 7, "Engine"), sym(ENGINE, "status", "method", 16, 8, "Engine", signature="virtual int status()"),
        sym(ENGINE, "dumpState", "method", 20, 9, "DebugEngine"), sym(MAIN, "main", "function", 9, 10),
    ]
    up, re_, st, du, ma = (f"{ENGINE}:Engine::update", f"{ENGINE}:Engine::render", f"{ENGINE}:Engine::status", f"{ENGINE}:DebugEngine::dumpState", f"{MAIN}:main")
    calls = [(up, f"{UTILS}:lerp", ENGINE, 7), (up, f"{UTILS}:clamp", ENGINE, 9), (re_, f"{UTILS}:formatString", ENGINE, 13), (du, st, ENGINE, 21), (ma, up, MAIN, 11), (ma, re_, MAIN, 12), (ma, f"{UTILS}:clamp", MAIN, 14), (ma, st, MAIN, 15), (f"{UTILS}:formatString", "std::to_string", UTILS, 16)]
    edges = [edge(a, b, "calls", f, n, i) for i, (a, b, f, n) in enumerate(calls)] + [edge("DebugEngine", "Engine", "inherits", "/p/engine.h", 0, 20)]
    includes = [(ENGINE, "/p/engine.h", 1, 0), (ENGINE, "/p/utils.h", 2, 0), (MAIN, "/p/engine.h", 1, 0), ("/p/a.h", "/p/b.h", 1, 0), ("/p/b.h", "/p/a.h", 1, 0), ("/p/c.h", "/p/c.h", 1, 0)]
    files = [(f, "cpp", i, i) for i, f in enumerate((ENGINE, UTILS, MAIN, "/p/engine.h"))]
    return GraphStore(*[spark.createDataFrame(r, s).cache() for r, s in ((symbols, SYMBOLS), (edges, EDGES), (includes, INCLUDES), (files, FILES))])


def starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "start string")


def test_callers_and_callees(spark, graph):
    update = f"{ENGINE}:Engine::update"
    assert [(r.node, r.depth, r.line) for r in traverse.callers(graph, starts(spark, update)).collect()] == [(f"{MAIN}:main", 1, 11)]
    assert {(r.node, r.line) for r in traverse.callees(graph, starts(spark, update)).collect()} == {(f"{UTILS}:lerp", 7), (f"{UTILS}:clamp", 9)}
    deep = {r.node: (r.depth, r.line) for r in traverse.callees(graph, starts(spark, f"{MAIN}:main"), 4).collect()}
    assert deep[f"{UTILS}:clamp"] == (1, 14) and deep[f"{UTILS}:formatString"] == (2, 13) and "std::to_string" not in deep


def test_orphans(graph):
    assert [r.name for r in structure.orphans(graph).collect()] == ["dumpState", "Engine", "main"]
    assert [r.name for r in structure.orphans(graph, reliability="very_high").collect()] == ["dumpState", "main"]


def test_coupling_dependencies_cycles(graph):
    out = {r.other: r["count"] for r in structure.coupling(graph, ENGINE).collect()}
    assert out == {UTILS: 3, "/p/engine.h": 1, "/p/utils.h": 1}
    assert {r.other: r["count"] for r in structure.coupling(graph, ENGINE, "incoming").collect()} == {MAIN: 3}
    assert [(r["count"], r.other) for r in structure.coupling(graph, "/p/c.h").collect()] == [(1, "/p/c.h")]
    assert [r.file for r in structure.dependencies(graph, ENGINE).collect()] == ["/p/engine.h", "/p/utils.h"]
    for small in (traverse.SMALL_EDGES, 0):
        assert [(r.files, r.original_len) for r in traverse.cycles(graph, small_edges=small).collect()] == [(["/p/a.h", "/p/b.h"], 2)]
    assert traverse.cycles(graph, subtree="/q").count() == 0


def test_search(graph):
    assert [r.name for r in lookup.search(graph, "^Engine::.*e").orderBy("name").collect()] == ["Engine", "render", "update"]
    assert lookup.search(graph, "update(").count() == 0
    assert [r.name for r in lookup.near(graph, "clanp").collect()] == ["clamp"]
    assert [r.id for r in lookup.suggestions(graph, "^rende$").collect()] == [f"{ENGINE}:Engine::render"]
    assert {(r.namespace, r.kind): r["count"] for r in lookup.summary(graph).collect()}[("utils", "function")] == 3
    with pytest.raises(ValueError):
        lookup.search(graph, subtree="/p")
    assert not lookup.is_pattern("(?=x)") and not lookup.is_pattern("a(") and lookup.is_pattern("a.*")


def test_hierarchy_and_diagram(graph):
    edges = structure.class_neighbourhood(graph, "Engine", 1)
    assert structure.hierarchy(edges, "Engine") == {"tree": {"name": "Engine", "bases": [], "derived": [{"name": "DebugEngine", "bases": [], "derived": []}]}, "truncated": False}
    found = structure.diagram([("a", "b", "calls"), ("b", "c", "calls"), ("a", "b", "calls")], "a", 2)
    assert found == [("a", "b", "calls"), ("b", "c", "calls")]
    assert structure.mermaid(found).splitlines()[0] == "graph TD" and structure.mermaid([]) == ""


def test_pages(graph):
    ordered = lookup.search(graph, ".").select("id", "name").orderBy("id")
    ids, offset = [], 0
    while True:
        got = page.page(ordered, offset, 4)
        ids += [r["id"] for r in got.results]
        offset += 4
        if not got.results:
            break
    assert ids == [r.id for r in ordered.collect()]
    short = page.page(ordered, budget=page.HEADROOM + 120)
    assert short.truncated and short.next_offset == len(short.results) and short.total == len(ids)
    assert page.page(ordered, count_only=True).results == []


def test_merge_is_idempotent_and_prunes(spark, graph):
    gone = incremental.remove_files(graph, spark.createDataFrame([(UTILS,)], "path string"))
    assert gone.of_kind("calls").where("dst like '%utils%' or src like '%utils%'").count() == 0
    fresh = GraphStore(graph.occurrences.where(f"file = '{UTILS}'"), graph.edges.where(f"file = '{UTILS}'"), graph.includes.where(f"src_file = '{UTILS}'"), graph.files.where(f"path = '{UTILS}'"))
    once = incremental.merge(graph, fresh)
    assert sorted(map(tuple, once.edges.collect())) == sorted(map(tuple, graph.edges.select(*once.edges.columns).collect()))


def test_save_and_load(spark, graph, tmp_path):
    assert GraphStore.load(spark, str(tmp_path / "none")) is None
    graph.save(str(tmp_path / "g"))
    back = GraphStore.load(spark, str(tmp_path / "g"))
    assert back.edges.count() == graph.edges.count() and back.inconsistent().count() == 0


def test_scc_against_python(spark):
    rnd = random.Random(4)
    for n, m in ((12, 20), (20, 26)):
        pairs = list({(f"n{rnd.randrange(n):02}", f"n{rnd.randrange(n):02}") for _ in range(m)})
        reach = {a: {a} for e in pairs for a in e}
        for _ in range(n):
            for a, b in pairs:
                reach[a] |= reach[b]
        want = {frozenset(b for b in reach[a] if a in reach[b]) for a in reach}
        want = {g for g in want if len(g) > 1}
        rows = traverse.strong_components(spark.createDataFrame(pairs, "src string, dst string"), 0).collect()
        got = {}
        for r in rows:
            got.setdefault(r.root, set()).add(r.node)
        assert {frozenset(g) for g in got.values()} == want


def test_resolution_scores(spark):
    index = spark.createDataFrame([("cpp", "f", "/a.cpp:f", "/a.cpp", "", 0, 0), ("cpp", "f", "/b.cpp:f", "/b.cpp", "", 1, 0), ("cpp", "g", "/b.cpp:g", "/b.cpp", "", 1, 1)], "language string, key string, id string, file string, parent string, file_ord long, sym_ord long")
    raw = spark.createDataFrame([("/b.cpp:m", "f", "cpp", "/b.cpp", 1, 0), ("/c.cpp:m", "f", "cpp", "/c.cpp", 1, 0), ("/c.cpp:m", "g", "cpp", "/c.cpp", 2, 1), ("/c.cpp:m", "h", "cpp", "/c.cpp", 3, 2)], "src string, token string, language string, file string, line long, edge_ord long")
    got = {(r.src, r.token): (r.dst, r.confidence) for r in resolve.resolve_calls(raw, index).collect()}
    assert got == {("/b.cpp:m", "f"): ("/b.cpp:f", "heuristic"), ("/c.cpp:m", "f"): ("/a.cpp:f", "heuristic"), ("/c.cpp:m", "g"): ("/b.cpp:g", "resolved"), ("/c.cpp:m", "h"): ("h", "resolved")}


def test_bounded_walks_against_whole_ones(spark):
    """Diagrams and hierarchies from bounded neighbourhoods against the same walks over all edges."""
    rnd = random.Random(21)
    pairs = [(f"n{rnd.randrange(40):02}", f"n{rnd.randrange(40):02}") for _ in range(150)] + [("n00", f"x{i:03}") for i in range(120)] + [(f"y{i:03}", "n01") for i in range(60)]
    rows = [(a, b, "inherits", "/f", 1, "resolved", 0, i) for i, (a, b) in enumerate(pairs) if a != b]
    edges = spark.createDataFrame(rows, EDGES).cache()
    whole = list(dict.fromkeys((r[0], r[1]) for r in rows))
    store = GraphStore(None, edges, None, None)
    for start in ("n00", "n07"):
        for depth, most, direction in ((1, 5, "both"), (2, 12, "both"), (2, 30, "outgoing"), (3, 200, "incoming")):
            want = structure.diagram([(a, b, "x") for a, b in whole], start, depth, most, direction)
            got = structure.diagram([(a, b, "x") for a, b in structure.bounded_ball(edges, start, depth, most, direction)], start, depth, most, direction)
            assert got == want, (start, depth, most, direction)
        for depth, most in ((1, 6), (2, 25)):
            want = structure.hierarchy([(a, b, 0) for a, b in whole], start, depth, most)
            assert structure.hierarchy(structure.class_neighbourhood(store, start, depth, most), start, depth, most) == want


def test_bursts_end_at_the_gap(spark):
    """A gap of exactly the limit ends a burst, bursts go on past midnight, and events without a time count; null paths too."""
    import datetime

    from codeloom.operators import incremental

    zero = datetime.datetime(2024, 1, 1, 23, 59, 59, 800_000)
    at = {"a": [0, 249_999, 499_999, 500_000], "b": [0, 0, 150_000, 300_000, 400_000, 86_400_000_000], "c": [None, None, 5], None: [1, 2]}
    rows = [(p, None if u is None else zero + datetime.timedelta(microseconds=u)) for p, held in at.items() for u in held]
    want = {"a": [2, 2], "b": [1, 5], "c": [1, 1, 1], None: [2]}
    for kind in ("timestamp", "timestamp_ntz"):
        frame = spark.createDataFrame(rows, f"path string, ts {kind}")
        got = {}
        for r in incremental.debounced(frame).collect():
            got.setdefault(r.path, []).append(r.events)
        assert {p: sorted(n) for p, n in got.items()} == want


def test_resolution_joins_no_candidate_lists(spark):
    """A thousand calls of a name with a thousand symbols: scores as before, and no plan step gives their product."""
    size = 1000
    index = spark.createDataFrame([("cpp", "f", f"/f{i % 10}.cpp:P{i % 7}::f{i}", f"/f{i % 10}.cpp", f"P{i % 7}", 0, i) for i in range(20, size)], "language string, key string, id string, file string, parent string, file_ord long, sym_ord long")
    calls = [(f"/f{i % 13}.cpp:" + (f"P{i % 9}::m" if i % 2 else "m"), "f", "cpp", f"/f{i % 13}.cpp", 1, i) for i in range(size)]
    raw = spark.createDataFrame(calls, "src string, token string, language string, file string, line long, edge_ord long")
    solved = resolve.resolve_calls(raw, index)
    got = {r.edge_ord: (r.dst, r.confidence) for r in solved.collect()}
    held = [(i, f"/f{i % 10}.cpp", f"P{i % 7}") for i in range(20, size)]
    for src, _, _, file, _, order in calls:
        parent = src.split(":", 1)[1].split("::")[0] if "::" in src else ""
        _, i, f, p = min((-(4 * (f == file) + 3 * (parent != "" and p == parent)), i, f, p) for i, f, p in held)
        assert got[order] == (f"{f}:{p}::f{i}", "heuristic")
    widest = []

    def walk(node):
        metric = node.metrics().get("numOutputRows")
        if metric.isDefined():
            widest.append(metric.get().value())
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            walk(node.plan())

    plan = solved._jdf.queryExecution().executedPlan()
    solved._jdf.queryExecution().toRdd().count()
    walk(plan.executedPlan() if hasattr(plan, "executedPlan") else plan)
    assert widest and max(widest) <= 2 * size


def test_reach_of_many_starts(spark, monkeypatch):
    """Depths and places against a plain search, for few starts, for groups and for groups put together; pairs of a start and a node pass no shuffle."""
    rnd = random.Random(5)
    rows = [(f"n{rnd.randrange(30):02}", f"n{rnd.randrange(30):02}", f"/f{i % 3}", rnd.randrange(9), i % 3, rnd.randrange(12)) for i in range(90)] + [("n00", "gone", "/f", 1, 0, 0), ("n01", None, "/f", 1, 0, 0)]
    edges = spark.createDataFrame(rows, "src string, dst string, file string, line long, file_ord long, edge_ord long").cache()
    names = [f"n{i:02}" for i in range(30)]
    nodes, starts = spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame([(n,) for n in [*names[:20], names[0], None]], "start string")
    want = {}
    for start in names[:20]:
        found, seen = {start: ()}, {start}
        for depth in (1, 2, 3):
            best = {}
            for a, b, file, line, f, e in rows:
                if a in found and b in names and b not in seen:
                    x = (found[a] + ((f, e),), file, line)
                    best[b] = min(best.get(b, x), x)
            want.update({(start, b): (depth, x[1], x[2]) for b, x in best.items()})
            found = {b: x[0] for b, x in best.items()}
            seen |= found.keys()
    for few, size, copies in ((1000, 1000, 6), (2, 3, 100), (2, 3, 1)):
        monkeypatch.setattr(traverse, "FEW_STARTS", few)
        monkeypatch.setattr(traverse, "STARTS_A_GROUP", size)
        monkeypatch.setattr(traverse, "COPIES_OF_EDGES", copies)
        got = traverse.reach(edges, starts, 3, nodes).collect()
        assert len(got) == len(want) and {(r.start, r.node): (r.depth, r.file, r.line) for r in got} == want
        plain = traverse.reach(edges, starts, 3, nodes, places=False)
        got = plain.collect()
        assert len(got) == len(want) and {(r.start, r.node): r.depth for r in got} == {k: v[0] for k, v in want.items()}
        above = plain._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")[0]
        assert "Exchange" not in above and "Join" not in above and "Aggregate" not in above


def test_reach_by_number(spark, monkeypatch):
    """The same as ``reach`` without places, for few starts, for groups and for groups put together; a null and what has no label count nowhere."""
    rnd = random.Random(6)
    pairs = [(rnd.randrange(0, 60, 2), rnd.randrange(0, 60, 2)) for _ in range(90)] + [(0, 61), (61, 4), (2, None), (None, 2), (99, 0)]
    numbered = spark.createDataFrame(pairs, "src long, dst long").cache()
    labels = spark.createDataFrame([(i, f"n{i:02}") for i in range(0, 60, 2)] + [(4000, None), (None, "none")], "id long, label string")
    begun = spark.createDataFrame([(i,) for i in [*range(0, 40, 2), 0, None, 61]], "start long")
    known = [(f"n{a:02}", f"n{b:02}", "/f", 1, 0, i) for i, (a, b) in enumerate(pairs) if a in range(0, 60, 2) and b in range(0, 60, 2)]
    edges = spark.createDataFrame(known, "src string, dst string, file string, line long, file_ord long, edge_ord long")
    for depth in (1, 3):
        want = sorted(map(tuple, traverse.reach(edges, spark.createDataFrame([(f"n{i:02}",) for i in range(0, 40, 2)], "start string"), depth, places=False).select("start", "node", "depth").collect()))
        for few, size, copies in ((1000, 1000, 6), (2, 3, 100), (2, 3, 1)):
            monkeypatch.setattr(traverse, "FEW_STARTS", few)
            monkeypatch.setattr(traverse, "STARTS_A_GROUP", size)
            monkeypatch.setattr(traverse, "COPIES_OF_EDGES", copies)
            got = traverse.reach_numbered(numbered, begun, depth, labels).select("start", "node", "depth")
            assert want and sorted(map(tuple, got.collect())) == want
            above = got._jdf.queryExecution().sparkPlan().toString().split("MapInArrow")[0]
            assert "Exchange" not in above and "Join" not in above and "Aggregate" not in above


@pytest.mark.parametrize("name", ["callees_d3", "callers_d3"])
def test_deep_walks_shuffle_little(spark, name):
    """Calls go through shuffles as numbers: on sf0.01 all shuffles together write less than 4 times the input."""
    import os

    import __spark_entry__

    data = "/root/testdata/sf0.01"

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        held = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(held.apply(k).totalShuffleWrite() for k in range(held.size()))

    before = shuffled()
    __spark_entry__.queries()[name](spark, data).write.format("noop").mode("overwrite").save()
    took, given = shuffled() - before, sum(os.path.getsize(f"{data}/{t}.parquet") for t in ("part", "lineitem"))
    assert 0 < took < 4 * given, (took, given)


def test_written_table_frees_its_shuffles(spark):
    """With ``frees`` no shuffle file of the write is left when it ends, and the session's setting is as before."""
    import time

    from codeloom.plans import tables

    def held():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for k in range(found.size()) if (n := found.apply(k).getName()).startswith("shuffle_")}

    before, setting = held(), spark.conf.get(tables._FREES, None)
    made = tables.written(spark.range(9_000).selectExpr("id % 7 AS k").repartition("k").groupBy("k").count(), "freed", frees=True)
    until = time.time() + 20
    while held() - before and time.time() < until:
        time.sleep(0.2)
    assert not held() - before and spark.conf.get(tables._FREES, None) == setting
    assert made.count() == 7
