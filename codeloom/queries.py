"""The registered graph queries over the projection of the star-schema tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import id_basename, id_file, id_parent, qualified, rfc3339
from codeloom.operators import incremental, lookup, resolve, structure, traverse
from codeloom.plans.page import within_budget
from codeloom.plans.store import GraphStore
from codeloom.sources import projection

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_SYMBOLS = """sym AS (SELECT concat(replace(p_name, ' ', '_'), '_', p_partkey) AS name,
  ['function','method','class','struct','enum','typedef','interface','trait'][p_size % 8 + 1] AS kind,
  concat('/src/', lower(replace(p_brand, '#', '')), '/', lower(replace(p_type, ' ', '_')), '.', ['cpp','rs','go','py','cs','java'][p_partkey % 6 + 1]) AS file,
  p_size::BIGINT AS line, 0::BIGINT AS "column", (p_size + 1)::BIGINT AS end_line,
  CASE WHEN p_partkey % 7 = 0 THEN concat('virtual void f', p_partkey, '()') WHEN p_partkey % 11 = 0 THEN concat('/* template */ void f', p_partkey, '()') ELSE concat('void f', p_partkey, '()') END AS signature,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE lower(replace(p_brand, '#', '')) END AS namespace,
  CASE WHEN p_size % 8 = 1 THEN concat('C', p_size) ELSE '' END AS parent,
  ['cpp','rust','go','python','csharp','java'][p_partkey % 6 + 1] AS language, p_partkey AS sym_ord FROM part),
s AS (SELECT concat(file, ':', CASE WHEN parent = '' THEN name ELSE concat(parent, '::', name) END) AS id, * FROM sym)"""
_CALLS = """step AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey, lead(l_partkey) OVER w AS nxt, l_orderkey * 64 + row_number() OVER w AS edge_ord
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_returnflag)),
calls AS (SELECT a.id AS src, b.id AS dst, a.file, b.file AS dst_file, l_linenumber::BIGINT AS line, CASE WHEN l_returnflag = 'R' THEN 'heuristic' ELSE 'resolved' END AS confidence, edge_ord
  FROM step JOIN s a ON a.sym_ord = l_partkey JOIN s b ON b.sym_ord = nxt - nxt % 3)"""
_INCLUDES = """inc AS (SELECT f.file AS src_file, t.file AS dst_file, f.line FROM (SELECT file, min(sym_ord) AS o, arg_min(line, sym_ord) AS line FROM s GROUP BY file) f
  JOIN s t ON t.sym_ord = (f.o * 7 + f.line) % (SELECT count(*) FROM part))"""
_INHERITS = "inh AS (SELECT a.name AS src, b.name AS dst, a.sym_ord FROM s a JOIN s b ON b.sym_ord = a.sym_ord - 1 - a.line WHERE a.sym_ord % 3 <> 0)"
_OVERRIDES = "ovr AS (SELECT a.id AS src, b.id AS dst FROM s a JOIN s b ON b.sym_ord = a.sym_ord - 1 WHERE a.kind = 'method')"
_EVENTS = "ev AS (SELECT concat('/src/f', user_id % 7, '.cpp') AS path, event_type = 'error' AS is_remove, ts, event_id FROM events)"
_PARTS = {"calls": _CALLS, "inc": _INCLUDES, "inh": _INHERITS, "ovr": _OVERRIDES, "ev": _EVENTS}


def query(name: str, sql: str | None = None, *parts: str, recursive: bool = False) -> Callable[[Callable[[GraphStore, SparkSession, str], DataFrame]], Query]:
    """Registers a function of (graph, spark, sf_dir), with SQL over ``s`` and the named parts."""

    def add(made: Callable[[GraphStore, SparkSession, str], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return made(projection.graph(spark, sf_dir), spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = f"WITH {'RECURSIVE ' * recursive}" + ", ".join([_SYMBOLS, *[_PARTS[p] for p in parts]]) + ("" if sql.lstrip().startswith(",") else " ") + sql
        return run

    return add


_SHOWN = ["id", "name", "kind", "file", "line", "signature", "namespace", "parent", "language"]
_SHOW = "SELECT id, name, kind, file, line, signature, namespace, parent, language FROM s"


def _one(graph: GraphStore, order: int, column: str) -> str:
    return graph.occurrences.where(F.col("sym_ord") == order).first()[column]


@query("symbol_detail", f"{_SHOW} WHERE sym_ord = 17")
def _(g, spark, d):
    return lookup.detail(g, _one(g, 17, "id")).select(*_SHOWN)


@query("file_symbols", f"{_SHOW} WHERE file = (SELECT file FROM s WHERE sym_ord = 5)")
def _(g, spark, d):
    return lookup.file_symbols(g, _one(g, 5, "file")).select(*_SHOWN)


@query("file_symbols_top_level_brief", "SELECT id, kind, line, 0::BIGINT AS \"column\", 0::BIGINT AS end_line, '' AS signature FROM s WHERE file = (SELECT file FROM s WHERE sym_ord = 5) AND parent = ''")
def _(g, spark, d):
    return lookup.brief(lookup.file_symbols(g, _one(g, 5, "file"), top_level_only=True)).select("id", "kind", "line", "column", "end_line", "signature")


@query("class_candidates", f"{_SHOW} WHERE name = (SELECT min(name) FROM s WHERE kind = 'class') AND kind IN ('class', 'struct', 'interface', 'trait')")
def _(g, spark, d):
    return lookup.class_candidates(g, g.symbols.where("kind = 'class'").agg(F.min("name")).first()[0]).select(*_SHOWN)


@query("search_regex", f"{_SHOW} WHERE regexp_matches(CASE WHEN parent = '' THEN name ELSE parent || '::' || name END, '^C[0-9]+::.*_1[0-9]*$', 'i')")
def _(g, spark, d):
    return lookup.search(g, "^C[0-9]+::.*_1[0-9]*$").select(*_SHOWN)


@query("search_substring", "SELECT id, upper(name) || '(' AS name FROM s WHERE contains(lower(name) || '(', '1(')")
def _(g, spark, d):
    # No pattern, as its bracket stays open: sought as text, case aside.
    named = g.symbols.withColumn("name", F.concat(F.upper("name"), F.lit("(")))
    return lookup.search(GraphStore(named, g.edges, g.includes, g.files, named), "1(").select("id", "name")


@query("search_filters", f"{_SHOW} WHERE kind = 'method' AND language = 'rust' AND contains(namespace, '1') AND regexp_matches(parent || '::' || name, '_[0-9]*7', 'i')")
def _(g, spark, d):
    return lookup.search(g, "_[0-9]*7", kind="method", namespace="1", language="rust").select(*_SHOWN)


@query("search_count", "SELECT count(*) AS total FROM s WHERE kind IN ('function') AND regexp_matches(name, '1', 'i')")
def _(g, spark, d):
    return lookup.search(g, "1", kind="function").agg(F.count(F.lit(1)).alias("total"))


@query("search_subtree", f"{_SHOW} WHERE starts_with(file, '/src/brand1/') AND kind = 'class'")
def _(g, spark, d):
    return lookup.search(g, kind="class", subtree="/src/brand1").select(*_SHOWN)


@query("search_near", "SELECT id, name, levenshtein(lower(name), lower((SELECT name FROM s WHERE sym_ord = 7)))::BIGINT AS distance FROM s WHERE levenshtein(lower(name), lower((SELECT name FROM s WHERE sym_ord = 7))) <= 3")
def _(g, spark, d):
    return lookup.near(g, _one(g, 7, "name"), 3).select("id", "name", F.col("distance").cast("long").alias("distance"))


@query("near_rank", """, q AS (SELECT name AS qn, lower(name) AS q FROM s WHERE sym_ord = 7), n AS (SELECT id, name, levenshtein(lower(name), q) AS distance, len(list_filter(range(1, length(q) + 1), lambda i: starts_with(lower(name), left(q, i)))) AS common, length(name) < length(qn) AS shorter, abs(length(name) - length(qn)) AS off FROM s, q)
  SELECT id, row_number() OVER (ORDER BY distance, common DESC, shorter, off, name, id) AS rank FROM n WHERE distance <= 8 ORDER BY rank LIMIT 50""")
def _(g, spark, d):
    found = lookup.near(g, _one(g, 7, "name"), 8).select("id").limit(50)
    return found.withColumn("rank", F.monotonically_increasing_id() + 1)  # one page of an ordered frame is one partition


@query("symbol_summary", "SELECT CASE WHEN namespace = '' THEN '<global>' ELSE namespace END AS namespace, kind, count(*) AS count FROM s GROUP BY ALL")
def _(g, spark, d):
    return lookup.summary(g)


@query("stats", "SELECT (SELECT count(*) FROM s) AS nodes, ((SELECT count(*) FROM calls) + (SELECT count(*) FROM inc) + (SELECT count(*) FROM inh) + (SELECT count(*) FROM ovr))::BIGINT AS edges, (SELECT count(DISTINCT file) FROM s) AS files", "calls", "inc", "inh", "ovr")
def _(g, spark, d):
    return lookup.stats(g)


@query("page_topk", f"{_SHOW} ORDER BY id LIMIT 20 OFFSET 40")
def _(g, spark, d):
    return g.symbols.select(*_SHOWN).orderBy("id").offset(40).limit(20)


@query("byte_budget_page", ", p AS (SELECT id, (strlen(id) + strlen(signature) + 40)::BIGINT AS size FROM s ORDER BY id LIMIT 1000), r AS (SELECT id, size, sum(size + 1) OVER (ORDER BY id)::BIGINT AS running FROM p) SELECT id, size, running FROM r WHERE running <= 20000 - 512")
def _(g, spark, d):
    page = g.symbols.select("id", (F.octet_length("id") + F.octet_length("signature") + 40).cast("long").alias("size")).orderBy("id").limit(1000)
    return within_budget(["id"], page, F.col("size"), 20000)


@query("dependencies", "SELECT dst_file AS file, line FROM inc WHERE src_file = (SELECT file FROM s WHERE sym_ord = 5)", "inc")
def _(g, spark, d):
    return structure.dependencies(g, _one(g, 5, "file"))


@query("overrides", "SELECT src, dst FROM ovr", "ovr")
def _(g, spark, d):
    return structure.overriding(g)


_ORPHANS = "SELECT id FROM s WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst = s.id)"
_HIGH = " AND NOT (starts_with(signature, 'virtual ') OR contains(signature, ' virtual '))"
for _name, _more, _args in (
    ("orphans_all", "", {}), ("orphans_high", _HIGH, {"reliability": "high"}), ("orphans_very_high", _HIGH + " AND NOT starts_with(signature, '/* template */') AND NOT (language IN ('cpp', 'java', 'csharp') AND name = parent AND parent <> '')", {"reliability": "very_high"}),
    ("orphans_subtree", " AND starts_with(file, '/src/brand1/')", {"subtree": "/src/brand1"}), ("orphans_kind", " AND kind = 'method'", {"kind": "method"}),
):
    query(_name, _ORPHANS + _more, "calls")(lambda g, spark, d, args=_args: structure.orphans(g, **args).select("id"))

_OUT = "SELECT file, dst_file AS other FROM calls WHERE file <> dst_file UNION ALL SELECT src_file, dst_file FROM inc"
_IN = "SELECT dst_file AS file, file AS other FROM calls WHERE file <> dst_file UNION ALL SELECT dst_file, src_file FROM inc WHERE src_file <> dst_file"


@query("coupling_out", f"SELECT file, other, count(*) AS count FROM ({_OUT}) GROUP BY ALL", "calls", "inc")
def _(g, spark, d):
    return structure.coupling(g)


@query("coupling_in", f"SELECT file, other, count(*) AS count FROM ({_IN}) GROUP BY ALL", "calls", "inc")
def _(g, spark, d):
    return structure.coupling(g, direction="incoming")


@query("coupling_both", f"SELECT 'outgoing' AS direction, file, other, count(*) AS count FROM ({_OUT}) WHERE file = (SELECT file FROM s WHERE sym_ord = 5) GROUP BY ALL UNION ALL SELECT 'incoming', file, other, count(*) FROM ({_IN}) WHERE file = (SELECT file FROM s WHERE sym_ord = 5) GROUP BY ALL", "calls", "inc")
def _(g, spark, d):
    file = _one(g, 5, "file")
    sides = [structure.coupling(g, file, side).withColumn("direction", F.lit(side)) for side in ("outgoing", "incoming")]
    return sides[0].unionByName(sides[1]).select("direction", "file", "other", "count")


def _starts(g: GraphStore) -> DataFrame:
    return g.symbols.where("kind IN ('function', 'method')").select(F.col("id").alias("start"))


def _bfs(source: str, target: str, depth: int, where: str = "TRUE") -> str:
    return f""", e AS (SELECT DISTINCT {source} AS a, {target} AS b FROM calls WHERE {where}),
walk(start, node, depth) AS (SELECT id, id, 0 FROM s WHERE kind IN ('function', 'method') UNION SELECT start, b, depth + 1 FROM walk JOIN e ON e.a = node WHERE depth < {depth})
SELECT start, node, min(depth)::BIGINT AS depth FROM walk GROUP BY start, node HAVING min(depth) > 0"""


for _name, _walk, _depth, _sure in (("callers_d1", traverse.callers, 1, False), ("callers_d3", traverse.callers, 3, False), ("callees_d1", traverse.callees, 1, False), ("callees_d3", traverse.callees, 3, False), ("callees_resolved", traverse.callees, 3, True)):
    query(_name, _bfs(*(("dst", "src") if _walk is traverse.callers else ("src", "dst")), _depth, "confidence = 'resolved'" if _sure else "TRUE"), "calls", recursive=True)(
        lambda g, spark, d, walk=_walk, depth=_depth, sure=_sure: walk(g, _starts(g), depth, sure, places=False).select("start", "node", "depth")
    )


@query("callees_first_site", ", f AS (SELECT src AS start, dst AS node, file, line, row_number() OVER (PARTITION BY src, dst ORDER BY edge_ord, file, line) AS n FROM calls WHERE src <> dst AND src IN (SELECT id FROM s WHERE kind IN ('function', 'method'))) SELECT start, node, file, line FROM f WHERE n = 1", "calls")
def _(g, spark, d):
    return traverse.callees(g, _starts(g), 1).select("start", "node", "file", "line")


_SCC = """, e AS (SELECT DISTINCT src_file AS a, dst_file AS b FROM inc WHERE src_file <> dst_file), r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT x.a AS node, min(x.b) AS root FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a), c AS (SELECT root AS first, list_sort(list(node)) AS files, count(*) AS original_len FROM m GROUP BY root HAVING count(*) > 1)"""


@query("cycles", _SCC + " SELECT first, array_to_string(files, '|') AS files, original_len FROM c", "inc", recursive=True)
def _(g, spark, d):
    return traverse.cycles(g).withColumn("files", F.array_join("files", "|"))


@query("cycle_cap", _SCC + " SELECT first, array_to_string(files[1:3], '|') AS files, original_len FROM c", "inc", recursive=True)
def _(g, spark, d):
    return traverse.cycles(g, most_files=3).withColumn("files", F.array_join("files", "|"))


@query("cycles_subtree", "SELECT min(file) AS first, string_agg(file, '|' ORDER BY file) AS files, count(*) AS original_len FROM (SELECT DISTINCT file FROM s WHERE starts_with(file, '/src/' || (SELECT regexp_extract(file, '/src/([^/]*)/', 1) FROM s WHERE sym_ord = 5) || '/')) HAVING count(*) > 1")
def _(g, spark, d):
    # Every folder's files include one another in a ring; one folder's ring is under the subtree, the others' are not.
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    by = Window.partitionBy("folder").orderBy("path")
    ring = g.files.select("path", folder.alias("folder")).withColumns({"next": F.lead("path").over(by), "first": F.first("path").over(by)})
    ring = ring.select(F.col("path").alias("src_file"), F.coalesce("next", "first").alias("dst_file"), F.lit(1).cast("long").alias("line"), F.lit(0).cast("long").alias("seq"))
    return traverse.cycles(GraphStore(g.occurrences, g.edges, ring, g.files), subtree=_one(g, 5, "file").rsplit("/", 1)[0]).withColumn("files", F.array_join("files", "|"))


def _names(g: GraphStore) -> DataFrame:
    return g.symbols.where("kind = 'class'").select(F.col("name").alias("start"))


for _name, _up in (("class_ancestors", True), ("class_descendants", False)):
    _a, _b = ("src", "dst") if _up else ("dst", "src")
    query(_name, f", w(start, node, depth) AS (SELECT name, name, 0 FROM s WHERE kind = 'class' UNION SELECT start, {_b}, depth + 1 FROM w JOIN inh ON {_a} = node WHERE depth < 100) SELECT start, node, min(depth)::BIGINT AS depth FROM w GROUP BY ALL HAVING min(depth) > 0", "inh", recursive=True)(
        lambda g, spark, d, up=_up: structure.relatives(g, _names(g), up)
    )


@query("hierarchy_names", ", e AS (SELECT src AS a, dst AS b FROM inh UNION SELECT dst, src FROM inh), w(node, depth) AS (SELECT min(dst), 0 FROM inh UNION SELECT b, depth + 1 FROM w JOIN e ON a = node WHERE depth < 2) SELECT DISTINCT node FROM w", "inh", recursive=True)
def _(g, spark, d):
    edges = g.of_kind("inherits").select("src", "dst", "file", "line", "file_ord", "edge_ord")
    both = edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    start = edges.agg(F.min("dst").alias("start"))
    return traverse.reach(both, start, 2).select("node").union(start).distinct()


@query("override_inference", ", w(start, node, depth) AS (SELECT name, name, 0 FROM s UNION SELECT start, dst, depth + 1 FROM w JOIN inh ON src = node WHERE depth < 100) SELECT DISTINCT 'm:' || x.id AS src, 'm:' || y.id AS dst FROM s x JOIN w ON w.start = x.name AND w.node <> x.name JOIN s y ON y.name = w.node AND y.kind = x.kind", "inh", recursive=True)
def _(g, spark, d):
    # Every symbol is read as a class with one method, named like the symbol's kind.
    methods = g.occurrences.withColumns({"id": F.concat(F.lit("m:"), F.col("id")), "parent": F.col("name"), "name": F.col("kind"), "kind": F.lit("method")})
    return structure.inferred_overrides(GraphStore(methods, g.edges, g.includes, g.files))


_INDEX = """ix AS (SELECT language, name AS key, id, file, parent, sym_ord FROM s UNION ALL SELECT language, parent || '::' || name, id, file, parent, sym_ord FROM s WHERE parent <> ''
  UNION ALL SELECT language, namespace || '::' || name, id, file, parent, sym_ord FROM s WHERE namespace <> ''
  UNION ALL SELECT language, namespace || '::' || parent || '::' || name, id, file, parent, sym_ord FROM s WHERE namespace <> '' AND parent <> '')"""


@query("symbol_index", f", {_INDEX} SELECT language, key, id FROM ix")
def _(g, spark, d):
    return resolve.symbol_index(g.symbols).select("language", "key", "id")


_SHORT = "regexp_replace(name, '_[0-9]+$', '')"


@query("resolve_calls", f""", t AS (SELECT id, {_SHORT} AS name, file, namespace, parent, language, sym_ord FROM s), raw AS (SELECT c.src, c.edge_ord, c.file, c.line, b.language, regexp_replace(b.name, '_[0-9]+$', '') AS token, a.parent AS cp
  FROM calls c JOIN s a ON a.id = c.src JOIN s b ON b.id = c.dst),
k AS (SELECT raw.src, raw.edge_ord, raw.file, raw.line, raw.token, t.id, (CASE WHEN t.file = raw.file THEN 4 ELSE 0 END) + (CASE WHEN raw.cp <> '' AND t.parent = raw.cp THEN 3 ELSE 0 END) AS score, t.sym_ord FROM raw JOIN t ON t.language = raw.language AND t.name = raw.token),
p AS (SELECT src, edge_ord, arg_min(id, (-score, sym_ord)) AS dst, count(*) AS n FROM k GROUP BY src, edge_ord)
SELECT raw.src, raw.edge_ord, raw.token, coalesce(p.dst, raw.token) AS dst, CASE WHEN n > 1 THEN 'heuristic' ELSE 'resolved' END AS confidence FROM raw LEFT JOIN p USING (src, edge_ord)""", "calls")
def _(g, spark, d):
    short = F.regexp_replace("name", "_[0-9]+$", "")
    names = g.symbols.select(F.col("id").alias("dst"), short.alias("token"), "language")
    raw = g.of_kind("calls").join(names, "dst").select("src", "token", "language", "file", "line", "edge_ord")
    index = g.symbols.select("language", short.alias("key"), "id", "file", "parent", "file_ord", "sym_ord")
    return resolve.resolve_calls(raw, index).select("src", "edge_ord", "token", "dst", "confidence")


@query("resolve_includes", ", f AS (SELECT file AS path, min(sym_ord) AS o, regexp_extract(file, '[^/]*$') AS base FROM s GROUP BY file), raw AS (SELECT src_file, line, CASE WHEN line % 2 = 0 THEN regexp_extract(dst_file, '[^/]*$') ELSE regexp_extract(dst_file, '[^/]*/[^/]*$') END AS token FROM inc) SELECT src_file, line, arg_min(path, (NOT ends_with(path, '/' || token), o)) AS dst_file FROM raw JOIN f ON base = regexp_extract(token, '[^/]*$') GROUP BY src_file, line, token", "inc")
def _(g, spark, d):
    token = F.when(F.col("line") % 2 == 0, F.regexp_extract("dst_file", "([^/]*)$", 1)).otherwise(F.regexp_extract("dst_file", "([^/]*/[^/]*)$", 1))
    return resolve.resolve_includes(g.includes.select("src_file", token.alias("token"), "line", "seq"), g.files).select("src_file", "line", "dst_file")


@query("longest_prefix_owner", ", f AS (SELECT DISTINCT file AS path FROM s), o AS (SELECT '/src' AS owner UNION ALL SELECT DISTINCT regexp_extract(file, '^(/src/[^/]*[13579])/', 1) FROM s) SELECT path, arg_max(owner, length(owner)) AS owner FROM f JOIN o ON owner <> '' AND starts_with(path, owner || '/') GROUP BY path")
def _(g, spark, d):
    owners = g.files.select(F.regexp_extract("path", "^(/src/[^/]*[13579])/", 1).alias("owner")).where("owner <> ''").union(spark.createDataFrame([("/src",)], "owner string"))
    return resolve.longest_prefix(g.files, owners)


@query("diagram_edges", ", w(node, depth) AS (SELECT min(src_file), 0 FROM inc UNION SELECT CASE WHEN node = src_file THEN dst_file ELSE src_file END, depth + 1 FROM w JOIN inc ON node IN (src_file, dst_file) WHERE depth < 2), m AS (SELECT node, min(depth) AS depth FROM w GROUP BY node) SELECT DISTINCT src_file AS \"from\", dst_file AS \"to\" FROM inc WHERE (src_file IN (SELECT node FROM m WHERE depth < 2) OR dst_file IN (SELECT node FROM m WHERE depth < 2))", "inc", recursive=True)
def _(g, spark, d):
    start = g.includes.agg(F.min("src_file")).first()[0]
    inc = g.includes.select(F.col("src_file").alias("src"), F.col("dst_file").alias("dst"), "line", F.lit("").alias("file"), F.lit(0).cast("long").alias("file_ord"), F.lit(0).cast("long").alias("edge_ord"))
    edges = [(a, b, "includes") for a, b in structure.bounded_ball(inc, start, 2, 500)]
    return spark.createDataFrame([(a, b) for a, b, _ in structure.diagram(edges, start, 2, 500)], "from string, to string")


@query("stale_files", ", f AS (SELECT file AS path, min(sym_ord) AS t FROM s GROUP BY file), c AS (SELECT path, CASE WHEN t % 3 = 0 THEN t + 1 ELSE t END AS t FROM f WHERE t % 5 <> 0) SELECT coalesce(f.path, c.path) AS path FROM f FULL JOIN c USING (path) WHERE f.t IS DISTINCT FROM c.t")
def _(g, spark, d):
    now = g.files.where("mtime % 5 <> 0").select("path", F.when(F.col("mtime") % 3 == 0, F.col("mtime") + 1).otherwise(F.col("mtime")).alias("mtime"))
    return incremental.stale(g.files, now)


@query("evict_missing", "SELECT file AS path FROM s WHERE starts_with(file, '/src/brand1/') GROUP BY file HAVING min(sym_ord) % 4 = 0")
def _(g, spark, d):
    return incremental.evict_missing(g, g.files.where("mtime % 4 <> 0").select("path"), "/src/brand1")


@query("prune_dangling", "SELECT src, dst, line FROM calls WHERE NOT starts_with(file, '/src/brand1/') AND NOT starts_with(dst_file, '/src/brand1/')", "calls")
def _(g, spark, d):
    return incremental.remove_subtree(g, "/src/brand1").of_kind("calls").select("src", "dst", "line")


_BUSY = "(SELECT file FROM s GROUP BY file ORDER BY count(*) DESC, file LIMIT 1)"


@query("watch_upsert", f""", gone AS (SELECT arg_max(id, sym_ord) AS id FROM s WHERE file = {_BUSY}), t AS (SELECT id, {_SHORT} AS name, file, parent, language, sym_ord FROM s WHERE id NOT IN (SELECT id FROM gone)),
  raw AS (SELECT c.src, c.edge_ord, c.file, b.language, regexp_replace(b.name, '_[0-9]+$', '') AS token, a.parent AS cp FROM calls c JOIN s a ON a.id = c.src JOIN s b ON b.id = c.dst WHERE c.file = {_BUSY} AND c.src NOT IN (SELECT id FROM gone)),
  k AS (SELECT raw.src, raw.edge_ord, t.id, (CASE WHEN t.file = raw.file THEN 4 ELSE 0 END) + (CASE WHEN raw.cp <> '' AND t.parent = raw.cp THEN 3 ELSE 0 END) AS score, t.sym_ord FROM raw JOIN t ON t.language = raw.language AND t.name = raw.token),
  p AS (SELECT src, edge_ord, arg_min(id, (-score, sym_ord)) AS dst, count(*) AS n FROM k GROUP BY src, edge_ord)
  SELECT src, dst, edge_ord, confidence FROM calls WHERE file <> {_BUSY} AND dst NOT IN (SELECT id FROM gone)
  UNION ALL SELECT raw.src, coalesce(p.dst, raw.token), raw.edge_ord, CASE WHEN n > 1 THEN 'heuristic' ELSE 'resolved' END FROM raw LEFT JOIN p USING (src, edge_ord)""", "calls")
def _(g, spark, d):
    # The file with most symbols loses its last one; its calls are resolved against all files and take the place of its old ones.
    file = g.symbols.groupBy("file").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "file").first()["file"]
    last = g.symbols.where(F.col("file") == file).agg(F.max("sym_ord")).first()[0]
    kept = g.symbols.where(F.col("sym_ord") != last)
    short = F.regexp_replace("name", "_[0-9]+$", "")
    names = g.symbols.select(F.col("id").alias("dst"), short.alias("token"), "language")
    fresh = kept.where(F.col("file") == file)
    raw = g.of_kind("calls").where(F.col("file") == file).join(fresh.select(F.col("id").alias("src")), "src", "left_semi").join(names, "dst").select("src", "token", "language", "file", "line", "edge_ord")
    solved = resolve.resolve_calls(raw, kept.select("language", short.alias("key"), "id", "file", "parent", "file_ord", "sym_ord"))
    solved = solved.select("src", "dst", F.lit("calls").alias("kind"), "file", "line", "confidence", F.lit(0).cast("long").alias("file_ord"), "edge_ord")
    merged = incremental.merge(g, GraphStore(fresh, solved, g.includes.where(F.col("src_file") == file), g.files.where(F.col("path") == file)))
    return merged.of_kind("calls").select("src", "dst", "edge_ord", "confidence")


@query("watch_remove_folder", ", f AS (SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS folder FROM s WHERE sym_ord = 5) SELECT src, dst, edge_ord FROM calls WHERE NOT starts_with(file, (SELECT folder FROM f) || '/') AND NOT starts_with(dst_file, (SELECT folder FROM f) || '/')", "calls")
def _(g, spark, d):
    folder = _one(g, 5, "file").rsplit("/", 1)[0]
    return incremental.remove_below(g, spark.createDataFrame([(folder,)], "path string")).of_kind("calls").select("src", "dst", "edge_ord")


@query("watch_last_event", "SELECT path, arg_max(is_remove, (ts, event_id)) AS is_remove, count(*) AS events FROM ev GROUP BY path", "ev")
def _(g, spark, d):
    return incremental.last_events(projection.file_events(spark, d))


@query("watch_debounce", ", o AS (SELECT path, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 250 MILLISECOND THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY path ORDER BY ts)), n AS (SELECT path, ts, sum(new) OVER (PARTITION BY path ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS burst FROM o) SELECT path, count(*) AS events, count(DISTINCT burst) AS bursts FROM n GROUP BY path", "ev")
def _(g, spark, d):
    return incremental.debounced(projection.file_events(spark, d)).groupBy("path").agg(F.sum("events").alias("events"), F.count(F.lit(1)).alias("bursts"))


@query("bench_lang_breakdown", "SELECT language AS key, count(*) AS symbols, count(DISTINCT file) AS files FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(g, spark, d):
    return lookup.breakdown(g)


@query("bench_top_dirs", "SELECT regexp_extract(file, '^(.*)/[^/]*$', 1) AS key, count(*) AS symbols, count(DISTINCT file) AS files FROM s GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(g, spark, d):
    return lookup.breakdown(g, "directory")


@query("id_functions", "SELECT id, file AS of_file, parent AS of_parent, name AS base, CASE WHEN parent = '' THEN name ELSE parent || '::' || name END AS qualified, strftime(to_timestamp(sym_ord) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM s")
def _(g, spark, d):
    i = F.col("id")
    return g.symbols.select("id", id_file(i).alias("of_file"), id_parent(i).alias("of_parent"), id_basename(i).alias("base"), qualified(F.col("parent"), F.col("name")).alias("qualified"), rfc3339(F.col("sym_ord") * 1_000_000_000).alias("at"))
