"""Source trees as frames: discovery with ignore rules, distributed parsing, and the graph that follows."""

from __future__ import annotations

import fnmatch
import os
import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.columns import EXTENSIONS, symbol_id
from codeloom.operators.link import module_names, override_tokens, with_modules
from codeloom.operators.resolve import resolve_calls, resolve_includes, resolve_rust_modules, symbol_index
from codeloom.plans.ship import ship
from codeloom.plans.store import GraphStore
from codeloom.plans.tables import written
from codeloom.sources.config import Config

_PARSED = (
    "path string, language string, file_ord long, ok boolean, symbols array<struct<name string, kind string, line long, column long, end_line long, signature string, namespace string, parent string>>, "
    "edges array<struct<caller string, token string, kind string, line long>>"
)
CACHE = ".codeloom"
#: Override edges come after all other edges of their file.
OVERRIDES_FROM = 1 << 40


def discover(root: str, extra_ignore: tuple[str, ...] = (), extensions: tuple[str, ...] = tuple(EXTENSIONS)) -> list[str]:
    """The source files below a root, by path components. ``.gitignore`` and ``.ignore`` files hold for their folder and below."""
    found: list[str] = []

    def walk(folder: str, rules: list[tuple[str, str, bool]]) -> None:
        for name in (".gitignore", ".ignore"):
            try:
                with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as file:
                    lines = [x.rstrip("\n").strip() for x in file]
            except OSError:
                continue
            rules = rules + [(folder, x.lstrip("!"), not x.startswith("!")) for x in lines if x and not x.startswith("#")]
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            ignored = False
            for base, pattern, drops in rules:
                rel = os.path.relpath(entry.path, base)
                own = pattern.strip("/")
                hit = fnmatch.fnmatch(rel, own) if "/" in pattern.rstrip("/") else fnmatch.fnmatch(entry.name, own)
                if hit and (entry.is_dir(follow_symlinks=False) or not pattern.endswith("/")):
                    ignored = drops
            rel = os.path.relpath(entry.path, root)
            if ignored or any(fnmatch.fnmatch(rel, p) for p in extra_ignore) or entry.name == ".git":
                continue
            if entry.is_dir(follow_symlinks=False):
                walk(entry.path, rules)
            elif os.path.splitext(entry.name)[1].lower() in extensions:
                found.append(entry.path)

    walk(root, [])
    return sorted(found, key=lambda p: p.split("/"))


def manifests(paths: list[str]) -> list[tuple[str, str, str]]:
    """(owner, language, name) of the crates and modules whose manifests lie in a folder of the paths or above one.

    A manifest without a name, or one that cannot be read, owns nothing.
    """
    folders: set[str] = set()
    for path in paths:
        folder = os.path.dirname(path)
        while folder not in folders:
            folders.add(folder)
            folder = os.path.dirname(folder)
    found = []
    for folder in sorted(folders):
        for file, language in (("Cargo.toml", "rust"), ("go.mod", "go")):
            try:
                with open(os.path.join(folder, file), encoding="utf-8") as held:
                    text = held.read()
                if language == "rust":
                    name = tomllib.loads(text).get("package", {}).get("name", "").replace("-", "_")
                else:
                    bare = re.sub(r"//[^\n]*|/\*.*?\*/", "", text, flags=re.S)
                    name = next(iter(re.findall(r"(?m)^\s*module\s+\"?([^\s\"]+)", bare)), "")
            except (OSError, ValueError):
                continue
            if name:
                found.append((os.path.join(folder, "src") if language == "rust" else folder, language, name))
    return found


def parse(sources: DataFrame, config: Config | None = None) -> DataFrame:
    """Symbols and raw edges of (path, content, file_ord); a file that fails gives a row with ``ok`` false."""
    config = config or Config()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from codeloom.sources.extract import default_registry

        registry = default_registry(config.macro_strip, config.macro_strip_with_args, config.extensions)
        names_s = ("name", "kind", "line", "column", "end_line", "signature", "namespace", "parent")
        names_e = ("caller", "token", "kind", "line")
        schema = pa.schema([
            ("path", pa.string()), ("language", pa.string()), ("file_ord", pa.int64()), ("ok", pa.bool_()),
            ("symbols", pa.list_(pa.struct([(n, pa.int64() if n in ("line", "column", "end_line") else pa.string()) for n in names_s]))),
            ("edges", pa.list_(pa.struct([(n, pa.int64() if n == "line" else pa.string()) for n in names_e]))),
        ])
        for batch in batches:
            rows = []
            for path, content, order in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "file_ord"))):
                plugin = registry.find(path)
                if plugin is None:
                    continue
                row = {"path": path, "language": plugin.language, "file_ord": order, "ok": True, "symbols": [], "edges": []}
                try:
                    found = plugin.extract(plugin.preprocess((content or b"").decode("utf-8", "replace")), path)
                    row["symbols"] = [dict(zip(names_s, s)) for s in found.symbols]
                    row["edges"] = [dict(zip(names_e, e)) for e in found.edges]
                except (SyntaxError, ValueError, RecursionError, re.error):  # a file that cannot be parsed becomes a warning
                    row["ok"] = False
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    ship(sources.sparkSession)
    return sources.select("path", "content", "file_ord").mapInArrow(run, _PARSED)


def index(sources: DataFrame, config: Config | None = None, base: GraphStore | None = None, owners: list[tuple[str, str, str]] = ()) -> tuple[GraphStore, DataFrame]:
    """The resolved graph of (path, content, file_ord, mtime), and the paths that failed to parse.

    With ``base``, a graph of other files or of earlier forms of these, tokens may also name what its other files have; its own edges are
    not resolved again. ``owners`` are the ``manifests``, which give Rust and Go symbols their namespaces.
    """
    spark = sources.sparkSession
    parsed = written(parse(sources, config), "parsed")
    ok = parsed.where("ok")
    files = ok.select("path", "language", "file_ord").join(sources.select("path", "mtime"), "path").select("path", "language", "mtime", F.col("file_ord").alias("merge_ord"))
    occurrences = ok.select("path", "language", "file_ord", F.posexplode("symbols").alias("at", "s")).select(
        symbol_id(F.col("path"), F.col("s.parent"), F.col("s.name")).alias("id"), "s.name", "s.kind", F.col("path").alias("file"), "s.line", "s.column", "s.end_line", "s.signature", "s.namespace", "s.parent",
        "language", "file_ord", F.col("at").cast("long").alias("sym_ord"),
    )
    if owners:
        occurrences = with_modules(occurrences, module_names(files, spark.createDataFrame(list(owners), "owner string, language string, name string")))
    occurrences = written(occurrences, "occurrences")
    raw = ok.select("path", "language", "file_ord", F.posexplode("edges").alias("at", "e")).select(
        F.col("e.caller").alias("src"), F.col("e.token").alias("token"), F.col("e.kind").alias("kind"), F.col("path").alias("file"), F.col("e.line").alias("line"), "language", "file_ord", F.col("at").cast("long").alias("edge_ord")
    )
    others = base if base is not None else GraphStore.empty(spark)
    here = parsed.select("path")
    known = occurrences.unionByName(others.occurrences.join(here.withColumnRenamed("path", "file"), "file", "left_anti").select(*occurrences.columns))
    all_files = files.unionByName(others.files.join(here, "path", "left_anti").select(*files.columns))

    inherits = raw.where("kind = 'inherits'").select("src", F.col("token").alias("dst"), "kind", "file", "line", F.lit("resolved").alias("confidence"), "file_ord", "edge_ord")
    above = raw.where("kind = 'inherits' AND language = 'cpp'").select("src", F.col("token").alias("dst"))
    theirs = others.of_kind("inherits").join(others.files.where("language = 'cpp'").select(F.col("path").alias("file")), "file", "left_semi").select("src", "dst")
    methods = "language = 'cpp' AND kind = 'method' AND parent <> ''"
    overrides = override_tokens(occurrences.where(methods), known.where(methods), above.union(theirs))
    overrides = overrides.withColumn("edge_ord", F.lit(OVERRIDES_FROM) + F.pmod(F.xxhash64("src", "token"), F.lit(OVERRIDES_FROM)))
    tokens = raw.where("kind = 'calls'").select("src", "token", "language", "file", "line", "edge_ord", "kind").unionByName(overrides.withColumn("kind", F.lit("overrides")))
    tokens = written(tokens, "tokens")
    solved = resolve_calls(tokens.drop("kind"), symbol_index(known)).join(tokens.select("src", "file", "edge_ord", "kind"), ["src", "file", "edge_ord"])
    orders = files.select(F.col("path").alias("file"), F.col("merge_ord").alias("file_ord"))
    solved = solved.join(orders, "file").select("src", "dst", "kind", "file", "line", "confidence", "file_ord", "edge_ord")

    named = raw.where("kind = 'includes'").select(F.col("file").alias("src_file"), "token", "line", F.col("edge_ord").alias("seq"))
    declared = raw.where("kind = 'mod'").select(
        F.col("file").alias("src_file"), F.substring_index("token", "=", 1).alias("name"), F.when(F.col("token").contains("="), F.expr("substring(token, instr(token, '=') + 1)")).alias("path"), "line", F.col("edge_ord").alias("seq")
    )
    includes = resolve_includes(named, all_files).unionByName(resolve_rust_modules(declared, all_files))
    return GraphStore(occurrences, solved.union(inherits), includes, files), parsed.where("NOT ok").select("path")
