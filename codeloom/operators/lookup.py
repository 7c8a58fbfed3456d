"""Queries about single symbols: detail, file symbols, search, near search, summary, counts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import CLASS_LIKE, KINDS, LANGUAGES, adaptive_distance, common_prefix, qualified, under
from codeloom.plans.store import GraphStore

_LOOKAROUND = re.compile(r"\(\?[=!]|\(\?<[=!]|\\[1-9]")


def detail(graph: GraphStore, symbol: str) -> DataFrame:
    return graph.symbols.where(F.col("id") == symbol)


def file_symbols(graph: GraphStore, file: str, top_level_only: bool = False) -> DataFrame:
    """A file's symbols by id: the surviving one of each id, once for each time that the id occurs in the file."""
    times = graph.occurrences.where(F.col("file") == file).select("id")
    found = graph.symbols.where(F.col("file") == file).join(times, "id")
    return (found.where("parent = ''") if top_level_only else found).orderBy("id")


def class_candidates(graph: GraphStore, name: str) -> DataFrame:
    return graph.symbols.where((F.col("name") == name) & F.col("kind").isin(*CLASS_LIKE)).orderBy("file", "line")


def brief(rows: DataFrame) -> DataFrame:
    """Rows with column and end_line 0 and no signature."""
    return rows.withColumns({"column": F.lit(0).cast("long"), "end_line": F.lit(0).cast("long"), "signature": F.lit("")})


def is_pattern(query: str) -> bool:
    """Whether ``query`` is a regular expression without look-around and back references; else it is sought as text."""
    if _LOOKAROUND.search(query):
        return False
    try:
        re.compile(query)
    except re.error:
        return False
    return True


def _filtered(graph: GraphStore, kind: str, namespace: str, language: str, subtree: str) -> DataFrame:
    if kind and kind not in KINDS:
        raise ValueError(f"unknown kind: {kind}")
    if language and language not in LANGUAGES:
        raise ValueError(f"unknown language: {language}")
    rows = graph.symbols
    if subtree:
        rows = rows.where(under(F.col("file"), subtree))
    if kind:
        rows = rows.where(F.col("kind") == kind)
    if language:
        rows = rows.where(F.col("language") == language)
    if namespace:
        rows = rows.where(F.lower("namespace").contains(namespace.lower()))
    return rows


def search(graph: GraphStore, query: str = "", kind: str = "", namespace: str = "", language: str = "", subtree: str = "") -> DataFrame:
    """Symbols whose qualified name fits ``query``, case aside. The cheap filters come first; the pattern is one expression."""
    if not (query or kind or namespace or language):
        raise ValueError("at least one of query, kind, namespace and language is needed")
    rows = _filtered(graph, kind, namespace, language, subtree)
    name = qualified(F.col("parent"), F.col("name"))
    if not query:
        return rows
    return rows.where(name.rlike("(?iu)" + query) if is_pattern(query) else F.lower(name).contains(query.lower()))


def near(graph: GraphStore, query: str, max_distance: int | None = None, kind: str = "", namespace: str = "", language: str = "", subtree: str = "") -> DataFrame:
    """Symbols whose name is at most some edits from ``query``, nearest first; adds ``distance``."""
    if not re.fullmatch("[A-Za-z0-9_]+", query):
        raise ValueError("a near search needs a plain identifier")
    most = min(8, max_distance) if max_distance is not None else adaptive_distance(query)
    name, wanted = F.lower("name"), query.lower()
    rows = _filtered(graph, kind, namespace, language, subtree).where(F.abs(F.length("name") - len(query)) <= most)
    rows = rows.withColumn("distance", F.levenshtein(name, F.lit(wanted), most)).where("distance >= 0")
    return rows.orderBy("distance", F.desc(common_prefix(name, wanted)), F.length("name") < len(query), F.abs(F.length("name") - len(query)), "name", "id")


def suggestions(graph: GraphStore, query: str, most: int = 5) -> DataFrame:
    """Ids for an anchored search that found nothing: near names, else names that contain the text."""
    text = query.removeprefix("^").removesuffix("$")
    found = near(graph, text, None).select("id").limit(most) if re.fullmatch("[A-Za-z0-9_]+", text) else None
    if found is not None and found.limit(1).count():
        return found
    return graph.symbols.where(F.lower("id").contains(text.lower())).orderBy("id").select("id").limit(most)


def summary(graph: GraphStore, file: str | None = None) -> DataFrame:
    """(namespace, kind, count), the empty namespace shown as ``<global>``."""
    rows = graph.symbols if file is None else graph.symbols.where(F.col("file") == file)
    shown = F.when(F.col("namespace") == "", F.lit("<global>")).otherwise(F.col("namespace"))
    return rows.groupBy(shown.alias("namespace"), "kind").agg(F.count(F.lit(1)).alias("count")).orderBy("namespace", "kind")


def stats(graph: GraphStore) -> DataFrame:
    """One row: nodes, edges with includes, files."""
    parts = [(graph.symbols, "nodes"), (graph.edges, "edges"), (graph.includes, "edges"), (graph.files, "files")]
    counted = None
    for rows, name in parts:
        one = rows.agg(*[(F.count(F.lit(1)) if n == name else F.lit(0).cast("long")).alias(n) for n in ("nodes", "edges", "files")])
        counted = one if counted is None else counted.union(one)
    return counted.agg(*[F.sum(n).alias(n) for n in ("nodes", "edges", "files")])


def breakdown(graph: GraphStore, by: str = "language", top: int = 10) -> DataFrame:
    """The languages or directories with the most symbols."""
    key = F.col("language") if by == "language" else F.regexp_extract("file", "^(.*)/[^/]*$", 1)
    return graph.symbols.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("file").alias("files")).orderBy(F.desc("symbols"), "key").limit(top)
