"""Resolution of raw tokens: calls by a symbol index, includes by file names, owners by the longest prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.columns import basename, id_parent


def symbol_index(symbols: DataFrame) -> DataFrame:
    """(language, key, id, file, parent, ord): each symbol under its name and its name with parent, namespace or both; duplicates stay."""
    own = [F.col("language"), F.col("id"), F.col("file"), F.col("parent"), F.col("file_ord"), F.col("sym_ord")]
    name, parent, space, sep = F.col("name"), F.col("parent"), F.col("namespace"), F.lit("::")
    forms = [
        (F.lit(True), name), (parent != "", F.concat(parent, sep, name)), (space != "", F.concat(space, sep, name)), ((space != "") & (parent != ""), F.concat(space, sep, parent, sep, name)),
    ]
    # One pass over the symbols: the keys that apply are exploded.
    keys = F.array_compact(F.array(*[F.when(c, k) for c, k in forms]))
    return symbols.select(*own, F.explode(keys).alias("key"))


def resolve_calls(raw: DataFrame, index: DataFrame) -> DataFrame:
    """Call edges (src, token, language, file, line, edge_ord) with ``dst`` and ``confidence``.

    The candidate of the same file scores 4, of the caller's parent 3; the first of the best wins. One candidate: resolved; several:
    heuristic; none: the token stays.
    """
    edges = raw.withColumn("_parent", id_parent(F.col("src")))
    named = index.select("language", F.col("key").alias("token"), F.col("file"), F.col("parent").alias("_parent"), F.struct("file_ord", "sym_ord", "id").alias("o"))
    # The first candidate of each score, by one equi-join a score: calls never meet all candidates of their token.
    held = edges
    for score, keys in ((7, ["file", "_parent"]), (4, ["file"]), (3, ["_parent"]), (0, [])):
        of_parent = named.where("_parent <> ''") if "_parent" in keys else named
        first = of_parent.groupBy("language", "token", *keys).agg(F.min("o").alias(f"_{score}"), *([F.count(F.lit(1)).alias("n")] if not keys else []))
        held = held.join(first, ["language", "token", *keys], "left")
    best = F.coalesce("_7", "_4", "_3", "_0")
    return held.select("src", F.coalesce(best["id"], "token").alias("dst"), "token", "file", "line", "edge_ord", F.when(F.col("n") > 1, F.lit("heuristic")).otherwise(F.lit("resolved")).alias("confidence"))


def resolve_includes(raw: DataFrame, files: DataFrame) -> DataFrame:
    """Include tokens (src_file, token, line, seq) with the file that they name; tokens that name none go.

    Of the files of the token's base name, the first whose path ends with the token wins, else the first.
    """
    named = files.select(basename(F.col("path")).alias("_base"), F.col("path").alias("_path"), F.col("merge_ord").alias("_ord"))
    joined = raw.withColumn("_base", basename(F.col("token"))).join(named, "_base")
    ends = (F.col("_path") == F.col("token")) | F.col("_path").endswith(F.concat(F.lit("/"), F.col("token")))
    picked = joined.groupBy("src_file", "token", "line", "seq").agg(F.min(F.struct((~ends).alias("e"), F.col("_ord").alias("o"), F.col("_path").alias("path"))).alias("x"))
    return picked.select("src_file", F.col("x.path").alias("dst_file"), "line", "seq")


def longest_prefix(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, owner): the deepest owner directory that a file lies in, found by an equi-join on the file's ancestors."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = files.select("path", F.posexplode(ups).alias("depth", "owner"))
    return above.join(owners.select("owner").distinct(), "owner").groupBy("path").agg(F.max_by("owner", "depth").alias("owner"))


def resolve_rust_modules(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(src_file, dst_file, line, seq) of ``mod`` items (src_file, name, path, line, seq): an explicit path alone, else ``name.rs``, else ``name/mod.rs``."""
    stem = F.regexp_replace(F.col("src_file"), r"(/(mod|lib|main))?\.rs$", "")
    folder = F.regexp_extract("src_file", "^(.*)/[^/]*$", 1)
    options = F.when(F.col("path").isNotNull(), F.array(F.concat(folder, F.lit("/"), F.col("path")))).otherwise(F.array(F.concat(stem, F.lit("/"), F.col("name"), F.lit(".rs")), F.concat(stem, F.lit("/"), F.col("name"), F.lit("/mod.rs"))))
    tried = declared.select("src_file", "name", "line", "seq", F.posexplode(options).alias("rank", "dst_file"))
    return tried.join(files.select(F.col("path").alias("dst_file")), "dst_file", "left_semi").groupBy("src_file", "name", "line", "seq").agg(F.min_by("dst_file", "rank").alias("dst_file")).select("src_file", "dst_file", "line", "seq")
