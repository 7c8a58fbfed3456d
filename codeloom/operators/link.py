"""What an index learns from all files together: crate and module namespaces, ``mod`` files and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.operators.resolve import longest_prefix
from codeloom.operators.traverse import closure


def module_names(files: DataFrame, owners: DataFrame) -> DataFrame:
    """(path, module) of Rust and Go files below a manifest, from (path, language) and (owner, language, name).

    The deepest owner counts. A Rust owner is a crate's source folder: its lib and main files are the crate, a mod file is its folder, and any
    other file adds its name. A Go owner is a module's folder; a file belongs to the package of its folder.
    """

    def of(language: str, module: Column) -> DataFrame:
        own, names = files.where(F.col("language") == language).select("path"), owners.where(F.col("language") == language).select("owner", "name")
        found = longest_prefix(own, names).join(names.dropDuplicates(["owner"]), "owner")
        found = found.withColumn("parts", F.split(F.expr("substring(path, length(owner) + 2)"), "/"))
        found = found.withColumn("folders", F.slice("parts", 1, F.size("parts") - 1)).withColumn("stem", F.regexp_replace(F.element_at("parts", -1), r"\.rs$", ""))
        return found.select("path", module.alias("module"))

    crate = F.array("name")
    whole = (F.size("folders") == 0) & F.col("stem").isin("lib", "main")
    rust = F.when(whole, crate).when(F.col("stem") == "mod", F.concat(crate, F.col("folders"))).otherwise(F.concat(crate, F.col("folders"), F.array("stem")))
    return of("rust", F.array_join(rust, "::")).unionByName(of("go", F.array_join(F.concat(crate, F.col("folders")), "/")))


def with_modules(symbols: DataFrame, modules: DataFrame) -> DataFrame:
    """Symbols whose namespace begins with their file's module; in Go it is the module."""
    joined = symbols.join(modules.withColumnRenamed("path", "file"), "file", "left")
    inner = F.when(F.col("namespace") == "", F.col("module")).otherwise(F.concat("module", F.lit("::"), "namespace"))
    space = F.when(F.col("module").isNull(), F.col("namespace")).when(F.col("language") == "go", F.col("module")).otherwise(inner)
    return joined.withColumn("namespace", space).select(*symbols.columns)


def override_tokens(methods: DataFrame, known: DataFrame, inherits: DataFrame) -> DataFrame:
    """Raw override edges (src, token, language, file, line): a method's name in a class above its own, as ``Base::name``.

    ``methods`` are the C++ methods that may override, ``known`` those that may be overridden; ``inherits`` has (src, dst).
    """
    own = methods.select("id", "parent", "name", "language", "file", "line")
    above = closure(inherits, own.select(F.col("parent").alias("start")).distinct()).where("start <> node").select(F.col("start").alias("parent"), F.col("node").alias("base"))
    named = known.select(F.col("parent").alias("base"), "name").distinct()
    found = own.join(above, "parent").join(named, ["base", "name"])
    return found.select(F.col("id").alias("src"), F.concat("base", F.lit("::"), "name").alias("token"), "language", "file", "line").distinct()
