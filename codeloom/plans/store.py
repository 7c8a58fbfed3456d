"""The graph as a bundle of tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.columns import symbol_id

SYMBOLS = "id string, name string, kind string, file string, line long, column long, end_line long, signature string, namespace string, parent string, language string, file_ord long, sym_ord long"
EDGES = "src string, dst string, kind string, file string, line long, confidence string, file_ord long, edge_ord long"
INCLUDES = "src_file string, dst_file string, line long, seq long"
FILES = "path string, language string, mtime long, merge_ord long"
POINTER = "version string, format int, at long"
VERSION = 2


@dataclass(frozen=True)
class GraphStore:
    """``occurrences`` has a row for every symbol found; ``symbols`` keeps the last of each id, as ``stored`` or by a window within files.

    ``numbered``, where a graph has it, gives the ends (src, dst) of all calls, or of the resolved ones alone, as ``sym_ord`` of symbols in place of
    ids; each symbol then has a ``sym_ord`` of its own.
    """

    occurrences: DataFrame
    edges: DataFrame
    includes: DataFrame
    files: DataFrame
    stored: DataFrame | None = None
    numbered: Callable[[bool], DataFrame] | None = None

    @property
    def symbols(self) -> DataFrame:
        if self.stored is not None:
            return self.stored
        # An id begins with its file, so filters on files pass below the window.
        last = Window.partitionBy("file", "id").orderBy(F.desc("file_ord"), F.desc("sym_ord"))
        return self.occurrences.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")

    def of_kind(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("kind") == kind)

    def save(self, path: str) -> None:
        """Writes a new version beside the others, symbols without repeats among it, and adds a pointer to it last.

        Pointers are only added and the latest one counts, so that readers see one version or the other at any time.
        """
        version = uuid.uuid4().hex
        self.edges.write.partitionBy("kind").parquet(f"{path}/{version}/edges")
        for name in ("occurrences", "includes", "files", "symbols"):
            getattr(self, name).write.parquet(f"{path}/{version}/{name}")
        spark = self.files.sparkSession
        spark.createDataFrame([(version, VERSION, time.time_ns())], POINTER).coalesce(1).write.mode("append").parquet(f"{path}/_versions")

    @staticmethod
    def load(spark: SparkSession, path: str) -> GraphStore | None:
        """The current version; None if there is none or it has another format, which asks for a new index."""
        from pyspark.errors import AnalysisException

        try:
            found = spark.read.schema(POINTER).parquet(f"{path}/_versions").orderBy(F.desc("at"), "version").first()
        except AnalysisException:
            return None
        if found is None or found["format"] != VERSION:
            return None
        schemas = {"occurrences": SYMBOLS, "edges": EDGES, "includes": INCLUDES, "files": FILES, "symbols": SYMBOLS}
        tables = {name: spark.read.schema(schema).parquet(f"{path}/{found['version']}/{name}") for name, schema in schemas.items()}
        return GraphStore(tables["occurrences"], tables["edges"], tables["includes"], tables["files"], tables["symbols"])

    def inconsistent(self) -> DataFrame:
        """Symbols whose id is not the one that their columns make."""
        return self.occurrences.where(F.col("id") != symbol_id(F.col("file"), F.col("parent"), F.col("name")))

    @staticmethod
    def empty(spark: SparkSession) -> GraphStore:
        return GraphStore(*[spark.createDataFrame([], s) for s in (SYMBOLS, EDGES, INCLUDES, FILES)])
