"""A corpus pipeline: quality rules, exact and near deduplication, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as the next
one's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import queries
from codeloom.llm.common import materialize, table

STAGES = [
    ("quality rules", queries.stage_quality),
    ("exact dedup", queries.stage_dedup),
    ("n-gram Jaccard join", queries.stage_near),
    ("mixing", queries.stage_mix),
    ("BPE", queries.stage_tokens),
]
#: SQL can express neither the learned rules nor the tokens; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
