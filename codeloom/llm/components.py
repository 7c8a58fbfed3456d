"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import join_split, materialize, ship, sparing


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of some edges, for every node but the least ones."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while not (root[root] == root).all():
            root = root[root]
    other = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[other], nodes[root[other]]


def contract(batches: Iterator[pa.RecordBatch], edges_a_step: int = 250_000) -> Iterator[pa.RecordBatch]:
    """The edges (u, v) of a task as stars, one set of stars for each ``edges_a_step`` edges."""
    held: list[pa.RecordBatch] = []

    def made() -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(u, v)], ["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= edges_a_step:
            yield made()
            held = []
    if held:
        yield made()


def components(edges: DataFrame, tag: str = "components", edges_a_task: int = 250_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v) but the roots; a root is its component's least node.

    Tasks of about ``edges_a_task`` edges first turn what they hold into stars. Each round hooks a node's neighbours on the least of them, first the larger
    ones, then the smaller ones, and writes the edges; rounds end when every node has one edge and no root is a node. Nulls and loops
    are ignored. Least neighbours are found by aggregation and joined by ``join_split``, so that no hub's edges meet in a task.
    """
    ship(edges.sparkSession)

    def contracted(rows: DataFrame) -> DataFrame:
        held = materialize(rows, tag)
        return materialize(held.coalesce(max(1, -(-held.count() // edges_a_task))).mapInArrow(sparing(contract), "u long, v long"), tag)

    kept = contracted(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while True:
        ends = kept.select("u", "v", F.lit(False).alias("root")).union(kept.select("v", F.lit(None).cast("long"), F.lit(True)))
        ends = ends.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.max("root").alias("root"), F.count("v").alias("n"))
        open_, total = ends.agg(F.max(F.col("a").isNotNull() & (F.col("root") | (F.col("a") != F.col("b")))), F.sum("n")).first()
        if not open_:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
        both = kept.union(kept.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_split(both.where("v > u"), least, ["u"], "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large, tag)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_split(large, low, ["u"], "n", 2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = contracted(small.union(low.select("u", F.col("m").alias("v"))))
