"""Mixing sources to target weights by Pfair scheduling.

A source's rows are dealt into blocks. Its k-th block is released at floor((k-1)/w) and due at
ceil(k/w) for the source's weight w; each slot goes to the released block that is due first. With
weights in whole units the schedule repeats after as many slots as there are units, so one period
is simulated and every block's slot follows by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The stream of all sources without a weight of their own, null included.
OTHER = "*"
#: Rows of a file that are ranked together, where rows are mixed already.
BUCKET_ROWS = 4096


def pfair_period(units: dict[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(stream, k, slot, release, deadline) for each slot of one period, by earliest deadline first.

    Ties go to the larger weight, then to the smaller name.
    """
    streams = {s: u for s, u in units.items() if u > 0}
    period = sum(streams.values())
    dealt = dict.fromkeys(streams, 0)
    made = []
    for slot in range(period):
        ready = []
        for s, u in streams.items():
            k = dealt[s] + 1
            if k <= u and (k - 1) * period // u <= slot:
                ready.append((-(-k * period // u), -u, s, k, (k - 1) * period // u))
        due, _, s, k, release = min(ready)
        dealt[s] = k
        made.append((s, k, slot, release, due))
    return made


def mix(docs: DataFrame, units: dict[str, int], block_rows: int = 8, id_col: str = "doc_id", source_col: str = "source", keep: list[str] | None = None, ties: tuple[str, ...] = (), order: tuple[str, str] | None = None) -> DataFrame:
    """Every row with its place in the mix: stream, block, slot, seat, release, deadline.

    ``units`` gives the weight of sources in whole units; ``OTHER`` is the weight of all the rest and
    must be there if the rest is to be mixed in a ratio (0 or none: one unit). Rows of a stream are
    ordered by md5 of the id. While every stream has rows, each is less than one block away from its share
    at every slot; later the slots of exhausted streams stay empty and the others keep their ratio.
    All rows are kept. Null ids come first in their stream; rows with equal ids are ordered by source and by the columns ``ties``, or ``keep`` if there are none.
    ``keep`` names further columns to carry along; rows that are alike in all of this are exchangeable.
    ``order`` names two columns to order by in place of the md5, the second of whole numbers: a file and a row in it, for rows that are mixed already.
    """
    spark = docs.sparkSession
    units = {**units, OTHER: max(1, units.get(OTHER, 0))}
    period = sum(units.values())
    named = [s for s in units if s != OTHER]
    carried = [F.col(c) for c in keep or []]
    tied = [f"_t{i}" for i in range(len(ties))] or [f"_c{i}" for i in range(len(carried))]
    rows = docs.select(
        F.col(id_col).alias("_id"), *[c.alias(f"_c{i}") for i, c in enumerate(carried)], F.col(source_col).alias("_source"), *[F.col(c).alias(f"_t{i}") for i, c in enumerate(ties)],
        F.when(F.col(source_col).isin(named), F.col(source_col)).otherwise(F.lit(OTHER)).alias("_stream"),
        (F.struct(*order) if order else F.coalesce(F.md5(F.col(id_col).cast("string")), F.lit(""))).alias("_order"),
    )
    rows = rows.withColumn("_bucket", F.struct(f"_order.{order[0]}", F.floor(F.col(f"_order.{order[1]}") / BUCKET_ROWS)) if order else F.substring("_order", 1, 3))
    # Ranks in two steps, so that no stream meets in one task: buckets of the order, then ranks in each bucket.
    counts = rows.groupBy("_stream", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_stream").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_stream", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    table = spark.createDataFrame([(s, k, slot, r, d) for s, k, slot, r, d in pfair_period(units)], "_stream string, _k long, _slot long, _release long, _due long")
    share = F.create_map(*[F.lit(x) for s, u in units.items() for x in (s, u)])
    ranked = rows.withColumn("_row", F.row_number().over(Window.partitionBy("_stream", "_bucket").orderBy("_order", "_id", "_source", *tied))).join(offsets, ["_stream", "_bucket"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_row") - 1).withColumn("_block", F.floor(F.col("_rank") / block_rows).cast("long"))
    ranked = ranked.withColumn("_units", F.element_at(share, F.col("_stream")).cast("long"))
    ranked = ranked.withColumn("_round", F.floor(F.col("_block") / F.col("_units")).cast("long")).withColumn("_k", F.col("_block") % F.col("_units") + 1)
    placed = ranked.join(F.broadcast(table), ["_stream", "_k"])  # one row per unit of weight
    shift = F.col("_round") * period
    return placed.select(
        F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(keep or [])],
        *([] if source_col in (keep or []) else [F.col("_source").alias(source_col)]), F.col("_stream").alias("stream"), (F.col("_block") + 1).alias("block"),
        (F.col("_slot") + shift).alias("slot"), (F.col("_rank") % block_rows).alias("seat"), (F.col("_release") + shift).alias("release"), (F.col("_due") + shift).alias("deadline"),
    )
