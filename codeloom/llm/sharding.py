"""Sharding by sampled splitters.

Rows are ordered by (hash of the text, id), so equal texts are neighbours. Quantiles of a
size-weighted sample of that order cut it into many small ranges; ranges that turn out overfull
are sampled again and subdivided. Exact range sizes then decide which ranges make up a shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import materialize, ship, text_or_empty

_LOWEST = -(2**63)


@dataclass(frozen=True)
class Splitters:
    """Sorted lower bounds (key, id) of the ranges after range 0."""

    keys: np.ndarray
    ids: np.ndarray

    @staticmethod
    def of(points: set[tuple[int, int]]) -> Splitters:
        made = sorted(points)
        return Splitters(np.array([k for k, _ in made], np.int64), np.array([i for _, i in made], np.int64))

    def points(self) -> set[tuple[int, int]]:
        return set(zip(self.keys.tolist(), self.ids.tolist()))

    def locate(self, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The number of bounds at or below each (key, id)."""
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        found = low.copy()
        for a, b in {(int(a), int(b)) for a, b in zip(low[high > low], high[high > low])}:
            own = (low == a) & (high == b)
            found[own] = a + np.searchsorted(self.ids[a:b], ids[own], "right")
        return found


def quantile_splitters(sample: list[tuple[int, int]], ranges: int) -> set[tuple[int, int]]:
    """Bounds at the quantiles of a sample.

    A key that holds one bound is cut before its first row, so equal keys stay in one range; a key
    that holds several is a range of its own, subdivided by id.
    """
    if len(sample) < 2:
        return set()
    sample = sorted(sample)
    picked = sorted({sample[len(sample) * i // ranges] for i in range(1, ranges)}) if ranges < len(sample) else sorted(set(sample))
    held: dict[int, list[int]] = {}
    for key, row in picked:
        held.setdefault(key, []).append(row)
    bounds: set[tuple[int, int]] = set()
    for key, rows in held.items():
        bounds.add((key, _LOWEST))
        if len(rows) > 1:
            bounds.update((key, row) for row in rows[1:])
            if key < 2**63 - 1:
                bounds.add((key + 1, _LOWEST))
    return bounds


def plan_shards(splitters: Splitters, bytes_of: dict[int, int], rows_of: dict[int, int], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, first slot) of every range.

    Ranges of one key move together while they fit a shard. Units far above the mean range are
    placed largest first on the emptiest shard; the others fill the shards up in key order.
    """
    n = len(splitters.keys) + 1
    size = np.array([bytes_of.get(r, 0) for r in range(n)], np.int64)
    target = size.sum() / shards
    units: list[list[int]] = [[0]]
    for r in range(1, n):
        k = splitters.keys
        same = r >= 2 and k[r - 1] == k[r - 2] and sum(size[x] for x in units[-1]) + size[r] <= target
        units[-1].append(r) if same else units.append([r])
    weight = [int(sum(size[r] for r in u)) for u in units]
    large = 4 * size.sum() / max(n, 64 * shards)
    load, shard = np.zeros(shards), np.zeros(n, np.int32)
    for u in sorted((u for u in range(len(units)) if weight[u] > large), key=lambda u: -weight[u]):
        at = int(np.argmin(load))
        load[at] += weight[u]
        shard[units[u]] = at
    at = 0
    for u in range(len(units)):
        if weight[u] <= large:
            while at < shards - 1 and load[at] + weight[u] / 2 > target:
                at += 1
            load[at] += weight[u]
            shard[units[u]] = at
    slot, used = np.zeros(n, np.int64), np.zeros(shards, np.int64)
    for r in range(n):
        slot[r] = used[shard[r]]
        used[shard[r]] += rows_of.get(r, 0)
    return shard, slot


def assign_shards(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", ranges: int = 8192, sample_rows: int = 65536, range_rows: int = 2_000_000
) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law ``bytes``.

    Size is the text's bytes plus 1 (a null text: 1). Shards are near equal in size; equal texts share a
    shard unless their group is larger than a shard, which is then subdivided by id. Slots count
    from 0 without gaps. Null ids sort first; repeated rows get a slot each. An empty table gives
    no rows. Ranges are ``ranges``, or more of ``range_rows`` rows each, up to eight times as many; one that is overfull is subdivided until
    it is not or no more bounds are found. The driver holds about eight times as many sampled keys and the bounds.
    """
    ship(docs.sparkSession)
    base = materialize(
        docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).select(
            "id", (F.octet_length("text") + 1).cast("long").alias("size"), F.crc32("text").alias("crc"), F.xxhash64("text").alias("key"), F.coalesce("id", F.lit(_LOWEST)).alias("row")
        ),
        "shard-base",
    )
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = max(1, min(rows, max(ranges, min(8 * ranges, rows // range_rows))))
    sample_rows = max(sample_rows, 8 * ranges)
    draw = F.shiftrightunsigned(F.xxhash64("key", "row", F.lit(17)), 11) / F.lit(float(1 << 53))

    def sample(frame: DataFrame, weight: int, points: int) -> list[tuple[int, int]]:
        """About ``points`` rows, each as likely as it is large."""
        picked = frame.where(draw * F.lit(float(max(weight, 1))) < F.col("size") * F.lit(float(points)))
        return [(r[0], r[1]) for r in picked.select("key", "row").collect()]

    def located(cuts: Splitters, shard: np.ndarray | None = None, slot: np.ndarray | None = None) -> DataFrame:
        def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                place = cuts.locate(batch.column("key").to_numpy(), batch.column("row").to_numpy())
                more = [pa.array(place.astype(np.int32))]
                if shard is not None:
                    more += [pa.array(shard[place]), pa.array(slot[place])]
                names = ["place", "shard", "first"][: len(more)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

        return base.mapInArrow(locate, "id long, size long, crc long, key long, row long, place int" + ", shard int, first long" * (shard is not None))

    cuts = Splitters.of(quantile_splitters(sample(base, total, sample_rows), ranges))
    while True:
        seen = located(cuts).groupBy("place").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"), F.max("size").alias("most")).collect()
        over = {r["place"]: r["b"] for r in seen if r["b"] > 2 * total / ranges and r["n"] > 1 and r["b"] > r["most"] * 1.5}
        if not over:
            break
        pieces = sum(-(-b * ranges // total) for b in over.values())
        found = sample(located(cuts).where(F.col("place").isin(list(over))), sum(over.values()), min(sample_rows, 8 * pieces))
        more = cuts.points() | quantile_splitters(found, 2 * pieces)
        if len(more) == len(cuts.keys):
            break
        cuts = Splitters.of(more)
    shard, slot = plan_shards(cuts, {r["place"]: r["b"] for r in seen}, {r["place"]: r["n"] for r in seen}, shards)
    within = F.row_number().over(Window.partitionBy("place").orderBy("key", "row", "size", "crc"))
    return located(cuts, shard, slot).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("first") + within - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
