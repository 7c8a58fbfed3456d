"""Exact deduplication with counting quotient filters.

Every partition folds its 64-bit text fingerprints into counting quotient filters, one for each
slice of the fingerprint space. Filters of one slice merge without loss, since their remainders
are sorted. Only fingerprints whose merged count is above one reach the comparison of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import join_split, materialize, partitions, ship, text_or_empty

#: Low bits of a fingerprint that are stored as its remainder; the bits above are its quotient.
REMAINDER_BITS = 40
_REMAINDER_BYTES = REMAINDER_BITS // 8


def encode_filter(fingerprints: np.ndarray, counts: np.ndarray) -> bytes:
    """A counting quotient filter of sorted distinct uint64 fingerprints.

    Layout: the numbers of occupied quotients, remainders and counters above one (uint32), the
    occupied quotients, the length of each quotient's run, the remainders in run order and, for
    the counters, the slot and the count.
    """
    quotients, runs = np.unique(fingerprints >> np.uint64(REMAINDER_BITS), return_counts=True)
    remainders = fingerprints.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_REMAINDER_BYTES]
    slots = np.flatnonzero(counts > 1)
    head = np.array([len(quotients), len(fingerprints), len(slots)], "<u4")
    parts = (head, quotients.astype("<u4"), runs.astype("<u4"), remainders, slots.astype("<u4"), counts[slots].astype("<u8"))
    return b"".join(np.ascontiguousarray(x).tobytes() for x in parts)


def decode_filter(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts."""
    n_quotients, n, n_slots = (int(x) for x in np.frombuffer(data, "<u4", 3))
    at = 12
    quotients = np.frombuffer(data, "<u4", n_quotients, at)
    at += 4 * n_quotients
    runs = np.frombuffer(data, "<u4", n_quotients, at)
    at += 4 * n_quotients
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :_REMAINDER_BYTES] = np.frombuffer(data, np.uint8, n * _REMAINDER_BYTES, at).reshape(n, _REMAINDER_BYTES)
    at += n * _REMAINDER_BYTES
    slots = np.frombuffer(data, "<u4", n_slots, at)
    counts = np.ones(n, np.int64)
    counts[slots] = np.frombuffer(data, "<u8", n_slots, at + 4 * n_slots)
    return (np.repeat(quotients, runs).astype(np.uint64) << np.uint64(REMAINDER_BITS)) | wide.view("<u8").ravel(), counts


def merge_sorted(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adds the counts of equal fingerprints; the result is sorted."""
    if not len(fingerprints):
        return fingerprints, counts
    order = np.argsort(fingerprints, kind="stable")
    fingerprints, counts = fingerprints[order], counts[order]
    first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]])
    return fingerprints[first], np.add.reduceat(counts, first)


def suspects(fingerprints: DataFrame, total: int, column: str = "fp", filter_rows: int = 1 << 20, slice_rows: int = 1 << 22) -> DataFrame:
    """(fp, copies) of the fingerprints that occur more than once.

    A task holds at most ``filter_rows`` fingerprints before it emits filters; a merge holds the
    filters of one slice, which have about ``slice_rows`` of the ``total`` fingerprints at most.
    """
    slices = max(partitions(fingerprints.sparkSession), -(-total // slice_rows))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            owner = ((keys >> np.uint64(32)) * np.uint64(slices)) >> np.uint64(32)
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True])
            made = [encode_filter(keys[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            return pa.RecordBatch.from_arrays([pa.array(owner[cuts[:-1]].astype(np.int32)), pa.array(made, pa.binary())], ["slice", "filter"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                if sum(map(len, held)) >= filter_rows:
                    yield flush()
        if held:
            yield flush()

    def merge(group: pa.Table) -> pa.Table:
        decoded = [decode_filter(x.as_py()) for x in group.column("filter")]
        keys, counts = merge_sorted(np.concatenate([k for k, _ in decoded]), np.concatenate([c for _, c in decoded]))
        many = counts > 1
        return pa.table({"fp": keys[many].view(np.int64), "copies": counts[many]})

    filters = fingerprints.select(column).mapInArrow(build, "slice int, filter binary")
    return filters.groupBy("slice").applyInArrow(merge, "fp long, copies long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fingerprint_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; of equal texts the row with the largest id stays.
    A null text counts as empty. A null id is smaller than any id: such a row stays only if its
    group has no id at all. Rows that repeat both id and text share one verdict. An empty table
    gives no rows; other columns are neither read nor returned.
    ``fingerprint_bits`` may be lowered, to provoke collisions; the result is the same.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.withColumn("fp", F.shiftrightunsigned(F.xxhash64("text"), 64 - fingerprint_bits))
    total = rows.count()
    repeated = materialize(suspects(rows, total).select("fp"), "dedup-suspects")
    # Bytes are compared here: the text itself is the grouping key. Each task folds its own copies first.
    classes = (
        rows.join(repeated, "fp", "left_semi").groupBy("text").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1").select(F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    classes = materialize(classes.withColumn("copies", F.col("group_size")), "dedup-groups")
    judged = join_split(rows.select("id", F.sha2("text", 256).alias("text_sha256")), classes, ["text_sha256"], "copies", total, "left")
    lone = F.col("group_size").isNull()
    return judged.select(
        F.col("id").alias(id_col),
        F.when(lone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
