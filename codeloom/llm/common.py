"""What the training-data operators share: written intermediate tables, the package on executors, column picks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.plans.ship import ship
from codeloom.plans.tables import written as materialize

__all__ = ["WORD_GAP", "join_split", "materialize", "may_be_in", "partitions", "ship", "small_batches", "sparing", "steps", "table", "text_or_empty", "without"]

#: The separators between words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_GAP = r"[\x20\x09-\x0D]"
#: A worker's slice of texts holds about so many bytes.
_STEP_BYTES = 4 << 20


def join_split(rows: DataFrame, small: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner", least: int = 1_000, most: int = 100_000) -> DataFrame:
    """``rows`` with the columns of ``small``, which has one row a key and in ``weight`` the number of rows with that key.

    Keys of more than ``least`` and more than a ``most``-th of all ``total`` rows are joined by broadcast, so that their rows meet in no
    task: since their weights add up to ``total`` at most, there are ``most`` of them at most. All other keys are shuffled. ``how`` is inner or left.
    """
    limit = max(least, -(-total // most))
    hot = small.where(F.col(weight) > limit).drop(weight)
    cold = small.where(F.col(weight) <= limit).drop(weight)
    few = rows.join(F.broadcast(hot), keys)  # at most ``most`` keys
    many = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how)
    return few.unionByName(many)


def _flagged(rows: DataFrame, wanted: DataFrame, key: str, words: int) -> DataFrame:
    """``rows`` with ``_may``: whether ``key`` may be in ``wanted``. True for all that are, and for another key with probability 1 - exp(-keys / bits).

    The keys are hashed to ``words`` words of 64 bits, and the words with a bit, ``words`` rows of two numbers at most, are broadcast. Far more
    keys than bits make the flag useless, never wrong. Null keys are not flagged.
    """
    word = F.pmod(F.xxhash64(key, F.lit(31)), F.lit(words)).cast("int").alias("_word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(37)), F.lit(64)).cast("int"))
    bits = wanted.where(F.col(key).isNotNull()).groupBy(word).agg(F.bit_or(bit).alias("_bits"))
    found = rows.select("*", word).join(F.broadcast(bits), "_word", "left")  # at most ``words`` rows
    may = F.col(key).isNotNull() & (F.coalesce("_bits", F.lit(0)).bitwiseAND(bit) != 0)
    return found.withColumn("_may", may).drop("_word", "_bits")


def may_be_in(rows: DataFrame, wanted: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """Those ``rows`` whose ``key`` is in ``wanted``, and few others, so that a join with ``wanted`` shuffles no more than that. Null keys drop out."""
    return _flagged(rows, wanted, key, words).where("_may").drop("_may")


def without(rows: DataFrame, wanted: DataFrame, key: str, words: int = 1 << 18) -> DataFrame:
    """Those ``rows`` whose ``key`` is not in ``wanted``, null keys among them; only rows that may be in it are shuffled."""
    flagged = _flagged(rows, wanted, key, words)
    return flagged.where(~F.col("_may")).unionByName(flagged.where("_may").join(wanted, key, "left_anti").select(*flagged.columns)).drop("_may")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Returns what this process has freed to the system: its allocators keep it, and idle workers count with the JVM as their executor's memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim is not None:
        trim(0)


def sparing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``; its worker, which waits for more tasks, gives free memory back when the task ends."""

    def spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return spared


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """What is planned within it hands its Python workers up to ``rows`` rows at once: a batch of long texts is held by the JVM and by the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    held = int(spark.conf.get(key))
    spark.conf.set(key, str(min(held, rows) if held > 0 else rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def steps(batches: Iterator[pa.RecordBatch], column: str, step_bytes: int = _STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``step_bytes`` of text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        at = 0
        while at < batch.num_rows:
            held, to = 0, at
            while to < batch.num_rows and (to == at or held + sizes[to] <= step_bytes):
                held += sizes[to]
                to += 1
            yield batch.slice(at, to - at)
            at = to
