"""What several corpus operators share: staged tables, table readers, bounded Bloom filters."""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import drop_stage, shared_dir, staged  # noqa: F401

#: Most bits of a Bloom filter: 32 MB once packed. One for more keys than it suits lets more through, and the joins behind it decide.
BLOOM_BITS = 1 << 28
BLOOM_HASHES = 4


def trimmed(run):
    """A task function that hands freed memory back to the system when it ends; workers stay for later tasks."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return wrapped


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as make it none of columns (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bloom_bits(n: int) -> int:
    """Bits of a filter for n keys: 16 or more each, within BLOOM_BITS."""
    return min(max(1 << 20, 1 << max(0, 16 * n - 1).bit_length()), BLOOM_BITS)


def bloom_of(df: DataFrame, col: str) -> np.ndarray:
    """A packed Bloom filter over a column of longs, sized by their number.

    Tasks emit words of set bits; Spark ORs them by position, so at most BLOOM_BITS / 64 rows reach the
    driver whatever the size of df. Misses are certain; hits must be confirmed by the caller.
    """
    bits = bloom_bits(df.count())
    h = F.col(col)
    second = F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1).cast("long"))
    slots = F.array(*[F.pmod(h + second * F.lit(i).cast("long"), F.lit(bits).cast("long")) for i in range(BLOOM_HASHES)])
    words = (
        df.where(h.isNotNull())
        .select(F.explode(slots).alias("slot"))
        .select(F.expr("slot div 64").alias("at"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("word"))
        .groupBy("at")
        .agg(F.bit_or("word").alias("word"))
        .toPandas()
    )
    out = np.zeros(bits // 64, dtype=np.int64)
    out[words["at"].to_numpy(np.int64)] = words["word"].to_numpy(np.int64)
    return out.view(np.uint64)


def bloom_has(bloom: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """True where a hash (int64) may be in the filter."""
    bits = len(bloom) * 64
    h = hashes.astype(np.int64)
    second = (h.view(np.uint64) >> np.uint64(32)).astype(np.int64) | 1
    hit = np.ones(len(h), dtype=bool)
    with np.errstate(over="ignore"):
        for i in range(BLOOM_HASHES):
            slot = np.mod(h + second * np.int64(i), np.int64(bits))
            hit &= (bloom[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
    return hit
