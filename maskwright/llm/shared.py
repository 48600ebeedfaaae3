"""Shared folder, staged tables and word rules used by the corpus operators."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import drop_staged, release_shuffles, shared_root, staged

#: A word is a run of bytes other than space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

__all__ = ["SPACE", "WORD", "KeyFilter", "drop_staged", "read_table", "release_shuffles", "salted_join", "shared_root", "small_batches", "staged"]

#: Keys that hold over 1 / HOT_SHARE of all rows are hot, so there are fewer than HOT_SHARE of them;
#: each is dealt over SALTS tasks.
HOT_SHARE, SALTS = 2048, 32


def salted_join(rows: DataFrame, table: DataFrame, on: str, counts: DataFrame, *spread: str) -> DataFrame:
    """``rows`` joined with ``table``, which has one row for each ``on``. ``counts(on, n)`` says how many
    rows each key has; a hot key's rows are dealt over tasks by the hash of their columns ``spread``."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = F.broadcast(counts.filter(F.col("n") * HOT_SHARE > F.lit(total)).select(on, F.lit(SALTS).alias("__salts")))  # < HOT_SHARE rows
    dealt = rows.join(hot, on, "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*spread), "__salts").cast("int"), F.lit(0))).drop("__salts")
    copies = table.join(hot, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copies, [on, "__salt"]).drop("__salt")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1024):
    """Arrow batches of so many rows for what runs inside: rows with whole sets are large, and several
    batches of each task are in memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of a key filter for each key, and at least and at most in all (32 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 20, 1 << 28


class KeyFilter:
    """A bitmap over 64-bit keys, sized by their number: says no only for keys that aren't there.

    The bitmap is made by Spark's own bitmap aggregates and at most ``MOST_BITS / 8`` bytes reach
    the driver. It keeps rows from a shuffle before an exact join; more keys than fit cost time alone.
    """

    def __init__(self, keys: DataFrame, column: str):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * keys.count()).bit_length()))
        bit = F.pmod(F.col(column), F.lit(self.bits))
        rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("flags")).toArrow()
        held = dict(zip(rows["bucket"].to_pylist(), rows["flags"].to_pylist(), strict=True))
        self._shared = keys.sparkSession.sparkContext.broadcast(held)

    def __reduce__(self):
        return _filter_again, (self.bits, self._shared)

    def tester(self):
        """A function of an array of signed 64-bit keys, for use in a worker."""
        size = 8 * 4096  # bits of a bucket of Spark's bitmap functions; buckets count from 1
        flags = np.zeros((self.bits // size + 2, 4096), np.uint8)
        for k, bits in self._shared.value.items():
            flags[k] = np.frombuffer(bits, np.uint8)

        def test(keys: np.ndarray) -> np.ndarray:
            b = keys & np.int64(self.bits - 1)
            bucket = np.where(b > 0, (b - 1) // size + 1, 0)
            at = np.where(b > 0, (b - 1) % size, 0)
            return (flags[bucket, at // 8] >> (at % 8).astype(np.uint8) & 1).astype(bool)

        return test


def _filter_again(bits: int, shared) -> KeyFilter:
    out = KeyFilter.__new__(KeyFilter)
    out.bits, out._shared = bits, shared
    return out
