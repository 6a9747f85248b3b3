"""Sharding: a Feistel permutation with cycle walking over global row numbers gives a reproducible shuffle; shard and slot follow by arithmetic.

Law `rows`: shard counts differ by one at most. Only (id, size, crc) are shuffled, never texts.

Defined results: null text has size 8 and crc 0; rows with a null id come first in the numbering; rows equal in id, crc and size are
interchangeable, so ties and repeated rows give the same result rows in any run. An empty table gives an empty result.
Other columns are neither read nor returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, partitions, table

SHARDS, SEED, ROUNDS = 24, 20240229, 4
_P, _A, _B = (1 << 31) - 1, 1_103_515_245, 1_299_709_633 % ((1 << 31) - 1)


def half_bits(n: int) -> int:
    """Bits of a Feistel half: the smallest domain 4^b that holds n row numbers."""
    b = 1
    while 1 << (2 * b) < n:
        b += 1
    return b


def round_keys(seed: int) -> list[int]:
    return [(seed * (i + 1) * 40_503 + 7_919 * i) % _P for i in range(ROUNDS)]


def feistel(x: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The place of each row number below n; cycle walking repeats the permutation of the larger domain until it falls below n."""
    b = half_bits(n)
    mask = (1 << b) - 1
    x = x.astype(np.int64).copy()
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> b, x[todo] & mask
        for k in round_keys(seed):
            f = (right + k) % _P * _A % _P
            f = (f ^ (f >> 15)) * _B % _P
            left, right = right, left ^ (f & mask)
        x[todo] = (left << b) | right
        todo = todo[x[todo] >= n]
    return x


def ranged(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """df in n ranges of keys. A key's rows may go to several ranges, so that repeated rows are no hot task: ties go by a row's place in
    its input file, which a task that is run again finds unchanged."""
    tie = "__tie"
    while any(c.lower() == tie for c in df.columns):
        tie += "_"
    return df.withColumn(tie, F.monotonically_increasing_id() % 4096).repartitionByRange(n, *keys, tie).drop(tie)


def number_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Adds row_no, gapless from 0 in the order of keys. Sorted parts are written first, so part counts and rows agree even if tasks rerun."""
    spark = df.sparkSession
    part = materialise(ranged(df, keys, partitions(spark)).withColumn("__part", F.spark_partition_id()))
    before, total = {}, 0
    for r in part.groupBy("__part").count().orderBy("__part").collect():  # a row for each partition, not for each document
        before[r["__part"]] = total
        total += r["count"]
    starts = spark.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __before long")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return part.join(F.broadcast(starts), "__part").withColumn("row_no", rank - 1 + F.col("__before")).drop("__part", "__before"), total


def shards(rows: DataFrame, keys: list[str], n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Adds row_no, place, shard and slot. place is the row number's image; shard = place mod n_shards, slot = place div n_shards."""
    numbered, total = number_rows(rows, keys)

    @F.pandas_udf("long")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(feistel(x.to_numpy(), total, seed))

    out = numbered.withColumn("place", place("row_no"))
    return out.withColumn("shard", (F.col("place") % n_shards).cast("int")).withColumn("slot", F.expr(f"place div {n_shards}"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shards(rows, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
