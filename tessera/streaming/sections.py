"""Sections arriving as a stream: coefficients accumulate by pass. decoder.py holds sections until their prerequisites are there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of sections."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(f"{sf_dir}")
    return events.select("event_id", "ts", (F.col("user_id") % 16).cast("int").alias("grp"), F.abs(F.round(F.col("value") * 100)).cast("long").alias("len"))


def accumulate(sections: DataFrame) -> DataFrame:
    """Progressive sums by group and coefficient."""
    return sections.groupBy("grp", (F.col("len") % 64).alias("k")).agg(F.count("*").alias("passes"), F.sum("len").alias("coeff"))


def drain(df: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, each batch's result written as a table by the executors; the last of a complete stream counts,
    all of an appending one."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="tessera-")
    path = f"{shared}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch={number}")

    q = df.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}-state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


def t4_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drain(accumulate(stream(spark, sf_dir)))


QUERIES = {"t4_progressive_passes": t4_accumulate}
ORACLE_SQL = {"t4_progressive_passes": "with s as (select (user_id%16)::int grp, abs(round(value*100))::bigint len from events) select grp, len % 64 k, count(*) passes, sum(len)::bigint coeff from s group by 1, 2"}
