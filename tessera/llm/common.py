"""Shared helpers: reading tables, materialising in the shared folder, size-checked joins, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, one of our own, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


#: Rows of an Arrow batch between the JVM and Python, where the session has Spark's own default of 10,000.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def small_batches(spark: SparkSession) -> None:
    """Batches of texts, which both sides of a Python worker hold whole, get a tenth of Spark's default rows; a session's own number stays."""
    name, default, ours = BATCH
    if spark.conf.get(name) == default:
        spark.conf.set(name, ours)


def release(spark: SparkSession) -> str:
    """Has the driver's JVM collect its garbage and give back what its native allocator keeps. Plans, metrics and shuffle files of the steps
    before go at once; else the heap and the arenas of some hundred threads grow first. Returns what the JVM says; empty if it can't trim."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    lang = jvm.java.lang

    def array(kind, *values):
        out = gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    try:
        of = lang.Class.forName
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        # by the interface's method: the server's own class is not open to reflection
        call = of("javax.management.MBeanServer").getMethod("invoke", array(lang.Class, of("javax.management.ObjectName"), of("java.lang.String"), of("[Ljava.lang.Object;"), of("[Ljava.lang.String;")))
        said = call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, name, "systemTrimNativeHeap", None, None))
    except Py4JJavaError:  # before JDK 17.0.9, or not on Linux
        return ""
    return str(said).strip()


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends, lost executors lose nothing.

    The files go when the application ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def map_rows(df: DataFrame, make, ddl: str, step: int = 256) -> DataFrame:
    """Arrow in and out. make() is called once a partition and gives a function from a dict of column lists (at most `step` rows, so that
    memory stays bounded however long the texts are) to row tuples in the order of ddl. Longs keep all their bits beside nulls."""
    small_batches(df.sparkSession)
    schema = to_arrow_schema(T.StructType.fromDDL(ddl))

    def run(batches):
        rows_of = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                rows = list(rows_of(batch.slice(at, step).to_pydict()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def join_checked(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", most: int = 20_000) -> DataFrame:
    """Broadcasts right only if a count proves it has at most `most` rows; else an ordinary shuffled join, whose skew AQE splits."""
    if right.limit(most + 1).count() <= most:
        return left.join(F.broadcast(right), on, how)
    return left.join(right.hint("merge"), on, how)


#: Edges of a task that makes a local forest.
EDGES = 50_000


def _local_forest(batches):
    """Edges of one partition to a star forest with the same components."""
    root: dict[int, int] = {}

    def find(x):
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while root.get(x, x) != top:
            root[x], x = top, root[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            ra, rb = find(a), find(b)
            root.setdefault(ra, ra)
            root.setdefault(rb, rb)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
        if len(root) > 2_000_000:  # bounded memory: hand on what is known, start anew
            keys = list(root)
            yield pd.DataFrame({"a": keys, "b": [find(k) for k in keys]})
            root.clear()
    keys = list(root)
    yield pd.DataFrame({"a": np.array(keys, dtype="int64"), "b": np.array([find(k) for k in keys], dtype="int64")})


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs to (v, component): the smallest vertex reachable; every vertex of an edge appears.

    Each partition first shrinks its edges to a forest; then large-star and small-star steps alternate until nothing changes.
    Minima are pre-aggregated, so a hub with any number of links is no hot task; the joins back are split by AQE."""
    e = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    # tasks by the number of edges, not by the session's partitions: many small forests shrink little, and a task in Python has its price
    e = materialise(e.repartition(min(partitions(e.sparkSession, 2), 2 + e.count() // EDGES)).mapInPandas(_local_forest, "a long, b long").where("a <> b"))
    sign = None
    while True:
        both = e.select("a", "b").union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        e = down.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e = materialise(e)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == sign or not now[0]:
            break
        sign = now
    release(e.sparkSession)
    top = e.groupBy("a").agg(F.min("b").alias("component"))
    every = e.select(F.col("a").alias("v")).union(e.select("b")).distinct()
    return every.join(top.withColumnRenamed("a", "v"), "v", "left").select("v", F.coalesce("component", "v").alias("component"))


def drawn(df: DataFrame, seed: str, most: int) -> DataFrame:
    """About `most` distinct rows, chosen by a hash of all their values: one key of many rows is thinned like any other, and exact
    repeats, which a hash can't tell apart, are one row."""
    h = F.pmod(F.xxhash64(*df.columns, F.lit(seed)), F.lit(1 << 30))
    return df.where(h < int((1 << 30) * min(1.0, most / max(df.count(), 1)))).dropDuplicates()


def crc_mod(doc_id: str, n: int):
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n
