"""Planes, frames and byte columns derived from ordinary tables, as DataFrames and as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 64


@dataclass(frozen=True)
class View:
    spark: Callable[[SparkSession, str], DataFrame]
    duck: str


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def plane_f32(spark, sf_dir):
    """(y, x, v): one row of samples for each embedding."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "e")).select("y", "x", F.col("e").cast("double").alias("v"))


_PLANE = "select vec_id::int y, t.x::int x, embedding[t.x+1]::double v from embeddings, range(0,64) t(x)"


def plane_rgb(spark, sf_dir):
    """(y, x, c0, c1, c2): three equal bands of plane_f32 as channels; what the last band lacks is 0. The band height is one aggregated row."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    h = read(spark, sf_dir, "embeddings").agg(F.expr("cast((max(vec_id) + 3) div 3 as int)").alias("h"))
    e = e.crossJoin(F.broadcast(h)).select(F.expr("cast(vec_id % h as int)").alias("y"), F.expr("cast(vec_id div h as int)").alias("c"), "embedding")
    rows = e.groupBy("y").agg(*[F.any_value(F.when(F.col("c") == c, F.col("embedding")), True).alias(f"e{c}") for c in range(3)])
    rows = rows.select("y", "e0", *[F.coalesce(f"e{c}", F.transform("e0", lambda v: v * 0)).alias(f"e{c}") for c in (1, 2)])
    return rows.select("y", F.posexplode(F.arrays_zip("e0", "e1", "e2")).alias("x", "e")).select("y", "x", *[F.col(f"e.e{c}").cast("double").alias(f"c{c}") for c in range(3)])


_RGB = f"""with p as ({_PLANE}), h as (select (max(y)+3)//3 h from p)
select (y % h)::int y, x, max(case when y//h=0 then v end) c0, coalesce(max(case when y//h=1 then v end), 0e0) c1, coalesce(max(case when y//h=2 then v end), 0e0) c2 from p, h group by 1,2"""


def plane_i32(spark, sf_dir):
    """(y, x, v): event values in hundredths, 64 to a row; the last row may be shorter."""
    e = read(spark, sf_dir, "events").select("event_id", "value")
    return e.select(F.expr(f"cast(event_id div {WIDTH} as int)").alias("y"), (F.col("event_id") % WIDTH).cast("int").alias("x"), F.round(F.col("value") * 100).cast("long").alias("v"))


_INT = "select (event_id//64)::int y, (event_id%64)::int x, round(value*100)::bigint v from events"


def pix_i32(spark, sf_dir):
    """(k, l, c0, c1, c2): small integers of lineitem."""
    return read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").cast("long").alias("c0"), F.round(F.col("l_discount") * 100).cast("long").alias("c1"), F.round(F.col("l_tax") * 100).cast("long").alias("c2"))


_PIX = "select l_orderkey k, l_linenumber l, l_quantity::bigint c0, round(l_discount*100)::bigint c1, round(l_tax*100)::bigint c2 from lineitem"


def frames(spark, sf_dir):
    """(frame, y, x, v): embeddings of one label are one frame's rows."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "embeddings").withColumn("y", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1)
    return e.select(F.col("label").alias("frame"), "y", F.posexplode("embedding").alias("x", "e")).select("frame", "y", "x", F.col("e").cast("double").alias("v"))


_FRAMES = "select label frame, y, t.x::int x, embedding[t.x+1]::double v from (select *, (row_number() over (partition by label order by vec_id) - 1)::int y from embeddings), range(0,64) t(x)"


def sections(spark, sf_dir):
    """(event_id, grp, pass, kind, len): events as sections of sixteen groups."""
    from pyspark.sql import Window

    e = read(spark, sf_dir, "events").withColumn("grp", (F.col("user_id") % 16).cast("int"))
    return e.select("event_id", "grp", (F.row_number().over(Window.partitionBy("grp").orderBy("event_id")) - 1).cast("int").alias("pass"), F.col("event_type").alias("kind"), F.abs(F.round(F.col("value") * 100)).cast("long").alias("len"))


_SECTIONS = "select event_id, (user_id%16)::int grp, (row_number() over (partition by user_id%16 order by event_id) - 1)::int pass, event_type kind, abs(round(value*100))::bigint len from events"


def contents(spark, sf_dir):
    """(doc_id, content): texts as bytes, every fourth behind a bare stream's signature, every fourth behind a container's."""
    d = read(spark, sf_dir, "documents")
    head = F.expr("case doc_id % 4 when 0 then X'FF0A' when 1 then X'0000000C4A584C200D0A870A' when 2 then X'0000' else X'' end")
    return d.select("doc_id", F.concat(head, F.col("text").cast("binary")).alias("content"))


_CONTENTS = r"""select doc_id, (case doc_id % 4 when 0 then '\xFF\x0A'::blob when 1 then '\x00\x00\x00\x0C\x4A\x58\x4C\x20\x0D\x0A\x87\x0A'::blob when 2 then '\x00\x00'::blob else ''::blob end) || encode(text) as content from documents"""

VIEWS = {
    "plane": View(plane_f32, _PLANE),
    "rgb": View(plane_rgb, _RGB),
    "ints": View(plane_i32, _INT),
    "pix": View(pix_i32, _PIX),
    "frames": View(frames, _FRAMES),
    "sections": View(sections, _SECTIONS),
    "contents": View(contents, _CONTENTS),
}
