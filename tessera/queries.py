"""All queries of the plane operators with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import colour, compose, modular, noise, stencil, streams, vardct
from tessera.sources import container, icc, sinks, views
from tessera.streaming import decoder, sections

_MODULES = (colour, compose, modular, stencil, vardct, container)
OPERATORS = {k: v for m in _MODULES for k, v in m.OPERATORS.items()}
QUERIES = {k: v.query() for k, v in OPERATORS.items()} | modular.QUERIES | vardct.QUERIES | container.QUERIES | sinks.QUERIES | icc.QUERIES | sections.QUERIES | streams.QUERIES | noise.QUERIES | decoder.QUERIES
ORACLE_SQL = {k: v.oracle() for k, v in OPERATORS.items()} | {k: q.replace("{contents}", f"({views.VIEWS['contents'].duck})") for k, (_, q) in container.ORACLE.items()} | sections.ORACLE_SQL | streams.ORACLE_SQL | decoder.ORACLE_SQL | modular.ORACLE_SQL | vardct.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_band_statistics"](spark, sf_dir)
