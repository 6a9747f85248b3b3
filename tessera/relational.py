"""One description of a relational operator for both engines: a SQL template over named inputs.

Templates name their inputs as {input}. On Spark an input is a DataFrame, and Catalyst plans the whole; the DuckDB text has sub-queries in
the same places. @div is integer division that truncates; @each(n)) makes rows of 0 to n; numbers with an exponent (1e0) are doubles in both engines."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import views


@dataclass(frozen=True)
class Operator:
    id: str  # the coverage list's number
    template: str
    inputs: tuple[str, ...]  # names of views; the first is the operator's main input
    params: dict = field(default_factory=dict)

    def text(self) -> str:
        out = self.template
        for k, v in self.params.items():
            out = out.replace(f"@{k}", str(v))
        return out.replace(", 6) ", ", 6)+0e0 ")  # engines differ in the sign of a rounded zero

    def apply(self, spark: SparkSession, **frames: DataFrame) -> DataFrame:
        """The operator over any frames that have its inputs' columns."""
        return spark.sql(self.text().replace("@div", "div").replace("@each(", "explode(sequence(0, "), **frames)

    def query(self) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, sf_dir: self.apply(spark, **{n: views.VIEWS[n].spark(spark, sf_dir) for n in self.inputs})

    def oracle(self) -> str:
        out = self.text().replace("@div", "//").replace("@each(", "unnest(range(0, 1 + ")
        for n in self.inputs:
            out = out.replace("{" + n + "}", f"({views.VIEWS[n].duck})")
        return out
