"""Everything registered, plus the flagship query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fraygraph.functions.scalars import ratio
from fraygraph.plans import graphs, networks, runs, supply, tables  # noqa: F401
from fraygraph.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship"]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """(batch, fraction_removed, flow, flow_norm) of the static out-strength order."""
    run = graphs.trade_flows(spark, sf).filter("strategy = 'out_strength'")
    start = F.first("flow").over(Window.partitionBy("strategy").orderBy("batch"))
    return run.select("batch", "fraction_removed", "flow", ratio(F.col("flow"), start).alias("flow_norm"))
