"""Roll-ups of entity and region counts: anchors, compartments, property profiles, weighted choices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.operators.ranking import random_key, unit_uniform


def region_totals(counts: DataFrame) -> DataFrame:
    """(v, region, total) with a positive pre + post sum, from (label, region, pre, post)."""
    totals = counts.groupBy(F.col("label").alias("v"), "region").agg(F.sum(F.col("pre") + F.col("post")).alias("total"))
    return totals.filter("total > 0")


def anchor_regions(counts: DataFrame) -> DataFrame:
    """(v, region): the region with the largest total, ties to the first name."""
    return region_totals(counts).groupBy("v").agg(F.min_by("region", F.struct((-F.col("total")).alias("t"), "region")).alias("region"))


def weighted_choice(counts: DataFrame, seed: int) -> DataFrame:
    """(v, region): one region per label, drawn with probability proportional to its total."""
    part = Window.partitionBy("v")
    table = region_totals(counts).withColumn("_upto", F.sum("total").over(part.orderBy("region"))).withColumn("_whole", F.sum("total").over(part))
    return table.filter(F.col("_upto") > unit_uniform(random_key(seed, "v")) * F.col("_whole")).groupBy("v").agg(F.min("region").alias("region"))


def compartments(counts: DataFrame, labels: DataFrame, first: str, second: str) -> DataFrame:
    """(v, first, second, share, compartment) from (v, compartment, count); exact halves and empty labels get no compartment."""
    wide = counts.groupBy("v").pivot("compartment", [first, second]).sum("count")
    wide = labels.select("v").join(wide, "v", "left").na.fill(0, [first, second])
    total = F.col(first) + F.col(second)
    table = wide.select("v", F.col(first).alias("first"), F.col(second).alias("second"), F.when(total > 0, F.col(first) / total).alias("share"))
    return table.withColumn("compartment", F.when(F.col("share") > 0.5, first).when(F.col("share") < 0.5, second))


def profile(df: DataFrame, properties: list[str]) -> DataFrame:
    """(property, filled, values): non-null and distinct counts; one pass, every (property, value) counted map-side first."""
    cells = F.explode(F.array(*[F.struct(F.lit(p).alias("property"), F.col(p).cast("string").alias("value")) for p in properties]))
    counts = df.select(cells.alias("c")).groupBy("c.property", "c.value").agg(F.count("c.value").alias("n"))
    return counts.groupBy("property").agg(F.sum("n").alias("filled"), F.count("value").alias("values"))
