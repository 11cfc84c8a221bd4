"""Consistency of result tables: every check is a DataFrame of violations (check, detail) that must be empty."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def violations(rows: DataFrame, check: str, bad: Column, *detail: str) -> DataFrame:
    return rows.filter(bad).select(F.lit(check).alias("check"), F.concat_ws("|", *[F.col(d).cast("string") for d in detail]).alias("detail"))


def together(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def report(found: DataFrame, names: list[str]) -> DataFrame:
    """(check, violations, status): one row per check that ran, OK or FAIL."""
    spark = found.sparkSession
    counts = found.groupBy("check").agg(F.count(F.lit(1)).alias("violations"))
    listed = spark.createDataFrame([(n,) for n in names], "check string")
    table = listed.join(counts, "check", "left").na.fill(0, ["violations"])
    return table.withColumn("status", F.when(F.col("violations") == 0, "OK").otherwise("FAIL"))


CURVE_CHECKS = ["batches contiguous", "fraction increasing", "flow not increasing", "pairs not increasing", "null only at batch 0"]


def check_curves(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Curves (keys, batch, fraction_removed, flow, reachable_pairs, avalanche)."""
    run = Window.partitionBy(*keys).orderBy("batch")
    rows = curves
    for c in ("batch", "fraction_removed", "flow", "reachable_pairs"):
        rows = rows.withColumn(f"_{c}", F.lag(c).over(run))
    first = F.col("_batch").isNull()
    return together(
        violations(rows, CURVE_CHECKS[0], F.when(first, F.col("batch") != 0).otherwise(F.col("batch") != F.col("_batch") + 1), *keys, "batch"),
        violations(rows, CURVE_CHECKS[1], ~first & (F.col("fraction_removed") <= F.col("_fraction_removed")), *keys, "batch"),
        violations(rows, CURVE_CHECKS[2], ~first & (F.col("flow") > F.col("_flow")), *keys, "batch"),
        violations(rows, CURVE_CHECKS[3], ~first & (F.col("reachable_pairs") > F.col("_reachable_pairs")), *keys, "batch"),
        violations(rows, CURVE_CHECKS[4], F.col("avalanche").isNull() != (F.col("batch") == 0), *keys, "batch"),
    )


GRAPH_CHECKS = ["no self-loop", "no parallel edge", "ends are vertices", "share at threshold", "terminals disjoint", "terminals are vertices"]


def check_graph(vertices: DataFrame, edges: DataFrame, terminals: DataFrame, tau: float) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    parallel = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    roles = terminals.groupBy("v").agg(F.countDistinct("role").alias("n"))
    always = F.lit(True)
    return together(
        violations(edges, GRAPH_CHECKS[0], F.col("src") == F.col("dst"), "src"),
        violations(parallel, GRAPH_CHECKS[1], F.col("n") > 1, "src", "dst"),
        violations(ends.join(vertices.select("v"), "v", "left_anti"), GRAPH_CHECKS[2], always, "v"),
        violations(edges, GRAPH_CHECKS[3], ~F.col("share").between(tau, 1.0), "src", "dst"),
        violations(roles, GRAPH_CHECKS[4], F.col("n") > 1, "v"),
        violations(terminals.join(vertices.select("v"), "v", "left_anti"), GRAPH_CHECKS[5], always, "v"),
    )


KNOCKOUT_CHECKS = ["flow plus drop is intact", "no negative drop", "one row per vertex", "pairs plus lost is intact"]


def check_knockouts(scan: DataFrame, vertices: DataFrame, intact_flow: int, intact_pairs: int) -> DataFrame:
    """Scan (v, flow, flow_drop, reachable_pairs, pairs_lost)."""
    rows = vertices.select("v").join(scan.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v", "full")
    return together(
        violations(scan, KNOCKOUT_CHECKS[0], F.col("flow") + F.col("flow_drop") != intact_flow, "v"),
        violations(scan, KNOCKOUT_CHECKS[1], (F.col("flow_drop") < 0) | (F.col("pairs_lost") < 0), "v"),
        violations(rows, KNOCKOUT_CHECKS[2], F.coalesce("n", F.lit(0)) != 1, "v"),
        violations(scan, KNOCKOUT_CHECKS[3], F.col("reachable_pairs") + F.col("pairs_lost") != intact_pairs, "v"),
    )


NULL_CHECKS = ["rows unique", "indices contiguous", "auc in range", "p from counts", "p at least floor"]


def check_nulls(scores: DataFrame, summary: DataFrame, n: int) -> DataFrame:
    """Scores (g, strategy, auc_flow, auc_reachability) and summary (strategy, at_or_below, n, p_value)."""
    counts = scores.groupBy("g", "strategy").agg(F.count(F.lit(1)).alias("rows"))
    spans = scores.groupBy("strategy").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.countDistinct("g").alias("d"))
    formula = (F.col("at_or_below") + 1) / (F.col("n") + 1)
    return together(
        violations(counts, NULL_CHECKS[0], F.col("rows") != 1, "strategy", "g"),
        violations(spans, NULL_CHECKS[1], (F.col("lo") != 0) | (F.col("hi") != n - 1) | (F.col("d") != n), "strategy"),
        violations(scores, NULL_CHECKS[2], ~F.col("auc_flow").between(0, 1) | ~F.col("auc_reachability").between(0, 1), "strategy", "g"),
        violations(summary, NULL_CHECKS[3], F.abs(F.col("p_value") - formula) > 1e-12, "strategy"),
        violations(summary, NULL_CHECKS[4], F.col("p_value") < 1 / (n + 1), "strategy"),
    )


def close(a: Column, b: Column, rel: float = 1e-6, absolute: float = 1e-9) -> Column:
    """Equal within tolerance; two nulls are equal, one is not."""
    near = F.abs(a - b) <= F.greatest(F.lit(absolute), F.lit(rel) * F.greatest(F.abs(a), F.abs(b)))
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(near)


def table_differences(left: DataFrame, right: DataFrame, keys: list[str], numbers: list[str], texts: list[str] = ()) -> DataFrame:
    """(keys, column, left_value, right_value): cells that differ, missing rows included; empty when tables agree."""
    a = left.select(*keys, *[F.col(c).alias(f"a_{c}") for c in [*numbers, *texts]], F.lit(True).alias("_a"))
    b = right.select(*keys, *[F.col(c).alias(f"b_{c}") for c in [*numbers, *texts]], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    cells = [(F.lit("row"), F.col("_a"), F.col("_b"), F.col("_a").eqNullSafe(F.col("_b")))]
    cells += [(F.lit(c), F.col(f"a_{c}"), F.col(f"b_{c}"), close(F.col(f"a_{c}").cast("double"), F.col(f"b_{c}").cast("double"))) for c in numbers]
    cells += [(F.lit(c), F.col(f"a_{c}"), F.col(f"b_{c}"), F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))) for c in texts]
    packed = F.array(*[
        F.struct(n.alias("column"), x.cast("string").alias("left_value"), y.cast("string").alias("right_value"), ok.alias("ok")) for n, x, y, ok in cells
    ])
    return both.select(*keys, F.explode(packed).alias("c")).filter("not c.ok").select(*keys, "c.column", "c.left_value", "c.right_value")


def first_difference(differences: DataFrame, keys: list[str]) -> DataFrame:
    return differences.orderBy(*keys, "column").limit(1)


def missing_fields(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
