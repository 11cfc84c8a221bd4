"""Algebra of removal curves: rows (scenario, batch, x = fraction removed, y) and comparisons across runs.

A run has a few hundred batches, so windows are always inside one run and never over all runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.functions.scalars import ratio
from fraygraph.functions.special import t_quantile
from fraygraph.operators.ranking import value_ranks


def restore_fractions(curves: DataFrame, n: int, column: str = "fraction_removed") -> DataFrame:
    """Snap fractions that went through rounding back to whole counts over n."""
    return curves.withColumn(column, F.rint(F.col(column) * F.lit(n)) / F.lit(float(n)))


def nested_runs(curves: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row per run with its values as arrays in batch order."""
    packed = F.array_sort(F.collect_list(F.struct("batch", *values)))
    runs = curves.groupBy(*keys).agg(packed.alias("points"))
    return runs.select(*keys, *[F.col(f"points.{v}").alias(v) for v in values])


def auc_window(curves: DataFrame, keys: list[str], x: str = "fraction_removed", limit: float = 0.5, strict: bool = False) -> DataFrame:
    """Points up to and including the first with x >= limit. A run that stops earlier is an error under ``strict``, else dropped."""
    last = curves.groupBy(*keys).agg(F.min(F.when(F.col(x) >= limit, F.col("batch"))).alias("_last"))
    if strict:
        last = last.withColumn("_last", F.coalesce("_last", F.raise_error(F.lit("a run stops before the AUC window ends"))))
    return curves.join(last, keys).filter("batch <= _last").drop("_last")


def normalized_auc(curves: DataFrame, keys: list[str], x: str, values: dict[str, str]) -> DataFrame:
    """Trapezoid area of y / y(batch 0) over x, divided by the x range. ``values`` maps y column -> result column.

    A curve that begins at 0 has nothing to be divided by: its area is NaN. One without a batch 0 is an error.
    """
    run = Window.partitionBy(*keys).orderBy("batch")
    table = curves.withColumn("_dx", F.col(x) - F.lag(x).over(run))
    for y in values:
        table = table.withColumn(f"_{y}", F.col("_dx") * (F.col(y) + F.lag(y).over(run)) / 2)
    aggregates = []
    for y, name in values.items():
        baseline = F.max(F.when(F.col("batch") == 0, F.col(y)))
        known = F.when(baseline >= 0, baseline).otherwise(F.raise_error(F.lit("baseline must not be missing or negative")).cast("double"))
        aggregates.append((ratio(F.sum(f"_{y}"), known) / (F.max(x) - F.min(x))).alias(name))
    return table.groupBy(*keys).agg(*aggregates)


def critical_fractions(curves: DataFrame, keys: list[str], x: str, y: str, cutoff: float = 0.5, strict: bool = False) -> DataFrame:
    """(keys, f_c, f_c_batch, batch): where y first falls strictly below cutoff * y(0); null when it never does."""
    run = Window.partitionBy(*keys).orderBy("batch")
    table = curves.select(
        *keys, "batch", F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"),
        F.lag(x).over(run).cast("double").alias("x0"), F.lag(y).over(run).cast("double").alias("y0"),
        (F.first(y).over(run) * F.lit(float(cutoff))).alias("limit"),
    )
    below = F.when(F.col("y1") < F.col("limit"), F.struct("batch", "x0", "y0", "x1", "y1", "limit"))
    found = table.groupBy(*keys).agg(F.min(below).alias("c")).select(*keys, "c.*")
    f_c = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("y0") - F.col("limit")) / (F.col("y0") - F.col("y1"))
    if strict:
        f_c = F.coalesce(f_c, F.raise_error(F.lit("the curve never falls below the cutoff")).cast("double"))
    return found.select(*keys, f_c.alias("f_c"), F.col("x1").alias("f_c_batch"), "batch")


def first_batch_below(curves: DataFrame, keys: list[str], y: str, share: float = 0.5) -> DataFrame:
    start = curves.filter("batch = 0").select(*keys, F.col(y).alias("_start"))
    hit = F.when(F.col(y) < F.col("_start") * share, F.col("batch"))
    return curves.join(start, keys).groupBy(*keys).agg(F.min(hit).alias("batch"))


def value_at(curves: DataFrame, points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, at, value): linear interpolation at arbitrary x, clamped to the ends of the run.

    As-of lookup without a range join: points and curve are sorted together inside each run and look both ways.
    """
    left = curves.select(*keys, F.col(x).cast("double").alias("pos"), F.col(y).cast("double").alias("val"), F.lit(0).alias("kind"))
    right = points.select(*keys, F.col("at").cast("double").alias("pos"), F.lit(None).cast("double").alias("val"), F.lit(1).alias("kind"))
    both = left.unionByName(right)
    spot = F.when(F.col("kind") == 0, F.struct("pos", "val"))
    before = Window.partitionBy(*keys).orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy("pos", "kind").rowsBetween(0, Window.unboundedFollowing)
    seen = both.withColumn("a", F.last(spot, True).over(before)).withColumn("b", F.first(spot, True).over(after)).filter("kind = 1")
    slope = (F.col("pos") - F.col("a.pos")) / (F.col("b.pos") - F.col("a.pos"))
    value = F.when(F.col("a").isNull(), F.col("b.val")).when(F.col("b").isNull(), F.col("a.val")).otherwise(
        F.col("a.val") + (F.col("b.val") - F.col("a.val")) * slope
    )
    return seen.select(*keys, F.col("pos").alias("at"), value.alias("value"))


def resample(curves: DataFrame, points: DataFrame, keys: list[str], x: str, y: str, scale: str) -> DataFrame:
    """The curve at other x values (keys, at), divided by the column ``scale`` of its batch 0 (NaN where both are 0)."""
    start = curves.filter("batch = 0").select(*keys, F.col(scale).cast("double").alias("_scale"))
    return value_at(curves, points, keys, x, y).join(start, keys).select(*keys, "at", ratio(F.col("value"), F.col("_scale")).alias("value"))


def band(curves: DataFrame, by: list[str], y: str) -> DataFrame:
    return curves.groupBy(*by).agg(F.avg(y).alias("mean"), F.min(y).alias("low"), F.max(y).alias("high"), F.count(y).alias("trials"))


def mean_ci(df: DataFrame, by: list[str], value: str, level: float = 0.95) -> DataFrame:
    """(by, n, mean, sd, low, high): Student-t interval of the mean; one value has no interval."""
    stats = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    half = t_quantile(F.lit(0.5 + level / 2), F.col("n") - 1) * F.col("sd") / F.sqrt("n")
    return stats.withColumn("_half", half).select(*by, "n", "mean", "sd", (F.col("mean") - F.col("_half")).alias("low"), (F.col("mean") + F.col("_half")).alias("high"))


def trial_summary(trials: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and range over trials, null as soon as one trial has no value."""
    whole = F.bool_and(F.col(value).isNotNull())
    return trials.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trials"), F.when(whole, F.avg(value)).alias("mean"),
        F.when(whole, F.min(value)).alias("low"), F.when(whole, F.max(value)).alias("high"),
    )


def cascade_summary(curves: DataFrame, by: list[str], size: str = "avalanche") -> DataFrame:
    return curves.filter(F.col(size).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("batches"), F.count_if(F.col(size) == 0).alias("zero_batches"),
        F.max(size).alias("max_size"), F.sum(size).alias("total_cut"),
    )


def threshold_table(critical: DataFrame, strategy: str = "strategy") -> DataFrame:
    """Per targeted strategy: f_c, whether it lies below the random interval, and whether it is the most damaging."""
    random = mean_ci(critical.filter(F.col(strategy) == "random"), [], "f_c").first()
    targeted = critical.filter(F.col(strategy) != "random").groupBy(strategy).agg(F.avg("f_c").alias("f_c"), F.avg("f_c_batch").alias("f_c_batch"))
    first = F.min_by(strategy, F.struct("f_c", strategy)).over(Window.partitionBy(F.lit(0)))  # one row per strategy
    limits = [F.lit(random[c]).cast("double").alias(f"random_{c}") for c in ("mean", "low", "high")]
    table = targeted.select(strategy, "f_c", "f_c_batch", *limits, (F.col(strategy) == first).alias("most_damaging"))
    return table.withColumn("below_random", F.col("f_c") < F.col("random_low"))


def null_summary(real: DataFrame, nulls: DataFrame, by: list[str], value: str, alpha: float) -> DataFrame:
    """Real value against its null ensemble: moments, range, lower-tail p with +1 on both sides, z, significance."""
    joined = nulls.select(*by, F.col(value).alias("null")).join(real.select(*by, F.col(value).alias("real")), by)
    stats = joined.groupBy(*by, "real").agg(
        F.avg("null").alias("null_mean"), F.stddev_samp("null").alias("null_sd"), F.min("null").alias("null_min"),
        F.max("null").alias("null_max"), F.count_if(F.col("null") <= F.col("real")).alias("at_or_below"), F.count("null").alias("n"),
    )
    p = (F.col("at_or_below") + 1) / (F.col("n") + 1)
    return stats.withColumn("p_value", p).withColumn("z", F.when(F.col("null_sd") > 0, (F.col("real") - F.col("null_mean")) / F.col("null_sd"))).withColumn(
        "significant", F.col("p_value") < alpha
    )


def upper_p(observed: DataFrame, nulls: DataFrame, by: list[str], value: str) -> DataFrame:
    """Upper-tail empirical p per group; ``nulls`` is joined on ``by`` and ties count against the observation."""
    joined = observed.join(nulls.select(*by, F.col(value).alias("_null")), by)
    keep = observed.columns
    return joined.groupBy(*keep).agg(
        ((F.count_if(F.col("_null") >= F.col(value)) + 1) / (F.count("_null") + 1)).alias("p_value"),
        F.avg("_null").alias("random_mean"), F.stddev_samp("_null").alias("random_sd"),
    )


def histogram(df: DataFrame, by: list[str], value: str, bins: int = 24) -> DataFrame:
    """(by, bin, low, step, count): equal-width bins, the last one closed, empty bins kept; a constant is widened by 0.0005."""
    ends = df.groupBy(*by).agg(F.min(value).cast("double").alias("_min"), F.max(value).cast("double").alias("_max"))
    flat = F.col("_min") == F.col("_max")
    ends = ends.select(
        *by, F.when(flat, F.col("_min") - 0.0005).otherwise(F.col("_min")).alias("lo"),
        F.when(flat, F.col("_max") + 0.0005).otherwise(F.col("_max")).alias("_hi"),
    ).withColumn("step", (F.col("_hi") - F.col("lo")) / bins)
    cell = F.least(F.floor((F.col(value) - F.col("lo")) / F.col("step")), F.lit(bins - 1)).cast("int")
    counts = df.join(ends, by).groupBy(*by, cell.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    low = F.col("lo") + F.col("bin") * F.col("step")
    return grid.join(counts, [*by, "bin"], "left").select(*by, "bin", low.alias("low"), "step", F.coalesce("count", F.lit(0)).alias("count"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, quantiles): exact, linearly interpolated, from the histogram of distinct values with cumulative counts."""
    ranks = value_ranks(df, by, value)
    ends = []
    for share in shares:
        place = F.lit(float(share)) * (F.col("total") - 1)
        for i, at in enumerate((F.floor(place), F.ceil(place))):
            here = (F.col("below") <= at) & (at < F.col("below") + F.col("ties"))
            ends.append(F.max(F.when(here, F.col(value))).cast("double").alias(f"_{i}"))
    packed = [F.struct(low, high) for low, high in zip(ends[::2], ends[1::2])]
    found = ranks.groupBy(*by).agg(F.max("total").alias("_total"), F.array(*packed).alias("_ends"))
    values = []
    for i, share in enumerate(shares):
        place = F.lit(float(share)) * (F.col("_total") - 1)
        pair = F.col("_ends")[i]
        values.append(pair["_0"] + (pair["_1"] - pair["_0"]) * (place - F.floor(place)))
    return found.select(*by, F.array(*values).alias("quantiles"))


def ccdf(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, p): share of the positive values at or above each distinct value."""
    return value_ranks(df.filter(F.col(value) > 0), by, value).select(*by, value, ((F.col("total") - F.col("below")) / F.col("total")).alias("p"))


def log_grid(df: DataFrame, by: list[str], value: str, points: int = 120) -> DataFrame:
    """(by, at): distinct whole numbers nearest to ``points`` log-spaced values between the smallest and largest."""
    ends = df.filter(F.col(value) > 0).groupBy(*by).agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    return ends.withColumn("i", step).select(*by, F.rint(F.col("lo") * F.pow(F.col("hi") / F.col("lo"), F.col("i") / (points - 1))).alias("at")).distinct()


def ccdf_on_grid(df: DataFrame, by: list[str], value: str, points: int = 120) -> DataFrame:
    """(by, at, p) on the log grid: the CCDF at the smallest distinct value >= at."""
    steps = ccdf(df, by, value).select(*by, F.col(value).cast("double").alias("pos"), "p", F.lit(1).alias("_kind"))
    grid = log_grid(df, by, value, points).select(*by, F.col("at").alias("pos"), F.lit(None).cast("double").alias("p"), F.lit(0).alias("_kind"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    ahead = part.orderBy("pos", "_kind").rowsBetween(0, Window.unboundedFollowing)
    both = steps.unionByName(grid).withColumn("p", F.first("p", True).over(ahead))
    return both.filter("_kind = 0").select(*by, F.col("pos").alias("at"), F.coalesce("p", F.lit(0.0)).alias("p"))
