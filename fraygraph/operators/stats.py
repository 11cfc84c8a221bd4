"""Rank tests and comparisons. Ranks come from histograms of distinct values; p-values are added to the aggregated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fraygraph.functions.scalars import ratio
from fraygraph.functions.special import log10_normal_tail, normal_tail, t_tail_two_sided
from fraygraph.operators.ranking import average_rank, join_ranks, mid_rank_percentile, value_ranks


def mann_whitney(df: DataFrame, by: list[str], score: str, member: str) -> DataFrame:
    """(by, n_members, n_other, u, auc, rank_biserial, median_percentile, z, p_value): do members score higher than the rest?

    ``member`` is a boolean column; rows without a score or membership are left out. Average ranks, tie-corrected normal approximation with continuity correction.
    """
    df = df.filter(F.col(score).isNotNull() & F.col(member).isNotNull())
    ranks = value_ranks(df, by, score)
    ties = ranks.groupBy(*by).agg(F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).cast("double").alias("tie_term"))
    members = df.groupBy(*by, score).agg(F.count_if(F.col(member)).alias("inside"))
    hist = ranks.join(members, [*by, score]).withColumn("rank", average_rank()).withColumn("pct", mid_rank_percentile())
    sums = hist.groupBy(*by).agg(
        F.sum("inside").alias("n_members"), F.sum("ties").alias("n"), F.sum(F.col("inside") * F.col("rank")).alias("rank_sum"),
        F.percentile("pct", F.lit(0.5), F.col("inside")).alias("median_percentile"),
    ).join(ties, by)
    m, k = F.col("n_members"), F.col("n") - F.col("n_members")
    u = F.col("rank_sum") - m * (m + 1) / 2
    auc = u / (m * k)
    spread = F.sqrt(m * k / 12 * ((F.col("n") + 1) - F.col("tie_term") / (F.col("n") * (F.col("n") - 1))))
    table = sums.select(
        *by, m.alias("n_members"), k.alias("n_other"), u.alias("u"), auc.alias("auc"), (2 * auc - 1).alias("rank_biserial"),
        "median_percentile", ((u - m * k / 2 - 0.5) / spread).alias("z"),
    )
    return table.withColumn("p_value", normal_tail("z"))


def signed_rank(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, pairs_differing, w, z, p_value, log10_p): one-sided, x above y, over the rows where they differ."""
    diff = df.withColumn("_d", F.col(x) - F.col(y)).filter("_d <> 0").withColumn("_a", F.abs("_d"))
    ranks = value_ranks(diff, by, "_a")
    positive = diff.groupBy(*by, "_a").agg(F.count_if(F.col("_d") > 0).alias("up"))
    hist = ranks.join(positive, [*by, "_a"]).withColumn("rank", average_rank())
    sums = hist.groupBy(*by).agg(
        F.sum("ties").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"),
        F.sum(F.col("ties") * F.col("ties") * F.col("ties") - F.col("ties")).cast("double").alias("tie_term"),
    )
    n = F.col("n")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tie_term") / 48)
    table = sums.select(*by, n.alias("pairs_differing"), "w", ((F.col("w") - n * (n + 1) / 4) / spread).alias("z"))
    return table.withColumn("p_value", normal_tail("z")).withColumn("log10_p", log10_normal_tail("z"))


def welch(df: DataFrame, by: list[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """(by, t, df, p_value) of two groups named in column ``group``; two-sided, unequal variances; NaN without any variance between equal means."""
    def of(name, function):
        return function(F.when(F.col(group) == name, F.col(value)))

    stats = df.groupBy(*by).agg(
        of(first, F.avg).alias("m1"), of(first, F.var_samp).alias("v1"), of(first, F.count).alias("n1"),
        of(second, F.avg).alias("m2"), of(second, F.var_samp).alias("v2"), of(second, F.count).alias("n2"),
    )
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = ratio(F.col("m1") - F.col("m2"), F.sqrt(a + b))
    freedom = ratio((a + b) * (a + b), a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1))
    return stats.select(*by, t.alias("t"), freedom.alias("df")).withColumn("p_value", t_tail_two_sided("t", "df"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, rho, p_value): correlation of average ranks over the rows that have both values, p by the t approximation.

    Where one of the two is the same in all rows there is no correlation: NaN, without a p. One row alone has null.
    """
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for column in (x, y):
        ranks = value_ranks(df.select(*by, column), by, column).select(*by, column, average_rank().alias(f"_r_{column}"))
        df = join_ranks(df, ranks, by, column)
    spread = F.sqrt(F.var_pop(f"_r_{x}") * F.var_pop(f"_r_{y}"))
    rho = F.when(F.count(F.lit(1)) > 1, ratio(F.covar_pop(f"_r_{x}", f"_r_{y}"), spread))
    stats = df.groupBy(*by).agg(rho.alias("rho"), F.count(F.lit(1)).alias("_n"))
    t = F.abs("rho") * F.sqrt((F.col("_n") - 2) / F.greatest(F.lit(1e-300), 1 - F.col("rho") * F.col("rho")))
    return stats.withColumn("p_value", t_tail_two_sided(t, F.col("_n") - 2)).drop("_n")
