"""Discrete heavy-tail fits on (by, value, n) histograms: power law, bootstrap goodness of fit, likelihood ratios.

Groups are data sets (or bootstrap samples); everything is counted per distinct value before it meets another value.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraygraph.functions import digests
from fraygraph.session import hint_small, settle, store

ZETA_TERMS = 10


def hurwitz_zeta(a: Column, q: Column) -> Column:
    """sum over k >= 0 of (q + k)^-a: ten terms and the Euler-Maclaurin tail (about 1e-12 relative for q >= 1)."""
    end = q + F.lit(float(ZETA_TERMS))
    power = lambda x, e: F.exp(-e * F.ln(x))
    total = power(q.cast("double"), a)
    for k in range(1, ZETA_TERMS):
        total = total + power(q + F.lit(float(k)), a)
    tail = power(end, a)
    total = total + tail * end / (a - 1) + tail / 2 + a * tail / end / 12
    return total - a * (a + 1) * (a + 2) * tail / (end * end * end) / 720 + a * (a + 1) * (a + 2) * (a + 3) * (a + 4) * tail / (end * end * end * end * end) / 30240


def value_histogram(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, value, n) of the positive values."""
    return df.filter(F.col(value) > 0).groupBy(*by, F.col(value).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _candidates(hist: DataFrame, by: list[str]) -> DataFrame:
    """(by, xmin, alpha, n_tail, total) for every distinct value but the largest, by reverse running sums."""
    part = Window.partitionBy(*by)
    above = part.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    logs = F.sum(F.col("n") * F.ln("value")).over(above)
    n_tail = F.sum("n").over(above)
    table = hist.select(*by, F.col("value").alias("xmin"), n_tail.alias("n_tail"), logs.alias("logs"), F.sum("n").over(part).alias("total"), F.max("value").over(part).alias("top"))
    alpha = 1 + F.col("n_tail") / (F.col("logs") - F.col("n_tail") * F.ln(F.col("xmin") - 0.5))
    return table.filter("xmin < top").select(*by, "xmin", alpha.alias("alpha"), "n_tail", "total")


def fit_power_law(hist: DataFrame, by: list[str], blocks: int = 8) -> DataFrame:
    """(by, xmin, alpha, sigma, n_tail, n, ks): the xmin whose tail is nearest to its power law.

    Every candidate is compared with every distinct value above it; candidates are spread over ``blocks`` per data set
    and each comparison is folded into its maximum where it is made.
    """
    candidates = _candidates(hist, by)
    part = Window.partitionBy(*by)
    above = part.orderBy(F.col("value").desc()).rowsBetween(Window.unboundedPreceding, 0)
    points = hist.select(*by, "value", F.sum("n").over(above).alias("at_least"))
    points = points.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    spread = candidates.withColumn("_block", F.pmod(F.xxhash64("xmin"), F.lit(blocks)).cast("int"))
    spread = spread.withColumn("_scale", hurwitz_zeta(F.col("alpha"), F.col("xmin")))
    met = spread.join(points, [*by, "_block"]).filter("value >= xmin")
    gap = F.abs(F.col("at_least") / F.col("n_tail") - hurwitz_zeta(F.col("alpha"), F.col("value")) / F.col("_scale"))
    scored = met.groupBy(*by, "xmin", "alpha", "n_tail", "total").agg(F.max(gap).alias("ks"))
    best = scored.groupBy(*by).agg(F.min(F.struct("ks", "xmin", "alpha", "n_tail", "total")).alias("b")).select(*by, "b.*")
    return best.select(*by, "xmin", "alpha", ((F.col("alpha") - 1) / F.sqrt("n_tail")).alias("sigma"), "n_tail", F.col("total").alias("n"), "ks")


def model_ccdf(hist: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """(by, value, p): the fitted tail, scaled to its share of the data, at the observed values above xmin."""
    scale = F.col("n_tail") / F.col("total") / hurwitz_zeta(F.col("alpha"), F.col("xmin"))
    params = fits.select(*by, "xmin", "alpha", "n_tail", F.col("n").alias("total"))
    joined = hist.join(params, by).filter("value >= xmin")
    return joined.select(*by, "value", (scale * hurwitz_zeta(F.col("alpha"), F.col("value"))).alias("p"))


def _redrawn(table: pa.Table, by: list[str], seed: int) -> pa.Table:
    """(by, sim, value, n) of one simulation of one data set; ``table`` has its histogram, its fit and the ``_rest`` of the keys of its draws."""
    row = {c: table.column(c)[0].as_py() for c in ("xmin", "alpha", "n_tail", "total")}
    values, sizes = (table.column(c).to_numpy() for c in ("value", "n"))
    below = np.flatnonzero(values < row["xmin"])
    below = below[np.argsort(values[below], kind="stable")]
    upto, size = np.cumsum(sizes[below]), row["total"] - row["n_tail"]
    body, near, far = np.zeros(below.size, np.int64), np.zeros(4096, np.int64), []
    rests = list(zip(table.column("_rest").to_pylist(), sizes.tolist()))
    parts, draws = (digests.uniforms([(f"{seed}|{tag}|{rest}|".encode(), n) for rest, n in rests]) for tag in ("part", "draw"))
    for u, w in zip(parts, draws):
        is_tail = u * row["total"] < row["n_tail"]
        place = np.minimum(np.floor(w[~is_tail] * size).astype(np.int64), size - 1)
        body += np.bincount(np.searchsorted(upto, place, side="right"), minlength=below.size)
        drawn = np.floor((row["xmin"] - 0.5) * np.power(1 - w[is_tail], -1 / (row["alpha"] - 1)) + 0.5)
        over = np.where(drawn < 2.0**63, drawn, 0.0).astype(np.int64) - row["xmin"]
        over = np.where(drawn < 2.0**63, over, 2**63 - 1 - row["xmin"])  # what is past a long stops there
        near += np.bincount(over[over < near.size], minlength=near.size)
        far.append(over[over >= near.size])
    beyond, times = np.unique(np.concatenate(far), return_counts=True)
    values = np.concatenate([values[below], np.arange(near.size) + row["xmin"], beyond + row["xmin"]])
    sizes = np.concatenate([body, near, times])
    values, sizes = values[sizes > 0], sizes[sizes > 0]
    same = table.select([*by, "sim"]).take(pa.array(np.zeros(values.size, np.int64)))
    return same.append_column("value", pa.array(values, pa.int64())).append_column("n", pa.array(sizes, pa.int64()))


def bootstrap(hist: DataFrame, fits: DataFrame, by: list[str], sims: int, seed: int) -> DataFrame:
    """(by, sims, p_value): share of synthetic data sets, refitted from scratch, that lie at least as far from their fit.

    Every observation is redrawn in every simulation: above xmin from the fitted law with probability n_tail / n, else
    from the observed values below xmin. Draws are md5 uniforms, so any partitioning gives the same samples. A task makes the
    draws of one simulation by blocks and keeps how often each value came.
    """
    total = fits.select(*by, "xmin", "alpha", "n_tail", F.col("n").alias("total"), F.col("ks").alias("observed"))
    rows = hist.filter("n > 0").withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1)))).join(hint_small(settle(total)), by)
    # The histogram is small and the draws are many: simulations are dealt to tasks before anything is drawn.
    rows = rows.repartition(int(hist.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sim")
    rows = rows.withColumn("_rest", F.concat_ws("|", *[F.col(c).cast("string") for c in (*by, "sim", "value")]))
    kinds = T.StructType([*[hist.schema[c] for c in by], T.StructField("sim", T.IntegerType()), T.StructField("value", T.LongType()), T.StructField("n", T.LongType())])
    samples = settle(rows.groupBy("sim", *by).applyInArrow(lambda table: _redrawn(table, by, seed), kinds))
    refits = fit_power_law(samples, [*by, "sim"]).join(total.select(*by, "observed"), by)
    return refits.groupBy(*by).agg(F.count(F.lit(1)).alias("sims"), F.avg((F.col("ks") >= F.col("observed")).cast("double")).alias("p_value"))


def _doubles(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


# A fit is done when its gradient per observation is below this; steps without getting there are an error.
GRADIENT, MOST_STEPS = 1e-7, 60
DIRECT_TERMS, FARTHEST = 2000, 600.0


def _truncated_nodes(alpha: float, rate: float, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Points x >= start and weights w whose sum is that of x^-alpha exp(-rate (x - start)) over whole numbers: direct terms, then
    the integral from half a step below the next one, by Gauss panels of at most one unit of log x."""
    near = np.arange(start, start + DIRECT_TERMS, dtype=float)
    edge = start + DIRECT_TERMS - 0.5
    far = min(FARTHEST, 45.0 / max(alpha - 1, 1e-3), math.log1p(60.0 / max(rate * edge, 1e-300)))
    panels = max(1, math.ceil(far))
    x, w = np.polynomial.legendre.leggauss(16)
    at = ((np.arange(panels)[:, None] + (x[None, :] + 1) / 2) * (far / panels)).ravel()
    beyond = edge * np.exp(at)
    steps = np.tile(w / 2 * far / panels, panels) * beyond
    points = np.concatenate([near, beyond])
    return points, np.concatenate([np.ones(near.size), steps]) * np.exp(-alpha * np.log(points) - rate * (points - start))


def truncated_fit(mean_log: float, mean_excess: float, start: int, alpha: float) -> tuple[float, float, float]:
    """(alpha, rate, log normalizer) of the likeliest power law with an exponential cut-off, alpha >= 1 and rate >= 0.

    The likelihood knows the data by the means of ln x and x - start only, and is concave; Newton steps keep to the bounds and are halved
    until they gain. At the end no parameter has a gradient above ``GRADIENT`` (in units of the mean excess for the rate), but for one
    that lies at its bound, or nears a rate of 0, and would leave it.
    """
    point = np.array([max(alpha, 1.001), 0.1 / max(mean_excess, 1e-9)])
    means = np.array([mean_log, mean_excess])

    def at(p):
        x, w = _truncated_nodes(p[0], p[1], start)
        z = w.sum()
        f = np.stack([np.log(x), x - start])
        expected = f @ w / z
        centred = f - expected[:, None]
        return -(p @ means) - math.log(z), expected - means, (centred * w) @ centred.T / z

    value, slope, spread = at(point)
    scale = np.array([1.0, max(mean_excess, 1.0)])  # the excess has the size of the values
    for _ in range(MOST_STEPS):
        # A parameter that lies at its bound, or as good as there, and would leave it stays where it is.
        free = np.array([point[0] > 1.0 or slope[0] > 0, slope[1] > 0 or -slope[1] * point[1] >= GRADIENT])
        left = np.abs(slope) / scale
        if np.all(left[free] < GRADIENT):
            return float(point[0]), float(point[1]), -value - float(point @ means)
        step = np.zeros(2)
        step[free] = np.linalg.lstsq(spread[np.ix_(free, free)], slope[free], rcond=None)[0]
        share = 1.0
        while share > 1e-12:
            trial = np.maximum(point + share * step, [1.0, point[1] / 10])  # a rate of 0 is neared, not reached
            got = at(trial)
            if got[0] >= value - 1e-12 * abs(value):
                break
            share /= 2
        else:
            raise RuntimeError(f"no step from {point} gains; gradient {slope}")
        point, (value, slope, spread) = trial, got
    raise RuntimeError(f"no maximum after {MOST_STEPS} steps; gradient {slope}")


@F.pandas_udf(_doubles("alpha", "rate", "norm"))
def _truncated(mean_log: pd.Series, mean_excess: pd.Series, start: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    rows = [truncated_fit(float(m), float(e), int(s), float(a)) for m, e, s, a in zip(mean_log, mean_excess, start, alpha)]
    return pd.DataFrame(rows, columns=["alpha", "rate", "norm"], dtype="float64")


def lognormal_sums(b: float, k: float, start: float) -> tuple[float, ...]:
    """log of the integral of exp(b l - k l^2 / 2) over t >= start with l = ln(t / start), the means of l and -l^2 / 2 there, and their
    variances and covariance; Gauss panels over where the integrand is above exp(-45) of its top."""
    beta = b + 1
    if k > 0 and beta > 0:
        low, high = max(0.0, beta / k - math.sqrt(90 / k)), beta / k + math.sqrt(90 / k)
    else:
        low, high = 0.0, 90 / (math.sqrt(beta * beta + 90 * k) - beta)
    x, w = np.polynomial.legendre.leggauss(16)
    width = (high - low) / 64
    l = (low + (np.arange(64)[:, None] + (x[None, :] + 1) / 2) * width).ravel()
    e = beta * l - k * l * l / 2
    mass = np.exp(e - e.max()) * np.tile(w / 2 * width, 64)
    z = mass.sum()
    f = np.stack([l, -l * l / 2])
    m = f @ mass / z
    c = ((f - m[:, None]) * mass) @ (f - m[:, None]).T / z
    return (math.log(z) + e.max() + math.log(start), m[0], m[1], c[0, 0], c[0, 1], c[1, 1])


def lognormal_step(b: float, k: float, g1: float, g2: float, a11: float, a12: float, a22: float, damping: float) -> tuple[float, float]:
    """The next point: top of the damped quadratic within k >= 0; on that bound b stays below -1."""
    a11, a22 = a11 * (1 + damping) + 1e-15, a22 * (1 + damping) + 1e-15
    det = a11 * a22 - a12 * a12
    db, dk = ((a22 * g1 - a12 * g2) / det, (a11 * g2 - a12 * g1) / det) if det > 0 else (g1 / a11, g2 / a22)
    if k + dk <= 0:
        db, dk = (g1 + a12 * k) / a11, -k
        return min(b + db, (b - 1.0) / 2 if b < -1 else -1.001), 0.0
    return b + db, k + dk


@F.pandas_udf(_doubles("norm", "m1", "m2", "c11", "c12", "c22"))
def _lognormal_sums(b: pd.Series, k: pd.Series, start: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lognormal_sums(*map(float, r)) for r in zip(b, k, start)], columns=["norm", "m1", "m2", "c11", "c12", "c22"], dtype="float64")


@F.pandas_udf(_doubles("b", "k"))
def _lognormal_step(b: pd.Series, k: pd.Series, g1: pd.Series, g2: pd.Series, a11: pd.Series, a12: pd.Series, a22: pd.Series, damping: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([lognormal_step(*map(float, r)) for r in zip(b, k, g1, g2, a11, a12, a22, damping)], columns=["b", "k"], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _chi1_tail(x: pd.Series) -> pd.Series:
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2))).astype("float64")


def _lognormal_mass(value: Column, b: Column, k: Column, start: Column) -> tuple[Column, list[Column]]:
    """log of the integral of exp(b l - k l^2 / 2), l = ln(t / start), over [value - 1/2, value + 1/2] (Simpson, four panels), and the
    means over it of l, -l^2 / 2 and of their squares and product."""
    weigh = lambda l: b * l - k * l * l / 2
    centre = weigh(F.ln(value / start))
    total, sums = F.lit(0.0), [F.lit(0.0)] * 5
    for step, weight in zip((-0.5, -0.25, 0.0, 0.25, 0.5), (1, 4, 2, 4, 1)):
        l = F.ln((value + F.lit(step)) / start)
        q = -l * l / 2
        w = F.lit(weight / 12) * F.exp(weigh(l) - centre)
        total, sums = total + w, [s + w * p for s, p in zip(sums, (l, q, l * l, l * q, q * q))]
    return centre + F.ln(total), [s / total for s in sums]


def _lognormal_at(tail: DataFrame, by: list[str], points: DataFrame) -> DataFrame:
    """(by, xmin, b, k, norm, like, g1, g2, a11, a12, a22): mean log-likelihood at one point (by, xmin, b, k) per data set, its
    gradient and its negative second derivatives; one aggregation of the histogram."""
    log_mass, m = _lognormal_mass(F.col("value"), F.col("b"), F.col("k"), F.col("xmin") - 0.5)
    rows = tail.join(hint_small(points), by).select(*by, "xmin", "b", "k", "n", log_mass.alias("_l"), *[c.alias(f"_m{i}") for i, c in enumerate(m)])
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    x, y = F.col("_m0"), F.col("_m1")
    sums = rows.groupBy(*by, "xmin", "b", "k").agg(
        mean(F.col("_l")).alias("l"), mean(x).alias("x"), mean(y).alias("y"),
        mean(F.col("_m2") - x * x).alias("v11"), mean(F.col("_m3") - x * y).alias("v12"), mean(F.col("_m4") - y * y).alias("v22"),
    ).withColumn("z", _lognormal_sums("b", "k", F.col("xmin") - 0.5))
    return sums.select(
        *by, "xmin", "b", "k", "z.norm", (F.col("l") - F.col("z.norm")).alias("like"), (F.col("x") - F.col("z.m1")).alias("g1"), (F.col("y") - F.col("z.m2")).alias("g2"),
        (F.col("z.c11") - F.col("v11")).alias("a11"), (F.col("z.c12") - F.col("v12")).alias("a12"), (F.col("z.c22") - F.col("v22")).alias("a22"),
    )


def lognormal_fit(tail: DataFrame, by: list[str], start: DataFrame) -> DataFrame:
    """(by, b, k, norm, gradient): the likeliest lognormal tail of (by, value, n), from one point (by, xmin, b, k) per data set.

    Its density is exp(b l - k l^2 / 2 - norm) with l = ln(t / (xmin - 1/2)): k is 1 / variance of the logs, and k = 0 the power law with
    exponent -b, the bound that power laws run into. Damped Newton steps of all data sets at once, an aggregation a step: one that
    gains is taken and the damping lowered, another one is dropped and the damping raised. It ends when no gradient per
    observation is above ``GRADIENT``, but for k at its bound when it would leave it; not getting there is an error.
    """
    names = ["b", "k", "norm", "like", "g1", "g2", "a11", "a12", "a22"]
    best = store(_lognormal_at(tail, by, start).withColumn("damping", F.lit(1e-4)))
    size = F.greatest(F.abs("g1"), F.when((F.col("k") <= 0) & (F.col("g2") <= 0), 0.0).otherwise(F.abs("g2")))
    for _ in range(MOST_STEPS):
        if best.filter(~(size < GRADIENT)).isEmpty():
            return best.select(*by, "b", "k", "norm", size.alias("gradient"))
        trial = best.withColumn("t", _lognormal_step("b", "k", "g1", "g2", "a11", "a12", "a22", "damping")).select(*by, "xmin", "t.b", "t.k")
        got = _lognormal_at(tail, by, settle(trial)).select(*by, F.struct(*names).alias("_new"))
        gains = F.col("_new.like") >= F.col("like") - 1e-13 * F.abs("like")
        taken = [F.when(gains, F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) for c in names]
        best = store(best.join(got, by).select(*by, "xmin", *taken, F.when(gains, F.col("damping") / 10).otherwise(F.greatest(F.lit(1e-6), F.col("damping")) * 10).alias("damping")))
    worst = best.select(F.max(size)).first()[0]
    raise RuntimeError(f"no maximum after {MOST_STEPS} steps; largest gradient {worst}")


ALTERNATIVES = ("exponential", "lognormal", "truncated_power_law")


def likelihood_ratios(hist: DataFrame, fits: DataFrame, by: list[str], alternatives: tuple[str, ...] = ALTERNATIVES) -> DataFrame:
    """(by, alternative, ratio, p_value): normalized log-likelihood ratio of the power law over the alternatives.

    Positive favours the power law. The truncated power law contains it, so its p is the chi-square tail of twice the raw
    ratio; the others use the normal tail of the normalized ratio. The exponential has a closed form, the truncated power law is fitted
    from two means of a data set, the lognormal by Newton steps over the histogram; all to a gradient of ``GRADIENT``.
    A tail of fewer than three distinct values has no likeliest lognormal: ratio and p are null there.
    """
    params = settle(fits.select(*by, "xmin", "alpha", "n_tail"))
    tail = settle(hist.join(hint_small(params), by).filter("value >= xmin").select(*by, "value", "n", "xmin", "alpha"))
    mean = lambda c: F.sum(F.col("n") * c) / F.sum("n")
    moments = tail.groupBy(*by, "xmin", "alpha").agg(
        mean(F.col("value")).alias("mean"), mean(F.ln("value")).alias("mlog"), F.count(F.lit(1)).alias("distinct_values")
    )
    models = moments.withColumn("rate", F.ln(1 + 1 / F.greatest(F.lit(1e-9), F.col("mean") - F.col("xmin"))))
    log_mass = {"exponential": F.ln(1 - F.exp(-F.col("rate"))) - F.col("rate") * (F.col("value") - F.col("xmin"))}
    if "truncated_power_law" in alternatives:
        models = models.withColumn("cut", _truncated("mlog", F.col("mean") - F.col("xmin"), "xmin", "alpha"))
        log_mass["truncated_power_law"] = -F.col("cut.alpha") * F.ln("value") - F.col("cut.rate") * (F.col("value") - F.col("xmin")) - F.col("cut.norm")
    models = settle(models)
    if "lognormal" in alternatives:
        start = settle(models.filter("distinct_values >= 3").select(*by, "xmin", (-F.col("alpha")).alias("b"), F.lit(0.0).alias("k")))
        models = settle(models.join(lognormal_fit(tail.select(*by, "value", "n"), by, start), by, "left"))
        log_mass["lognormal"] = _lognormal_mass(F.col("value"), F.col("b"), F.col("k"), F.col("xmin") - 0.5)[0] - F.col("norm")
    rows = tail.join(hint_small(models.drop("xmin", "alpha")), by)
    power = -F.col("alpha") * F.ln("value") - F.ln(hurwitz_zeta(F.col("alpha"), F.col("xmin")))
    chosen = F.array(*[F.struct(F.lit(a).alias("alternative"), log_mass[a].alias("l")) for a in alternatives])
    gaps = rows.withColumn("_a", F.explode(chosen)).select(*by, "n", F.col("_a.alternative").alias("alternative"), (power - F.col("_a.l")).alias("_gap"))
    sums = gaps.groupBy(*by, "alternative").agg(
        F.sum("n").alias("k"), F.sum(F.col("n") * F.col("_gap")).alias("raw"), F.sum(F.col("n") * F.col("_gap") * F.col("_gap")).alias("square")
    )
    variance = F.greatest(F.lit(1e-300), F.col("square") / F.col("k") - F.pow(F.col("raw") / F.col("k"), 2))
    table = sums.withColumn("ratio", F.col("raw") / F.sqrt(F.col("k") * variance))
    statistic = F.when(F.col("alternative") == "truncated_power_law", 2 * F.abs("raw")).otherwise(F.pow("ratio", 2))
    return table.withColumn("p_value", _chi1_tail(statistic)).select(*by, "alternative", "ratio", "p_value")
