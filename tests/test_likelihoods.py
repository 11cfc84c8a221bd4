"""Maximum likelihood of heavy tails: gradients, bounds and known parameters."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from fraygraph.operators import tails
from fraygraph.session import settle


def cut_likelihood(alpha, rate, mean_log, mean_excess, start):
    k = np.arange(start, start + 200_000, dtype=float)
    return -alpha * mean_log - rate * mean_excess - math.log(np.sum(k**-alpha * np.exp(-rate * (k - start))))


@pytest.mark.parametrize("alpha,rate,start", [(1.5, 0.02, 1), (2.2, 0.1, 3), (3.0, 0.005, 10)])
def test_truncated_power_law_finds_its_parameters(alpha, rate, start):
    k = np.arange(start, start + 200_000, dtype=float)
    p = k**-alpha * np.exp(-rate * (k - start))
    p /= p.sum()
    a, r, norm = tails.truncated_fit(float(p @ np.log(k)), float(p @ (k - start)), start, 2.0)
    assert (a, r) == pytest.approx((alpha, rate), rel=1e-4)
    assert norm == pytest.approx(math.log(np.sum(k**-alpha * np.exp(-rate * (k - start)))), abs=1e-6)


def test_truncated_power_law_beats_its_neighbours():
    mean_log, mean_excess, start = 1.3, 6.0, 1
    a, r, _ = tails.truncated_fit(mean_log, mean_excess, start, 1.8)
    best = cut_likelihood(a, r, mean_log, mean_excess, start)
    assert all(cut_likelihood(max(1.0, a + x), r + y, mean_log, mean_excess, start) <= best + 1e-9 for x in (-0.01, 0, 0.01) for y in (-0.001, 0, 0.001))


@pytest.mark.parametrize("b,k,start", [(-2.5, 0.0, 1.5), (-2.0, 0.3, 0.5), (1.7, 1.0, 0.5), (-5.0, 2.0, 9.5)])
def test_lognormal_sums_equal_a_fine_grid(b, k, start):
    l = np.linspace(0, 60, 2_000_001)
    y = np.exp((b + 1) * l - k * l * l / 2)
    z = np.trapezoid(y, l)
    norm, m1, m2, c11, _, _ = tails.lognormal_sums(b, k, start)
    assert norm == pytest.approx(math.log(z * start), abs=1e-6)
    mean = np.trapezoid(l * y, l) / z
    assert (m1, m2) == pytest.approx((mean, -np.trapezoid(l * l * y, l) / z / 2), rel=1e-5)
    assert c11 == pytest.approx(np.trapezoid(l * l * y, l) / z - mean**2, rel=1e-4)


def test_ratios_of_two_data_sets(spark):
    rng = np.random.default_rng(1)
    normal = np.rint(np.exp(rng.normal(2, 1, 6000))).astype(int)
    rows = [("logn", int(v)) for v in normal if v > 0] + [("geom", int(v)) for v in rng.geometric(0.05, 5000)]
    hist = settle(tails.value_histogram(spark.createDataFrame(rows, "d string, v long"), ["d"], "v"))
    n = {r["d"]: r["k"] for r in hist.groupBy("d").agg(F.sum("n").alias("k")).collect()}
    fits = spark.createDataFrame([(d, 1, 1.6, k) for d, k in n.items()], "d string, xmin long, alpha double, n_tail long")
    start = settle(fits.select("d", "xmin", (-F.col("alpha")).alias("b"), F.lit(0.0).alias("k")))
    found = {r["d"]: r for r in tails.lognormal_fit(hist, ["d"], start).collect()}
    assert all(r["gradient"] < tails.GRADIENT for r in found.values())
    r = found["logn"]
    assert 1 / math.sqrt(r["k"]) == pytest.approx(1, abs=0.05) and math.log(0.5) + (r["b"] + 1) / r["k"] == pytest.approx(2, abs=0.05)
    got = {(r["d"], r["alternative"]): r["ratio"] for r in tails.likelihood_ratios(hist, fits, ["d"]).collect()}
    assert len(got) == 6 and got[("geom", "exponential")] < -10 and got[("logn", "lognormal")] < -10
    assert got[("logn", "lognormal")] < got[("logn", "exponential")]
