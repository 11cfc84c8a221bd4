"""Bootstrap draws are hashed by blocks inside the task of a simulation: the same numbers as a row per draw, without the rows."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fraygraph.functions import digests
from fraygraph.operators import tails
from fraygraph.operators.ranking import random_key, unit_uniform


def uniform(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 16**13


@pytest.mark.parametrize("digits, lanes, few", [(5, 50_000, 400), (2, 70, 0), (3, 5000, 10**9)])
def test_uniforms_of_series_are_md5(monkeypatch, digits, lanes, few):
    for name, value in (("BLOCK_DIGITS", digits), ("LANES", lanes), ("FEW", few)):
        monkeypatch.setattr(digests, name, value)
    series = [("41|part|a|1|12|", 1234), ("41|part|a|1|13|", 7), ("41|part|a|1|3|", 2555), ("", 11), ("é" * 27, 101), ("x" * 60, 460), ("y" * 200, 1)]
    got = np.concatenate(list(digests.uniforms([(start.encode(), n) for start, n in series])))
    assert sorted(got.tolist()) == sorted(uniform(f"{start}{i}") for start, n in series for i in range(n))


def test_uniforms_are_those_of_spark(spark):
    rows = spark.range(1200).select(unit_uniform(random_key(7, F.lit("part"), F.lit("d"), F.lit(3), "id")).alias("u"))
    assert sorted(r["u"] for r in rows.collect()) == sorted(np.concatenate(list(digests.uniforms([(b"7|part|d|3|", 1200)]))).tolist())


def test_samples_are_those_of_single_draws(spark, monkeypatch):
    kept = {}

    def settle(df):
        if "sim" in df.columns:
            kept["plan"], kept["samples"] = df._jdf.queryExecution().executedPlan().toString(), df.localCheckpoint()
            return kept["samples"]
        return df.localCheckpoint()

    monkeypatch.setattr(tails, "settle", settle)
    data = {"d": ((1, 1200), (2, 500), (3, 120), (5, 60), (9, 3), (30, 1)), "e": ((2, 300), (3, 30), (4, 9), (11, 2)), "one": ((4, 7),)}
    hist = spark.createDataFrame([(d, v, n) for d, rows in data.items() for v, n in rows], "d string, value long, n long")
    fits = tails.fit_power_law(hist, ["d"]).localCheckpoint()
    table = tails.bootstrap(hist, fits, ["d"], 4, 1).collect()
    assert {(r["d"], r["sims"]) for r in table} == {("d", 4), ("e", 4)}
    want = Counter()
    for fit in fits.collect():
        body = [v for v, n in data[fit["d"]] if v < fit["xmin"] for _ in range(n)]
        for sim in range(4):
            for v, n in data[fit["d"]]:
                for i in range(n):
                    w = uniform(f"1|draw|{fit['d']}|{sim}|{v}|{i}")
                    if uniform(f"1|part|{fit['d']}|{sim}|{v}|{i}") * fit["n"] < fit["n_tail"]:
                        drawn = int((fit["xmin"] - 0.5) * (1 - w) ** (-1 / (fit["alpha"] - 1)) + 0.5)
                    else:
                        drawn = body[min(int(w * len(body)), len(body) - 1)]
                    want[fit["d"], sim, drawn] += 1
    assert {(r["d"], r["sim"], r["value"]): r["n"] for r in kept["samples"].collect()} == dict(want)
    assert kept["plan"].count("Generate explode") == 1  # a row per value and simulation, none per draw
