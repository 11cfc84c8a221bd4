"""Graphs without any flow: what would be divided by it is NaN, as SQL has it, and never an error."""

import math

import pytest

from fraygraph.operators import curves, knockout as K, stats


def nan(value):
    return value is not None and math.isnan(value)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [(r, b, b * 0.25, y) for r, ys in (("none", (0, 0, 0)), ("some", (4, 2, 0))) for b, y in enumerate(ys)]
    return spark.createDataFrame(rows, "run string, batch int, x double, y long")


def test_areas_and_resampled_curves(spark, runs):
    area = dict(tuple(r) for r in curves.normalized_auc(runs, ["run"], "x", {"y": "auc"}).collect())
    assert nan(area["none"]) and area["some"] == pytest.approx(0.5)
    with pytest.raises(Exception, match="missing or negative"):
        curves.normalized_auc(runs.filter("batch > 0"), ["run"], "x", {"y": "auc"}).collect()
    points = runs.filter("batch = 1").selectExpr("run", "x AS at")
    values = {r["run"]: r["value"] for r in curves.resample(runs, points, ["run"], "x", "y", "y").collect()}
    assert nan(values["none"]) and values["some"] == 0.5


def test_intervals_and_nulls(spark):
    areas = spark.createDataFrame([("a", float("nan")), ("a", float("nan"))], "s string, y double")
    row = curves.mean_ci(areas, [], "y").first()
    assert row["n"] == 2 and all(nan(row[c]) for c in ("mean", "sd", "low", "high"))
    row = curves.null_summary(areas.limit(1), areas, ["s"], "y", 0.05).first()
    assert (row["at_or_below"], row["n"], row["p_value"], row["significant"]) == (2, 2, 1.0, False) and nan(row["z"])


def test_group_impact(spark, toy):
    graph = toy(["s1>a", "b>m1"], ["s1"], ["m1"])
    groups = spark.createDataFrame([("left", "a"), ("right", "b")], "group string, v string")
    for layered in (True, False):
        rows = K.group_impact(graph, groups, 4, 2, layered=layered).collect()
        assert len(rows) == 2 and all(r["flow_after"] == 0 and r["p_value"] == 1.0 and nan(r["flow_drop"]) and nan(r["excess"]) for r in rows)


def test_comparisons_of_constants(spark):
    rows = spark.createDataFrame([(g, i, 0.0) for g in "ab" for i in range(3)], "g string, i int, y double")
    row = stats.welch(rows, [], "g", "a", "b", "y").first()
    assert nan(row["t"]) and nan(row["df"])
    row = stats.spearman(rows, [], "i", "y").first()
    assert nan(row["rho"]) and row["p_value"] is None
    row = stats.spearman(rows.filter("g = 'a'").selectExpr("i", "3 * i + 1 AS y"), [], "i", "y").first()
    assert row["rho"] == pytest.approx(1)
