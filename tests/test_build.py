import pytest
from pyspark.sql import functions as F

from fraygraph.functions import scalars, special
from fraygraph.operators import curves, graph_build as B, nulls, profile, ranking, stats, tails

CONNECTIONS = [(1, 3, 5), (1, 4, 2), (2, 3, 7), (3, 5, 4), (4, 5, 6), (5, 1, 3), (1, 2, 9)]
LABELS = [(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "C")]


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def connections(spark):
    return spark.createDataFrame(CONNECTIONS, "pre long, post long, weight long")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "entity long, label string")


def test_edges_by_label(connections, labels):
    edges = B.aggregate_edges(B.label_connections(connections, labels))
    assert found(edges) == [("A", "A", 9, 1), ("A", "B", 14, 3), ("B", "C", 10, 2), ("C", "A", 3, 1)]
    first, second = connections.filter("weight <= 5"), connections.filter("weight > 5")
    parts = [B.aggregate_edges(B.label_connections(c, labels)) for c in (first, second)]
    assert found(B.merge_edges(*parts)) == found(edges)


def test_unlabelled_end_is_an_error(spark, connections, labels):
    bad = connections.unionByName(spark.createDataFrame([(1, 99, 1)], connections.schema))
    assert found(B.unlabelled_ends(bad, labels)) == [(99,)]
    with pytest.raises(Exception, match="without a label"):
        B.require_labelled(B.label_connections(bad, labels)).collect()


def test_share_denominator_keeps_self_loops(connections, labels):
    edges = B.aggregate_edges(B.label_connections(connections, labels))
    assert found(B.threshold_edges(edges, 0.3).select("src", "dst", "weight")) == [("A", "B", 14), ("B", "C", 10)]
    assert ("C", "A", 3, 0.25) in found(B.threshold_edges(edges, 0.25))


def test_sides_suffixes_and_names(spark):
    soma = ["L", "R", "M", None, None, None, "L"]
    root = [None, None, None, "R", "unknown", None, "R"]
    rows = spark.createDataFrame([(i, s, r) for i, (s, r) in enumerate(zip(soma, root))], "i int, a string, b string")
    got = [r[0] for r in rows.orderBy("i").select(B.first_known_side("a", "b")).collect()]
    assert got == ["L", "R", "M", "R", "unknown", "unknown", "L"]
    names = spark.createDataFrame([("x_L",), ("x_R",), ("x_M",), ("x",), (None,)], "n string")
    assert [r[0] for r in names.select(B.suffix_class("n")).collect()] == ["L", "R", "M", "other", "none"]
    assert found(spark.createDataFrame([("a|b|L",)], "v string").select(*B.split_composite("v"))) == [("a|b", "L")]


def test_majority_null_rules(spark):
    rows = spark.createDataFrame([("A", "x"), ("A", "y"), ("B", None), ("B", None), ("B", "z"), ("C", None)], "k string, c string")
    assert found(B.majority(rows, "k", "c").select("k", "c")) == [("A", "x"), ("B", "z"), ("C", "unannotated")]
    assert found(B.majority(rows, "k", "c", null_competes=True).select("k", "c")) == [("A", "x"), ("B", "unannotated"), ("C", "unannotated")]


def test_anchor_ties_and_empty(spark):
    rows = [("A", "AL", 5, 5), ("A", "LH", 1, 2), ("B", "b", 2, 0), ("B", "a", 1, 1), ("C", "z", 0, 0)]
    counts = spark.createDataFrame(rows, "label string, region string, pre long, post long")
    assert found(profile.anchor_regions(counts)) == [("A", "AL"), ("B", "a")]


def sizes_of(*args):
    return [last - first + 1 for first, last in ranking.removal_steps(*args)]


def test_schedule():
    sizes = sizes_of(1000)
    left = 1000
    for size in sizes:
        assert size == -(-left // 100)
        left -= size
    assert 1000 - left >= 500 > 1000 - left - sizes[-1]
    assert sizes_of(3, 0.01, 1.0) == [1, 1, 1] and sizes_of(10, 0.5, 1.0) == [5, 3, 1, 1] and sizes_of(0) == []


SCORES = {
    "double": "CASE WHEN id % 3 = 0 THEN 7.0D WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN double('NaN') ELSE double(id * 37 % 501) END",
    "long": "CASE WHEN id % 7 = 0 THEN NULL ELSE 9007199254740992 + id % 40 END",
    "decimal": "CAST(id * 37 % 501 AS decimal(38, 0)) * 10000000000000000000000 + id % 3",
    "string": "CASE WHEN id % 5 = 0 THEN NULL ELSE concat('n', id * 37 % 301) END",
}


@pytest.mark.parametrize("kind", SCORES)
@pytest.mark.parametrize("descending", [True, False])
def test_ranges_number_like_one_window(spark, kind, descending):
    """Null and repeated scores, null keys, a group with most rows: ranges give the numbers of a plain window."""
    rows = spark.range(1500).selectExpr("CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 < 9 THEN 'hot' ELSE 'g' END AS g", f"{SCORES[kind]} AS x", "id AS v")
    rows = rows.withColumn("tie", ranking.random_key(1, "v"))
    plain = ranking.exact_rank(rows, ["g"], "x", "tie", descending=descending, group_rows=1500)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        large = ranking.exact_rank(rows.repartition(3), ["g"], "x", "tie", descending=descending)
        assert large.columns == plain.columns and sorted(map(str, large.collect())) == sorted(map(str, plain.collect()))
        assert sorted(map(str, ranking.number_within(rows, ["g"], ["x", "v"]).collect())) == sorted(map(str, ranking.number_within(rows, ["g"], ["x", "v"], group_rows=1500).collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rewiring_does_not_depend_on_the_numbering(spark, monkeypatch):
    from brute import random_digraph

    edges = spark.createDataFrame(random_digraph(30, 150, 3), "src string, dst string, weight long")
    plain = found(nulls.rewire(edges, 1, 5, swaps_per_edge=1))
    monkeypatch.setattr(ranking, "ONE_TASK_ROWS", 0)
    assert found(nulls.rewire(edges, 1, 5, swaps_per_edge=1)) == plain


def test_null_scores_have_no_rank(spark):
    rows = spark.createDataFrame([(i, None if i < 20 else i) for i in range(100)], "i int, x int")
    table = {r["i"]: r for r in ranking.competition_rank(ranking.with_percentile(rows, "x", "p"), "x").collect()}
    assert len(table) == 100 and table[3]["p"] is None and table[3]["rank"] is None
    assert table[20]["p"] == 0.625 and table[99]["rank"] == 1 and table[20]["rank"] == 80
    pairs = spark.createDataFrame([("k", 1.0, 1.0), ("k", 2.0, 2.0), ("k", 3.0, 9.0), ("k", 0.5, None), ("k", None, 1.5)], "k string, x double, y double")
    assert stats.spearman(pairs, ["k"], "x", "y").first()["rho"] == pytest.approx(1.0)
    scores = spark.createDataFrame([("t", float(x), x > 3) for x in range(1, 6)] + [("t", None, True), ("t", 9.0, None)], "k string, x double, m boolean")
    assert stats.mann_whitney(scores, ["k"], "x", "m").first()["u"] == 6.0


def test_quantiles_of_histograms(spark):
    import numpy as np

    values = [3, 1, 1, 7, 7, 7, 20, 4]
    rows = spark.createDataFrame([("a", v) for v in values] + [("b", 5)], "k string, v int")
    shares = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["quantiles"] for r in curves.quantiles(rows, ["k"], "v", shares).collect()}
    assert got["a"] == pytest.approx(np.quantile(values, shares).tolist()) and got["b"] == [5.0] * 6
    codes = {r["v"]: r["c"] for r in scalars.dictionary(rows, "v", "c").collect()}
    assert codes == {v: i for i, v in enumerate(sorted(set(values) | {5}))}


def test_name_search_trims_and_ignores_blank_texts(spark):
    names = spark.createDataFrame([("abc",), ("cab",), ("b",), ("Bd",)], "name string")
    assert [r["name"] for r in scalars.name_search(names, "name", " b ").collect()] == ["b", "Bd", "abc", "cab"]
    assert scalars.name_search(names, "name", "  ").count() == 0


def test_percentiles(spark):
    rows = spark.createDataFrame([(0, 10, 5), (1, 40, 5), (2, 20, 1), (3, 30, 9)], "i int, a int, b int")
    table = ranking.with_percentile(ranking.with_percentile(rows, "a", "pa"), "b", "pb").orderBy("i").collect()
    assert [r["pa"] for r in table] == [12.5, 87.5, 37.5, 62.5]
    assert [r["pb"] for r in table] == [50, 50, 12.5, 87.5]


def test_curve_algebra(spark):
    rows = [("a", b, x, y) for b, (x, y) in enumerate([(0.0, 10), (0.2, 8), (0.4, 4), (0.6, 0)])] + [("flat", 0, 0.0, 4), ("flat", 1, 0.6, 4)]
    table = spark.createDataFrame(rows, "run string, batch int, x double, y long")
    hit = {r["run"]: r for r in curves.critical_fractions(table, ["run"], "x", "y").collect()}
    assert hit["a"]["f_c"] == pytest.approx(0.35) and hit["a"]["f_c_batch"] == 0.4 and hit["flat"]["f_c"] is None
    with pytest.raises(Exception, match="never falls"):
        curves.critical_fractions(table, ["run"], "x", "y", strict=True).collect()
    area = dict(found(curves.normalized_auc(curves.auc_window(table, ["run"], "x"), ["run"], "x", {"y": "auc"})))
    assert area["flat"] == pytest.approx(1) and area["a"] == pytest.approx((9 + 6 + 2) * 0.2 / 10 / 0.6)
    with pytest.raises(Exception, match="stops before"):
        curves.auc_window(table.filter("batch < 2 and run = 'a'"), ["run"], "x", strict=True).collect()
    points = spark.createDataFrame([("a", 0.1), ("a", 0.9), ("a", -1.0)], "run string, at double")
    assert dict((r["at"], r["value"]) for r in curves.value_at(table, points, ["run"], "x", "y").collect()) == {0.1: 9.0, 0.9: 0.0, -1.0: 10.0}


def test_ccdf_and_p_values(spark):
    values = spark.createDataFrame([("d", v) for v in (0, 1, 1, 2, 3, 5, 8, 13, 100)], "d string, v long")
    p = {r["v"]: r["p"] for r in curves.ccdf(values, ["d"], "v").collect()}
    assert (p[2], p[5], p[100]) == (6 / 8, 4 / 8, 1 / 8)
    nulls_table = spark.createDataFrame([("g", x) for x in (0.1, 0.2, 0.3, 0.4)], "g string, x double")
    for observed, expected in ((0.5, 1 / 5), (0.25, 3 / 5), (0.0, 1.0)):
        seen = spark.createDataFrame([("g", observed)], "g string, x double")
        assert curves.upper_p(seen, nulls_table, ["g"], "x").first()["p_value"] == expected


def test_rank_tests_match_known_values(spark):
    pairs = spark.createDataFrame([("t", float(x), 0.0) for x in (1, 2, 3, 4, 5, -6, 0)], "k string, x double, y double")
    row = stats.signed_rank(pairs, ["k"], "x", "y").first()
    assert (row["pairs_differing"], row["w"]) == (6, 15.0) and row["z"] == pytest.approx(4.5 / (22.75**0.5))
    scores = spark.createDataFrame([("t", float(x), x > 3) for x in range(1, 6)], "k string, x double, m boolean")
    assert stats.mann_whitney(scores, ["k"], "x", "m").first()["u"] == 6.0
    assert special.t_inverse(0.975, 29) == pytest.approx(2.045229642, abs=1e-8)
    assert special.log10_normal_upper(5.0) == pytest.approx(-6.5426, abs=1e-3)
    assert special.log10_normal_upper(60.0) == pytest.approx(-783.9, abs=0.3)


def test_zeta_and_power_law_recovery(spark):
    one = spark.range(1).select(tails.hurwitz_zeta(F.lit(2.0), F.lit(1.0)).alias("z")).first()["z"]
    assert one == pytest.approx(1.6449340668, abs=1e-9)
    draws = spark.range(20000).withColumn("u", ranking.unit_uniform(ranking.random_key(5, "id")))
    draws = draws.select(F.lit("d").alias("d"), F.floor(4.5 * F.pow(1 - F.col("u"), -1 / 1.5) + 0.5).alias("v"))
    hist = tails.value_histogram(draws, ["d"], "v")
    fit = tails.fit_power_law(hist, ["d"]).first()
    assert fit["alpha"] == pytest.approx(2.5, abs=0.1) and fit["xmin"] <= 12


def test_rewiring_keeps_degrees(spark):
    from brute import random_digraph

    edges = spark.createDataFrame(random_digraph(60, 500, 3), "src string, dst string, weight long")
    got = nulls.rewire(edges, 2, 5, swaps_per_edge=4)
    again = nulls.rewire(edges, 2, 5, swaps_per_edge=4)
    assert found(got) == found(again)
    before = found(edges)
    for g in (0, 1):
        after = [(a, b, w) for x, a, b, w in found(got) if x == g]
        assert len({(a, b) for a, b, _ in after}) == len(after) == 500 and all(a != b for a, b, _ in after)
        for end in (0, 1):
            assert sorted(r[end] for r in after) == sorted(r[end] for r in before)
        assert sorted((a, w) for a, _, w in after) == sorted((a, w) for a, _, w in before)
        assert len({(a, b) for a, b, _ in after} & {(a, b) for a, b, _ in before}) < 150


def test_rounding(spark):
    row = spark.range(1).select(scalars.significant(F.lit(0.00123456), 3).alias("a"), scalars.rounded(F.lit(float("nan")), 2).alias("b")).first()
    assert row["a"] == pytest.approx(0.00123) and row["b"] is None


def test_favoured_models(spark):
    rows = spark.createDataFrame([(-2.0, 0.01), (2.0, 0.01), (2.0, 0.5), (0.0, 0.0)], "r double, p double")
    got = [r["f"] for r in rows.select(scalars.favoured(F.col("r"), F.col("p")).alias("f")).collect()]
    assert got == ["alternative", "power_law", "undecided", "undecided"]
