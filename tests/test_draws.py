"""Draws by keyed permutations: one to one for every size, even over vertices, as many rows as asked for."""

import pytest
from pyspark.sql import functions as F

from fraygraph.operators import knockout as K, ranking


@pytest.mark.parametrize("total", [1, 2, 3, 7, 16, 17, 50, 101])
def test_every_permutation_is_one_to_one(spark, total):
    rows = spark.range(total).select(F.col("id").alias("place"), F.explode(F.array(F.lit("x"), F.lit("y"))).alias("key"))
    images = ranking.permuted(rows, "place", total, 3, "key").collect()
    for key in "xy":
        assert sorted(r.place for r in images if r.key == key) == list(range(total))


def test_draws_are_even_and_differ(spark):
    n, draws = 60, 400
    vertices = spark.createDataFrame([(f"v{i:03d}",) for i in range(n)], "v string")
    table = K.same_size_draws(vertices, spark.createDataFrame([(6,), (6,), (0,), (None,), (90,)], "size int"), draws, 5, n)
    assert table.count() == draws * (6 + n) and table.distinct().count() == table.count()
    six = table.filter("size = 6")
    counts = [r["count"] for r in six.groupBy("v").count().collect()]
    expected = draws * 6 / n
    assert len(counts) == n and sum((c - expected) ** 2 / expected for c in counts) < 105  # chi-square, 59 degrees, p 0.0002
    pairs = six.alias("a").join(six.alias("b"), ["size", "draw"]).filter("a.v < b.v").groupBy("a.v", "b.v").count()
    assert pairs.count() > 0.93 * n * (n - 1) / 2  # 6,000 pairs fall on 1,770 kinds: about 97 % occur
    assert six.groupBy("draw").agg(F.sort_array(F.collect_list("v")).alias("set")).select("set").distinct().count() == draws


def test_no_vertices_no_draws(spark):
    none = spark.createDataFrame([], "v string")
    assert K.same_size_draws(none, [3], 5, 1, 0).count() == 0
