"""Order-dependent operators that never need a whole group in one task.

``number_within`` and ``exact_rank`` number the rows of an order, ``value_ranks`` gives competition, average and percentile
ranks through the histogram of distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.session import store

# Rows of a group that one task may order; a larger group, or one of unknown size, is dealt to ranges.
ONE_TASK_ROWS = 200_000


def random_key(seed, *parts) -> Column:
    """md5 of seed and parts: a random order that no partitioning changes and that SQL can repeat."""
    columns = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    columns += [F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]
    return F.md5(F.concat_ws("|", *columns))


def unit_uniform(key: Column) -> Column:
    """Uniform in [0, 1) from the first 13 hex digits of an md5 key (52 bits, exact in a double)."""
    return F.conv(F.substring(key, 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


# Rounds of a keyed permutation; each moves one digit by a hash of the other.
PERMUTATION_ROUNDS = 6


def permuted(df: DataFrame, index: str, total: int, seed, *parts: str) -> DataFrame:
    """``df`` with ``index`` (0 .. total - 1) replaced by its image under a random permutation keyed by ``seed`` and ``parts``.

    A number is read as two digits in bases a and b, a * b just above ``total``. Every round adds a hash of one digit to the
    other, which can be undone, so the whole is one to one; images beyond ``total`` are permuted again, and as few numbers
    lie there (fewer than a of about a * a), few rows go round again. No row is made for an image that nobody asks for.
    """
    a = math.isqrt(max(0, total - 1)) + 1
    b = -(-total // a)

    def hashed(round_: int, digit: str) -> Column:
        return F.conv(F.substring(random_key(seed, *parts, F.lit(round_), digit), 1, 13), 16, 10).cast("long")

    def turn(rows: DataFrame) -> DataFrame:
        rows = rows.withColumns({"_left": F.floor(F.col(index) / b).cast("long"), "_right": F.pmod(F.col(index), F.lit(b)).cast("long")})
        for k in range(PERMUTATION_ROUNDS):
            own, other, base = ("_right", "_left", b) if k % 2 else ("_left", "_right", a)
            rows = rows.withColumn(own, F.pmod(F.col(own) + hashed(k, other), F.lit(base)))
        return rows.withColumn(index, F.col("_left") * b + F.col("_right")).drop("_left", "_right")

    placed = store(turn(df.withColumn(index, F.col(index).cast("long"))))
    while not placed.filter(F.col(index) >= total).isEmpty():
        placed = store(placed.filter(F.col(index) < total).unionByName(turn(placed.filter(F.col(index) >= total))))
    return placed


def number_ordered(df: DataFrame, keys: list[str], order: list[Column], name: str, group_rows: int | None = None) -> DataFrame:
    """Number the rows of each key group 1..size in ``order``; equal to one window over the group, for groups of any size.

    Rows are dealt to ranges of (keys, order) by Spark's sampled range exchange, which takes every type as it is and nulls as
    a value, so a group is spread over as many tasks as it fills. A number is the row number inside the range plus the rows
    of the same group in earlier ranges. The ranges are stored before they are counted, so both readings see the same ones.

    ``group_rows`` is a proven bound on the group size; up to ``ONE_TASK_ROWS`` a window gives the same numbers at once.
    """
    if group_rows is not None and group_rows <= ONE_TASK_ROWS:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    ranged = store(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key{i}" for i in range(len(keys))]
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_range").alias("_of"), "_before"
    )
    same = F.col("_range") == F.col("_of")
    for key, other in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(other))
    inside = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    numbered = ranged.withColumn("_inside", inside).join(offsets, same)
    return numbered.withColumn(name, (F.col("_inside") + F.col("_before")).cast("int")).select(*df.columns, name)


def number_within(df: DataFrame, keys: list[str], order: list[str], name: str = "n", group_rows: int | None = None) -> DataFrame:
    """Number the rows of each key group 1..size in ascending ``order``, nulls first."""
    return number_ordered(df, keys, [F.col(c).asc() for c in order], name, group_rows)


def exact_rank(
    df: DataFrame, keys: list[str], score: str, tie: str, name: str = "rank", descending: bool = True, group_rows: int | None = None
) -> DataFrame:
    """Rank 1..size by score, null scores last, equal scores by ``tie`` ascending."""
    by = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    return number_ordered(df, keys, [by, F.col(tie).asc()], name, group_rows)


def top_k(df: DataFrame, keys: list[str], score: str, tie: str, k: int, name: str = "rank", descending: bool = True, salts: int = 16) -> DataFrame:
    """The first ``k`` rows of each key group as ``exact_rank`` numbers them, without ordering the rest.

    Groups are cut by a hash of ``tie``. A task keeps the k first rows of each cut before anything is shuffled, the cuts keep
    k rows each, and only those meet: a hot group costs a task k rows a cut, whatever its size.
    """
    by = F.col(score).desc_nulls_last() if descending else F.col(score).asc_nulls_last()
    salt = next(n for n in (f"{'_' * i}salt" for i in range(1, len(df.columns) + 2)) if n not in df.columns)
    cut = df.withColumn(salt, F.pmod(F.xxhash64(tie), F.lit(salts)))
    for part in ([*keys, salt], keys):
        window = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(by, F.col(tie).asc())
        cut = cut.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return cut.drop(salt)


def value_ranks(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """(keys, score, ties, below, total) per distinct score that is not null: the histogram with cumulative counts.

    Equal values are counted before the shuffle. The histogram is dealt to ranges of (keys, score); running sums are taken
    inside a range and moved by the counts of the ranges before, so no group of distinct values is ordered in one task.
    """
    histogram = df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count(F.lit(1)).alias("ties"))
    ranged = store(histogram.repartitionByRange(*keys, score).withColumn("_range", F.spark_partition_id()))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))  # a row per range
    earlier = part.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_key{i}" for i in range(len(keys))]
    offsets = ranged.groupBy(*keys, "_range").agg(F.sum("ties").alias("_rows")).select(
        *[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_range").alias("_of"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"), F.sum("_rows").over(part).alias("total"),
    )
    lower = Window.partitionBy(*keys, "_range").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_range") == F.col("_of")
    for key, other in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(other))
    inside = ranged.withColumn("_in", F.coalesce(F.sum("ties").over(lower), F.lit(0)))
    return inside.join(offsets, same).select(*keys, score, "ties", (F.col("_in") + F.col("_before")).alias("below"), "total")


def average_rank() -> Column:
    return F.col("below") + (F.col("ties") + 1) / 2


def mid_rank_percentile() -> Column:
    """100 * (average rank - 0.5) / n over the columns of ``value_ranks``."""
    return F.lit(100.0) * (average_rank() - F.lit(0.5)) / F.col("total")


def join_ranks(df: DataFrame, ranks: DataFrame, keys: list[str], score: str) -> DataFrame:
    """``df`` with the other columns of ``ranks`` by keys and score; null where the score is null."""
    names = [f"_key{i}" for i in range(len(keys))]
    renamed = ranks.withColumnsRenamed({**dict(zip(keys, names)), score: "_score"})
    same = F.col(score) == F.col("_score")
    for key, other in zip(keys, names):
        same = same & F.col(key).eqNullSafe(F.col(other))
    return df.join(renamed, same, "left").drop(*names, "_score")


def with_percentile(df: DataFrame, score: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Adds the mid-rank percentile among the rows with a score; null where the score is null."""
    keys = keys or []
    return join_ranks(df, value_ranks(df, keys, score).select(*keys, score, mid_rank_percentile().alias(name)), keys, score)


def competition_rank(df: DataFrame, score: str, keys: list[str] | None = None) -> DataFrame:
    """Adds ``rank`` (1 + rows with a higher score) and ``ties`` (rows with the same score); both null where the score is."""
    keys = keys or []
    rank = F.col("total") - F.col("below") - F.col("ties") + 1
    return join_ranks(df, value_ranks(df, keys, score).select(*keys, score, rank.alias("rank"), "ties"), keys, score)


def removal_steps(n: int, batch_fraction: float = 0.01, max_fraction: float = 0.5) -> Iterator[tuple[int, int]]:
    """(first, last) rank of every batch: 1 % of what is left, rounded up, as long as less than ``max_fraction`` is gone."""
    last = 0
    while last < min(n, max_fraction * n):
        first, last = last + 1, last + math.ceil(batch_fraction * (n - last))
        yield first, last


def schedule_table(spark, n: int, batch_fraction: float = 0.01, max_fraction: float = 0.5) -> DataFrame:
    """(batch, size, first_rank, last_rank, fraction_removed); batch 0 is the intact graph. A few hundred rows."""
    steps = enumerate(removal_steps(n, batch_fraction, max_fraction), start=1)
    rows = [(0, 0, 0, 0, 0.0), *((batch, last - first + 1, first, last, last / n) for batch, (first, last) in steps)]
    return spark.createDataFrame(rows, "batch int, size int, first_rank int, last_rank int, fraction_removed double")


def batch_of_rank(ranked: DataFrame, schedule: DataFrame, rank: str = "rank") -> DataFrame:
    """Rank -> batch by the schedule; ranks beyond it are dropped (never removed).

    The schedule grows with log(n), so it travels as one array column of last ranks.
    """
    limits = [r["last_rank"] for r in schedule.filter("batch > 0").orderBy("batch").select("last_rank").collect()]
    bounds = F.array(*[F.lit(x) for x in limits])
    batch = F.size(F.filter(bounds, lambda b: b < F.col(rank))) + 1
    return ranked.filter(F.col(rank) <= limits[-1]).withColumn("batch", batch.cast("int"))
