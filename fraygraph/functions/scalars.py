"""Column expressions used by reports and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraygraph.operators.ranking import value_ranks


def rounded(column: Column, digits: int) -> Column:
    """Value rounded half to even; NaN and null become null."""
    value = column.cast("double")
    return F.when(column.isNotNull() & ~F.isnan(value), F.rint(value * 10.0**digits) / 10.0**digits)


def ratio(above: Column, below: Column) -> Column:
    """Quotient as doubles divide: over 0, NaN for 0 and an infinity for any other value; null if one side is null."""
    a, b = above.cast("double"), below.cast("double")
    far = F.when((a == 0) | F.isnan(a), float("nan")).when(a > 0, float("inf")).when(a < 0, float("-inf"))
    return F.when(b == 0, far).otherwise(F.try_divide(a, b))


def significant(column: Column, digits: int) -> Column:
    """Value with ``digits`` significant figures."""
    value = column.cast("double")
    power = F.pow(F.lit(10.0), F.lit(digits) - F.floor(F.log10(F.abs(value))) - 1)
    return F.when(value == 0, F.lit(0.0)).when(value.isNotNull() & ~F.isnan(value), F.rint(value * power) / power)


def role_code(role: Column) -> Column:
    return F.when(role == "S", 1).when(role == "M", 2).otherwise(0)


def encode(df: DataFrame, column: str, code: str) -> DataFrame:
    """Dictionary code of a low-cardinality label column in label order, -1 for null; codes are ranked over distinct labels only."""
    words = dictionary(df, column, code)
    return df.join(words, column, "left").na.fill(-1, [code])


def dictionary(df: DataFrame, column: str, code: str) -> DataFrame:
    """(column, code): the number of distinct labels before each label."""
    words = df.select(column).filter(F.col(column).isNotNull()).distinct()
    return value_ranks(words, [], column).select(column, F.col("below").cast("int").alias(code))


def name_search(df: DataFrame, name: str, text: str, limit: int = 8) -> DataFrame:
    """Case-insensitive lookup of the trimmed text: names that start with it (short first), then names that contain it (early
    first). A blank text finds nothing."""
    wanted = text.strip().lower()
    at = F.instr(F.lower(name), F.lit(wanted)) if wanted else F.lit(0)
    group = F.when(at == 1, 0).otherwise(1)
    place = F.when(at == 1, F.length(name)).otherwise(at)
    hits = df.filter(at > 0).select(name, group.alias("hit_group"), place.alias("place"))
    return hits.orderBy("hit_group", "place", F.length(name), name).limit(limit)


def fragility_verdict(is_significant: Column, real: Column, mean: Column) -> Column:
    return F.when(is_significant, "more_fragile").when(real > mean, "above_null_mean").otherwise("not_significant")


def favoured(ratio: Column, p: Column, level: float = 0.1) -> Column:
    return F.when((p < level) & (ratio < 0), "alternative").when((p < level) & (ratio > 0), "power_law").otherwise("undecided")


def plausible(p: Column, level: float = 0.1) -> Column:
    return F.when(p >= level, "plausible").otherwise("rejected")
