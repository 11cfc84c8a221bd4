"""Small helpers of the operators: Arrow passes that keep the other columns, and the registry of their queries."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    small_batches(spark)
    df = spark.read.parquet(f"{sf}/{table}.parquet")
    return df.select(*columns) if columns else df


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as it takes for ``df`` to have no such column, in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        found.append(name)
    return found


# Rows and bytes of an Arrow batch: what a task holds of a table at once, in the JVM and again in its Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the Arrow limits of the session to ``BATCH_ROWS`` and ``BATCH_BYTES``; lower ones of the caller stay.

    Whole texts pass through the operators here, and executors keep the memory that their largest batches once took.
    """
    conf, rows, size = spark.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
    own = re.fullmatch(r"(\d+)([kmgtp]?)b?", conf.get(size).lower())
    if not own or not 0 < int(own[1]) * 1024 ** " kmgtp".index(own[2] or " ") <= BATCH_BYTES:
        conf.set(size, f"{BATCH_BYTES}b")


def with_arrow(df: DataFrame, read_columns: list[str], added: str, function: Callable[..., dict[str, list]]) -> DataFrame:
    """``df`` with the columns of the DDL ``added``, computed from the values of some columns batch by batch.

    Columns of ``df`` that have the name of an added one are replaced. Batches are bounded by Spark's Arrow limits.
    """
    small_batches(df.sparkSession)
    new = T._parse_datatype_string(added)
    kept = [f for f in df.schema.fields if f.name not in new.names]
    schema = T.StructType([*kept, *new.fields])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(new)
        for batch in batches:
            made = function(*(batch.column(c).to_pylist() for c in read_columns))
            columns = [batch.column(n) for n in names] + [pa.array(made[f.name], f.type) for f in arrow]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *new.names])

    return df.mapInArrow(run, schema)


def set_aside(df: DataFrame, added: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns that have the name of one in the DDL ``added`` renamed, and the way back to the columns of ``df``."""
    clash = set(T._parse_datatype_string(added).names) & set(df.columns)

    def back(found: DataFrame) -> DataFrame:
        return found.select(*[F.col(f"_own_{c}").alias(c) if c in clash else F.col(c) for c in df.columns])

    return df.withColumnsRenamed({c: f"_own_{c}" for c in clash}), back
