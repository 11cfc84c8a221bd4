"""Reading and writing entity, connection and result tables; chunked, resumable and exported forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fraygraph.operators.curves import restore_fractions
from fraygraph.session import store

CONNECTION_SCHEMA = T.StructType([T.StructField("pre", T.LongType()), T.StructField("post", T.LongType()), T.StructField("weight", T.LongType())])
CURVE_SCHEMA = "strategy string, trial int, batch int, fraction_removed double, flow long, reachable_pairs long, avalanche long"
EDGE_CURVE_SCHEMA = "order string, trial int, fraction_removed double, flow long, reachable_pairs long"


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: list[str] | None = None) -> DataFrame:
    """Parquet file or folder. Columns missing from the file but named in the schema come back null."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None) -> None:
    """CSV with a header; ``digits`` gives fixed decimals per column."""
    digits = digits or {}
    columns = [F.format_string(f"%.{digits[c]}f", F.col(c).cast("double")).alias(c) if c in digits else F.col(c) for c in df.columns]
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON document per row."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", schema).alias("d")).select("d.*")


def load_curves(spark: SparkSession, path: str, n: int) -> DataFrame:
    return restore_fractions(read_csv(spark, path, CURVE_SCHEMA), n)


def load_edge_trials(spark: SparkSession, path: str, edges: int) -> DataFrame:
    """Edge-attack rows with exact fractions and the batch number they imply."""
    rows = restore_fractions(read_csv(spark, path, EDGE_CURVE_SCHEMA), edges)
    run = Window.partitionBy("order", "trial").orderBy("fraction_removed")
    return rows.withColumn("batch", F.row_number().over(run) - 1)


def pending(planned: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Planned scenarios without a stored result."""
    return planned.join(done.select(*keys).distinct(), keys, "left_anti")


def last_writes(rows: DataFrame, keys: list[str], arrival: str) -> DataFrame:
    """Append-only checkpoint rows: the latest per key wins. An aggregate, so that a hot key is combined map-side."""
    others = [c for c in rows.columns if c not in keys]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), arrival).alias("_r"))
    return latest.select(*keys, "_r.*").select(*rows.columns)


def ingest_chunks(spark: SparkSession, path: str, schema, expected: int | None = None) -> DataFrame:
    """A folder of chunk files as one table; a count other than ``expected`` is an error."""
    df = spark.read.schema(schema).parquet(path)
    if expected is not None:
        found = df.count()
        if found != expected:
            raise ValueError(f"chunks hold {found} rows, expected {expected}")
    return df


def ingest_edges(connections: DataFrame, labelings: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """(src, dst, weight, n) at several label granularities from one reading of the connection table.

    Both ends get all their labels in one join each; the sums per combination of labels are stored and rolled up per level.
    A connection end without a label at some level fails the job.
    """
    levels = list(labelings)
    labels = None
    for level, table in labelings.items():
        own = table.select("entity", F.col("label").alias(level))
        labels = own if labels is None else labels.join(own, "entity", "full")
    ends = {side: labels.toDF(end, *[f"{side}_{level}" for level in levels]) for side, end in (("src", "pre"), ("dst", "post"))}
    labelled = connections.join(ends["src"], "pre", "left").join(ends["dst"], "post", "left")
    missing = F.raise_error(F.lit("connection end without a label"))
    columns = [f"{side}_{level}" for side in ends for level in levels]
    labelled = labelled.select("weight", *[F.coalesce(c, missing).alias(c) for c in columns])
    finest = store(labelled.groupBy(*columns).agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n")))
    sums = [F.sum("weight").alias("weight"), F.sum("n").alias("n")]
    return {level: finest.groupBy(F.col(f"src_{level}").alias("src"), F.col(f"dst_{level}").alias("dst")).agg(*sums) for level in levels}


def run_missing(planned: DataFrame, store: str, keys: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Run ``work`` only for scenarios that the result folder lacks, append, and return everything stored."""
    spark = planned.sparkSession
    try:
        todo = pending(planned, spark.read.parquet(store), keys)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = planned
    if not todo.isEmpty():
        work(todo).write.mode("append").parquet(store)
    return spark.read.parquet(store)


def export_sections(available: dict[str, DataFrame], sections: dict[str, tuple[list[str], Callable[..., DataFrame]]]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Build each section whose inputs are all there. Returns the documents and a manifest (section, status, missing)."""
    documents, manifest = {}, []
    for name, (needs, build) in sections.items():
        missing = [n for n in needs if n not in available]
        if not missing:
            documents[name] = build(*[available[n] for n in needs])
        manifest.append((name, "awaited" if missing else "written", ",".join(missing)))
    spark = next(iter(available.values())).sparkSession
    return documents, spark.createDataFrame(manifest, "section string, status string, missing string")


def column_document(df: DataFrame, order: str, columns: list[str], rows_per_part: int = 100_000) -> DataFrame:
    """(part, rows, one array per column): column-oriented export; the parts, by key hash, hold about ``rows_per_part`` rows."""
    parts = -(-df.count() // rows_per_part) or 1
    packed = F.array_sort(F.collect_list(F.struct(order, *[c for c in columns if c != order])))
    part = F.pmod(F.xxhash64(order), F.lit(parts)).cast("int").alias("part")
    grouped = df.groupBy(part).agg(packed.alias("_p"))
    return grouped.select("part", F.size("_p").alias("rows"), *[F.col(f"_p.{c}").alias(c) for c in columns])
