"""Session set-up, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows a table may have before this package stops hinting a broadcast of it.
BROADCAST_ROWS = 250_000


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; on a cluster the submitter's session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fraygraph")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("FRAYGRAPH_DRIVER_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a fresh local one only for local masters without it."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="fraygraph-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage of one superstep with a reliable checkpoint, which survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written under the shared checkpoint folder, read back with its real size.

    A checkpoint keeps the planner's size estimate, and the estimate of a join is a product: in loops whose state joins
    itself the estimate would gain digits exponentially and planning would stall. Those loops store their state.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: DataFrame, on: list[str]) -> tuple[DataFrame, int]:
    """``rows`` stored, and held dealt by ``on`` and sorted: joins by these keys read it where and as it lies. A lost part is read anew."""
    return held(store(rows), on)


def held(stored: DataFrame, on: list[str]) -> tuple[DataFrame, int]:
    """A stored table held dealt by ``on`` and sorted, see ``dealt``.

    It is counted at once, as the planner knows how a held table is dealt only when it is there.
    """
    table = stored.repartition(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), *on)
    table = table.sortWithinPartitions(*on).persist(StorageLevel.MEMORY_AND_DISK)
    return table, table.count()


def hint_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint for a settled table, given only after counting that it has at most ``rows`` rows.

    Larger tables come back unhinted: Spark then shuffles, and splits hot keys by adaptive skew joins.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def replicate(df: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Give every row of ``df`` to every scenario: fragment-and-replicate over a grid of about as many cells as there are
    shuffle partitions, so both sides are copied about the square root of that many times only.

    The output is what a caller asked for (seeds of every scenario); no task holds all rows of a side.
    """
    side = max(2, math.isqrt(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    every = F.explode(F.sequence(F.lit(0), F.lit(side - 1)))

    def own(table: DataFrame):
        return F.pmod(F.xxhash64(*table.columns), F.lit(side)).cast("int")

    left = df.withColumn("_row", own(df)).withColumn("_column", every)
    right = scenarios.withColumn("_column", own(scenarios)).withColumn("_row", every)
    return left.join(right, ["_row", "_column"]).drop("_row", "_column")
