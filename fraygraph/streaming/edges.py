"""Connection files that arrive in chunks, aggregated exactly once with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraygraph.session import checkpoint_folder


def stream_edges(spark: SparkSession, source: str, schema, prepare, run: str, files_per_trigger: int = 1) -> DataFrame:
    """Drain the chunk files in ``source`` and return edge totals equal to the batch aggregate.

    ``prepare`` maps the stream to (src, dst, weight). State and progress live under the shared checkpoint folder in
    ``run``, so a restarted query goes on where it stopped; each trigger hands the changed totals to ``foreachBatch``,
    which writes them under its batch id, and the newest total per edge is the result.
    """
    folder = f"{checkpoint_folder(spark)}/{run}"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    totals = prepare(stream).groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("step", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/totals/step={number}")

    query = (
        totals.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).foreachBatch(keep).start()
    )
    query.awaitTermination()
    written = spark.read.parquet(f"{folder}/totals/*")
    return written.groupBy("src", "dst").agg(F.max_by(F.struct("weight", "n"), "step").alias("t")).select("src", "dst", "t.weight", "t.n")
