"""Edit logs and segment files as streams: Structured Streaming with built-in operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridia.sources.shared import shared


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """Parquet files at path (a folder, or one file) as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rpartition("/")
    first = spark.read.parquet(path).select("_metadata.file_path").limit(1).collect()
    return reader.option("pathGlobFilter", name).parquet(folder) if first and first[0][0].endswith(f"/{name}") else reader.parquet(path)


def run_updates(state: DataFrame, key: list[str], order: str) -> DataFrame:
    """Runs an update-mode aggregate over all there is and gives each key's last row, the one of the greatest order column.

    Each batch's changed rows are one folder of the sink; a batch that runs twice overwrites its own.
    """
    spark = state.sparkSession
    sink = shared(spark, "updates")
    query = (
        state.writeStream.outputMode("update").option("checkpointLocation", shared(spark, "checkpoint")).trigger(availableNow=True)
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{sink}/batch={n}")).start()
    )
    query.awaitTermination()
    rest = [c for c in state.columns if c not in key]
    rows = spark.read.schema(state.schema).parquet(sink)
    return rows.groupBy(*key).agg(F.max(F.struct(order, *[c for c in rest if c != order])).alias("s")).select(*key, *[F.col(f"s.{c}") for c in rest])


def latest_state(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """(key, seq, value, edits): each key's last edit so far, deletes as null values, and how many edits it has had."""
    last = F.max(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))
    state = log.groupBy(key).agg(last.alias("m"), F.count(F.lit(1)).alias("edits")).select(key, F.col("m.s").alias(seq), F.col("m.v").alias(value), "edits")
    return run_updates(state, [key], "edits")


def windowed_counts(log: DataFrame, ts: str, by: str, width: str, late: str) -> DataFrame:
    """(start, by, n, closed): counts of all rows in windows of event time, whatever the number and order of the files.

    There is no watermark, as it would drop rows that come late: the state has a row for each window and value. closed
    tells the windows that end at least late before the last event. A row without a time is in no window.
    """
    at = log.withColumn(ts, F.col(ts).cast("timestamp"))
    counts = at.groupBy(F.window(ts, width), by).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    rows = run_updates(counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), by, "n", "last"), ["start", "end", by], "n")
    mark = rows.agg((F.max("last") - F.expr(f"INTERVAL '{late}'")).alias("mark"))
    return rows.crossJoin(F.broadcast(mark)).select("start", by, "n", (F.col("end") <= F.col("mark")).alias("closed"))


def ingest(stream: DataFrame, partition: str) -> DataFrame:
    """Micro-batches appended to a partitioned Parquet table; gives the table."""
    spark = stream.sparkSession
    sink = shared(spark, "ingest")
    stream.writeStream.outputMode("append").format("parquet").option("path", sink).option("checkpointLocation", shared(spark, "checkpoint")).partitionBy(partition).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)
