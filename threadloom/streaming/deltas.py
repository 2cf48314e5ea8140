"""Checkpoint deltas as streams: file sources, keep-one dedup, the hourly dashboard, exactly-once merges."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def event_stream(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """A folder of Parquet files (or one file) as a stream; `ts` becomes a timestamp, which watermarks need."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    alone = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(jvm_path).isFile()
    source = spark.readStream.schema(schema)
    stream = source.option("pathGlobFilter", name).parquet(folder) if alone else source.parquet(path)
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def without_repeats(stream: DataFrame, key: str, ts: str = "ts", late: str | None = None) -> DataFrame:
    """Each key once. With `late`, state older than that by event time is dropped, and so are later repeats' memories: a repeat beyond it counts as new."""
    if late is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def dashboard(stream: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """hour, events, error_rate and slow: whether there were fewer than 20 events; by event time."""
    hours = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"))
    made = hours.agg(F.count("*").alias("events"), F.avg(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("error_rate"))
    return made.select(F.col("w.start").alias("hour"), "events", "error_rate", (F.col("events") < 20).alias("slow"))


def alerts(stream: DataFrame, identity: str, short: Column, ts: str = "ts", late: str = "1 hour", least: int = 20, most_errors: float = 0.05) -> DataFrame:
    """hour, events, the shares of repeated identities, errors and short records, and alerts: slow (fewer than `least` events) and failing (more errors than `most_errors`).

    Identities are counted by a set of an hour's, which a state holds until the watermark passes.
    """
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    hours = stream.withWatermark(ts, late).groupBy(F.window(ts, "1 hour").alias("w"))
    made = hours.agg(F.count("*").alias("events"), F.size(F.collect_set(identity)).alias("ids"), flag(F.col("event_type") == "error").alias("errors"), flag(short).alias("short"))
    repeated = 1 - F.col("ids") / F.col("events")
    return made.select(F.col("w.start").alias("hour"), "events", repeated.alias("repeated"), "errors", "short", (F.col("events") < least).alias("slow"), (F.col("errors") > most_errors).alias("failing"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for the files that are there now, as a table written to the shared folder, each batch once."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        # a batch that is tried again replaces its own files; complete results replace all before them
        batch.write.mode("overwrite").parquet(f"{folder}/out/all" if mode == "complete" else f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/{'all' if mode == 'complete' else 'batch=*'}")


def merge_deltas(spark: SparkSession, path: str, schema: str, key: str, into: str) -> None:
    """Appends the records of new delta files whose key is not yet in the table `into`; the first of a batch by file and line wins."""
    stream = spark.readStream.schema(schema).json(path).withColumn("checkpoint", F.regexp_extract("_metadata.file_path", r"cp-([0-9]+)", 1))

    def put(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("place", F.monotonically_increasing_id())
        first = batch.groupBy(key).agg(F.min_by(F.struct(*batch.columns), F.struct("checkpoint", "place")).alias("r")).select("r.*").drop("place")
        try:
            done = batch.sparkSession.read.parquet(into).where(F.col("batch") != number).select(key)
            first = first.join(done, key, "left_anti")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        first.write.mode("overwrite").parquet(f"{into}/batch={number}")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{into}_state").trigger(availableNow=True).start().awaitTermination()
