"""Incremental queries with Structured Streaming. Each ends with what is there (availableNow) and can be started again.

Checkpoints and results lie in the shared folder. ``latest_state`` keeps running aggregates in update mode: each micro-batch writes the
keys that changed, with its number, and a reader takes the last row of each key. Its result equals the batch answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.tables import shared_dir


def read_stream(spark: SparkSession, root: str, name: str, files: int = 1) -> DataFrame:
    """The Parquet table as a stream of its files, ``files`` in each micro-batch."""
    path = f"{root}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    folder, _, last = path.rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", "*.parquet").parquet(path) if spark.read.parquet(path).inputFiles()[0].rstrip("/").rpartition("/")[2] != last else reader.option("pathGlobFilter", last).parquet(folder)


def latest_state(aggregate: DataFrame, keys: list[str], folder: str | None = None) -> DataFrame:
    """Runs a streaming aggregate to its end and gives the last state of each key."""
    spark = aggregate.sparkSession
    folder = folder or shared_dir(spark)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/states/batch={number}")

    query = aggregate.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in aggregate.columns if c not in keys]
    rows = spark.read.schema(aggregate.withColumn("_batch", F.lit(0)).schema).parquet(f"{folder}/states/*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_s")).select(*keys, *[F.col(f"_s.{v}").alias(v) for v in values])


def counts(stream: DataFrame, keys: list[str], **aggregates: Column) -> DataFrame:
    return latest_state(stream.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()]), keys)


def windows(stream: DataFrame, ts: str, keys: list[str], width: str, late: str = "40 days") -> DataFrame:
    """Counts in tumbling windows, with a watermark of ``late`` that bounds the state."""
    timed = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    grouped = timed.groupBy(F.window("_ts", width).alias("_w"), *keys).agg(F.count("*").alias("n"))
    return latest_state(grouped.select(F.col("_w.start").alias("start"), *keys, "n"), ["start", *keys])


def once_only(stream: DataFrame, ts: str, keys: list[str], ttl: str = "7 days", folder: str | None = None) -> DataFrame:
    """The keys of a stream, each let through once while its state is kept (``ttl`` behind the greatest time)."""
    spark = stream.sparkSession
    folder = folder or shared_dir(spark)
    out = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", ttl).dropDuplicatesWithinWatermark(keys).select(*keys)
    query = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/once").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/once")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str) -> DataFrame:
    """Batch sessions: (keys, start, end, n), closed by ``gap`` without an event."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp"))
    out = timed.groupBy(*keys, F.session_window("_ts", gap).alias("_w")).agg(F.count("*").alias("n"), F.min("_ts").alias("start"), F.max("_ts").alias("end"))
    return out.select(*keys, "start", "end", "n")
