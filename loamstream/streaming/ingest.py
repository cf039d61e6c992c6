"""Append-only ingest and streaming resample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.resample import GRAIN_SECONDS, _is_rain
from ..operators.timeops import floor_to
from ..session import path_exists


def start_append(stream: DataFrame, path: str, checkpoint: str, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Append to Parquet, everything available now, exactly once by the checkpoint."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start(path)


def start_append_new(stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], ts: str) -> StreamingQuery:
    """Append rows whose (keys, ts) the sink does not hold yet, however late they come.

    The sink is laid out by day; a batch is compared with the days it touches only. No watermark is
    involved, so a device that was offline for weeks loses nothing, and a batch that is run again
    after a failure finds its own rows. Rows without a time lie in a day of their own.
    """
    same = [*keys, ts]

    def land(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        # the source is read once for the days and the rows
        kept = batch.dropDuplicates(same).withColumn("_day", F.coalesce(F.to_date(ts), F.lit("1900-01-01").cast("date"))).persist()
        rows = kept
        if path_exists(spark, path):
            days = [r["_day"] for r in rows.select("_day").distinct().collect()]
            held = spark.read.schema(rows.schema).parquet(path).filter(F.col("_day").isin(days)).select(
                *[F.col(c).alias(f"_held_{c}") for c in same], F.col("_day").alias("_held_day"))
            match = F.col("_day") == F.col("_held_day")
            for c in same:
                match = match & F.col(c).eqNullSafe(F.col(f"_held_{c}"))
            rows = rows.join(held, match, "left_anti")
        try:
            rows.write.mode("append").partitionBy("_day").parquet(path)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new_batch(new: DataFrame, existing: DataFrame, keys: Sequence[str], ts: str, start: Column | None = None, end: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Batch twin: (rows in the window newer than the last seen per device, new last-seen table).

    The last-seen table has one row per device.
    """
    seen = existing.groupBy(*keys).agg(F.max(ts).alias("last_seen"))
    rows = new
    if start is not None:
        rows = rows.filter(F.col(ts) >= start)
    if end is not None:
        rows = rows.filter(F.col(ts) <= end)
    fresh = rows.join(seen, list(keys), "left").filter(F.col("last_seen").isNull() | (F.col(ts) > F.col("last_seen"))).drop("last_seen")
    now = fresh.groupBy(*keys).agg(F.max(ts).alias("_n"))
    last = seen.join(now, list(keys), "full_outer").withColumn("last_seen", F.coalesce("_n", "last_seen")).drop("_n")
    return fresh, last


def start_resample(stream: DataFrame, path: str, checkpoint: str, grain: str, keys: Sequence[str], ts: str = "ts", value: str = "value") -> StreamingQuery:
    """The batch resample as a stream: every batch adds its part of each bin to the sink.

    Parts are sums and counts, so a row counts whenever it comes; `read_resampled` adds them up. A batch
    that is run again replaces its own parts.
    """
    if grain == "monthly":
        raise ValueError("resample to days as a stream and to months from the daily table")
    names = [f.name for f in stream.schema.fields if f.name in keys]

    def land(batch: DataFrame, batch_id: int) -> None:
        parts = batch.withColumn("_rain", _is_rain()).groupBy(*names, floor_to(ts, GRAIN_SECONDS[grain]).alias("bin")).agg(
            F.max("_rain").alias("_rain"), F.sum(value).alias("_s"), F.count(value).alias("n"))
        parts.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_resampled(spark: SparkSession, path: str, keys: Sequence[str], value: str = "value", digits: int = 3) -> DataFrame:
    """Bins from the parts the stream has landed so far."""
    sums = spark.read.parquet(path).groupBy(*keys, "bin").agg(F.max("_rain").alias("_rain"), F.sum("_s").alias("_s"), F.sum("n").alias("n"))
    out = F.when(F.col("_rain"), F.col("_s")).otherwise(F.col("_s") / F.when(F.col("n") > 0, F.col("n")))
    return sums.filter("n > 0").select(*keys, "bin", F.bround(out, digits).alias(value), "n")
