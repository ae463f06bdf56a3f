"""Acceptance rates over a stream of feedback events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed_rates(events: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Views, expansions and their ratio by sliding window of event time; rows later than late are dropped from a stream.

    events(ts, event_type) may be a stream or a table.
    """
    own = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    if own.isStreaming:
        own = own.withWatermark("ts", late)
    views = F.count_if(F.col("event_type") == "view")
    acts = F.count_if(F.col("event_type").isin("click", "purchase"))
    grouped = own.groupBy(F.window("ts", window, slide)).agg(views.alias("views"), acts.alias("acts"))
    rate = F.when(F.col("views") > 0, F.col("acts") / F.col("views")).otherwise(0.0)
    return grouped.select(F.unix_timestamp("window.start").alias("window_start"), "views", "acts", rate.alias("rate"))


def recently_expanded(events: DataFrame, late: str = "1 day") -> DataFrame:
    """The first expansion of each (user_id, handle) within the watermark."""
    own = events.filter(F.col("event_type").isin("click", "purchase")).select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.get_json_object("props", "$.k").alias("handle"))
    if own.isStreaming:
        return own.withWatermark("ts", late).dropDuplicatesWithinWatermark(["user_id", "handle"])
    return own.groupBy("user_id", "handle").agg(F.min("ts").alias("ts"))


def run_available(stream: DataFrame, keys: tuple[str, ...], folder: str) -> DataFrame:
    """What a stream of changing rows has now, as a table: one availableNow run, of which the newest row of each of keys counts.

    Changed rows of a batch are written below folder, a folder for each, so a batch that is run again replaces its own; the state
    that the watermark has closed is dropped. Another run with the same folder goes on where this one ends.
    """

    spark, rows = stream.sparkSession, f"{folder}/rows"
    # a stream that has had nothing yet gives an empty table
    spark.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{rows}/batch=-1")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    started = stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{folder}/checkpoint")
    started.trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    kept = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    newest = spark.read.schema(kept).parquet(rows).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return newest.select(*keys, "r.*")
