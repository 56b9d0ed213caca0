"""Streams of usage records: tumbling and sliding totals, deduplication, alerts with a cool-down.

Each function takes a streaming (or batch) DataFrame of usage records and returns one; late records count until the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.stored import folder

LATE = "1 day"


def tumbling(records: DataFrame, length: str = "1 day", late: str = LATE) -> DataFrame:
    """start, api_key, requests, tokens."""
    w = F.window("ts", length)
    out = records.withWatermark("ts", late).groupBy(w.alias("w"), "api_key").agg(F.count("*").alias("requests"), F.sum(F.col("request_tokens") + F.col("response_tokens")).cast("long").alias("tokens"))
    return out.select(F.col("w.start").alias("start"), "api_key", "requests", "tokens")


def sliding(records: DataFrame, length: str = "300 seconds", step: str = "60 seconds", late: str = LATE) -> DataFrame:
    """start, requests, errors."""
    out = records.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"))
    return out.select(F.col("w.start").alias("start"), "requests", "errors")


def monthly(records: DataFrame, late: str = LATE) -> DataFrame:
    """month, api_key, requests: months are no fixed windows, so they are grouped by their first day."""
    return records.withWatermark("ts", late).groupBy(F.date_trunc("month", "ts").alias("month"), "api_key").agg(F.count("*").alias("requests"))


def deduplicated(records: DataFrame, keys: list[str], late: str = LATE) -> DataFrame:
    return records.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def cooled_alerts(candidates: DataFrame, seconds: int = 3600) -> DataFrame:
    """api_key, kind, ts, pct of candidates that come `seconds` or more after the last alert of their key and kind.

    The state of a key is the time of its last alert, so it survives restarts with the checkpoint; records of one batch are taken in order.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        keep = []
        for t in rows["ts"]:
            seconds_since = None if last is None else (t - pd.Timestamp(last, unit="us")).total_seconds()
            keep.append(last is None or seconds_since >= seconds)
            last = int(t.value // 1000) if keep[-1] else last
        state.update((last,))
        yield rows[keep].assign(api_key=key[0], kind=key[1])[["api_key", "kind", "ts", "pct"]]

    rows = candidates.select("api_key", "kind", F.col("ts").cast("timestamp_ntz").alias("ts"), "pct")
    return rows.groupBy("api_key", "kind").applyInPandasWithState(run, "api_key string, kind string, ts timestamp_ntz, pct double", "last long", "append", "NoTimeout")


def recorded(stream: DataFrame, path: str, checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Appends a stream of usage records or alerts (with ts) to a table by day; each record once, also over restarts."""
    by_day = stream.withColumn("day", F.to_date("ts"))
    return by_day.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start(path)


def record(records: DataFrame, path: str) -> None:
    """As recorded(), of a batch."""
    records.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def drained(spark: SparkSession, source: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Runs a plan over what a streaming source holds now; its result as a table in the shared folder."""
    out, path = plan(source), folder(spark, "drained")
    spark.createDataFrame([], out.schema).write.parquet(path)

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(path)

    query = out.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", folder(spark, "drained-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)
