"""Structured Streaming over the event log: replay, last progress per step, windows.

The folder of the table is the stream's source. ``run_available`` processes what
is there and stops, so a result can be compared with its batch twin; a checkpoint
is the resume point of a replay.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubicost.registry import query
from rubicost.sources.files import shared_folder
from rubicost.tables import Tables


def event_stream(t: Tables) -> DataFrame:
    """The events table as a stream of files."""
    schema = t("events").schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(t.sf_dir)


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is available and returns what it wrote.

    Append mode writes Parquet; complete mode keeps the last whole result.
    """
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:
        write = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{root}/out")
        q = stream.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("""SELECT event_id AS seq, user_id AS run_id, event_type AS type FROM events WHERE event_id > 400""")
def streamed_replay(t: Tables):
    """Replay after the last entry seen, as a stream."""
    return run_available(event_stream(t).where("event_id > 400").select(F.col("event_id").alias("seq"), F.col("user_id").alias("run_id"), F.col("event_type").alias("type")))


@query("""SELECT user_id AS run_id, json_extract_string(props, '$.k')::BIGINT % 4 AS step, max(event_id) AS seq, arg_max(event_type, event_id) AS type FROM events GROUP BY 1, 2""")
def streamed_last_progress(t: Tables):
    """Latest entry of each run and step, a streaming aggregate in complete mode."""
    step = (F.get_json_object("props", "$.k").cast("bigint") % 4).alias("step")
    agg = event_stream(t).groupBy(F.col("user_id").alias("run_id"), step).agg(F.max("event_id").alias("seq"), F.max_by("event_type", "event_id").alias("type"))
    return run_available(agg, "complete")


def timed(t: Tables) -> DataFrame:
    """The event stream with a watermark on ``at``, which is the event's time as a point in time (session zone UTC)."""
    return event_stream(t).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "1 day")


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS value FROM events GROUP BY 1, 2""")
def streamed_tumbling(t: Tables):
    """Tumbling windows with a watermark (an extension of ours, not part of the surveyed application)."""
    agg = timed(t).groupBy(F.window("at", "6 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("value"))
    return run_available(agg.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.col("value").cast("double").alias("value")), "complete")


@query("""WITH b AS (SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '2024-01-01') AS b, count(*) AS n FROM events GROUP BY 1), s AS (SELECT b - INTERVAL 1 HOUR * k AS start, n FROM b, (SELECT unnest([0, 1, 2]) AS k))
SELECT start, sum(n)::BIGINT AS n FROM s GROUP BY start""")
def streamed_sliding(t: Tables):
    """Sliding windows of three hours, one each hour (our extension)."""
    agg = timed(t).groupBy(F.window("at", "3 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return run_available(agg.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n"), "complete")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS stop, count(*) AS n FROM s GROUP BY user_id, session""")
def session_windows(t: Tables):
    """Sessions that end after two hours without an event (our extension)."""
    agg = t("events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return agg.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")
