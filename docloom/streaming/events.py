"""Event streams: admission, repeated deliveries, windows and once-only markers with Structured Streaming.

Queries read a table's files as a stream (all that is there, then stop) and return what the sink holds. State,
checkpoints and sinks live in the shared folder of ``spark.checkpoint.dir``. Sinks that merge are keyed by the
number of the micro-batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.session import shared_folder, table

# What is done with an event of each type; others are ignored.
ADMITTED = {"purchase": "run", "signup": "run", "click": "queue", "view": "queue"}


def new_folder(spark: SparkSession) -> str:
    """A new folder for one stream's state and sink."""
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream; a table is one file or a folder of them."""
    schema = table(spark, sf_dir, name).schema
    path = f"{sf_dir}/{name}.parquet"
    reader = spark.readStream.schema(schema)
    folder = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path")).limit(1).collect()
    single = bool(folder) and folder[0]["path"].rstrip("/").endswith(f"/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir) if single else reader.parquet(path)


def drain(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run the stream over all that is there and return what its sink holds."""
    folder = new_folder(df.sparkSession)
    query = df.writeStream.format("parquet").option("path", f"{folder}/sink").option("checkpointLocation", f"{folder}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/sink")


def action(event_type: Column) -> Column:
    """What is done with an event."""
    chain = F.create_map(*[F.lit(x) for pair in ADMITTED.items() for x in pair])
    return F.coalesce(chain[event_type], F.lit("ignore"))


def admitted_events(spark, sf_dir: str) -> DataFrame:
    """Events with what is done with each: a stateless map over the stream."""
    return drain(stream(spark, sf_dir, "events").select("event_id", "event_type", action(F.col("event_type")).alias("action")))


def by_batches(events: DataFrame, reduce: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``reduce`` makes of each micro-batch, as rows of one sink. A batch owns the folder of its number and
    replaces it when it is run again, so a replay adds nothing."""
    spark, folder = events.sparkSession, new_folder(events.sparkSession)

    def store(batch: DataFrame, number: int) -> None:
        reduce(batch).write.mode("overwrite").parquet(f"{folder}/sink/batch={number}")

    query = events.writeStream.foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", f"{folder}/sink").parquet(f"{folder}/sink")


def windowed(events: DataFrame) -> DataFrame:
    """Each batch stores its counts per window; the sums over batches are the windows' counts. Nothing is kept in
    memory between batches, so events may be late by any time and none is dropped."""
    parts = by_batches(events, lambda batch: batch.groupBy(F.date_trunc("day", "ts").alias("day"), "event_type").agg(F.count("*").alias("n")))
    return parts.groupBy("day", "event_type").agg(F.sum("n").alias("n"))


def windowed_events(spark, sf_dir: str) -> DataFrame:
    """Events per day and type from the stream."""
    return windowed(stream(spark, sf_dir, "events"))


def closed_windows(spark, sf_dir: str) -> DataFrame:
    """Events per day and type, given out once: when the watermark, two days behind the newest event, has passed
    the day's end. State is freed then; events that are later than that are no longer counted."""
    events = stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "2 days")
    counted = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return drain(counted.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n"))


MARK = ["user_id", "event_type", "day"]


def first_of_day(events: DataFrame) -> DataFrame:
    """The least id of each marker over all batches, whatever their order."""
    least = lambda d: d.groupBy(*MARK).agg(F.min("event_id").alias("event_id"))
    return least(by_batches(events.select("user_id", "event_type", F.date_trunc("day", "ts").alias("day"), "event_id"), least))


def once_per_day(spark, sf_dir: str) -> DataFrame:
    """The first event of each user, type and day: markers that are set once, whatever is delivered again."""
    return first_of_day(stream(spark, sf_dir, "events"))


def latest_of(events: DataFrame) -> DataFrame:
    """The last event of each user: each batch stores its own last ones, and the last of these counts. An older
    version that arrives later loses by its time and id."""
    last = lambda d: d.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("s")).select("user_id", "s.ts", "s.event_id", "s.event_type")
    return last(by_batches(events.select("user_id", "ts", "event_id", "event_type"), last)).select("user_id", "event_id", "event_type")


def stream_latest_state(spark, sf_dir: str) -> DataFrame:
    """The last event of each user, kept up by the stream."""
    return latest_of(stream(spark, sf_dir, "events"))


QUERIES = {f.__name__: f for f in (admitted_events, windowed_events, closed_windows, once_per_day, stream_latest_state)}
SQL = {
    "admitted_events": "SELECT event_id, event_type, CASE event_type WHEN 'purchase' THEN 'run' WHEN 'signup' THEN 'run' WHEN 'click' THEN 'queue' WHEN 'view' THEN 'queue' ELSE 'ignore' END AS action FROM events",
    "windowed_events": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "closed_windows": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 2 DAY",
    "once_per_day": "SELECT user_id, event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, min(event_id) AS event_id FROM events GROUP BY 1, 2, 3",
    "stream_latest_state": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
}
