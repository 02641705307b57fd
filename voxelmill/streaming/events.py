"""Event logs as streams: windows with late data, phases, heartbeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOG = "timestamp_unix double, event_type string, run_state string, token long, name string, status string, elapsed_seconds double"


def read_log(spark: SparkSession, path: str, stream: bool = True) -> DataFrame:
    """JSON lines of a folder as a stream (or a table), with `ts`."""
    reader = (spark.readStream if stream else spark.read).schema(LOG)
    return reader.json(path).withColumn("ts", F.timestamp_seconds("timestamp_unix"))


def read_table(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """A Parquet file (or folder of that name) of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def windowed(events: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts and sums of hundredths by tumbling window; rows more than `late`
    behind the newest are dropped."""
    cents = F.round(F.col(value) * 100).cast("long")
    return events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(cents).alias("cents"))


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "2 days") -> DataFrame:
    """Bursts of events of a key without a pause of `gap`."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))


def phases(log: DataFrame) -> DataFrame:
    """Starts and ends of phases (by token) joined, with their duration."""
    start = log.filter("event_type = 'phase_start'").select("token", "name", F.col("ts").alias("started"))
    end = log.filter("event_type = 'phase_end'").select("token", F.col("ts").alias("ended"), "status", "elapsed_seconds")
    return start.join(end, "token", "left")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, into Parquet files; a rerun goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Rows that change, batch by batch, into Parquet folders batch=n; a batch
    that is run again replaces its own. `latest` reads them."""

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last state of each key that run_updates wrote."""
    rows = spark.read.parquet(path)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("v")).select(*keys, "v.*")
