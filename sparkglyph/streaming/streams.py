"""Structured Streaming counterparts. Each equals its batch query over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.parsing import log_tags


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-25, STR-01: tagged lines of log files as they arrive; order within a file is that of its lines."""
    text = spark.readStream.format("text").option("wholetext", "true").load(folder)
    lines = text.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\n")).alias("line", "value"))
    return lines.select("file", "line", *log_tags(F.col("value")))


def repetitions(lines: DataFrame, timeout: str | None = None) -> DataFrame:
    """STR-01, STR-04: (file, test, rep, allocated): memory samples with the test and repetition they fall into.

    State per file: the test begun and the last repetition. With a timeout (for
    example "1 hour") a file that stays silent so long loses its state.
    """
    schema, state_schema = "file string, test string, rep int, allocated string", "test string, rep int"

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        test, rep = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("line")
        out = []
        for tag, value in zip(rows["tag"], rows["value"]):
            if tag == "BEGIN":
                test, rep = value, None
            elif tag == "END":
                test = rep = None
            elif tag == "REP":
                rep = int(value)
            elif tag == "MEM":
                out.append((key[0], test, rep, value))
        state.update((test, rep))
        if timeout:
            state.setTimeoutDuration(int(pd.Timedelta(timeout).total_seconds() * 1000))
        yield pd.DataFrame(out, columns=["file", "test", "rep", "allocated"]).astype({"rep": "Int32"})

    kind = GroupStateTimeout.ProcessingTimeTimeout if timeout else GroupStateTimeout.NoTimeout
    return lines.groupBy("file").applyInPandasWithState(run, schema, state_schema, "append", kind)


def samples(events: DataFrame, every: str = "10 seconds", late: str = "10 minutes") -> DataFrame:
    """STR-02, STR-05: counts by type in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """STR-05: sessions of a user that end after a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")


def incremental(spark: SparkSession, folder: str, schema: str, fmt: str, transform, target: str, checkpoint: str):
    """STR-03: handles the files of a folder that earlier runs have not, exactly once, and stops; returns the finished query."""
    q = (
        transform(spark.readStream.schema(schema).format(fmt).load(folder))
        .writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return q
