"""Flow sessions from a stream: state for each key, ended by event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowquery.storage import new_path

STATE = "start long, last long, n long"


def sessionize(rows: DataFrame, key: str, micros: str, idle: int, cap: int) -> DataFrame:
    """(key, start, end, n, ended) as the stream ``rows``, which has a watermark, goes on; ``end`` and ``n`` of a session grow until ``ended``.

    A row starts a session when more than ``idle`` after the last one, or more than ``cap`` after the session's start.
    The state of a key is three numbers; a timer drops it once the watermark has passed its idle time or cap.
    """

    def update(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            start, last, n = state.get
            state.remove()
            yield pd.DataFrame([(keys[0], start, last, n, True)], columns=[key, "start", "end", "n", "ended"])
            return
        start, last, n = state.get if state.exists else (None, None, 0)
        times = sorted(t for b in batches for t in b[micros])
        for t in times:
            if start is None or t - last > idle or t - start > cap:
                if start is not None:
                    out.append((keys[0], start, last, n, True))
                start, n = t, 0
            last, n = max(t, last or t), n + 1
        out.append((keys[0], start, last, n, False))
        state.update((start, last, n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, min(last + idle, start + cap) // 1000 + 1))
        yield pd.DataFrame(out, columns=[key, "start", "end", "n", "ended"])

    schema = f"{key} long, start long, end long, n long, ended boolean"
    return rows.groupBy(key).applyInPandasWithState(update, schema, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def replay(spark: SparkSession, sf_dir: str, idle: int, cap: int) -> DataFrame:
    """Sessions of the ``events`` table read as a stream until it is used up; of each session the latest state."""
    source = f"{sf_dir}/events.parquet"
    path = new_path(spark, "sessions")
    static = spark.read.parquet(source)
    stream = spark.readStream.schema(static.schema)
    if static.inputFiles()[0].endswith("/events.parquet"):  # streams read folders
        stream, source = stream.option("pathGlobFilter", "events.parquet"), sf_dir
    rows = stream.parquet(source)
    rows = rows.select("user_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", "0 seconds")
    found = sessionize(rows.withColumn("t", F.unix_micros("ts")), "user_id", "t", idle, cap)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    started = found.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}-log").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(path).groupBy("user_id", "start").agg(F.max("end").alias("end"), F.max("n").alias("n"))
