"""Streaming ingest, running health and calibration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sessionloom.operators.ingest import insert_new


KEYS = "session_id string,entry_id string,row_id long,batch long,part int"
PARTS = 256


def ingest_stream(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends entries (session_id, entry_id, pos, role, text) that ``target`` doesn't hold; redelivered ones change nothing.

    Beside the table, ``<target>-keys`` holds the ids alone in ``PARTS`` parts of sessions, and a batch reads the parts
    of its own sessions only, so texts that are stored are never read again. A batch is written to folders of its own
    number, the keys last, so a batch that runs again after a failure replaces what it wrote.
    """
    spark, keys = events.sparkSession, f"{target}-keys"
    spark.createDataFrame([], KEYS).write.mode("ignore").partitionBy("batch", "part").parquet(keys)  # the first batch finds a table
    part = F.pmod(F.hash("session_id"), F.lit(PARTS))

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        own = [r[0] for r in batch.select(part.alias("part")).distinct().collect()]  # PARTS at most
        stored = session.read.schema(KEYS).parquet(keys).filter((F.col("batch") != number) & F.col("part").isin(own))
        insert_new(stored.select("session_id", "entry_id", "row_id"), batch).write.mode("overwrite").parquet(f"{target}/batch={number}")
        new = session.read.parquet(f"{target}/batch={number}").select("session_id", "entry_id", "row_id", part.alias("part"))
        new.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{keys}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_health(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """Rows by UTC day and kind, with a watermark; works on streams and on tables."""
    stamped = log.withColumn("at", F.timestamp_millis("ts"))
    if log.isStreaming:
        stamped = stamped.withWatermark("at", late)
    return stamped.groupBy(F.window("at", "1 day").alias("day"), "kind").agg(F.count("*").alias("n")).select(F.date_format("day.start", "yyyy-MM-dd").alias("day"), "kind", "n")


def running_table(samples: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """``running_samples`` of each batch written beside the others; the last row of a session is its state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    running = running_samples(samples)
    return running.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_samples(samples: DataFrame, most: int = 8) -> DataFrame:
    """(session, n, median ratio) of the newest ``most`` samples of each session by place, kept as bounded state."""

    def update(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held = sorted([*held, *zip(f["pos"].tolist(), (f["chars"] / f["tokens"]).tolist(), strict=True)])[-most:]
        places, ratios = [p for p, _ in held], [r for _, r in held]
        state.update((places, ratios))
        yield pd.DataFrame({"session": [key[0]], "n": [len(held)], "ratio": [sorted(ratios)[len(ratios) // 2]]})

    from pyspark.sql.streaming.state import GroupStateTimeout

    return samples.groupBy("session").applyInPandasWithState(update, "session string, n long, ratio double", "places array<long>, ratios array<double>", "update", GroupStateTimeout.NoTimeout)
