"""Structured Streaming over event files: windows with watermarks, deduplication, keyed state and upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, folder: str, schema, late: str = "1 hour") -> DataFrame:
    """A stream of event files, with a watermark on ts."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "1 day") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))


def deduplicated(events: DataFrame) -> DataFrame:
    """Each event once, with state that the watermark bounds."""
    return events.dropDuplicatesWithinWatermark(["event_id"])


def bounded_batches(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of files, so many in each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


_STATE = "last long, seen map<string,long>"
_REVERT = "user_id long, event_id long, n_between long"


def keyed_reverts(events: DataFrame) -> DataFrame:
    """Reverts to an earlier state, found as events arrive in order of time for each user.

    The state of a user is the number of the last event and, for each state seen, where it was last; users are keys
    and states are categories, so it stays small.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen = state.get if state.exists else (0, {})
        seen = dict(seen)
        for b in batches:
            rows = []
            for r in b.sort_values(["ts", "event_id"]).itertuples(index=False):
                last += 1
                before = seen.get(r.event_type)
                if before is not None and last - before > 1:
                    rows.append((key[0], r.event_id, last - before - 1))
                seen[r.event_type] = last
            yield pd.DataFrame(rows, columns=["user_id", "event_id", "n_between"]).astype("int64")
        state.update((last, seen))

    return events.groupBy("user_id").applyInPandasWithState(step, _REVERT, _STATE, "append", GroupStateTimeout.NoTimeout)


def upsert_latest(events: DataFrame, folder: str, checkpoint: str):
    """The latest event of each user, kept as a table; a batch that is repeated after a failure changes nothing.

    Each batch writes the next version of the table from the one before and its own rows, under the batch's number.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.select("user_id", "ts", "event_id", "event_type")
        if number:
            rows = rows.unionByName(batch.sparkSession.read.parquet(f"{folder}/{number - 1}"))
        best = rows.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("r")).select("user_id", "r.*")
        best.write.mode("overwrite").parquet(f"{folder}/{number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
