"""Sequence operators over streams: the state of a key is its open run and its last value, whatever the stream's length."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "user_id long, seq long, cnt int, event_type string"
DELTAS = "user_id long, event_id long, value_cents long, diff long"


def stream_runs(events: DataFrame, cap: int = 255) -> DataFrame:
    """Finished runs of equal event_type of each user: user_id, seq, cnt, event_type.

    Rows of one trigger are put in order of (ts, event_id); a run that is still open stays in the state, and ends when
    another value comes or it is full; open_runs() reads those of a stream that has ended. events: user_id, event_id, ts,
    event_type."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, value, n = state.get if state.exists else (0, None, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for v in rows.event_type:
            if n and (v != value or n >= cap):
                out.append((key[0], seq, n, value))
                seq, n = seq + 1, 0
            value, n = v, n + 1
        state.update((seq, value, n))
        yield pd.DataFrame(out, columns=["user_id", "seq", "cnt", "event_type"])

    return events.groupBy("user_id").applyInPandasWithState(step, RUNS, "seq long, value string, n int", "append", GroupStateTimeout.NoTimeout)


def open_runs(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The runs that are still open where a stream of runs has ended, from the state in its checkpoint."""
    state = spark.read.format("statestore").load(checkpoint)
    kept = state.select("key.user_id", "value.groupState.*")
    return kept.filter("n > 0").select("user_id", "seq", F.col("n").alias("cnt"), F.col("value").alias("event_type"))


def to_end(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives until its sources are read to their end, written under a folder that all executors share."""
    schema = stream.schema
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").outputMode("append")
    writer.trigger(availableNow=True).start(f"{folder}/rows").awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows")


def stream_deltas(events: DataFrame) -> DataFrame:
    """Differences of value_cents to the user's event before, to zero for the first."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (last,) = state.get if state.exists else (0,)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        v = rows.value_cents
        state.update((int(v.iloc[-1]),))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows.event_id, "value_cents": v, "diff": v - v.shift(fill_value=last)})

    return events.groupBy("user_id").applyInPandasWithState(step, DELTAS, "last long", "append", GroupStateTimeout.NoTimeout)
