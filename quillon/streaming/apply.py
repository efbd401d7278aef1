"""Mutation logs as streams.

``start_apply`` keeps a table of each id's last write: every micro-batch is reduced to its last
writes and appended with the batch's number as one commit; readers replay, last writer wins by
log number.  Batches that come again, late or twice change nothing.  ``latest_writes`` is the
stateful form: the last write of each id as an updating stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillon.operators.log import last_writes, replay
from quillon.schema import LOG


def log_stream(spark: SparkSession, path: str, files_per_batch: int = 8) -> DataFrame:
    """Log files of a folder as a stream."""
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def start_apply(log: DataFrame, state: str, checkpoint: str, available_now: bool = True):
    """Starts the stream that keeps ``state``; with ``available_now`` it ends with what is there."""

    def one(batch: DataFrame, number: int) -> None:
        # a batch that is run again writes its folder over
        last_writes(batch).write.mode("overwrite").parquet(f"{state}/batch={number}")

    writer = log.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live(spark: SparkSession, state: str) -> DataFrame:
    """Live vectors of a state table."""
    return replay(spark.read.parquet(state).select("lsn", "op", "id", "vec"))


def latest_writes(log: DataFrame) -> DataFrame:
    """``(id, lsn, op)`` updates of a stream: a row when a newer write of an id comes."""

    def one(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (-1, "")
        old = best[0]
        for f in frames:
            top = f.loc[f["lsn"].idxmax()]
            if int(top["lsn"]) > best[0]:
                best = (int(top["lsn"]), top["op"])
        if best[0] > old:  # stale and repeated writes change nothing
            state.update(best)
            yield pd.DataFrame({"id": [key[0]], "lsn": [best[0]], "op": [best[1]]})

    return log.select("id", "lsn", "op").groupBy("id").applyInPandasWithState(one, "id long, lsn long, op string", "lsn long, op string", "update", GroupStateTimeout.NoTimeout)


def missed_windows(events: DataFrame, seconds: int, key: str = "user_id", ts: str = "ts", streak: int = 2) -> DataFrame:
    """``(key, first_missed, n_missed)``: runs of at least ``streak`` tumbling windows without a beat
    between two windows that have one."""
    from pyspark.sql import Window

    beats = events.select(key, F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)).alias("w")).distinct()
    gaps = beats.withColumn("before", F.lag("w").over(Window.partitionBy(key).orderBy("w")))
    return gaps.select(key, (F.col("before") + 1).alias("first_missed"), (F.col("w") - F.col("before") - 1).alias("n_missed")).where(F.col("n_missed") >= streak)


def unhealthy_since(beats: DataFrame, seconds: int, streak: int = 2, key: str = "user_id", ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """``(key, first_missed)`` of a stream or a table: each time ``streak`` tumbling windows after a beat
    pass without one, the number of the first of them.

    One missed window fewer changes nothing (hysteresis).  Beats of windows closer than that are one
    session; as a stream, a session is told when the watermark, ``delay`` behind, has passed its end.
    """
    start = F.timestamp_micros(F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000)) * (seconds * 1_000_000))
    alive = beats.select(F.col(key).alias("_key"), start.alias("_start")).withWatermark("_start", delay)
    # sessions that touch are one, so a microsecond less
    sessions = alive.groupBy("_key", F.session_window("_start", f"{(streak + 1) * seconds * 1_000_000 - 1} microseconds").alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
    first = F.floor(F.unix_micros("_s.end") / (seconds * 1_000_000)) - streak + 1
    return sessions.select(F.col("_key").alias(key), first.cast("long").alias("first_missed"))


def once(requests: DataFrame, request: str, ts: str, delay: str) -> DataFrame:
    """A stream of requests that may be delivered again: the first of each, as long as the others come
    within ``delay``.  State is kept no longer than that."""
    return requests.withWatermark(ts, delay).dropDuplicatesWithinWatermark([request])
