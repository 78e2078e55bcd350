"""Sliding-window rate limit with exact admission.

A hit is accepted while fewer than ``limit`` accepted hits of its key lie in
the trailing window; rejected hits do not count.  A plain window count is not
equivalent, because it counts rejected hits too.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

_STATE = T.StructType([T.StructField("accepted", T.ArrayType(T.LongType()))])


def _decide(times: Iterator[int], accepted: deque, limit: int, width: int) -> Iterator[bool]:
    """Verdict per time (ascending, microseconds); ``accepted`` is updated in place."""
    for at in times:
        while accepted and accepted[0] <= at - width:
            accepted.popleft()
        ok = len(accepted) < limit
        if ok:
            accepted.append(at)
        yield ok


def admit(hits: DataFrame, key: str, ts: str, tie: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Adds ``accepted`` to a batch of hits.

    A pause of a whole window makes what follows independent of what came
    before, so every key is cut at its pauses and the pieces are spread over
    tasks.  Pauses are found on (key, slot) extremes, not on the hits.  Inside
    a piece, rows stream through in time order and only the accepted times of
    one window are held.
    """
    width = seconds * 1_000_000
    timed = hits.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("_slot", F.floor(F.col("_us") / width))
    slots = timed.groupBy(key, "_slot").agg(F.min("_us").alias("_lo"), F.max("_us").alias("_hi"))
    along = Window.partitionBy(key).orderBy("_slot")
    paused = F.coalesce(F.col("_lo") - F.lag("_hi").over(along) >= width, F.lit(True))
    pieces = (
        slots.withColumn("_cut", paused.cast("long"))
        .withColumn("_piece", F.sum("_cut").over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .select(key, "_slot", "_piece")
    )
    ordered = (
        timed.join(pieces, [key, "_slot"])
        .repartition(key, "_piece")
        .sortWithinPartitions(key, "_piece", "_us", tie)
    )
    columns = hits.columns
    schema = T.StructType([*hits.schema.fields, T.StructField("accepted", T.BooleanType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: deque = deque()
        current = None
        for batch in batches:
            verdicts = []
            for who, piece, at in zip(batch[key], batch["_piece"], batch["_us"]):
                if (who, piece) != current:
                    current, held = (who, piece), deque()
                verdicts.extend(_decide(iter([at]), held, limit, width))
            yield batch[columns].assign(accepted=verdicts)

    return ordered.mapInPandas(run, schema)


def admit_stream(stream: DataFrame, key: str, ts: str, tie: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """The same on a stream: state per key is at most ``limit`` accepted times.

    A micro-batch is ordered by time within a key; rows of later batches are
    judged in arrival order.  Bound the batch with the source's trigger options.
    """
    width = seconds * 1_000_000
    columns = [key, ts, tie]
    schema = T.StructType([*[stream.schema[c] for c in columns], T.StructField("accepted", T.BooleanType())])

    def run(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = deque(state.get[0] if state.exists else [])
        rows = pd.concat(list(batches)).sort_values([ts, tie])
        micros = rows[ts].astype("datetime64[us]").astype("int64")
        verdicts = list(_decide(iter(micros), held, limit, width))
        state.update((list(held),))
        yield rows[columns].assign(accepted=verdicts)

    return (
        stream.select(*columns)
        .groupBy(key)
        .applyInPandasWithState(run, schema, _STATE, "append", GroupStateTimeout.NoTimeout)
    )


class _Admission(StatefulProcessor):
    """Verdicts of one key in the order of event time.

    Hits wait in state until the watermark has passed them, so none that could
    come before them is still accepted.  There is a timer at the first one that
    waits; it judges all that the watermark has passed and is set anew.  When
    nothing waits and a whole window has passed, the key leaves no state.
    """

    def __init__(self, tie: T.DataType, limit: int, width: int):
        self.tie, self.limit, self.width = tie, limit, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("us", T.LongType()), T.StructField("tie", self.tie)]))
        self.accepted = handle.getValueState("accepted", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            us = batch["us"].tolist()
            self.waiting.appendList(list(zip(us, batch["tie"].tolist(), strict=True)))
            first = min(us) if first is None else min(first, min(us))
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(self.waiting.get())
        due = [hit for hit in waiting if hit[0] <= passed]
        held = deque(self.accepted.get()[0] if self.accepted.exists() else [])
        verdicts = list(_decide((us for us, _ in due), held, self.limit, self.width))
        if len(due) < len(waiting):
            self.waiting.put(waiting[len(due) :])
            self.handle.registerTimer(-(-waiting[len(due)][0] // 1000))
        else:
            self.waiting.clear()
        while held and held[0] <= passed - self.width:
            held.popleft()
        if held:
            self.accepted.update((list(held),))
            if len(due) == len(waiting):  # nothing else would come back to clear it
                self.handle.registerTimer(-(-(held[-1] + self.width) // 1000))
        else:
            self.accepted.clear()
        if due:
            yield pd.DataFrame({"who": [key[0]] * len(due), "us": [us for us, _ in due], "tie": [t for _, t in due], "accepted": verdicts})

    def close(self) -> None:
        pass


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit_events(
    stream: DataFrame, key: str, ts: str, tie: str, limit: int = 60, seconds: int = 60, delay: str = "10 minutes"
) -> DataFrame:
    """Verdicts on a stream that do not depend on how it is cut into micro-batches.

    Rows of a key are judged in the order of (ts, tie) as the watermark passes them;
    rows later than ``delay`` fall to the watermark, rows not yet passed are judged
    in a later batch.  The verdicts are those of ``admit`` over the same rows.  Per
    key the state holds the hits of about ``delay`` and the accepted ones of a window,
    and is dropped after a quiet window.  Needs the RocksDB state store, which is set
    for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    fields = stream.schema
    schema = T.StructType(
        [
            T.StructField("who", fields[key].dataType), T.StructField("us", T.LongType()),
            T.StructField("tie", fields[tie].dataType), T.StructField("accepted", T.BooleanType()),
        ]
    )
    # the state API hands on plain names only
    timed = stream.withWatermark(ts, delay).select(
        F.col(key).alias("who"), F.col(ts).alias("at"), F.col(tie).alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")
    )
    judged = timed.groupBy("who").transformWithStateInPandas(
        _Admission(fields[tie].dataType, limit, seconds * 1_000_000), schema, "append", "EventTime"
    )
    return judged.select(
        F.col("who").alias(key), F.timestamp_micros("us").cast(fields[ts].dataType).alias(ts), F.col("tie").alias(tie), "accepted"
    )
