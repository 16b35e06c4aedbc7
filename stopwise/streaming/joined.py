"""Both realtime feeds as streams, joined on the way, and the gaps of a feed as they become final.

Every operator appends: a row leaves once the watermark has passed its snapshot, and its state goes
with it, so state holds the snapshots of one delay, whatever the length of the stream. Rows that
come later than the delay are not taken; the micro-batch job and the batch marts take them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from stopwise.plans import events
from stopwise.streaming.realtime import WATERMARK

DELAY = WATERMARK


def merge_streams(updates: DataFrame, positions: DataFrame, delay: str = DELAY) -> DataFrame:
    """The stream-to-stream form of ``events.merge_feeds``: the latest event per snapshot and trip.

    The full outer join of both feeds on snapshot, trip and route is one grouping of their union,
    which the watermarks of both bound: each side brings its candidates of a key, and state holds
    them once. A stream join would hold every row again in four stores of its own. Rows
    without a trip or a route match nothing, as in the batch form: there the sides have keys apart.
    """
    sides = []
    for feed, rows in ((updates, events.UPDATE_ROWS), (positions, events.POSITION_ROWS)):
        alone = F.when(F.col("trip_id").isNull() | F.col("route_id").isNull(), len(sides)).alias("alone")
        candidates = [F.expr(row).alias(name) for name, row in rows.items()]
        sides.append(feed.withWatermark("feed_ts_utc", delay).select(*events.KEYS, alone, *candidates))
    names = [*events.UPDATE_ROWS, *events.POSITION_ROWS]
    return (
        sides[0].unionByName(sides[1], allowMissingColumns=True)
        .groupBy(*events.KEYS, "alone").agg(*[F.max(n).alias(n) for n in names])
        .selectExpr("feed_ts_utc", "trip_id", f"{events.best_event(updates)} as best")
        .groupBy("feed_ts_utc", "trip_id").agg(F.max("best").alias("best"))
        .selectExpr("feed_ts_utc", "trip_id", "best.*")
    )


def gaps(updates: DataFrame, minutes: int = 5, delay: str = DELAY) -> DataFrame:
    """Starts of the windows between a feed's first and latest final ones in which nothing came.

    The windows that did occur are counted in parallel and leave in the order of the watermark. One
    state per feed keeps the last of them, and what lies between it and the next is missing: a
    feed has a row per window there, however many rows came in it.
    """
    step = minutes * 60 * 1_000_000
    seen = (
        updates.withWatermark("feed_ts_utc", delay)
        .groupBy(F.window("feed_ts_utc", f"{minutes} minutes").alias("w"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("updates").alias("feed"), F.unix_micros("w.start").alias("start"))
    )

    found = seen.groupBy("feed").transformWithStateInPandas(
        Missing(step), "missing long", outputMode="Append", timeMode="None"
    )
    return found.select(F.timestamp_micros("missing").alias("missing_from"))


class Missing(StatefulProcessor):
    """The starts that are absent between those of a feed, ``step`` microseconds apart."""

    def __init__(self, step: int) -> None:
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        starts = sorted(int(x) for frame in rows for x in frame["start"])
        last = self.last.get()[0] if self.last.exists() else starts[0]
        out: list[int] = []
        for start in starts:
            out.extend(range(last + self.step, start, self.step))
            last = max(last, start)
        self.last.update((last,))
        yield pd.DataFrame({"missing": pd.Series(out, dtype="int64")})

    def close(self) -> None:
        pass


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is final to a table, all there is now; the sink commits each batch once.

    State is kept in RocksDB, outside of the heap; a checkpoint stays with the store it began with.
    """
    conf, key = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        conf.set(key, before)
