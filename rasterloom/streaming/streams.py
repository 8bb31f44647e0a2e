"""The three live loops, each as a batch form and a Structured Streaming form over the same logic."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructField, StructType

from ..operators.raster import profile
from ..workspace import finished, remove

WATERMARK = "10 minutes"


def throttle(times: list[int], last: int | None, interval: int) -> tuple[list[bool], int | None]:
    """Which of the sorted times are kept: each at least ``interval`` after the last kept one."""
    kept = []
    for t in times:
        ok = last is None or t - last >= interval
        kept.append(ok)
        last = t if ok else last
    return kept, last


class _Throttle(StatefulProcessor):
    """Keeps the time of the last kept frame of a key."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last_kept", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "event_id"])
        last = self.last.get()[0] if self.last.exists() else None
        kept, last = throttle(pdf["us"].tolist(), last, self.step)
        self.last.update((last,))
        yield pdf[kept]

    def close(self) -> None:
        pass


def throttle_stream(frames: DataFrame, interval_seconds: float, key: str = "user_id") -> DataFrame:
    """A stream of (key, event_id, ts) with at least the interval between kept frames; needs the RocksDB state store."""
    us = frames.withWatermark("ts", WATERMARK).select(key, "event_id", F.unix_micros("ts").alias("us"))
    schema = f"{key} long, event_id long, us long"
    return us.groupBy(key).transformWithStateInPandas(statefulProcessor=_Throttle(int(interval_seconds * 1e6)), outputStructType=schema, outputMode="Append", timeMode="None")


def markers(lines: DataFrame) -> DataFrame:
    """(feed, first, second): the trimmed first two lines of each feed (feed, line_no, line), the state to compare with later."""
    head = lines.groupBy("feed").agg(F.min(F.struct("line_no", F.trim("line").alias("line"))).alias("a"))
    after = lines.join(head, "feed").filter(F.col("line_no") > F.col("a.line_no")).groupBy("feed").agg(F.min(F.struct("line_no", F.trim("line").alias("line"))).alias("b"))
    return head.join(after, "feed", "left").select("feed", F.col("a.line").alias("first"), F.col("b.line").alias("second"))


def new_changes(lines: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines (feed, line_no, line), newest first, above the stored marker (feed, first, second).

    The lines are new down to the stored first line; where that is still on top, as a day's headline
    is, down to the stored second one; and none is where both are on top.  A feed without a marker,
    or whose marker is gone, is new as a whole.
    """
    both = markers(lines).withColumnsRenamed({"first": "_first", "second": "_second"}).join(stored, "feed")
    same = F.col("_first") == F.col("first")
    stop = both.select("feed", F.when(same, F.col("second")).otherwise(F.col("first")).alias("_stop"), (same & F.col("_second").eqNullSafe(F.col("second"))).alias("_none"))
    marked = lines.join(stop, "feed")
    cut = marked.groupBy("feed", "_none").agg(F.min(F.when(F.trim("line") == F.col("_stop"), F.col("line_no"))).alias("_at"))
    out = lines.join(cut, "feed", "left").filter(~F.coalesce("_none", F.lit(False)) & (F.col("_at").isNull() | (F.col("line_no") < F.col("_at"))))
    return out.select("feed", "line_no", "line")


class MarkerStore:
    """The last order value seen of each key, as small tables in a folder that outlives any checkpoint.

    Each batch adds a table with the keys that it moved; after ``compact_after`` tables they are
    merged to one, with a row a key, and the merged ones are removed.  Only finished tables count.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, compact_after: int = 8):
        self.spark, self.path, self.keys, self.order, self.compact_after = spark, path, keys, order, compact_after

    def read(self, schema: StructType) -> DataFrame:
        """(keys, _mark); ``schema`` is that of the rows."""
        kinds = StructType([*(schema[k] for k in self.keys), StructField("_mark", schema[self.order].dataType)])
        names = [n for n in finished(self.spark, self.path) if n.startswith("marks-")]
        if not names:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*(f"{self.path}/{n}" for n in names)).groupBy(*self.keys).agg(F.max("_mark").alias("_mark"))

    def advance(self, rows: DataFrame) -> None:
        names = [n for n in finished(self.spark, self.path) if n.startswith("marks-")]
        at = int(names[-1].split("-")[1]) + 1 if names else 0
        moved = rows.groupBy(*self.keys).agg(F.max(self.order).alias("_mark"))
        merge = len(names) >= self.compact_after
        if merge:
            moved = moved.unionByName(self.read(rows.schema)).groupBy(*self.keys).agg(F.max("_mark").alias("_mark"))
        moved.write.mode("overwrite").parquet(f"{self.path}/marks-{at:012d}")
        for n in names if merge else []:
            remove(self.spark, f"{self.path}/{n}")


def above_marks(rows: DataFrame, marks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose order value is beyond the mark of their key, each once; all rows of keys without one."""
    joined = rows.join(marks, keys, "left").filter(F.col("_mark").isNull() | (F.col(order) > F.col("_mark")))
    return joined.drop("_mark").dropDuplicates([*keys, order])


def new_changes_stream(feed: DataFrame, state_path: str, keys: list[str], order: str, emit: Callable[[DataFrame], None], checkpoint: str):
    """Starts a query that hands each batch's rows above the stored marks to ``emit`` and moves the marks.

    The marks decide, not the number of the batch, so a query with a new checkpoint reads its
    source from the start and emits nothing again.  A batch that fails between the two steps is
    emitted again.  A row that comes after a later one of its key counts as seen.
    """
    store = MarkerStore(feed.sparkSession, state_path, keys, order)

    def step(batch: DataFrame, epoch: int) -> None:
        new = above_marks(batch, store.read(batch.schema), keys, order)
        new.write.mode("overwrite").parquet(f"{state_path}/new")  # one evaluation for both readers
        new = batch.sparkSession.read.schema(batch.schema).parquet(f"{state_path}/new")
        emit(new)
        if not new.isEmpty():
            store.advance(new)

    return feed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Pixels of an image that is broadcast to the events at most.
LIVE_PIXELS = 4_000_000


def live_profile(events: DataFrame, image: DataFrame) -> DataFrame:
    """The profile of the image for each region event (roi_id, kind, verts), as in ``profile``; a kind that has none gives an empty row.  Works on a stream of events in update mode.

    An image of ``LIVE_PIXELS`` at most is broadcast, so events stay where they are; a larger one is joined by its places.
    """
    small = image.limit(LIVE_PIXELS + 1).count() <= LIVE_PIXELS
    return profile(F.broadcast(image) if small else image, events, [])
