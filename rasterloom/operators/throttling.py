"""Keeping frames at least an interval apart, for keys of any size.

Whether a frame is kept depends on the last kept one, so a key is a chain.  Frames are sorted by
ranges of (key, time); within a range partition the next frame that may follow each frame is a
binary search, and chains that begin there are followed at once.  Only a key that goes on in the
next partition is open: from each of its frames that nothing in the partition may follow, a node
(key, least time of the next frame) leads to the partition where that time is met, and through it
to another node.  The nodes on the chain are found by pointer doubling, and each partition then
keeps the frames behind its node.  No task holds a key, and the rounds are the logarithm of the
partitions that a key spans.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import scans


def followers(us: np.ndarray, head: np.ndarray, step: int) -> np.ndarray:
    """For sorted times, in segments of equal ``head``: the first later row of the segment that is ``step`` on, or -1."""
    out = np.empty(len(us), np.int64)
    cuts = np.flatnonzero(np.diff(head, prepend=-1))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(us)], strict=True):
        at = np.maximum(np.searchsorted(us[a:b], us[a:b] + step), np.arange(1, b - a + 1))
        out[a:b] = np.where(at == b - a, -1, at + a)
    return out


def last_of(follow: np.ndarray) -> np.ndarray:
    """The row where the chain from each row ends."""
    at = np.where(follow >= 0, follow, np.arange(len(follow)))
    while True:
        on = at[at]
        if np.array_equal(on, at):
            return at
        at = on


def _chain(follow: list[int], start: int) -> list[int]:
    out = []
    while start >= 0:
        out.append(start)
        start = follow[start]
    return out


def throttle_frames(frames: DataFrame, interval_seconds: float, work: Workspace, key: str = "user_id") -> DataFrame:
    """(key, event_id, us): keeps a frame iff enough time has passed since the last kept one of its key; the first stays, and ties go by event_id."""
    step = int(interval_seconds * 1e6)
    us = frames.select(key, "event_id", F.unix_micros("ts").alias("us"))
    table = scans.ordered(us, [F.col(key).asc_nulls_first(), F.col("us"), F.col("event_id")], work, "frames")
    spans = table.groupBy(scans.PART, key).agg(F.min(scans.AT).alias("head"), F.max("us").alias("until"))
    ends = spans.groupBy(key).agg(F.min(scans.PART).alias("from"), F.max(scans.PART).alias("to"))
    spans = work.table(scans.null_safe_join(spans, ends, [key]), "spans")
    rows = work.table(scans.null_safe_join(table, spans.drop("until"), [scans.PART, key]), "rows")
    kind = dict(frames.dtypes)
    schema = f"`{key}` {kind[key]}, event_id {kind['event_id']}, us long, what int, t long"

    def out(got: pa.Table, at: np.ndarray, what: int, t: np.ndarray | None = None) -> pa.Table:
        n = len(at)
        part = got.select([key, "event_id", "us"]).take(pa.array(at, pa.int64()))
        return part.append_column("what", pa.array([what] * n, pa.int32())).append_column("t", pa.array(t, pa.int64()) if t is not None else pa.nulls(n, pa.int64()))

    def sorted_rows(got: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        got = got.sort_by(scans.AT).combine_chunks()
        times, head = got["us"].to_numpy(), got["head"].to_numpy()
        return got, times, followers(times, head, step)

    def first(group: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        """Kept rows of chains that begin here (0), nodes of an open key (1), and the node that its chain has, if it begins here (2)."""
        got, times, follow = sorted_rows(got)
        own, part = got["head"].to_numpy(), group[0].as_py()
        begins = np.flatnonzero((got[scans.AT].to_numpy() == own) & (got["from"].to_numpy() == part))
        as_list, kept, starts = follow.tolist(), [], []
        open_ = got["to"].to_numpy() > part
        for i in begins.tolist():
            chain = _chain(as_list, i)
            kept += chain
            if open_[i]:
                starts.append(chain[-1])
        leaves = np.flatnonzero(open_ & (follow < 0))
        leaves = leaves[np.unique(times[leaves], return_index=True)[1]]
        starts = np.array(starts, np.int64)
        return pa.concat_tables([out(got, np.array(kept, np.int64), 0), out(got, leaves, 1, times[leaves] + step), out(got, starts, 2, times[starts] + step)])

    found = work.table(rows.groupBy(scans.PART).applyInArrow(first, schema), "first")
    kept = found.filter("what = 0")
    nodes = found.filter("what = 1").select(key, "t").distinct()
    if nodes.isEmpty():
        return kept.select(key, "event_id", "us")
    # the partition in which a node's time is met: the first of the key that ends no earlier
    goals = spans.filter(F.col("from") < F.col("to")).select(key, F.col("until").alias("t"), F.col(scans.PART).alias("goal"))
    asked = goals.unionByName(nodes.withColumn("goal", F.lit(None).cast("int"))).withColumn("asks", F.col("goal").isNull())
    met = scans.running(asked, [key], [F.col("t").desc(), F.col("asks")], {"in_part": (F.min, "goal")}, work, "met")
    placed = work.table(met.filter("asks and in_part is not null").select(key, "t", F.col("in_part").alias(scans.PART)), "placed")

    def entries(got: pa.Table, ask: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The first row of each node here; the key that comes from before is the first of the partition."""
        got, times, follow = sorted_rows(got)
        n = int((got["head"].to_numpy() == got["head"][0].as_py()).sum())
        return got, times, follow, np.searchsorted(times[:n], ask["t"].to_numpy())

    def pass_on(group: tuple[pa.Scalar, ...], got: pa.Table, ask: pa.Table) -> pa.Table:
        """Node to node, through this partition."""
        if not ask.num_rows:
            return pa.table({key: got[key].slice(0, 0), "t": pa.array([], pa.int64()), "to": pa.array([], pa.int64())})
        got, times, follow, at = entries(got, ask)
        return pa.table({key: ask[key], "t": ask["t"], "to": pa.array(times[last_of(follow)[at]] + step)})

    by_part = rows.join(F.broadcast(placed.select(scans.PART).distinct()), scans.PART, "left_semi").groupBy(scans.PART)  # a number for each range partition at most
    edges = work.table(by_part.cogroup(placed.groupBy(scans.PART)).applyInArrow(pass_on, f"`{key}` {kind[key]}, t long, to long"), "edges-0")
    reached, jumps, step_no = found.filter("what = 2").select(key, "t"), edges, 0
    reached = work.table(reached, "reached-0")
    while True:
        step_no += 1
        ahead = scans.null_safe_join(reached, jumps, [key, "t"]).select(key, F.col("to").alias("t"))
        more = work.table(reached.unionByName(ahead).distinct(), f"reached-{step_no}")
        if more.count() == reached.count():
            break
        reached = more
        second = jumps.select(key, F.col("t").alias("to"), F.col("to").alias("_on"))
        jumps = work.table(scans.null_safe_join(jumps, second, [key, "to"]).select(key, "t", F.col("_on").alias("to")), f"edges-{step_no}")

    def keep(group: tuple[pa.Scalar, ...], got: pa.Table, ask: pa.Table) -> pa.Table:
        if not ask.num_rows:
            return out(got, np.zeros(0, np.int64), 0)
        got, times, follow, at = entries(got, ask)
        as_list = follow.tolist()
        return out(got, np.array(sorted({i for start in at.tolist() for i in _chain(as_list, start)}), np.int64), 0)

    on_chain = scans.null_safe_join(placed, reached, [key, "t"])
    later = by_part.cogroup(on_chain.groupBy(scans.PART)).applyInArrow(keep, schema)
    return kept.unionByName(later).select(key, "event_id", "us")
