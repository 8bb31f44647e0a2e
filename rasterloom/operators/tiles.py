"""Nearest tiles: blocked search over packed tiles.

A tile is packed to one row with its values in raster order.  Templates are broadcast in passes
of fixed size, and each pass is one scan of the packed database without a shuffle: a task keeps
the k best of every template that it has met so far and sends on those alone.  A database tile
is compared in full only where a lower bound, from sums over small blocks of pixels, is not
above the k-th best yet: (sum of differences)^2 is at most n times the sum of squares, for n
pixels.  Ties go to the lesser database id, so results don't depend on partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Pixels of the templates of a pass, and cells of a comparison of templates and database tiles.
PASS_PIXELS, CELLS = 2_000_000, 2_000_000
NO_ID = np.iinfo(np.int64).max
FOUND = "tile long, distance long, db long"


def pack(pixels: DataFrame, key: str, width: int, height: int, value: str = "val") -> DataFrame:
    """(id, v): the values of each tile (key, x, y, value) in raster order; a tile with missing or repeated pixels is an error."""
    place = (F.col("y") * width + F.col("x")).alias("p")
    one = pixels.groupBy(F.col(key).cast("long").alias("id")).agg(F.array_sort(F.collect_list(F.struct(place, F.col(value).cast("int").alias("v")))).alias("t"))
    whole = F.col("t.p") == F.sequence(F.lit(0), F.lit(width * height - 1))
    bad = F.raise_error(F.concat(F.lit("not a whole tile: "), F.col("id").cast("string"))).cast("array<int>")
    return one.select("id", F.when(whole, F.col("t.v")).otherwise(bad).alias("v"))


class Tiles:
    """Some tiles as a matrix, with the sums over blocks of ``bw`` x ``bh`` pixels."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, width: int, height: int):
        bw, bh = (4 if width % 4 == 0 else width), (4 if height % 4 == 0 else height)
        self.ids, self.v, self.cell = ids, v.astype(np.float64), bw * bh
        self.sums = self.v.reshape(len(ids), height // bh, bh, width // bw, bw).sum(axis=(2, 4)).reshape(len(ids), -1)

    def take(self, at: np.ndarray | slice) -> Tiles:
        out = object.__new__(Tiles)
        out.ids, out.v, out.cell, out.sums = self.ids[at], self.v[at], self.cell, self.sums[at]
        return out


def _matrix(batch: pa.RecordBatch, width: int, height: int) -> Tiles:
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False)
    return Tiles(batch.column("id").to_numpy(zero_copy_only=False), v.reshape(batch.num_rows, width * height), width, height)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; exact, as sums of products of small integers are below 2^53."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)


class Best:
    """The k best (distance, id) of each template, beyond (after, after_id) in that order."""

    def __init__(self, n: int, k: int, after: np.ndarray, after_id: np.ndarray):
        self.k, self.after, self.after_id = k, after, after_id
        self.d, self.id = np.full((n, k), np.inf), np.full((n, k), NO_ID)

    def meet(self, templates: Tiles, part: Tiles) -> None:
        """Takes in some tiles of the database."""
        bound = squared(templates.sums, part.sums) <= self.d[:, -1:] * templates.cell
        bound &= templates.ids[:, None] != part.ids[None, :]
        t, b = np.nonzero(bound)
        if 4 * len(t) > bound.size:
            d = squared(templates.v, part.v)[t, b]
        else:
            d = np.concatenate([((templates.v[t[i : i + 65536]] - part.v[b[i : i + 65536]]) ** 2).sum(1) for i in range(0, len(t), 65536)] or [np.zeros(0)])
        ids = part.ids[b]
        use = (d > self.after[t]) | (d == self.after[t]) & (ids > self.after_id[t])
        t, d, ids = (np.concatenate([np.repeat(np.arange(len(self.d)), self.k), t[use]]), np.concatenate([self.d.ravel(), d[use]]), np.concatenate([self.id.ravel(), ids[use]]))
        order = np.lexsort((ids, d, t))
        place = np.arange(len(t)) - np.searchsorted(t[order], t[order])
        kept = order[place < self.k]
        self.d, self.id = d[kept].reshape(-1, self.k), ids[kept].reshape(-1, self.k)


def _passes(templates: DataFrame, pixels: int) -> Iterator[Broadcast]:
    """The templates (id, v, after, after_id) as broadcast tables of bounded size."""
    spark = templates.sparkSession
    passes = -(-templates.count() * pixels // PASS_PIXELS)
    for p in range(passes):
        part = templates.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == p) if passes > 1 else templates
        yield spark.sparkContext.broadcast(part.toArrow().combine_chunks())


def _union(parts: list[DataFrame], schema: str, like: DataFrame) -> DataFrame:
    if not parts:
        return like.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def distances(templates: DataFrame, database: DataFrame, width: int, height: int) -> DataFrame:
    """(tile, db, distance) of every packed template and every packed tile but itself."""

    def pass_(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = _matrix(sent.value.to_batches()[0], width, height)
            step = max(1, CELLS // len(own.ids))
            for batch in batches:
                for lo in range(0, batch.num_rows, step):
                    part = _matrix(batch.slice(lo, step), width, height)
                    t, b = np.nonzero(own.ids[:, None] != part.ids[None, :])
                    d = squared(own.v, part.v)[t, b].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own.ids[t]), pa.array(part.ids[b]), pa.array(d)], ["tile", "db", "distance"])

        return database.mapInArrow(run, "tile long, db long, distance long")

    return _union([pass_(s) for s in _passes(templates, width * height)], "tile long, db long, distance long", database)


def nearest(templates: DataFrame, database: DataFrame, width: int, height: int, k: int = 1) -> DataFrame:
    """(tile, list): the k nearest (distance, db) of each packed template (id, v, after, after_id), beyond the given one, nearest first."""

    def pass_(sent: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            batch = sent.value.to_batches()[0]
            own = _matrix(batch, width, height)
            best = Best(len(own.ids), k, batch.column("after").to_numpy(zero_copy_only=False).astype(np.float64), batch.column("after_id").to_numpy(zero_copy_only=False))
            step, first = max(1, CELLS // len(own.ids)), 256  # a small part first, for a bound
            for whole in batches:
                lo = 0
                while lo < whole.num_rows:
                    best.meet(own, _matrix(whole.slice(lo, min(first, step)), width, height))
                    lo, first = lo + min(first, step), step
            t, j = np.nonzero(best.id != NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[t]), pa.array(best.d[t, j].astype(np.int64)), pa.array(best.id[t, j])], ["tile", "distance", "db"])

        return database.mapInArrow(run, FOUND)

    found = _union([pass_(s) for s in _passes(templates, width * height)], FOUND, database)
    if k == 1:
        return found.groupBy("tile").agg(F.array(F.min(F.struct("distance", "db"))).alias("list"))
    return found.groupBy("tile").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "db"))), 1, k).alias("list"))


def _start(templates: DataFrame) -> DataFrame:
    return templates.select("id", "v", F.lit(-1).cast("long").alias("after"), F.lit(-1).cast("long").alias("after_id"))


def tile_distance(template: DataFrame, database: DataFrame, work: Workspace, width: int, height: int, value: str = "val") -> DataFrame:
    """(tile, db, distance): sum of squared differences of every template (tile, x, y, value) and database tile (db, x, y, value) of another id."""
    own = work.table(pack(template, "tile", width, height, value), "templates")
    return distances(own, work.table(pack(database, "db", width, height, value), "tiles"), width, height)


def best_match(template: DataFrame, database: DataFrame, work: Workspace, width: int, height: int, value: str = "val") -> DataFrame:
    """(tile, db, distance) of the nearest database tile of another id, ties to the lesser one."""
    own = work.table(pack(template, "tile", width, height, value), "templates")
    found = nearest(_start(own), work.table(pack(database, "db", width, height, value), "tiles"), width, height)
    return found.select("tile", F.col("list")[0]["db"].alias("db"), F.col("list")[0]["distance"].alias("distance"))


def assign(want: DataFrame, ask: Callable[[DataFrame, int], DataFrame], work: Workspace, k: int = 16) -> DataFrame:
    """(tile, db, distance) with each db given once: tiles choose in ascending order, each the nearest that is left.

    Deferred acceptance: every tile holds a place in its own list of nearest ones; where several
    hold the same one the lowest tile stays and the others go a place down.  A list that is used up
    is filled again with the next ``k``; a tile for which nothing is left has no row.
    ``ask(tiles (tile, after, after_id), k)`` gives (tile, list of (distance, db)).  A round moves a
    row for each tile, never pairs; there are as many as the longest chain of displacements.
    """
    first = want.select("tile", F.lit(-1).cast("long").alias("after"), F.lit(-1).cast("long").alias("after_id"))
    state, step = work.table(ask(first, k).select("tile", "list", F.lit(0).alias("at")), "lists-0"), 0
    while True:
        step += 1
        holds = state.withColumn("db", F.col("list")[F.col("at")]["db"])
        winners = holds.groupBy("db").agg(F.min("tile").alias("tile")).select("tile", F.lit(True).alias("_stays"))
        moved = holds.drop("db").join(winners, "tile", "left").withColumn("_moves", F.col("_stays").isNull()).drop("_stays")
        moved = work.table(moved.withColumn("at", F.col("at") + F.col("_moves").cast("int")), f"round-{step}")
        if moved.filter("_moves").isEmpty():
            return moved.select("tile", F.col("list")[F.col("at")]["db"].alias("db"), F.col("list")[F.col("at")]["distance"].alias("distance"))
        used = F.col("at") >= F.size("list")
        state, empty = moved.filter(~used).drop("_moves"), moved.filter(used)
        if not empty.isEmpty():
            last = F.element_at("list", -1)
            more = ask(empty.select("tile", last["distance"].alias("after"), last["db"].alias("after_id")), k)
            state = work.table(state.unionByName(more.select("tile", "list", F.lit(0).alias("at"))), f"lists-{step}")


def best_match_unique(template: DataFrame, database: DataFrame, work: Workspace, width: int, height: int, value: str = "val", k: int = 16) -> DataFrame:
    """(tile, db, distance): each database tile at most once, templates served in ascending order."""
    own = work.table(pack(template, "tile", width, height, value), "templates")
    base = work.table(pack(database, "db", width, height, value), "tiles")

    def ask(tiles: DataFrame, k: int) -> DataFrame:
        return nearest(own.join(tiles.withColumnRenamed("tile", "id"), "id"), base, width, height, k)

    return assign(own.select(F.col("id").alias("tile")), ask, work, k)


def listed(pairs: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """``ask`` over a table of (tile, db, distance)."""

    def ask(tiles: DataFrame, k: int) -> DataFrame:
        beyond: Column = F.expr("distance > after or distance = after and db > after_id")
        left = pairs.join(tiles, "tile").filter(beyond)
        return left.groupBy("tile").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "db"))), 1, k).alias("list"))

    return ask
