"""Connected regions of pixel masks by a two-level union-find.

Pixels are packed in Spark to bit rows of square blocks.  One Arrow pass labels each block by
itself, on its horizontal runs; after that only runs at a block's border matter.  Their
adjacency across borders is a graph of block regions, and only that small graph goes through
rounds of least labels with pointer jumps, so that pixels are shuffled once and the rounds
depend on the blocks that a region crosses, not on its pixels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace

#: A block's side: a row of it is one 64-bit word.
BLOCK = 64


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component, for edges a-b: hooking to the lesser root, then flattening."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        open_ = ra != rb
        if not open_.any():
            return root
        np.minimum.at(root, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def label_blocks(block: np.ndarray, y: np.ndarray, word: np.ndarray, eight: bool) -> tuple[np.ndarray, ...]:
    """Runs of many blocks at once: (row of the input, first x, last x, root run), x within the block.

    The input has a bit row (block, y, word) each, sorted by block and y.
    """
    bits = np.unpackbits(np.ascontiguousarray(word).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    before = np.zeros_like(bits)
    before[:, 1:] = bits[:, :-1]
    after = np.zeros_like(bits)
    after[:, :-1] = bits[:, 1:]
    row, first = np.nonzero(bits & ~before)
    last = np.nonzero(bits & ~after)[1]
    run = np.cumsum(bits & ~before).reshape(bits.shape) - 1
    upper = np.flatnonzero((block[1:] == block[:-1]) & (y[1:] == y[:-1] + 1))
    a, b = [], []
    for shift in (-1, 0, 1) if eight else (0,):
        top, bottom = slice(max(0, -shift), BLOCK - max(0, shift)), slice(max(0, shift), BLOCK - max(0, -shift))
        i, x = np.nonzero(bits[upper, top] & bits[upper + 1, bottom])
        a.append(run[upper[i], x + top.start])
        b.append(run[upper[i] + 1, x + bottom.start])
    return row, first, last, _roots(len(row), np.concatenate(a), np.concatenate(b))


def block_runs(mask: DataFrame, keys: list[str], width: int, eight: bool) -> DataFrame:
    """(keys, y, x0, x1, root): the horizontal runs of every block, with the least node of their region within it."""
    cell = lambda c: F.floor(F.col(c) / BLOCK).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.col("x"), F.lit(BLOCK)).cast("int"))
    words = mask.groupBy(*keys, cell("x").alias("_bx"), cell("y").alias("_by"), "y").agg(F.bit_or(bit).alias("word"))
    blocks = words.groupBy(*keys, "_bx", "_by").agg(F.array_sort(F.collect_list(F.struct(F.col("y").cast("int").alias("y"), "word"))).alias("rows"))
    kinds = dict(mask.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "y int, x0 int, x1 int, root long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                rows = batch.column("rows")
                sizes, flat = rows.value_lengths().to_numpy(), rows.flatten()
                y, word = flat.field("y").to_numpy(), flat.field("word").to_numpy()
                block = np.repeat(np.arange(batch.num_rows), sizes)
                at, first, last, root = label_blocks(block, y, word, eight)
                left = batch.column("_bx").to_numpy()[block[at]].astype(np.int64) * BLOCK
                node = y[at].astype(np.int64) * width + left + first
                least = np.full(len(node), np.iinfo(np.int64).max)
                np.minimum.at(least, root, node)
                own = [batch.column(k).take(pa.array(block[at])) for k in keys]
                ends = [pa.array((left + e).astype(np.int32)) for e in (first, last)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(y[at].astype(np.int32)), *ends, pa.array(least[root])], [*keys, "y", "x0", "x1", "root"])

    return blocks.select(*keys, "_bx", "rows").mapInArrow(run, schema)


def _across(runs: DataFrame, keys: list[str], eight: bool) -> DataFrame:
    """(keys, a, b): block regions that touch across a border, a pair once at least."""
    edge = BLOCK - 1
    side = (-1, 0, 1) if eight else (0,)
    to = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    right = F.when(F.pmod(F.col("x1"), F.lit(BLOCK)) == edge, F.array(*(to(F.col("x1") + 1, F.col("y") + d) for d in side))).otherwise(F.array().cast("array<struct<x: int, y: int>>"))
    reach = 1 if eight else 0
    below = F.transform(F.sequence(F.col("x0") - reach, F.col("x1") + reach), lambda x: to(x, F.col("y") + 1))
    below = F.when(F.pmod(F.col("y"), F.lit(BLOCK)) == edge, below).otherwise(F.array().cast("array<struct<x: int, y: int>>"))
    asks = runs.select(*keys, F.col("root").alias("a"), F.explode(F.array_union(right, below)).alias("p")).select(*keys, "a", "p.x", "p.y")
    # the pixels that can be asked for: first columns, first rows, and by the diagonals last columns and rows of the neighbours
    border = F.when(F.pmod(F.col("y"), F.lit(BLOCK)) == 0, F.sequence("x0", "x1")).otherwise(F.filter(F.array("x0"), lambda x: F.pmod(x, F.lit(BLOCK)) == 0))
    edges = runs.select(*keys, F.col("root").alias("b"), "y", F.explode(border).alias("x"))
    return asks.join(edges, [*keys, "x", "y"]).filter("a <> b").select(*keys, "a", "b").distinct()


def _merge(pairs: DataFrame, keys: list[str], work: Workspace) -> DataFrame:
    """(keys, root, label) of all nodes of a written graph: least labels of neighbours and a pointer jump, a written table each round."""
    both = work.table(pairs.unionByName(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))), "both")
    labels = work.table(both.select(*keys, F.col("a").alias("root"), F.col("a").alias("label")).distinct(), "label-0")
    step = 0
    while True:
        step += 1
        other = labels.select(*keys, F.col("root").alias("b"), F.col("label").alias("_l"))
        least = both.join(other, [*keys, "b"]).groupBy(*keys, F.col("a").alias("root")).agg(F.min("_l").alias("_near"))
        moved = labels.join(least, [*keys, "root"]).withColumn("to", F.least("label", "_near"))
        jump = moved.select(*keys, F.col("root").alias("to"), F.col("to").alias("_far"))
        new = moved.join(jump, [*keys, "to"]).select(*keys, "root", F.col("_far").alias("label"), (F.col("_far") != F.col("label")).alias("_moved"))
        new = work.table(new, f"label-{step}")
        labels = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return labels


def label_components(mask: DataFrame, keys: list[str], work: Workspace, width: int, eight: bool = True) -> DataFrame:
    """(keys, x, y, label): label is the least y * width + x of the connected region; a pixel that is there twice comes once."""
    runs = work.table(block_runs(mask.select(*keys, "x", "y"), keys, width, eight), "runs")
    pairs = work.table(_across(runs, keys, eight), "pairs")
    if not pairs.isEmpty():
        runs = runs.join(_merge(pairs, keys, work), [*keys, "root"], "left").withColumn("root", F.coalesce("label", "root"))
    return runs.select(*keys, F.explode(F.sequence("x0", "x1")).alias("x"), "y", F.col("root").alias("label"))
