"""Best-fit packing by a grouping genetic algorithm on islands.

Texts are encoded (end id last); only documents over the capacity are cut, the rest
of the division first and full pieces after it.  Full pieces are sequences of their
own.  The other pieces are dealt at random into shards of bounded size, and each shard
is evolved on several islands: crossover injects whole bins from among the fullest of one
parent into the other, bins that hold a duplicate are taken apart with a few of the emptiest,
displaced pieces replace shorter ones where that fills a bin better, and the rest is placed
by best fit, longest first.  An island goes on until ``STALL`` children in turn bring no
gain; between epochs each island sends its elite to the next.  Of the best island's bins the
fullest are kept, so many that their room adds up to less than half a sequence over all
shards (a quarter at the next level, and so on); the others are packed again with those of
other shards, until they fit one shard or no sequence is saved.

No shard grows with the input: more pieces make more shards.  A shard whose bins reach
the lower bound, ceil(sum / capacity), stops at once, as no packing has fewer.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as
documents of their own; equal lengths are placed in item order; an empty table gives no
rows; other columns are not carried.
"""

from __future__ import annotations

import bisect
import math
import random
import zlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import Workspace
from . import _text as tx
from .tokens import encoded, tokenizer_path

CAPACITY = 2048
SHARD_ITEMS = 4096
ISLANDS, EPOCHS, POPULATION, STALL = 2, 2, 6, 8
#: Of the bins in order of their load, the part that crossover injects from.
FULLEST = 0.4
LEVELS = 5


def pieces(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids."""
    model = tokenizer or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, n in encoded(batches, model, end_id):
            # the first piece of a document is what is left over, the others are full
            count = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), count)
            no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            short = (n - (count - 1) * capacity)[row]
            start, length = np.where(no == 0, 0, short + (no - 1) * capacity), np.where(no == 0, short, capacity)
            at = (np.cumsum(n) - n)[row] + start
            crc = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
            cols = [tx.column(part, "doc_id").take(pa.array(row)), pa.array(no, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                # pieces stand in text order, one after the other
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)).astype(np.int32)), pa.array(ids.astype(np.int32)))
                cols, names = [*cols, lists], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


class Packer:
    """The genetic operators over one shard; a solution is a list of bins, a bin a list of item numbers."""

    def __init__(self, lengths: list[int], capacity: int, seed: int):
        self.lengths, self.capacity, self.rnd = lengths, capacity, random.Random(seed)
        self.bound = -(-sum(lengths) // capacity)

    def load(self, group: list[int]) -> int:
        return sum(map(self.lengths.__getitem__, group))

    def best_fit(self, bins: list[list[int]], items: list[int]) -> list[list[int]]:
        """Places each item, in the given order, in the bin with the least room that holds it."""
        rooms: list[list[list[int]]] = [[] for _ in range(self.capacity + 1)]
        free = 0
        for group in bins:
            r = self.capacity - self.load(group)
            rooms[r].append(group)
            free |= 1 << r
        for i in items:
            n = self.lengths[i]
            if fits := free >> n:
                r = n + (fits & -fits).bit_length() - 1
                group = rooms[r].pop()
                if not rooms[r]:
                    free ^= 1 << r
            else:
                group, r = [], self.capacity
                bins.append(group)
            group.append(i)
            rooms[r - n].append(group)
            free |= 1 << (r - n)
        return bins

    def first(self, noise: float) -> list[list[int]]:
        keys = {i: n * (1 - noise * self.rnd.random()) for i, n in enumerate(self.lengths)}
        return self.best_fit([], sorted(keys, key=lambda i: (-keys[i], i)))

    def cost(self, bins: list[list[int]]) -> tuple[int, float]:
        """Fewer bins first, then fuller ones."""
        return len(bins), -sum((self.load(b) / self.capacity) ** 2 for b in bins)

    def cross(self, a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        full = sorted(b, key=lambda g: -self.load(g))[: max(1, int(FULLEST * len(b)))]
        take = [list(g) for g in self.rnd.sample(full, max(1, self.rnd.randint(len(full) // 4, len(full) // 2)))]
        owned = {i for g in take for i in g}
        keep = sorted((list(g) for g in a if owned.isdisjoint(g)), key=self.load)
        displaced = [i for g in a if not owned.isdisjoint(g) for i in g if i not in owned]
        emptiest = self.rnd.randint(1, 4)
        displaced += [i for g in keep[:emptiest] for i in g]
        return self.best_fit(take + keep[emptiest:], self.exchange(keep[emptiest:], displaced))

    def exchange(self, bins: list[list[int]], items: list[int]) -> list[int]:
        """Puts longer items in place of shorter ones, or of two, where they fit; returns what is out, longest first."""
        out = sorted(items, key=lambda i: (self.lengths[i], self.rnd.random()))
        sizes = [self.lengths[i] for i in out]
        for g in bins:
            room = self.capacity - self.load(g)
            if not room or not out:
                continue
            singles = [(self.lengths[i], (i,)) for i in g]
            pairs = [(self.lengths[x] + self.lengths[y], (x, y)) for k, x in enumerate(g) for y in g[k + 1 :]] if len(g) <= 8 else []
            gain, best, at = 0, (), -1
            for n, gone in singles + pairs:
                k = bisect.bisect_right(sizes, n + room) - 1  # the longest that fits there
                if k >= 0 and sizes[k] - n > gain:
                    gain, best, at = sizes[k] - n, gone, k
            if gain:
                g[:] = [i for i in g if i not in best] + [out.pop(at)]
                sizes.pop(at)
                for i in best:
                    k = bisect.bisect_right(sizes, self.lengths[i])
                    out.insert(k, i)
                    sizes.insert(k, self.lengths[i])
        return out[::-1]

    def evolve(self, elites: list[list[list[int]]]) -> list[list[int]]:
        population = list(elites) or [self.first(0.0)]
        while min(map(len, population)) > self.bound and len(population) < POPULATION:
            population.append(self.first(0.1 * len(population)))
        scored = sorted(((self.cost(p), k, p) for k, p in enumerate(population)), key=lambda x: x[:2])
        stall = born = 0
        while scored[0][0][0] > self.bound and len(scored) > 1 and stall < STALL:
            born, before = born + 1, scored[0][0]
            a, b = self.rnd.sample(scored, 2)
            child = self.cross(a[2], b[2])
            scored = sorted([*scored, (self.cost(child), POPULATION + born, child)], key=lambda x: x[:2])[:POPULATION]
            stall = 0 if scored[0][0] < before else stall + 1
        return scored[0][2]


_STATE = "shard long, island int, items array<long>, lengths array<int>, bins array<int>, n_bins int"


def _row(shard: int, island: int, items: np.ndarray, lengths: list[int], solution: list[list[int]]) -> pd.DataFrame:
    bins = np.zeros(len(items), np.int32)
    for k, g in enumerate(solution):
        bins[g] = k
    return pd.DataFrame({"shard": [shard], "island": [island], "items": [items.tolist()], "lengths": [list(lengths)], "bins": [bins.tolist()], "n_bins": [len(solution)]})


def _groups(bins) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, k in enumerate(bins):
        out.setdefault(int(k), []).append(i)
    return list(out.values())


def solve(items: DataFrame, n_shards: int, capacity: int, work: Workspace, level: int) -> DataFrame:
    """The best island's state for each shard of (item, length)."""

    def begin(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values("item")
        lengths = pdf["length"].astype(int).tolist()
        packer = Packer(lengths, capacity, shard * 1000 + island * 10)
        seeds = [packer.first(0.0 if island == 0 else 0.1 * island)]
        return _row(shard, island, pdf["item"].to_numpy(), lengths, packer.evolve(seeds))

    def go_on(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        shard, island = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["n_bins"], kind="stable")
        lengths = [int(x) for x in pdf["lengths"].iloc[0]]
        packer = Packer(lengths, capacity, shard * 1000 + island * 10 + 1)
        return _row(shard, island, np.asarray(pdf["items"].iloc[0]), lengths, packer.evolve([_groups(b) for b in pdf["bins"]]))

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(n_shards)).cast("long"))
    islands = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    # a few shards are little data and much work, so they are dealt to as many tasks
    tasks = min(n_shards * ISLANDS, 4 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    islands = islands.repartition(tasks, "shard", "island")
    state = work.table(islands.groupBy("shard", "island").applyInPandas(begin, _STATE), f"state-{level}-0")
    for epoch in range(1, EPOCHS):
        migrants = state.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        state = work.table(state.unionByName(migrants).groupBy("shard", "island").applyInPandas(go_on, _STATE), f"state-{level}-{epoch}")
    best = state.groupBy("shard").agg(F.min_by(F.struct("items", "lengths", "bins"), F.struct("n_bins", "island")).alias("s"))
    return best.select("shard", "s.*")


def _split(state: DataFrame, capacity: int, allowance: int) -> DataFrame:
    """A row for each item of the shards' states; ``full`` in the fullest bins of a shard, with ``allowance`` of room in all."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {k: [] for k in ("item", "length", "sequence_id", "offset", "full")}
            for r in batch.to_pylist():
                room = 0
                for g in sorted(_groups(r["bins"]), key=lambda g: -sum(r["lengths"][i] for i in g)):
                    sizes = [r["lengths"][i] for i in g]
                    room += capacity - sum(sizes)
                    ids = [r["items"][i] for i in g]
                    cols["item"] += ids
                    cols["length"] += sizes
                    cols["sequence_id"] += [min(ids)] * len(g)
                    cols["offset"] += (np.cumsum(sizes) - sizes).tolist()
                    cols["full"] += [room <= allowance] * len(g)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.bool_() if k == "full" else pa.int64()) for k, v in cols.items()], list(cols))

    return state.mapInArrow(split, "item long, length long, sequence_id long, offset long, full boolean")


def place(items: DataFrame, capacity: int, work: Workspace) -> DataFrame:
    """(item, sequence_id, offset) for all of (item, length); a sequence's number is its least item."""
    out, last = None, None
    for level in range(LEVELS):
        n = items.count()
        n_shards = max(1, math.ceil(n / SHARD_ITEMS))
        placed = work.table(_split(solve(items, n_shards, capacity, work, level), capacity, capacity // (n_shards << level + 1)), f"placed-{level}")
        done = n_shards == 1 or level == LEVELS - 1 or n_shards == last
        kept = placed if done else placed.filter("full")
        kept = kept.select("item", "sequence_id", "offset")
        out = kept if out is None else out.unionByName(kept)
        if done:
            return out
        items, last = placed.filter("not full").select("item", "length"), n_shards
    return out


def pack(docs: DataFrame, *, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None, keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids)."""
    work = Workspace(docs.sparkSession, "packing")
    cut = work.table(pieces(docs, capacity=capacity, end_id=end_id, tokenizer=tokenizer, keep_ids=keep_ids).withColumn("item", F.monotonically_increasing_id()), "pieces")
    cols = [c for c in cut.columns if c != "item"]
    whole = cut.filter(F.col("length") == capacity).select(*cols, F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    parts = cut.filter(F.col("length") < capacity)
    placed = place(parts.select("item", "length"), capacity, work)
    return whole.unionByName(parts.join(placed, "item").select(*cols, "sequence_id", "offset"))
