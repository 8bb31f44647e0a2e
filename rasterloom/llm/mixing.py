"""Mixing sources to target weights by pivotal dependent rounding.

Every text of a source is to be taken ``target / source_size`` times, which is 2 at most.
The whole part is certain.  The fractions are rounded dependently: two texts of about the
same size meet, words are moved from one to the other at random until one of them is
taken wholly or not at all, and the other goes on.  The two outcomes of a meeting have
the probabilities that leave every text's expected share as it was, and the words of the
two stay the same in sum.

The meetings are a reduction tree.  A source's texts are dealt to chunks of bounded size
by a hash of their ids (small sources share a chunk); a chunk leaves one text undecided
for each class of sizes (powers of two), 64 chunks' undecided texts meet in the next
round, and so on, each round a written table.  Of what is left of a source in the end, one
text a size class, the largest is rounded to the nearest first, and each passes its error on
to the next smaller one, so that the words taken miss the target by half of the largest text
at most, and usually by about a small one.

Defined cases: a null, empty or blank text has size 0 and is never taken; null is a source of
its own, the last one; rows that repeat a doc_id are rounded each for itself; an empty table
gives no rows; other columns, whatever their names, are ignored by ``decide`` and kept by
``mixed``.  The choice depends on ids, sizes and the seed alone, not on partitions or
batches, so reruns agree; where rows agree in doc_id and size, any of them may be the one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scans
from ..workspace import Workspace
from . import _text as tx

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2
#: Texts of a chunk on average, and undecided chunks that meet in a round.
CHUNK_ROWS, FAN_IN = 4096, 64
_STATE = "tree long, chunk long, rank long, h long, size long, mass double, open boolean"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, max_copies: int = MAX_COPIES) -> DataFrame:
    """``sources`` (source_size, weight) with ``target`` and ``copies``, the target over the size.

    Every source gets ``level * weight`` words, or ``max_copies`` times its size if that is less.
    The level rises until the targets add up to the share; each round is one aggregate over the
    sources, and there are as many as times that an excess is shared anew.
    """
    cap = F.col("source_size") * max_copies
    total = (sources.agg(F.sum("source_size")).first()[0] or 0) * share
    level, last = 0.0, -1.0
    while level != last:
        full = cap < F.lit(level) * F.col("weight")
        got = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("full"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        last, level = level, max(level, (total - got.full) / got.weight) if got.weight else level
    full = cap < F.lit(level) * F.col("weight")
    out = sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.lit(level) * F.col("weight")))
    return out.withColumn("copies", F.when(full, F.lit(float(max_copies))).when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def _uniform(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    h = tx.mix(a.view(np.uint64) ^ tx.mix(b.view(np.uint64) + np.uint64(seed)))
    return (h >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def settle(rank: np.ndarray, h: np.ndarray, size: np.ndarray, mass: np.ndarray, seed: int) -> np.ndarray:
    """Words of each text after texts of a source and size class have met in pairs until one of them is undecided."""
    mass, kind = mass.copy(), np.frexp(size.astype(np.float64))[1]
    live = np.lexsort((size, h, kind, rank))
    while True:
        live = live[(mass[live] > 0) & (mass[live] < size[live])]
        head = np.ones(len(live), bool)
        head[1:] = (rank[live][1:] != rank[live][:-1]) | (kind[live][1:] != kind[live][:-1])
        start = np.flatnonzero(head)
        place = np.arange(len(live)) - np.repeat(start, np.diff([*start, len(live)]))
        first = np.flatnonzero(place[1:] % 2 == 1)
        if not len(first):
            return mass
        i, j = live[first], live[first + 1]
        up, down = np.minimum(size[i] - mass[i], mass[j]), np.minimum(mass[i], size[j] - mass[j])
        gains = _uniform(h[i], h[j], seed) * (up + down) < down
        i, j, moved = np.where(gains, i, j), np.where(gains, j, i), np.where(gains, up, down)
        filled, emptied = moved >= size[i] - mass[i], moved >= mass[j]
        mass[i], mass[j] = np.where(filled, size[i], mass[i] + moved), np.where(emptied, 0.0, mass[j] - moved)


def round_rest(rank: np.ndarray, h: np.ndarray, size: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """The undecided texts of each source from the largest on, each to the nearest with the error so far."""
    mass = mass.copy()
    error: dict[int, float] = {}
    for i in np.lexsort((h, -size, rank)).tolist():
        r = int(rank[i])
        want = mass[i] + error.get(r, 0.0)
        mass[i] = float(size[i]) if want >= size[i] / 2 else 0.0
        error[r] = want - mass[i]
    return mass


def _round(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """One level of the tree: the rows of each (tree, chunk) with their words settled as far as they can be."""

    def work(key: tuple[pa.Scalar, ...], got: pa.Table) -> pa.Table:
        rank, h, size, mass = (got[c].to_numpy() for c in ("rank", "h", "size", "mass"))
        mass = round_rest(rank, h, size, mass) if last else settle(rank, h, size, mass, seed)
        got = got.set_column(got.schema.get_field_index("mass"), "mass", pa.array(mass))
        return got.set_column(got.schema.get_field_index("open"), "open", pa.array((mass > 0) & (mass < size)))

    return rows.groupBy("tree", "chunk").applyInArrow(work, rows.schema)


def decide(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES, seed: int = 1, chunk_rows: int = CHUNK_ROWS, fan_in: int = FAN_IN, row: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies (int) and taken of every row, and ``row``, a column of ``docs`` that tells rows apart, if given."""
    work = Workspace(docs.sparkSession, "mixing")
    sized = work.table(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), *([F.col(row).alias("row")] if row else [])), "sizes")
    sums = work.table(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sums")
    ranked = scans.rank(sums, [F.col("source").asc_nulls_last()], work, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = work.table(targets(ranked.withColumn("weight", weight), share, max_copies), "targets")
    small = F.col("n") <= chunk_rows
    few, most = sources.agg(F.sum(F.when(small, F.col("n"))), F.max("n")).first()
    shared, chunks = -(-(few or 1) // chunk_rows), -(-(most or 1) // chunk_rows)
    plan = sources.select("source", "rank", "source_size", "target", F.col("copies").alias("share"), F.when(small, -1).otherwise(F.col("rank")).alias("tree"), F.when(small, F.pmod(F.xxhash64("rank"), F.lit(shared))).alias("own"), F.ceil(F.col("n") / chunk_rows).alias("chunks"))
    rows = scans.with_dimension(sized, work.table(plan, "plan"), ["source"])
    order = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = rows.withColumn("h", order).withColumn("chunk", F.coalesce("own", F.pmod(F.xxhash64("h"), "chunks")))
    rows = rows.withColumn("base", F.floor("share").cast("int")).withColumn("mass", (F.col("share") - F.floor("share")) * F.col("size"))
    carried = ["doc_id", "source", "source_size", "target", "base", *(["row"] if row else [])]
    state = rows.select(*carried, *(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _STATE.split(", ")[:-1]), F.lit(True).alias("open"))
    level, done = work.table(_round(state, seed, last=False), "level-0"), []
    step = 0
    while True:
        done.append(level.filter(~F.col("open")))
        last = chunks <= 1
        step, chunks = step + 1, -(-chunks // fan_in)
        up = F.when(F.col("tree") < 0, F.col("chunk")).otherwise(F.floor(F.col("chunk") / fan_in))
        level = work.table(_round(level.filter("open").withColumn("chunk", up.cast("long")), seed + step, last), f"level-{step}")
        if last:
            break
    for part in done:
        level = level.unionByName(part)
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("base") + (F.col("mass") > 0).cast("int"))
    kept = ["doc_id", "source", "size", "source_size", "target", *(["row"] if row else [])]
    return level.withColumn("copies", copies).select(*kept, "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of ``docs`` as often as they are taken, in its columns."""
    name = tx.fresh(docs, "_row")
    rows = Workspace(docs.sparkSession, "mixed").table(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    times = decide(rows, row=name, **options).filter("copies > 0").select(F.col("row").alias(name), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(tx.fresh(docs, "_copy")))
    return rows.join(times, name).select(*(F.col(f"`{c}`") for c in docs.columns))
