"""Ranks and running values over a whole sorted table, in two passes.

A table is sorted by ranges and written once; each range partition is then worked on by
itself, and what the partitions before it add up to is a small table, one row for each
partition (and key), that is carried in.  No task holds a key or the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Workspace

#: Rows of a dimension that is broadcast at most; a larger one is joined by shuffle.
BROADCAST_ROWS = 20_000
PART, AT = "_part", "_at"
_BITS = 33  # a monotonically increasing id holds the partition above these bits, and the row below


def ordered(df: DataFrame, order: list[Column], work: Workspace, name: str) -> DataFrame:
    """``df`` written in the given order, with _part (range partition) and _at (row in it); together they follow the order."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    numbered = dealt.withColumn("_id", F.monotonically_increasing_id())
    placed = numbered.withColumns({PART: F.shiftright("_id", _BITS).cast("int"), AT: F.col("_id").bitwiseAND(F.lit((1 << _BITS) - 1))}).drop("_id")
    return work.table(placed, name)


def rank(df: DataFrame, order: list[Column], work: Workspace, name: str, column: str = "rank") -> DataFrame:
    """``df`` with its place in the order, from 0, as a long."""
    table = ordered(df, order, work, name)
    sizes = table.groupBy(PART).agg(F.count("*").alias("_n"))
    before = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    starts = sizes.select(PART, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return table.join(F.broadcast(starts), PART).withColumn(column, F.col("_start") + F.col(AT)).drop(PART, AT, "_start")


def running(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, tuple[Callable, str]], work: Workspace, name: str) -> DataFrame:
    """``df`` with running values by key: ``values`` maps a new column to (F.max, F.min or F.sum, column), the row itself included.

    Null keys are a key; nulls among the values are passed over.
    """
    table = ordered(df, [*(F.col(k).asc_nulls_first() for k in keys), *order], work, name)
    own = Window.partitionBy(PART, *keys).orderBy(AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = table.withColumns({c: f(v).over(own) for c, (f, v) in values.items()})
    ends = table.groupBy(PART, *keys).agg(*(f(v).alias(c) for c, (f, v) in values.items()))
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(PART, *keys, *(f(c).over(before).alias(f"_c_{c}") for c, (f, _) in values.items()))
    both = null_safe_join(local, carry, [PART, *keys], "left")
    merged = {c: _add(f, F.col(c), F.col(f"_c_{c}")) for c, (f, _) in values.items()}
    return both.withColumns(merged).drop(PART, AT, *(f"_c_{c}" for c in values))


def _add(f: Callable, a: Column, b: Column) -> Column:
    if f is F.sum:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b)
    return F.greatest(a, b) if f is F.max else F.least(a, b)


def null_safe_join(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """An equi-join in which null equals null; the keys appear once."""
    right = other.select(*(F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in other.columns))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return df.join(F.broadcast(right) if broadcast else right, on, how).drop(*(f"_k_{k}" for k in keys))


def with_dimension(df: DataFrame, dimension: DataFrame, keys: list[str], how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with the columns of a written table that has one row a key: broadcast while it has ``limit`` rows at most, else by a shuffle that skew handling may split."""
    small = dimension.limit(limit + 1).count() <= limit
    return null_safe_join(df, dimension, keys, how, small)
