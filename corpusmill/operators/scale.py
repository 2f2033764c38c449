"""Building blocks that keep one hot key from landing in one task.

A window over ``partitionBy(key)`` sends every row of that key to one task. Three shapes avoid it:

* first-k per key: ``row_number() <= k`` lets Spark place a partial ``WindowGroupLimit`` before the
  shuffle, so each map task ships at most k rows of a key;
* running totals and positions: split a key into ordered *blocks*, total the blocks, then add each
  block's starting total to a running total inside the block. No task sees more than one block's rows;
* look-back over block edges: the same split, with the last value of the earlier block joined in.

``block`` must not decrease as the order columns grow (a time bucket, ``id div n``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A broadcast hint where a count shows the side to be small; otherwise Spark picks the join itself."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every key in the given (total) order; ``rank`` keeps the position as a column."""
    name = rank or "_rn"
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return out.withColumn(name, F.col(name).cast("bigint")) if rank else out.drop(name)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    block: Column,
    value: Column,
    name: str,
    inclusive: bool = True,
) -> DataFrame:
    """Running sum of ``value`` per key without gathering a key in one task."""
    rows = df.withColumn("_blk", block).withColumn("_val", value)
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1
    )
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        rows.groupBy(*keys, "_blk")
        .agg(F.sum("_val").alias("_tot"))
        .select(*keys, "_blk", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_base"))
    )
    rows = rows.withColumn("_in", F.coalesce(F.sum("_val").over(inside), F.lit(0)))
    return (
        _join_blocks(rows, bases, keys)
        .withColumn(name, F.col("_base") + F.col("_in"))
        .drop("_blk", "_val", "_in", "_base")
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, name: str = "pos") -> DataFrame:
    """One-based position of every row in its key."""
    return running_total(df, keys, order, block, F.lit(1).cast("bigint"), name)


def previous_value(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], block: Column, value: str, name: str
) -> DataFrame:
    """``lag(value)`` per key; the first row of a block takes the last value of the block before it."""
    rows = df.withColumn("_blk", block)
    last = F.max_by(F.col(value), F.struct(*[_plain(c) for c in order]))
    edges = (
        rows.groupBy(*keys, "_blk")
        .agg(last.alias("_last"))
        .select(*keys, "_blk", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_edge"))
    )
    inside = Window.partitionBy(*keys, "_blk").orderBy(*order)
    rows = rows.withColumn("_in", F.lag(value).over(inside)).withColumn("_n", F.row_number().over(inside))
    return (
        _join_blocks(rows, edges, keys)
        .withColumn(name, F.when(F.col("_n") == 1, F.col("_edge")).otherwise(F.col("_in")))
        .drop("_blk", "_n", "_in", "_edge")
    )


def _plain(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _join_blocks(rows: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join on keys and block (keys may be null, e.g. root folders)."""
    right = side.select(*[F.col(k).alias(f"_k_{k}") for k in [*keys, "_blk"]], *[c for c in side.columns if c not in (*keys, "_blk")])
    cond = None
    for k in [*keys, "_blk"]:
        one = rows[k].eqNullSafe(right[f"_k_{k}"])
        cond = one if cond is None else cond & one
    return rows.join(right, cond, "left").drop(*[f"_k_{k}" for k in [*keys, "_blk"]])
