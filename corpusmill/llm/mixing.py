"""Mix sources to target weights with hash-threshold histograms.

A row's fate hangs on a fixed hash of its id alone. Sizes are summed by source and hash bucket; the running sum finds
the bucket in which a source's budget ends, and only that bucket is summed again by the next hash bits, until one hash
value is left. A filter ``hash < threshold`` then takes the rows: nothing is sorted, and a larger budget takes a
superset. A source whose target exceeds its size repeats whole: each row ``floor(target / size)`` times, and once more
below the threshold.

Defined cases: a null id hashes as the empty text; rows with one id share their fate; a null source is a source of its
own, the last; sizes that are null or negative count 0; a source without size gets target 0 and no copies; an empty
table gives an empty table. The row at which the budget ends is taken if that comes nearer to the budget. Columns of
the input are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import stored

HASH_BITS, LEVEL_BITS = 60, 12


def row_hash(key: Column) -> Column:
    """60 bits of the id's md5, which other engines compute alike."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(totals: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """Target per source of ``totals`` (source, total): ``share`` of all sizes dealt by weight, where none exceeds
    ``max_repeat`` times its own size and the excess goes to the others by weight. Sources in code point order, null
    last, take the weights in turn. One row per source: the windows here never see more rows than there are sources."""
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    rows = totals.withColumn("turn", F.row_number().over(by_name) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("cap", (F.col("total") * max_repeat).cast("double"))
    # Sources fill up in the order of cap / weight. After those before it are full, each source sees this level of filling:
    before = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.sum("total").over(everything) * F.lit(float(share))
    rows = rows.withColumn(
        "level",
        (whole - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "turn", "level"))
    level = F.coalesce(F.min(fits).over(everything)["level"], F.lit(float("inf")))
    rows = rows.withColumn("target", F.least(F.col("cap"), level * F.col("weight")))
    copies = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("bigint")
    return rows.select("source", F.col("total").alias("source_size"), "target", copies.alias("copies"), (F.col("target") - copies * F.col("total")).alias("budget"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """The hash threshold of each source: ``budgets`` (source, source_size, target, copies, budget) with ``threshold``.

    ``sizes`` (source, size, h). The first pass reads all rows, each later one only the rows of the boundary buckets.
    """
    open_ = budgets.withColumns({"prefix": F.lit(0).cast("bigint"), "below": F.lit(0).cast("bigint")})
    rows, done = sizes, None
    names = [*budgets.columns]
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        if shift < HASH_BITS - LEVEL_BITS:
            # Only the boundary bucket of each source goes on.
            edge = open_.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
            prefix = F.shiftright("h", shift + LEVEL_BITS)
            rows = rows.join(edge, F.col("source").eqNullSafe(F.col("_s")) & (prefix == F.col("_p")), "left_semi")
        sums = rows.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
        sums = sums.withColumnRenamed("source", "_s")
        so_far = F.sum("in_bucket").over(Window.partitionBy("_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        over = (
            open_.join(sums.withColumn("to_here", so_far), F.col("source").eqNullSafe(F.col("_s")))
            .where(F.col("below") + F.col("to_here") > F.col("budget"))
            .groupBy("source")
            .agg(F.min(F.struct("bucket", "to_here", "in_bucket")).alias("edge"))
            .withColumnRenamed("source", "_s")
        )
        open_ = open_.join(over, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        if shift == HASH_BITS - LEVEL_BITS:
            # A budget that no bucket exceeds takes every row.
            done = open_.where("edge is null").select(*names, F.lit(1 << HASH_BITS).cast("bigint").alias("threshold"))
        open_ = open_.where("edge is not null").select(
            *names,
            F.col("edge.bucket").alias("prefix"),
            (F.col("below") + F.col("edge.to_here") - F.col("edge.in_bucket")).alias("below"),
            (F.col("below") + F.col("edge.to_here")).alias("through"),
        )
        open_ = stored(open_, "mix-bounds")
        if shift:
            open_ = open_.drop("through")
    last = F.col("prefix") + F.when(F.col("below") + F.col("through") < 2 * F.col("budget"), 1).otherwise(0)
    return done.unionByName(open_.select(*names, last.alias("threshold")))


def mix(docs: DataFrame, size: Column, key: str = "doc_id", source: str = "source", weights: Sequence[float] = (5, 2, 1), max_repeat: int = 3, share: float = 1.0) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with ``size``, ``source_size``, ``target`` and ``copies`` (how often
    the mix takes it). Two scans: one for sizes and hashes, one that filters."""
    sized = F.greatest(F.coalesce(size.cast("bigint"), F.lit(0)), F.lit(0).cast("bigint"))
    plain = docs.select(F.col(source).alias("source"), sized.alias("size"), row_hash(F.col(key)).alias("h"))
    sizes = stored(plain, "mix-sizes")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("total"))
    plan = stored(thresholds(sizes, stored(targets(totals, weights, max_repeat, share), "mix-targets")), "mix-plan")
    plan = plan.withColumnRenamed("source", "_s")
    rows = docs.select(F.struct("*").alias("row"), F.col(source).alias("source"), sized.alias("size"), row_hash(F.col(key)).alias("h"))
    # A budget of nothing takes nothing, not even rows of size 0.
    taken = F.col("copies") + F.when((F.col("budget") > 0) & (F.col("h") < F.col("threshold")), 1).otherwise(0)
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "row", "size", "source_size", "target", taken.alias("copies")
    )


def mixed_rows(docs: DataFrame, size: Column, **options) -> DataFrame:
    """The mix itself: each taken row as often as the mix takes it, with the columns of ``docs``."""
    taken = mix(docs, size, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
