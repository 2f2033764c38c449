"""Tables in buckets under one manifest per commit.

A store is a folder of tables. Rows lie in ``<table>/part=<commit>/bucket=<b>``; a commit writes its rows first and then its
manifest, the list of the folders that are live from then on. Readers take the last manifest, so rows of a commit that did
not get so far are never seen, and a commit that is repeated replaces its own folders. A read names the buckets it needs,
and only those folders are opened. Tables that are always read whole have one bucket: their rows are written where they
are, without a shuffle. Compaction is a commit too: it writes what is live and lists nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import checkpointed
from corpusmill.sources.corpus import table_if_there


#: How texts that stay, or are read once only, are compressed: they take two thirds of what Spark's default gives.
PACKED = "zstd"


class Store:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> list[int]:
        """The buckets of ``rows``: at most ``buckets`` numbers."""
        return sorted(r.b for r in rows.select(self.bucket(key).alias("b")).distinct().collect())

    def manifest(self, before: int | None = None) -> DataFrame | None:
        """Live folders (name, part, bucket) of the last commit, or of the last one before the number ``before``."""
        rows = table_if_there(self.spark, f"{self.path}/manifest")
        if rows is None:
            return None
        rows = rows if before is None else rows.where(F.col("version") < before)
        last = rows.agg(F.max("version")).first()[0]
        return None if last is None else rows.where(F.col("version") == last).select("name", "part", "bucket")

    def read(self, name: str, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame | None:
        """The rows of a table, each with the ``batch`` that wrote it; None where nothing was ever committed."""
        live, rows = self.manifest(before), table_if_there(self.spark, f"{self.path}/{name}")
        if live is None or rows is None:
            return None
        if buckets is not None:
            rows, live = rows.where(F.col("bucket").isin(list(buckets))), live.where(F.col("bucket").isin(list(buckets)))
        # One row for each folder: small beside what the folders hold, and the join's keys are the folders' names.
        live = F.broadcast(live.where(F.col("name") == name).select("part", "bucket"))
        return rows.join(live, ["part", "bucket"], "left_semi").drop("part", "bucket")

    def written(self, name: str, part: str) -> DataFrame:
        """What a commit wrote of a table with one bucket, before its manifest."""
        return self.spark.read.parquet(f"{self.path}/{name}/part={part}/bucket=0")

    def commit(self, version: int, part: str, tables: dict[str, tuple[DataFrame | Callable[[], DataFrame], str | None]], keep: bool = True) -> None:
        """Write ``tables`` in their order (name to rows with ``batch``, or a function that gives them once the tables before
        are written, and the column that buckets them, None for one bucket) and then the manifest; with ``keep`` what was
        live stays live."""
        written = None
        for name, (rows, key) in tables.items():
            rows = rows() if callable(rows) else rows
            if key is None:
                rows.write.mode("overwrite").option("compression", PACKED).parquet(f"{self.path}/{name}/part={part}/bucket=0")
            else:
                rows = rows.withColumn("bucket", self.bucket(key)).withColumn("part", F.lit(part)).repartition("bucket")
                writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", PACKED)
                writer.partitionBy("part", "bucket").parquet(f"{self.path}/{name}")
            found = table_if_there(self.spark, f"{self.path}/{name}")
            if found is not None:
                found = found.where(F.col("part") == part).select(F.lit(name).alias("name"), "part", "bucket").distinct()
                written = found if written is None else written.unionByName(found)
        before = self.manifest(version) if keep else None
        if before is not None:
            written = before if written is None else written.unionByName(before).distinct()
        if written is not None:
            checkpointed(written).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/version={version}")


#: Commits of batch b and of the compaction after it.
def batch_version(batch_id: int) -> int:
    return 2 * batch_id + 1


def compact(store: Store, current: dict[str, tuple[Callable[[], DataFrame | None], str | None]]) -> None:
    """Rewrite each table as what ``current`` says is live of it, in one part."""
    rows = table_if_there(store.spark, f"{store.path}/manifest")
    last = None if rows is None else rows.agg(F.max("version")).first()[0]
    if last is None or last % 2 == 0:  # nothing new since the last compaction
        return
    tables = {name: (live, key) for name, (read, key) in current.items() if (live := read()) is not None}
    store.commit(last + 1, f"c{last:010d}", tables, keep=False)
