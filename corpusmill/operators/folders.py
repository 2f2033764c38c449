"""Folder trees: ancestors, depth, subtrees, paths, empty folders.

The ancestor table is built by doubling: from ancestors up to distance d one self-join gives those up to 2d, until no
chain grows, so a tree of any depth takes as many rounds as its depth has binary digits. Each round is checkpointed. A
folder in a cycle has each folder of the cycle as an ancestor once, at the least distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.session import checkpointed


#: Parents that are looked up one by one.
CLIMB = 32


def ancestors(folders: DataFrame) -> DataFrame:
    """(folder_id, ancestor_id, distance), each folder its own ancestor at distance 0."""
    up = folders.select("folder_id", F.col("parent_id").alias("ancestor_id"), F.lit(1).alias("distance"))
    up = checkpointed(up.where("ancestor_id IS NOT NULL AND ancestor_id <> folder_id"))
    reach = 1
    while True:
        top = up.groupBy("folder_id").agg(F.max_by("ancestor_id", "distance").alias("_top"), F.max("distance").alias("_far"))
        # Only chains that reach the current distance can grow.
        grow = top.where(F.col("_far") == reach).join(
            up.select(F.col("folder_id").alias("_top"), F.col("ancestor_id"), F.col("distance").alias("_d")), "_top"
        )
        grow = grow.select("folder_id", "ancestor_id", (F.col("_far") + F.col("_d")).alias("distance")).where("folder_id <> ancestor_id")
        grow = checkpointed(grow.join(up, ["folder_id", "ancestor_id"], "left_anti"))
        if grow.isEmpty():
            break
        up = up.unionByName(grow)
        reach *= 2
    own = folders.select("folder_id", F.col("folder_id").alias("ancestor_id"), F.lit(0).alias("distance"))
    return own.unionByName(up)


def depths(folders: DataFrame) -> DataFrame:
    """Depth of every folder (root folders have 1) and height of its subtree."""
    a = ancestors(folders)
    depth = a.groupBy("folder_id").agg((F.max("distance") + 1).cast("bigint").alias("depth"))
    height = a.groupBy(F.col("ancestor_id").alias("folder_id")).agg(
        (F.max("distance")).cast("bigint").alias("subtree_depth"), F.count("*").alias("subtree_size")
    )
    return depth.join(height, "folder_id")


def subtree(folders: DataFrame, root: int) -> DataFrame:
    return ancestors(folders).where(F.col("ancestor_id") == root).select("folder_id", F.col("distance").cast("bigint").alias("distance"))


def is_cycle(folders: DataFrame, moves: DataFrame) -> DataFrame:
    """Whether moving ``folder_id`` under ``new_parent`` closes a cycle: the new parent lies in its subtree."""
    inside = ancestors(folders).select(F.col("folder_id").alias("new_parent"), F.col("ancestor_id").alias("folder_id"), F.lit(True).alias("_in"))
    return moves.join(inside, ["folder_id", "new_parent"], "left").withColumn("cycle", F.coalesce("_in", F.lit(False))).drop("_in")


def folder_paths(folders: DataFrame) -> DataFrame:
    """Path of safe names from the root."""
    named = ancestors(folders).join(
        folders.select(F.col("folder_id").alias("ancestor_id"), T.safe_segment("name", "folder").alias("name")), "ancestor_id"
    )
    return named.groupBy("folder_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), "name"))), lambda s: s["name"]), "/").alias("path")
    )


def chain_of(folders: DataFrame, folder_id: int) -> DataFrame:
    """(folder_id, ancestor_id, distance) of one folder, itself included: its parents one after another, a scan for each of
    the first ``CLIMB``; only a longer chain needs everybody's ancestors."""
    chain, at = [], folder_id
    while len(chain) <= CLIMB:
        found = folders.where(F.col("folder_id") == at).select("parent_id").take(2)
        if len(found) > 1:
            break
        if found:
            chain.append((folder_id, at, len(chain)))
            at = found[0].parent_id
        elif chain and at is not None:
            chain.append((folder_id, at, len(chain)))  # a parent that is no folder itself
            at = None
        if not found or at is None or at in [c[1] for c in chain]:
            kind = folders.schema["folder_id"].dataType.simpleString()
            return folders.sparkSession.createDataFrame(chain, f"folder_id {kind}, ancestor_id {kind}, distance int")
    return ancestors(folders).where(F.col("folder_id") == folder_id)


def breadcrumb(folders: DataFrame, folder_id: int) -> DataFrame:
    """Folders from the root down to one folder."""
    chain = chain_of(folders, folder_id)
    named = F.broadcast(chain.select("ancestor_id", "distance")).join(
        folders.select(F.col("folder_id").alias("ancestor_id"), "name"), "ancestor_id"
    )
    far = chain.agg(F.max("distance")).scalar()
    return named.select(F.col("ancestor_id").alias("folder_id"), "name", (far - F.col("distance")).cast("bigint").alias("level"))


def empty_folders(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Folders with no document anywhere below them: what bottom-up removal would delete."""
    used = docs.where(F.col("folder_id").isNotNull()).select("folder_id").distinct()
    kept = ancestors(folders).join(used, "folder_id", "left_semi").select(F.col("ancestor_id").alias("folder_id")).distinct()
    return folders.join(kept, "folder_id", "left_anti")


def folder_summary(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents below each top-level folder (zero where there are none)."""
    top = ancestors(folders).groupBy("folder_id").agg(F.max_by("ancestor_id", "distance").alias("top_id"))
    per_folder = docs.where(F.col("folder_id").isNotNull()).groupBy("folder_id").agg(F.count("*").alias("n"))
    counts = per_folder.join(top, "folder_id").groupBy("top_id").agg(F.sum("n").alias("n_docs"))
    roots = folders.where("parent_id IS NULL").select(F.col("folder_id").alias("top_id"), "name")
    return roots.join(counts, "top_id", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))


def non_empty_folders(folders: DataFrame, docs: DataFrame) -> DataFrame:
    """Folders with a document below them or a direct child folder."""
    used = docs.where(F.col("folder_id").isNotNull()).select("folder_id").distinct()
    holding = ancestors(folders).join(used, "folder_id", "left_semi").select(F.col("ancestor_id").alias("folder_id"))
    parents = folders.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("folder_id"))
    return holding.unionByName(parents).distinct()
