"""Usage, logs, notifications, threads, comments and other relational reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from corpusmill.functions import identity as I
from corpusmill.functions import text as T
from corpusmill.operators.ingest import keep_lowest
from corpusmill.operators.scale import first_k, positions
from corpusmill.operators.search import like_pattern, page_of

# Notification types by inbox category.
COMMENT_TYPES = ["new_mention", "comment_reply"]
STATUS_TYPES = ["connector_indexing", "connector_deletion", "document_processing"]


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def type_counts(docs: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Documents by type, in the spaces a user belongs to where members are given."""
    if members is not None:
        docs = docs.join(members.select("space_id").distinct(), "space_id", "left_semi")
    return docs.groupBy("doc_type").agg(F.count("*").alias("n"))


def list_docs(
    docs: DataFrame, space: int, types: list[str] | None = None, folder: int | str | None = None, sort: str = "updated_at",
    descending: bool = True, page: int = 0, size: int = 50,
) -> DataFrame:
    """Page of documents with total and has_more; folder ``root`` means no folder."""
    rows = docs.where(F.col("space_id") == space)
    if types:
        rows = rows.where(F.col("doc_type").isin(types))
    if folder == "root":
        rows = rows.where(F.col("folder_id").isNull())
    elif folder is not None:
        rows = rows.where(F.col("folder_id") == folder)
    total = rows.agg(F.count("*")).scalar()
    key = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    out = rows.select("doc_id", "title", "doc_type", "updated_at").withColumn("total", total)
    out = page_of(out, [key, F.col("doc_id")], page, size)
    return out.withColumn("has_more", F.col("total") > (page + 1) * size)


def doc_status(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.join(ids.select("doc_id"), "doc_id", "left_semi").select("doc_id", I.doc_state("status").alias("state"))


def recent_logs(logs: DataFrame, now: str, hours: int) -> DataFrame:
    return logs.where(F.col("created_at") >= F.date_trunc("second", at(now)) - F.expr(f"INTERVAL '{hours}' HOUR"))


def log_counts(logs: DataFrame, now: str, hours: int) -> DataFrame:
    """Counts by status, level and source of the last hours, in one pass."""
    rows = recent_logs(logs, now, hours)
    sets = rows.groupingSets([["status"], ["level"], ["source"]], "status", "level", "source").agg(
        F.grouping("status").alias("_s"), F.grouping("level").alias("_l"), F.count("*").alias("n")
    )
    kind = F.when(F.col("_s") == 0, "status").when(F.col("_l") == 0, "level").otherwise("source")
    return sets.select(kind.alias("kind"), F.coalesce("status", "level", "source").alias("value"), "n").where("value IS NOT NULL")


def _task(c: str) -> Column:
    return F.coalesce(F.get_json_object("metadata", f"$.{c}"), F.lit("Unknown"))


def active_tasks(logs: DataFrame, now: str, hours: int) -> DataFrame:
    rows = recent_logs(logs, now, hours).where("status = 'IN_PROGRESS'")
    return rows.select("log_id", _task("task_name").alias("task_name"), "message", "created_at", "source")


def recent_failures(logs: DataFrame, now: str, hours: int, n: int = 10) -> DataFrame:
    rows = recent_logs(logs, now, hours).where("status = 'FAILED'").orderBy(F.col("created_at").desc(), F.col("log_id")).limit(n)
    return rows.select("log_id", _task("task_name").alias("task_name"), "message", "created_at", "source")


def filter_logs(
    logs: DataFrame, spaces: DataFrame, level: str | None = None, status: str | None = None, source: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    rows = logs.join(spaces.select("space_id").distinct(), "space_id", "left_semi")
    for name, value in (("level", level), ("status", status)):
        if value:
            rows = rows.where(F.col(name) == value)
    if source:
        rows = rows.where(F.col("source").ilike(like_pattern(source)))
    if start:
        rows = rows.where(F.col("created_at") >= at(start))
    if end:
        rows = rows.where(F.col("created_at") <= at(end))
    return rows


def unread_counts(notif: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Unread notifications per user by category, in total and recent, in one pass."""
    recent = F.col("created_at") > at(now) - F.expr(f"INTERVAL '{days}' DAY")
    comments, status = F.col("type").isin(COMMENT_TYPES), F.col("type").isin(STATUS_TYPES)
    return notif.where(~F.col("read")).groupBy("user_id").agg(
        F.count_if(comments).alias("comments_total"), F.count_if(comments & recent).alias("comments_recent"),
        F.count_if(status).alias("status_total"), F.count_if(status & recent).alias("status_recent"),
    )


def source_types(notif: DataFrame) -> DataFrame:
    """Connector and document types seen, with counts, found in two metadata keys."""

    def seen(key: str, category: str, types: list[str]) -> DataFrame:
        name = F.get_json_object("metadata", f"$.{key}")
        rows = notif.where(F.col("type").isin(types)).select(name.alias("source_type")).where("source_type <> ''")
        return rows.groupBy("source_type").agg(F.count("*").alias("n")).select(
            F.concat(F.lit(f"{category}:"), "source_type").alias("key"), "source_type", F.lit(category).alias("category"), "n"
        )

    return seen("connector_type", "connector", ["connector_indexing", "connector_deletion"]).unionByName(
        seen("document_type", "document", ["document_processing"])
    )


def sync_stats(docs: DataFrame, by: str = "connector_id") -> DataFrame:
    """Live documents (deleted ones aside) and last change (deleted ones included)."""
    return docs.groupBy(by).agg(
        F.count_if(I.doc_state("status") != "deleting").alias("n_active"), F.max("updated_at").alias("last_update")
    )


def usage_by_model(calls: DataFrame) -> DataFrame:
    """Tokens and cost per turn and model, per turn, and in total, in one pass."""
    rows = calls.rollup("turn_id", "model").agg(
        F.grouping("model").alias("_m"), F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"), F.sum("cost_micros").alias("cost_micros"), F.count("*").alias("n_calls"),
    )
    return rows.withColumn("model", F.when(F.col("_m") == 1, "(all)").otherwise(F.col("model"))).withColumn(
        "turn_id", F.coalesce("turn_id", F.lit(-1))
    ).drop("_m")


def insert_usage(new: DataFrame, old: DataFrame, row_id: str = "call_id") -> DataFrame:
    """New usage rows to add: one per message not stored yet; rows without a message always."""
    fresh = new.join(old.where(F.col("message_id").isNotNull()).select("message_id").distinct(), "message_id", "left_anti")
    return keep_lowest(fresh.select(*new.columns), "message_id", row_id)


LEDGER = (
    S.StructType().add("user_id", S.LongType()).add("seq", S.LongType()).add("allowed", S.BooleanType()).add("status", S.StringType())
    .add("used", S.LongType()).add("reserved", S.LongType()).add("remaining", S.LongType())
)


def _ledger(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    user, used, reserved = None, 0, 0
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            if row.user_id != user:
                user, used, reserved = row.user_id, 0, 0
            allowed = True
            if row.kind == "reserve":
                allowed = used + reserved + row.reserve_micros <= row.limit_micros
                reserved += row.reserve_micros if allowed else 0
                held = used + reserved
            else:
                reserved = max(0, reserved - row.reserve_micros)
                used += row.actual_micros
                held = used
            status = "BLOCKED" if not allowed or held >= row.limit_micros else "WARNING" if held >= int(row.limit_micros * 0.8) else "OK"
            out.append((user, row.seq, allowed, status, used, reserved, max(0, row.limit_micros - used - reserved)))
        yield pd.DataFrame(out, columns=LEDGER.names)


def credit_ledger(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Balance after every reservation and settlement, in order; a refused reservation holds nothing.

    Refusals change later balances, so a user's rows run in order. They stream through a task in Arrow batches with
    two numbers of state; a user is never gathered in memory.
    """
    rows = events.join(limits, "user_id").select("user_id", "seq", "kind", "reserve_micros", "actual_micros", "limit_micros")
    return rows.repartition("user_id").sortWithinPartitions("user_id", "seq").mapInPandas(_ledger, LEDGER)


def spread_pick(configs: DataFrame, threads: DataFrame, mode: str = "auto_fastest", top: int = 5) -> DataFrame:
    """Configuration of each thread: among the best few (tier A first), by the hash of the thread id."""
    best = configs.withColumn("_a", F.coalesce(F.col("tier") == "A", F.lit(True)).cast("int")).orderBy(
        F.col("_a").desc(), F.col("score").desc(), F.col("config_id")
    ).limit(top)
    # At most ``top`` rows from here on.
    best = best.where(F.col("_a") == best.agg(F.max("_a")).scalar())
    best = best.withColumn("idx", F.expr("row_number() OVER (ORDER BY score DESC, config_id)") - 1)
    n = best.agg(F.count("*")).scalar()
    digest = F.sha2(F.concat(F.lit(f"{mode}:"), F.col("thread_id").cast("string")), 256)
    number = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    picked = threads.select("thread_id", number.alias("_h")).withColumn("_n", n).select("thread_id", (F.col("_h") % F.col("_n")).cast("int").alias("idx"))
    return picked.join(F.broadcast(best.select("idx", "config_id")), "idx").drop("idx")


def my_spaces(members: DataFrame, user: str) -> DataFrame:
    """Spaces of a user with their member counts."""
    mine = members.where(F.col("user_id") == user).select("space_id").distinct()
    return members.join(mine, "space_id", "left_semi").groupBy("space_id").agg(F.count_distinct("user_id").alias("n_members"))


def mention_feed(mentions: DataFrame, comments: DataFrame, threads: DataFrame, users: DataFrame, user: str, n: int = 50) -> DataFrame:
    """Newest mentions of a user with the comment's preview, author and thread."""
    rows = mentions.where(F.col("user_id") == user).select("comment_id").join(comments, "comment_id").join(
        threads.select("thread_id", "title", "space_id"), "thread_id"
    ).join(users.select(F.col("user_id").alias("author_id"), F.col("name").alias("author")), "author_id", "left")
    rows = rows.orderBy(F.col("created_at").desc(), F.col("comment_id").desc()).limit(n)
    return rows.select("comment_id", "thread_id", "space_id", "title", "author", T.preview("content", 100).alias("preview"))


def participants(comments: DataFrame, excluded: DataFrame) -> DataFrame:
    """Distinct authors of each thread, without the excluded (thread, user) pairs."""
    return comments.select("thread_id", F.col("author_id").alias("user_id")).distinct().join(excluded, ["thread_id", "user_id"], "left_anti")


def visible_threads(threads: DataFrame, user: str, owner: bool = False) -> DataFrame:
    seen = (F.col("created_by") == user) | (F.col("visibility") == "SEARCH_SPACE")
    return threads.where(seen | F.col("created_by").isNull() if owner else F.coalesce(seen, F.lit(False)))


def search_threads(threads: DataFrame, user: str, title: str, owner: bool = False) -> DataFrame:
    return visible_threads(threads, user, owner).where(F.col("title").ilike(like_pattern(title)))


def threads_with_comments(threads: DataFrame, comments: DataFrame) -> DataFrame:
    return threads.join(comments.select("thread_id").distinct(), "thread_id", "left_semi")


def list_threads(threads: DataFrame, user: str, n: int, owner: bool = False) -> DataFrame:
    """The newest ``n`` active threads and all archived ones."""
    rows = visible_threads(threads, user, owner)
    active = rows.where(~F.col("archived")).orderBy(F.col("updated_at").desc(), F.col("thread_id")).limit(n)
    return active.unionByName(rows.where("archived"))


def snapshot_hash(messages: DataFrame) -> DataFrame:
    """SHA-256 of each thread's messages as one JSON array in id order, whatever their number: a thread's rows stream
    through a task, which holds the hash so far and one batch."""
    rows = messages.select("thread_id", "id", F.to_json(F.struct("content", "id", "role")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thread, digest = None, None

        def ended() -> pa.RecordBatch:
            digest.update(b"]")
            return pa.RecordBatch.from_arrays([pa.array([thread], pa.int64()), pa.array([digest.hexdigest()])], ["thread_id", "content_hash"])

        for batch in batches:
            for t, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if digest is not None and t == thread:
                    digest.update(b",")
                else:
                    if digest is not None:
                        yield ended()
                    thread, digest = t, hashlib.sha256(b"[")
                digest.update(body.encode())
        if digest is not None:
            yield ended()

    ordered = rows.withColumn("thread_id", F.col("thread_id").cast("bigint")).repartition("thread_id").sortWithinPartitions("thread_id", "id")
    return ordered.mapInArrow(run, "thread_id long, content_hash string")


def stale_jobs(jobs: DataFrame, beats: DataFrame) -> DataFrame:
    """In-progress jobs without a heartbeat, as failed."""
    running = jobs.where((F.col("type") == "connector_indexing") & (F.get_json_object("metadata", "$.status") == "in_progress"))
    return running.join(beats.select("notif_id"), "notif_id", "left_anti").select(
        "notif_id", F.get_json_object("metadata", "$.connector_id").cast("bigint").alias("connector_id"), F.lit("failed").alias("status")
    )


def fail_stuck_documents(docs: DataFrame, stale: DataFrame, reason: str = "Sync was interrupted") -> DataFrame:
    """Documents with pending and processing ones of stale connectors set to failed."""
    hit = stale.where(F.col("connector_id").isNotNull()).select("connector_id", F.lit(True).alias("_stale")).distinct()
    rows = docs.join(hit, "connector_id", "left")
    stuck = F.col("_stale").isNotNull() & I.doc_state("status").isin("pending", "processing")
    return rows.withColumn("status", F.when(stuck, I.status_json("failed", F.lit(reason))).otherwise(F.col("status"))).drop("_stale")


def due_sources(sources: DataFrame, jobs: DataFrame, locks: DataFrame, now: str) -> DataFrame:
    """Enabled sources whose next run has come, neither locked nor in progress."""
    rows = sources.where(F.col("enabled") & (F.col("next_run_at") <= at(now)))
    return rows.join(locks.select("source_id").distinct(), "source_id", "left_anti").join(jobs.select("source_id").distinct(), "source_id", "left_anti")


def affected_snapshots(snapshots: DataFrame, ids: list[int]) -> DataFrame:
    return snapshots.where(F.arrays_overlap("message_ids", F.array(*[F.lit(i).cast("bigint") for i in ids])))


def discover_types(sources: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct source and document types of each space."""
    a = sources.select("space_id", F.lit("source").alias("kind"), F.col("source_type").alias("type"))
    return a.unionByName(docs.select("space_id", F.lit("document").alias("kind"), F.col("doc_type").alias("type"))).distinct()


def price_aliases(models: DataFrame) -> DataFrame:
    """One price per model alias; the first registration of an alias wins.

    ``models``: seq, provider, model_name, base_model, price.
    """
    p, base, name = F.lower("provider"), F.col("base_model"), F.col("model_name")
    both = lambda a, b: F.when((a != "") & (b != ""), F.concat(a, F.lit("/"), b))
    own = F.when((name != "") & (name != base), name)
    azure = p == "azure_openai"
    keys = F.array_distinct(F.array_compact(F.array(
        F.nullif(base, F.lit("")), both(p, base), own, both(p, own), F.when(azure, both(F.lit("azure"), base)), F.when(azure, both(F.lit("azure"), own)),
    )))
    rows = models.select("seq", "price", F.posexplode(keys).alias("n", "alias"))
    return first_k(rows, ["alias"], [F.col("seq"), F.col("n")], 1).select("alias", "seq", "price")


def comment_trees(comments: DataFrame, users: DataFrame, part_replies: int = 1000) -> DataFrame:
    """Top-level comments with author and their replies in order, ``part_replies`` to a row."""
    named = comments.join(users.select(F.col("user_id").alias("author_id"), F.col("name").alias("author")), "author_id", "left")
    top = named.where("parent_id IS NULL").select("message_id", "comment_id", "author", "content", "created_at")
    replies = named.where("parent_id IS NOT NULL").select("parent_id", F.col("comment_id").alias("id"), "author", "content")
    replies = positions(replies, ["parent_id"], [F.col("id")], F.floor(F.col("id") / 100_000), "_pos")
    packed = replies.withColumn("part", F.floor((F.col("_pos") - 1) / part_replies)).groupBy("parent_id", "part").agg(
        F.array_sort(F.collect_list(F.struct("id", "author", "content"))).alias("replies"), F.count("*").alias("n_replies")
    )
    return top.join(packed.withColumnRenamed("parent_id", "comment_id"), "comment_id", "left").withColumn(
        "part", F.coalesce("part", F.lit(0))
    ).withColumn("n_replies", F.coalesce("n_replies", F.lit(0)))


def list_snapshots(snapshots: DataFrame, threads: DataFrame) -> DataFrame:
    return snapshots.join(threads.select("thread_id", "title"), "thread_id").select(
        "snapshot_id", "thread_id", "title", F.size("message_ids").cast("bigint").alias("n_messages")
    )


def siblings(reports: DataFrame, block: Column) -> DataFrame:
    """Version number of each report in its group and the size of the group; a report without group stands alone."""
    rows = reports.withColumn("grp", F.coalesce(F.concat(F.lit("g"), F.col("group_id").cast("string")), F.concat(F.lit("r"), F.col("report_id").cast("string"))))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n_versions"))
    rows = positions(rows, ["grp"], [F.col("created_at"), F.col("report_id")], block, "version")
    return rows.join(sizes, "grp")


def action_log(actions: DataFrame, thread: int, page: int, size: int) -> DataFrame:
    """Page of a thread's actions, newest first, with the total and the action that reverted each one."""
    rows = actions.where(F.col("thread_id") == thread)
    total = rows.agg(F.count("*")).scalar()
    shown = page_of(rows.withColumn("total", total), [F.col("ts").desc(), F.col("action_id").desc()], page, size)
    undo = actions.where(F.col("reverse_of").isNotNull()).select(F.col("reverse_of").alias("action_id"), F.col("action_id").alias("reverted_by"))
    undo = first_k(undo, ["action_id"], [F.col("reverted_by")], 1)
    return shown.join(undo, "action_id", "left").withColumn("reverted_by", F.coalesce("reverted_by", F.lit(-1)))
