"""Streaming operators (W), each run over everything in the table and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.plans.catalog import path_query
from corpusmill.session import checkpoint_dir
from corpusmill.streaming import streams


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.as_stream_time(streams.read_table_stream(spark, sf_dir, "events"))


def _closed_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, streams.Closing]:
    """The events and their end."""
    end = streams.Closing(spark)
    return end.joined(_events(spark, sf_dir)), end


def _plain(df: DataFrame, *times: str) -> DataFrame:
    for name in times:
        df = df.withColumn(name, F.col(name).cast("timestamp_ntz"))
    return df


@path_query("W1", """
WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 5 = 1 THEN text || ' (revised)' ELSE text END AS second FROM {documents}),
one AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1 AS held FROM d WHERE text <> ''),
held AS (SELECT DISTINCT text AS content FROM one),
two AS (SELECT d.*, coalesce(one.held, FALSE) AS was, one.text AS old FROM d LEFT JOIN one ON one.doc_id = d.doc_id WHERE second <> ''),
fresh AS (SELECT doc_id, row_number() OVER (PARTITION BY second ORDER BY doc_id) = 1 AS first FROM two WHERE second NOT IN (SELECT content FROM held))
SELECT 'u-' || two.doc_id AS unique_id, CASE WHEN NOT was THEN 'new' WHEN second = text THEN 'retitled' WHEN coalesce(first, FALSE) THEN 'changed' ELSE 'new' END AS action,
       CASE WHEN was AND NOT coalesce(first, FALSE) AND second <> text THEN text ELSE two.second END AS content,
       CASE WHEN was AND NOT coalesce(first, FALSE) AND second <> text THEN 'Document ' ELSE 'Second ' END || two.doc_id AS title,
       1 + CAST(ceil(greatest(0, length(CASE WHEN was AND NOT coalesce(first, FALSE) AND second <> text THEN text ELSE two.second END) - 800) / 700.0) AS BIGINT) AS n_chunks
FROM two LEFT JOIN fresh ON fresh.doc_id = two.doc_id WHERE was OR coalesce(first, FALSE)
""")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and then all again under new titles, a fifth of them with new content; compacted in the end."""
    path = f"{checkpoint_dir(spark)}/ingest/{uuid.uuid4().hex}"

    def arriving(docs: DataFrame, name: str, content: Column) -> DataFrame:
        return docs.select(
            F.col("doc_id").alias("arrival"), F.lit(1).cast("bigint").alias("space_id"), F.lit("FILE").alias("doc_type"),
            F.concat(F.lit("u-"), F.col("doc_id").cast("string")).alias("unique_id"), F.concat(F.lit(name + " "), F.col("doc_id").cast("string")).alias("title"),
            content.alias("content"),
        )

    revised = F.when(F.col("doc_id") % 5 == 1, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text"))
    again = arriving(spark.read.parquet(f"{sf_dir}/documents.parquet"), "Second", revised)
    again.limit(0).write.parquet(f"{path}/again")  # the source needs a folder
    first = arriving(streams.read_table_stream(spark, sf_dir, "documents"), "Document", F.col("text"))
    stream = first.unionByName(spark.readStream.schema(again.schema).parquet(f"{path}/again"))
    for second in (False, True):
        if second:
            again.write.mode("append").option("compression", "zstd").parquet(f"{path}/again")
        streams.stream_ingest(stream, f"{path}/corpus", buckets=8).awaitTermination()
    corpus = streams.Corpus(spark, f"{path}/corpus", 8)
    corpus.compact()
    chunks = corpus.chunks().groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return corpus.documents().join(chunks, "doc_id").select(F.concat(F.lit("u-"), F.col("doc_id").cast("string")).alias("unique_id"), "action", "content", "title", "n_chunks")


@path_query("W2", """
WITH n AS (SELECT user_id AS job_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM {events})
SELECT job_id, ts AS last_beat, 'failed' AS status FROM n WHERE nxt - ts > INTERVAL 6 HOUR OR nxt IS NULL
""")
def silent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _closed_events(spark, sf_dir)
    beats = events.select(F.col("user_id").alias("job_id"), "ts")
    return _plain(streams.run_to_table(streams.heartbeat_timeout(beats, 6 * 3600), closing=end), "last_beat")


@path_query("W3", """
WITH c AS (SELECT user_id AS thread_id, event_id AS call_id, event_type AS signature, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
    row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS j FROM {events}),
r AS (SELECT *, row_number() OVER (PARTITION BY thread_id, signature, i - j ORDER BY i) AS run_length FROM c)
SELECT thread_id, call_id, signature, run_length FROM r WHERE run_length >= 3
""")
def repeated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _closed_events(spark, sf_dir)
    calls = events.select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("signature"))
    return streams.run_to_table(streams.repeat_runs(calls, 3), closing=end)


@path_query("W4", "SELECT DISTINCT event_id // 5 AS message_id, event_type AS name, user_id % 2 AS key FROM {events}")
def deduplicated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _events(spark, sf_dir).select(F.floor(F.col("event_id") / 5).alias("message_id"), F.col("event_type").alias("name"), (F.col("user_id") % 2).alias("key"), "ts")
    return streams.run_to_table(streams.dedup_calls(calls, ["message_id", "name", "key"])).select("message_id", "name", "key")


@path_query("W5", """
SELECT coalesce(m, -1) AS message_id, CASE WHEN m IS NULL THEN event_id ELSE -1 END AS loose_id FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id // 2 END AS m FROM {events})
WHERE m IS NULL UNION ALL SELECT DISTINCT event_id // 2, -1 FROM {events} WHERE event_id % 7 <> 0
""")
def messages_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 2))
    path = f"{checkpoint_dir(spark)}/once/{uuid.uuid4().hex}"
    streams.append_once(_events(spark, sf_dir).select("event_id", message.alias("message_id"), "ts"), path).awaitTermination()
    rows = streams.once_rows(spark, path)
    loose = F.when(F.col("message_id").isNull(), F.col("event_id")).otherwise(-1)
    return rows.select(F.coalesce("message_id", F.lit(-1)).alias("message_id"), loose.alias("loose_id"))


@path_query("W6", """
WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM {events}),
r AS (SELECT user_id, event_id, i, ts AS since, 1 AS used FROM e WHERE i = 1
  UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.ts - r.since >= INTERVAL 24 HOUR THEN e.ts ELSE r.since END, CASE WHEN e.ts - r.since >= INTERVAL 24 HOUR THEN 1 ELSE r.used + 1 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1)
SELECT user_id, event_id AS request_id, CAST(used AS BIGINT) AS used, used <= 3 AS allowed FROM r
""")
def request_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _closed_events(spark, sf_dir)
    requests = events.select("user_id", F.col("event_id").alias("request_id"), "ts")
    return streams.run_to_table(streams.rolling_quota(requests, 3), closing=end)


@path_query("W7", """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM {events} GROUP BY 1, 2, 3
""")
def hourly_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _closed_events(spark, sf_dir)
    return _plain(streams.run_to_table(streams.live_counts(events, ["event_type"], "1 hour"), closing=end), "window_start", "window_end")


@path_query("W7", """
WITH s AS (SELECT event_type, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS window_start FROM {events})
SELECT window_start, window_start + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n FROM s GROUP BY 1, 2, 3
""")
def sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _closed_events(spark, sf_dir)
    return _plain(streams.run_to_table(streams.live_counts(events, ["event_type"], "2 hours", "1 hour"), closing=end), "window_start", "window_end")


@path_query("W8", """
WITH g AS (SELECT user_id AS doc_id, ts, props, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM {events}),
v AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM g)
SELECT doc_id, min(ts) AS started_at, max(ts) AS edited_at, max_by(props, ts) AS content, count(*) AS n_edits FROM v GROUP BY doc_id, v
""")
def edit_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, end = _closed_events(spark, sf_dir)
    edits = events.select(F.col("user_id").alias("doc_id"), "ts", F.col("props").alias("content"))
    return _plain(streams.run_to_table(streams.edit_sessions(edits), closing=end), "started_at", "edited_at")


@path_query("W9", """
WITH d AS (SELECT conv_id AS message_id, role AS part_id, turn AS seq, coalesce(text, '') AS text, turn % 8 >= 6 AS is_end FROM {conversations}),
b AS (SELECT *, count(*) FILTER (is_end) OVER (PARTITION BY message_id, part_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS block FROM d)
SELECT message_id, part_id, block, string_agg(text, '' ORDER BY seq) AS text, count(*) AS n_pieces, bool_or(is_end) AS ended FROM b GROUP BY 1, 2, 3
""")
def assembled_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the pieces of a part for each role; the turns 6 and 7 of every eight end theirs."""
    end = streams.Closing(spark)
    raw = streams.read_table_stream(spark, sf_dir, "conversations")
    # Conversations start hours apart; the hours wrap, so that no number of conversations reaches the closing marker's time.
    at = F.timestamp_seconds(F.lit(1_706_745_600) + F.pmod("conv_id", F.lit(100_000)) * 3600 + F.col("turn"))
    deltas = raw.select(
        F.col("conv_id").alias("message_id"), F.col("role").alias("part_id"), F.col("turn").cast("bigint").alias("seq"), F.col("text").alias("delta"),
        (F.col("turn") % 8 >= 6).alias("is_end"), at.alias("ts"),
    )
    return streams.run_to_table(streams.assemble_parts(end.joined(deltas)), closing=end)
